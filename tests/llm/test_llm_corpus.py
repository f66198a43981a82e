"""Exact copies, importance resampling and the divergence of sources against plain Python, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kerbline import session
from kerbline.llm import divergence, exact, lines, mixing, resample, tokens, toxicity
from kerbline.llm.catalog import tokenizer_path
from kerbline.llm.words import NOT_ALNUM, as_bytes, chunks, spans

SMALL = "/root/testdata/sf0.001"
TEXT = "doc_id long, text string, sha string, key long, `a b` struct<`x y`: int>"


def frame(spark, rows):
    """Documents with other columns whose names clash or need quotes."""
    return spark.createDataFrame([(d, t, "s", 1, (2,)) for d, t in rows], TEXT)


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


ODD = [(9001, None), (9002, ""), (9003, " \t\n"), (9004, " "), (9005, "a  b"), (9006, "a\nb"), (9007, "A b"), (9005, "a  b"), (9005, "a b"), (None, "a b"),
       (None, "only without id"), (None, "only  without id"), (9010, "long " * 60_000), (9000, "long\n" * 60_000), (9011, " "), (9012, "a b")]


# ---------------------------------------------------------------- exact copies


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def copies_by_hand(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(d)
    out = Counter()
    for body, ids in groups.items():
        least = min((d for d in ids if d is not None), default=None)
        for d, n in Counter(ids).items():
            for i in range(n):
                out[(d, least, len(ids), d == least and i == 0, hashlib.sha256(body.encode()).hexdigest())] += 1
    return out


def reported(index):
    return Counter(tuple(r) for r in exact.report(index).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_exact_copies_against_grouping(spark):
    rows = documents(spark) + ODD + [(20_000 + i, "the same  text" if i % 2 else "the same text") for i in range(700)]
    got = exact.exact_duplicates(frame(spark, rows))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == copies_by_hand(rows)
    assert exact.exact_duplicates(frame(spark, rows).where("false")).collect() == []


def test_index_grows_and_shrinks(spark):
    """Batches come and go; filters overflow and are built again; live texts always stand as a grouping says."""
    first = [(i, f"text {i % 900}") for i in range(1500)]
    second = [(5000 + i, f"text {i}") for i in range(600, 2600)] + ODD
    index = exact.insert(exact.insert(exact.empty(spark, 2), frame(spark, first)), frame(spark, second))
    assert reported(index) == copies_by_hand(first + second)
    sizes = [len(r.filter) for r in index.filters.collect()]
    assert len(sizes) == 2 and all(s > 2 * exact.SLOTS * 256 for s in sizes), "no filter was built again"
    # least ids, whole groups and rows without id go; an id that isn't there changes nothing
    gone = {*range(0, 700), *range(5700, 6900), 9005, 9000, 123456, None}
    index = exact.delete(index, spark.createDataFrame([(g,) for g in gone], "id long"))
    left = [r for r in first + second if r[0] not in gone]
    assert reported(index) == copies_by_hand(left)
    live = {norm(t) for _, t in left}
    assert sum(exact.Cuckoo(slots=r.filter).n for r in index.filters.collect()) == len(live) == index.keys.count()
    again = first[:50] + [(70_000, "never seen"), (70_001, None)]
    least = {}
    for d, t in left:
        least[norm(t)] = min(x for x in (d, least.get(norm(t))) if x is not None)
    want = Counter((d, least[norm(t)]) for d, t in again if norm(t) in live)
    assert Counter(tuple(r) for r in exact.lookup(index, frame(spark, again)).collect()) == want
    index = exact.insert(index, frame(spark, again))
    assert reported(index) == copies_by_hand(left + again)


def test_hits_are_verified(spark, monkeypatch):
    """With fingerprints of which half are alike, nothing but the stored content tells texts apart."""
    few = exact.Cuckoo.place
    monkeypatch.setattr(exact.Cuckoo, "place", lambda self, mark: few(self, mark & ((1 << 48) - 1) | (1 + (mark >> 48) % 2) << 48))
    rows = [[i, bytes([i % 256, i >> 8]), 5, i, 1] for i in range(40)]
    shard = exact.Shard(None, False)
    for entry, mark in zip(rows + rows, exact.marks(range(40)) * 2, strict=True):
        shard.insert(list(entry), mark)
    assert [(k[0], k[4]) for k in shard.keys] == [(i, 2) for i in range(40)]
    later = exact.Shard(shard.filter.slots.tobytes(), False)
    for entry, mark in zip(rows, exact.marks(range(40)), strict=True):
        later.insert(list(entry), mark)
    assert len(later.suspects) == 40 and not later.keys


def test_cuckoo_filter_against_a_set():
    gen = np.random.default_rng(1)
    digests = gen.integers(0, 2**60, 30_000).tolist()
    known = exact.filled(digests[:20_000], 1)
    assert known.n == 20_000 and all(known.hits(m) for m in exact.marks(digests[:20_000]))
    assert sum(bool(known.hits(m)) for m in exact.marks(digests[20_000:])) < 20
    for mark in exact.marks(digests[:15_000]):
        assert known.remove(mark)
    assert known.n == 5000 and all(known.hits(m) for m in exact.marks(digests[15_000:20_000]))
    with pytest.raises(exact.Overflow):
        small = exact.Cuckoo(64)
        for i, mark in enumerate(exact.marks(digests)):
            small.add(mark, i)


def test_without_copies_keeps_rows_whole(spark):
    rows = documents(spark) + ODD
    df = frame(spark, rows)
    got = exact.without_copies(df)
    assert got.columns == df.columns and got.schema["a b"].dataType == df.schema["a b"].dataType
    kept = Counter((r.doc_id, norm(r.text)) for r in got.collect())
    want = Counter((d, h) for (d, _, _, k, h), n in copies_by_hand(rows).items() if k or d is None for _ in range(n))
    # a text that only rows without doc_id have keeps one of them
    alone = {h for (d, least, _, _, h) in copies_by_hand(rows) if least is None}
    want = Counter({(d, h): 1 for d, h in want if d is not None or h in alone})
    assert Counter((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in kept.elements()) == want


# ---------------------------------------------------------------- resampling


def features_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def resampled_by_hand(rows, target, percent, least, k=10_000, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % k
    s, t = Counter(), Counter()
    for texts, c in ((rows, s), (target, t)):
        for _, text in texts:
            c.update(map(bucket, features_by_hand(text)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (s_all + k)) / ((s[b] + 1) * (t_all + k)))) for b in range(k)]
    out = []
    for d, text in rows:
        words, feats = features_by_hand(text)
        weight = sum(gain[bucket(f)] for f in feats) // len(feats) if feats else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("percent,samples", [(25, None), (100, 7), (60, 1)])
def test_resampling_against_sorting(spark, monkeypatch, percent, samples):
    if samples:
        monkeypatch.setattr(resample, "SAMPLES", samples)
    rows = documents(spark) + ODD + [(30_000 + i % 7, "tied words " * 12) for i in range(60)] + [(None, "word " * 30), (None, "word " * 30)]
    target = [(0, "fox jumps over"), (1, None), (2, "Le renard, déjà vu " + "x" * 500 + " end")]
    got = resample.resample(frame(spark, rows), frame(spark, target), percent=percent)
    assert [d for _, d in got.dtypes] == ["bigint"] * 5
    assert Counter(tuple(r) for r in got.collect()) == resampled_by_hand(rows, target, percent, 20)


def test_resampling_of_nothing(spark):
    rows, none = frame(spark, ODD), frame(spark, ODD).where("false")
    assert resample.resample(none, rows).collect() == []
    assert Counter(tuple(r) for r in resample.resample(rows, none).collect()) == resampled_by_hand(ODD, [], 25, 20)
    assert resample.drawn(none, rows).collect() == []


def test_drawn_rows_are_whole(spark):
    rows = documents(spark) + [(None, "word " * 30)]
    df, target = frame(spark, rows), frame(spark, [(0, "fox jumps over")])
    for percent in (25, 100):
        got = resample.drawn(df, target, percent=percent)
        ids = {r[0] for r in resampled_by_hand(rows, [(0, "fox jumps over")], percent, 20) if r[4]}
        assert got.columns == df.columns and {r.doc_id for r in got.collect()} == ids


def test_crc_of_longer_runs():
    texts = ["abc " + "y" * 64 + " " + "z" * 65 + " é " + "q" * 9000 + " END", "", "one", "a-b_c", "tail"]
    data, offsets = as_bytes(pa.array(texts))
    data = resample._LOWER[data]
    for longest in (1, 2, 3):
        got = Counter()
        for bucket, row in resample.features(data, offsets, longest, 1 << 20):
            got.update(zip(row.tolist(), bucket.tolist(), strict=True))
        want = Counter()
        for i, text in enumerate(texts):
            words = features_by_hand(text)[0]
            for n in range(1, longest + 1):
                want.update((i, zlib.crc32(" ".join(words[j : j + n]).encode()) % (1 << 20)) for j in range(len(words) - n + 1))
        assert got == want


def test_words_that_meet_at_row_ends():
    data, offsets = as_bytes(pa.array(["ab", "cd", "", "e", " f", None, "g "]))
    start, length, first = spans(data, offsets, NOT_ALNUM)
    assert [data[s : s + n].tobytes().decode() for s, n in zip(start, length, strict=True)] == ["ab", "cd", "e", "f", "g"]
    assert first.tolist() == [0, 1, 2, 2, 3, 4, 4, 5]


# ---------------------------------------------------------------- divergence


def audited_by_hand(rows, least, top):
    terms = [(la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, la, so in rows]
    docs, out = Counter(), []
    for la, _, ts in terms:
        docs.update((la, t) for t in set(ts))
    for la in {x[0] for x in terms}:
        kept = {t for (l2, t), n in docs.items() if l2 == la and n >= least}
        counts = defaultdict(Counter)
        whole = Counter()
        for l2, so, ts in terms:
            if l2 == la:
                counts[so].update(t for t in ts if t in kept)
                whole.update(t for t in ts if t in kept)
        p = {}
        for name, c in [*counts.items(), (None, whole)]:
            total = sum(c.values())
            p[name] = {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        for so, c in counts.items():
            pairs = [(x, sum(abs(p[so][t] - p[x][t]) for t in kept)) for x in counts if x != so]
            above = [(t, p[so][t] - p[None][t]) for t in kept if c[t] and p[so][t] > p[None][t]]
            for part, items in (("pair", pairs), ("term", above)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(la, so, part, t, v, i + 1) for i, (t, v) in enumerate(items) if part == "pair" or i < top]
    return Counter(out)


@pytest.mark.parametrize("slab,block", [(4096, 32), (64, 3), (7, 1)])
def test_divergence_against_counting(spark, monkeypatch, slab, block):
    monkeypatch.setattr(divergence, "SLAB", slab)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 20_000)
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows += [("rare words", "xx", "a"), (None, "xx", "b"), ("", None, None), ("été-été9Ab_", None, "s"), ("x" * 20_000 + " été", "", "s"), ("1 2 3", "en", "only numbers")]
    rows += [("hot term " * (i % 5), "en" if i % 2 else "zz", "alone") for i in range(50)]
    df = spark.createDataFrame([(*r, 1, "v") for r in rows], "text string, lang string, source string, rank int, value string")
    got = divergence.audit(df, min_docs=3, top=9)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert Counter(tuple(r) for r in got.collect()) == audited_by_hand(rows, 3, 9)


def test_divergence_without_kept_terms(spark):
    df = spark.createDataFrame([("a", "en", "x"), ("b", "en", "y"), ("b", "de", "y")], "text string, lang string, source string")
    assert Counter(tuple(r) for r in divergence.audit(df).collect()) == Counter([("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)])
    assert divergence.audit(df.where("false")).collect() == []


def test_shares_of_large_counts(spark):
    df = spark.createDataFrame([(3 * 10**14, 4 * 10**14, 10**13), (0, 7, 1), (7, 7, 1), (0, 0, 3)], "n long, total long, v long")
    got = df.select("n", "total", "v", divergence.share("n", "total", "v").alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (r.n + 5) // (r.total + 5 * r.v) for r in got]


# ---------------------------------------------------------------- ids by piece


def test_ids_by_piece_are_the_tokenizers(monkeypatch):
    """Random strings of letters, marks, endings, white space of all kinds and special tokens; also where few pieces are kept."""
    gen = random.Random(4)
    signs = list("aZbé ÀÿßÖ×÷ªµ 's're'll'VE'd'm'T'' \n\t.,!?12½<|>") + [*tokens.BETWEEN.split("x"), "<|startoftext|>", "<|ENDOFTEXT|>", "don't", "İ", "́", "中", "“", " ", "\u0085", "ﬁ", "\x00", "\x1c", "😀"]
    texts = ["".join(gen.choices(signs, k=gen.randrange(60))) for _ in range(1500)] + ["", "x" * 30_000, "ab " * 20_000]
    data, offsets = as_bytes(pa.array(texts))
    for most in (1 << 20, 2500):
        monkeypatch.setattr(tokens.Encoder, "MOST", most)
        known = tokens.Encoder(tokenizer_path())
        assert known.by_piece
        monkeypatch.setitem(tokens._CACHE, tokenizer_path(), known)
        got = [ids.tolist() for lo, hi in chunks(offsets, 4000) for ids in tokens.token_ids(data, offsets[lo : hi + 1], tokenizer_path())]
        want = [known.tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]
        assert got == want
    known.by_piece = False
    assert [x.tolist() for x in tokens.token_ids(data, offsets[:50], tokenizer_path())] == want[:49]


def test_kept_pieces_are_bounded(monkeypatch):
    """Words that never come again don't add up in a worker, common ones stay; a long text goes through in windows; its ids are the tokenizer's."""
    known = tokens.Encoder(tokenizer_path())
    most = known.MOST
    assert most <= 1 << 18
    monkeypatch.setattr(tokens.Encoder, "MOST", 2000)
    monkeypatch.setattr(tokens.Encoder, "WINDOW", 1000)
    known._clear()
    gen = random.Random(5)
    rare = lambda n: " ".join("".join(gen.choices("abcdefgh\u00e9", k=9)) for _ in range(n))
    texts = ["often seen " + rare(100) for _ in range(100)] + ["", " ".join("often seen " + rare(50) for _ in range(100)), "y" * 5000, " " * 5000]
    data, offsets = as_bytes(pa.array(texts))
    seen = []
    cut = tokens.cut
    monkeypatch.setattr(tokens, "cut", lambda d, o: seen.append(int(o[-1] - o[0])) or cut(d, o))
    monkeypatch.setitem(tokens._CACHE, tokenizer_path(), known)
    got = [ids.tolist() for lo, hi in chunks(offsets, 4000) for ids in tokens.token_ids(data, offsets[lo : hi + 1], tokenizer_path())]
    assert got == [known.tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert len(known.place) <= 2000 and len(known.begin) == 2000
    assert {b"often", b"seen"} <= set(known.place)
    assert sorted(seen)[-2] < 1200 and max(seen) == 5000, "only a word without white space is longer than a window"


def test_packing_reads_small_batches(spark):
    """A batch's bytes are bounded where texts are encoded; the session's setting stays as it was."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    rows = spark.range(0, 3000, 1, 1).selectExpr("repeat('word ', 2000) as text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    with session.small_batches(spark):
        got = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 3e7 and max(got) < 6e6
    assert spark.conf.get(key, None) == before


def test_a_window_of_more_pieces_than_are_kept(monkeypatch):
    monkeypatch.setattr(tokens.Encoder, "MOST", 100)
    known = tokens.Encoder(tokenizer_path())
    monkeypatch.setitem(tokens._CACHE, tokenizer_path(), known)
    texts = [" ".join(chr(97 + i % 26) + chr(97 + i // 26 % 26) + "q" * (i % 7) for i in range(lo, lo + 700)) for lo in (0, 300, 2000, 0)]
    for text in texts:
        data, offsets = as_bytes(pa.array([text]))
        assert [x.tolist() for x in tokens.token_ids(data, offsets, tokenizer_path())] == [known.tokenizer.encode(text, add_special_tokens=False).ids + [0]]


def test_stages_keep_columns_of_any_name(spark):
    odd = spark.createDataFrame([(1, "some text " * 20, (2,), 3), (2, None, (2,), 3)], "doc_id long, text string, `a b` struct<`x y`: int>, `t``ick.dot` int").withColumn("source", F.lit("s"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for out in (lines.without_repeated_lines(odd), toxicity.without_toxic(odd, labels, 2.0), mixing.mixed(odd), exact.without_copies(odd)):
        assert out.columns == odd.columns and out.schema["a b"].dataType == odd.schema["a b"].dataType and out.count() >= 1
