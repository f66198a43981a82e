"""Fingerprints, lines, secrets, toxicity and packing against plain Python, with odd rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kerbline.llm import bloom, fingerprint, lines, packing, secrets, toxicity
from kerbline.llm.catalog import tokenizer_path
from kerbline.llm.words import Words, as_bytes, chunks, mix

SMALL = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, key int, score string"


def odd_docs(spark, extra=()):
    """Nulls, empty and long texts, repeats, ties, and columns whose names operators use themselves."""
    common = "A line that is long enough to be counted as one, surely"
    texts = [
        (1, None), (2, ""), (3, "one"), (4, "one two three four five six"), (4, "one two three four five six"), (5, "ünï cödé " * 40 + "\n" + common),
        (6, f"\t{common.upper()} \nshort\n{common}"), (7, common), (8, common), (9, common + "\n\n"), (None, common), (None, None),
        (10, " ".join(f"w{i}" for i in range(60_000))), (11, "\n" * 5), (12, "x" * 300_000), *extra,
    ]
    return spark.createDataFrame([(i, t, "en", "s", 0, "mine", 7, "own") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_word_hashes_follow_the_words():
    texts = ["", " a  b\tA\n", "Ä ä", None, "a b", "b", "  ", "x" * 5000 + " a", "a\x0bb\x1cc"]
    data, offsets = as_bytes(pa.array(texts))
    got = []
    for lo, hi in chunks(offsets, 64):
        w = Words(data, offsets[lo : hi + 1])
        got += [w.hash[w.first[i] : w.first[i + 1]].tolist() for i in range(hi - lo)]
    want = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    pairs = {(h, w) for g, x in zip(got, want) for h, w in zip(g, x)}
    assert len({h for h, _ in pairs}) == len({w for _, w in pairs}) == len(pairs)


# ---------------------------------------------------------------- fingerprints


def five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = five_words(a), five_words(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def check_fingerprints(rows, texts):
    """rows by doc_id; texts: (doc_id, text) in order."""
    errors = []
    for i, (doc_id, text) in enumerate(texts):
        row, following = rows[doc_id], texts[(i + 1) % len(texts)][1]
        k = len(text) // 4
        new = text[: len(text) - k] + following[:k]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        errors += [row.near_edited - jaccard(text, new), row.near_next - jaccard(text, following)]
    errors = np.abs(errors)
    assert errors.max() < 0.14 and errors.mean() < 0.02


def test_fingerprints_against_all_shingles(spark, docs):
    rows = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    texts = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    check_fingerprints(rows, texts)
    by_text = {}
    for doc_id, text in texts:
        assert by_text.setdefault(text, rows[doc_id].fingerprint) == rows[doc_id].fingerprint
    low = fingerprint.unpack(rows[texts[0][0]].fingerprint)
    assert low.shape == (fingerprint.BINS,) and low.max() < 16


def test_fingerprints_of_odd_rows(spark):
    df = odd_docs(spark).where("doc_id is not null and not (doc_id = 4)")
    rows = {r.doc_id: r for r in fingerprint.fingerprints(df).collect()}
    check_fingerprints(rows, sorted((r.doc_id, r.text or "") for r in df.collect()))
    assert rows[1].fingerprint == rows[2].fingerprint == "" and rows[1].near_next == 1.0 and rows[2].near_next == 0.0
    everything = fingerprint.fingerprints(odd_docs(spark)).collect()
    assert len(everything) == odd_docs(spark).count()
    nulls = [r for r in everything if r.doc_id is None]
    assert len(nulls) == 2 and {r.n_chars for r in nulls} == {0, 55}
    fours = [r for r in everything if r.doc_id == 4]
    assert sorted(r.near_next == 1.0 for r in fours) == [False, True]


def test_fingerprints_of_one_and_no_row(spark):
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    (row,) = fingerprint.fingerprints(one).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"a b c d e f a b").hexdigest()
    assert fingerprint.fingerprints(one.where("false")).collect() == []


def test_densified_bins_keep_the_likeness():
    words = [f"w{i}" for i in range(24)]
    texts = [" ".join(words[:20]), " ".join(words[:16] + ["x", "y", "z", "q"])]
    data, offsets = as_bytes(pa.array(texts))
    low, some = fingerprint.bins_of(data, offsets)
    near = fingerprint.likeness(low[:1], low[1:], some[:1], some[1:])[0]
    assert abs(near - jaccard(*texts)) < 0.25


# ---------------------------------------------------------------- lines


def lines_by_hand(rows, least=40, many=5):
    held = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            key = re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(WHITE))
            if len(key) >= least:
                held.setdefault(key, set()).add(doc_id)
    order = lambda d: -1 if d is None else d
    keeper = {k: max(v, key=order) for k, v in held.items() if len(v) >= many}
    out = []
    for doc_id, text in rows:
        split = (text or "").split("\n")
        keys = [re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(WHITE)) for x in split]
        kept = [x for x, k in zip(split, keys) if k not in keeper or keeper[k] == doc_id]
        out.append((doc_id, len(split), len(split) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_lines_of_odd_rows(spark):
    df = odd_docs(spark)
    got = Counter(tuple(r) for r in lines.line_report(df).collect())
    assert got == lines_by_hand([(r.doc_id, r.text) for r in df.collect()])
    assert sum(r[2] for r in got) > 3
    out = lines.without_repeated_lines(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert {r.n_lines for r in out.collect()} == {"mine"}
    assert lines.line_report(df.where("false")).collect() == []


def test_a_tiny_filter_changes_nothing(spark, docs, monkeypatch):
    want = Counter(tuple(r) for r in lines.line_report(docs).collect())
    monkeypatch.setattr(bloom, "PER_KEY", 0)
    assert Counter(tuple(r) for r in lines.line_report(docs).collect()) == want


def test_many_ranges_change_nothing(spark, docs, monkeypatch):
    want = Counter(tuple(r) for r in lines.line_report(docs).collect())
    monkeypatch.setattr(bloom, "RANGE", 64)
    monkeypatch.setattr(bloom, "HELD", 32)
    assert Counter(tuple(r) for r in lines.line_report(docs).collect()) == want


@pytest.mark.parametrize("span", [1 << 20, 1 << 12])
def test_repeated_keys_and_few_others(spark, monkeypatch, span):
    monkeypatch.setattr(bloom, "RANGE", span)
    monkeypatch.setattr(bloom, "HELD", 5000)
    once = spark.range(60_000).select(F.xxhash64("id").alias("k"))
    many = spark.range(3_000).select(F.xxhash64(F.col("id") + 10**6).alias("k"))
    one = spark.range(40_000).select(F.lit(7).cast("long").alias("k"))
    df = once.unionByName(many).unionByName(many).unionByName(one).repartition(6)
    known = bloom.repeated(df, bloom.longs, "test")
    keys = lambda rows: np.array([r.k for r in rows.collect()], np.int64).view(np.uint64)
    assert bloom.has(known, keys(many)).all() and bloom.has(known, np.array([7], np.uint64)).all()
    assert bloom.has(known, keys(once)).mean() < 0.05


def test_a_full_range_lets_few_through():
    """The share is that of one range, however many ranges a corpus has."""
    key = mix(np.arange(bloom.RANGE, dtype=np.uint64))
    rows = [x.tobytes() for x in np.array_split(key, 50)]
    out = bloom._seen_twice(bloom.bits_for(bloom.RANGE))(pa.table({"hashes": pa.array(rows, pa.binary())}))
    assert out["n"][0].as_py() < 0.02 * bloom.RANGE


def test_sizes_of_filters():
    assert [bloom.bits_for(n) for n in (0, 1 << 16, (1 << 16) + 1, 1 << 40)] == [1 << 20, 1 << 20, 1 << 21, bloom.MOST_BITS]


# ---------------------------------------------------------------- secrets


def github(body):
    return "ghp_" + body + secrets.checksum(body)


def spans_by_hand(text):
    out = []
    for m in re.finditer(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return out


def test_secrets_against_plain_expressions(spark, docs):
    body = "Ab3dEf6hIj9lMn2pQr5tUv8xYz1bCd"
    odd = [
        "PassWord=abc", "password=password=secret1", "token: tokentoken=abcdef1", 'é API_KEY"  :  "zzz.zz-z/+= ', "apikeyapi_key=123456",
        "AKIAAKIA" + "A1" * 9, "AKIA" + "Z" * 15, "akia" + "0" * 20, "ſecret=abcdefg toKen=abcdefg", "ab" * 12, "ab" * 11 + "g", "x" + "0" * 5000,
        github(body), github(body)[:-1] + "?", github(body).replace("A", "B"), "my_" + github(body) + " npm_" + body + secrets.checksum(body), None, "",
        "secret=" + github(body), "passwd\n=abcdefg", "token = 'x' token='abcdef",
    ]
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(10_000 + i, t) for i, t in enumerate(odd)] + [(None, odd[1]), (10_001, odd[1])]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("spans", F.lit(1))
    rows = secrets.scan(df).collect()
    assert len(rows) == len(texts)
    want = Counter()
    for doc_id, text in texts:
        spans = spans_by_hand(text or "")
        n = [sum(s[1] == k for s in spans) for k in range(3)]
        want[(doc_id, *n, hashlib.sha256(secrets.listed(spans).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows) == want
    by_id = {r.doc_id: r.spans for r in rows}
    assert by_id[10_012] == "github:0:40" and "github" not in by_id[10_013] + by_id[10_014]
    assert "github:3:43" in by_id[10_015] and "npm:44:84" in by_id[10_015]
    assert by_id[10_018] == "assign:0:47,github:7:47"
    assert secrets.scan(df.where("false")).collect() == []


# ---------------------------------------------------------------- toxicity


def test_machine_learns_a_pair():
    """Neither of two terms tells anything alone; both together do."""
    gen = np.random.default_rng(3)
    n = 4000
    a, b = gen.integers(0, 2, n), gen.integers(0, 2, n)
    label = (a == b).astype(float)
    pairs = sorted({(i, x) for i in range(n) for x in (10 + a[i], 20 + b[i])})
    row, bucket = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], np.int32)
    original, toxicity.choose = toxicity.choose, lambda *_: np.where(np.isin(np.arange(1 << toxicity.BUCKET_BITS), [10, 11, 20, 21]), np.arange(1 << toxicity.BUCKET_BITS) % 10 + 2 * (np.arange(1 << toxicity.BUCKET_BITS) >= 20), -1).astype(np.int32)
    try:
        model = toxicity.fit(bucket, row, label, epochs=40)
    finally:
        toxicity.choose = original
    column = model["column"][bucket]
    z = toxicity.raw_score(model, column, row, n)
    assert ((z > 0) == (label == 1)).mean() > 0.95


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.scores(docs, labels)
    rows = scored.join(labels, "doc_id").collect()
    assert scored.count() == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, r.toxic) for r in rows if r.held_out]
    good, bad = ([s for s, t in held if t == x] for x in (0, 1))
    auc = np.mean([(b > g) + 0.5 * (b == g) for b, g in itertools.product(bad, good)])
    assert auc > 0.95
    assert np.mean([g < 0.5 for g in good]) > 0.99


def test_toxicity_of_odd_rows(spark):
    df = odd_docs(spark)
    labels = spark.createDataFrame([(i, None, t) for i, t in [(3, 0), (4, 1), (5, 0), (6, 1), (7, None), (None, 1), (8, 0)]], "doc_id long, quality int, toxic int")
    rows = toxicity.scores(df, labels).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scores(df.where("false"), labels).collect() == []
    assert {r.score for r in toxicity.scores(df, labels.where("false")).collect()} == {0.5}
    assert toxicity.without_toxic(df, labels).columns == df.columns


# ---------------------------------------------------------------- packing


def check_packing(rows, texts, size):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), size)):
            part = ids[start : start + size]
            want[(doc_id, piece, start, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= size
    total = sum(r.length for r in rows)
    return len(sequences), -(-total // size)


def test_packing_of_documents(spark, docs):
    rows = packing.pack(docs, tokenizer_path(), 2048).collect()
    used, least = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert used <= least * 1.03 + 1


def test_packing_of_odd_rows(spark):
    extra = [(20, "don't STOP... it's 3.14, <|endoftext|> naïve, é, İstanbul. a b 中文。x,y. ,. ''s"), (21, "The the, the. The.")]
    df = odd_docs(spark, extra).withColumn("rank", F.lit("x")).withColumn("length", F.lit(1))
    rows = packing.pack(df, tokenizer_path(), 64).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], 64)
    assert packing.pack(df.where("false"), tokenizer_path(), 64).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece_once(seed):
    gen = np.random.default_rng(seed)
    lengths = [gen.integers(1, 2049, 5000), np.full(700, 2048), gen.integers(600, 700, 3000), gen.integers(1, 30, 4000)][seed]
    histogram = Counter(lengths.tolist())
    runs = packing.plan(dict(histogram), 2048)
    got = Counter()
    for run, n in runs:
        assert n > 0 and sum(run) <= 2048
        for x in run:
            got[x] += n
    assert got == histogram
    best = -(-sum(lengths.tolist()) // 2048)
    assert sum(n for _, n in runs) <= (1.01 * best + 1 if seed != 2 else 1000)


def test_non_negative_least_squares():
    gen = np.random.default_rng(0)
    a, x = gen.random((20, 12)), np.maximum(gen.normal(size=12), 0)
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    b = gen.normal(size=20)
    x = packing.nnls(a, b)
    gain = a.T @ (b - a @ x)
    assert (x >= 0).all() and gain.max() < 1e-6 and np.abs(gain[x > 0]).max() < 1e-6
