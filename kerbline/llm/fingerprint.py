"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits.

The hashes of all word shingles of a text fall into ``BINS`` bins once; each bin keeps its least.  An empty bin
takes over the value of the first filled bin in its own random order of all others, the same for
every text.  Of every bin the lowest ``BITS`` bits are kept and packed.  Two fingerprints agree by chance in 2^-BITS of
their bins; the likeness takes that out.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.words import U, Words, as_bytes, chunks

BINS, BITS, SHINGLE = 512, 4, 5
_GEN = np.random.Generator(np.random.PCG64(77))
_PROBES = np.argsort(_GEN.random((BINS, BINS)), axis=1).astype(np.int16)
_FIRST = 16
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def bins_of(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Low bits of the densified bins of every row (rows x BINS), and which rows have shingles."""
    hashes, first = Words(data, offsets).shingles(k)
    n = len(first) - 1
    empty = np.iinfo(np.uint64).max
    least = np.full(n * BINS, empty, np.uint64)
    row = np.repeat(np.arange(n), np.diff(first))
    np.minimum.at(least, row * BINS + (hashes >> U(55)).astype(np.int64), hashes & U((1 << 55) - 1))
    least = least.reshape(n, BINS)
    some = np.diff(first) > 0
    filled = least != empty
    rows, at = np.nonzero(~filled & some[:, None])
    source = np.empty(len(rows), np.int64)
    for lo, hi in ((0, _FIRST), (_FIRST, BINS)):
        for piece in range(0, len(rows), 1 << 15):
            part = slice(piece, piece + (1 << 15))
            todo = np.arange(len(rows))[part]
            if lo:
                todo = todo[source[part] < 0]
            if not len(todo):
                continue
            probe = _PROBES[at[todo], lo:hi]
            hit = filled[rows[todo][:, None], probe]
            which = hit.argmax(1)
            source[todo] = np.where(hit.any(1), probe[np.arange(len(todo)), which], -1)
    least[rows, at] = least[rows, source]
    return (least & U((1 << BITS) - 1)).astype(np.uint8), some


def pack(low: np.ndarray, some: np.ndarray) -> list[str]:
    """Two bins a byte, in base64; a text without words has the empty fingerprint."""
    packed = (low[:, 0::2] << 4) | low[:, 1::2]
    return [base64.b64encode(p.tobytes()).decode() if s else "" for p, s in zip(packed, some, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity; two texts without words are alike (1), one without words is like no other (0)."""
    chance = 2.0**-BITS
    near = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    return np.where(some_a & some_b, near, (some_a == some_b).astype(float))


def unpack(fingerprint: str) -> np.ndarray:
    packed = np.frombuffer(base64.b64decode(fingerprint), np.uint8)
    return np.stack([packed >> 4, packed & 15], 1).ravel()


def _all_bins(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = as_bytes(pa.array(texts, pa.large_binary()))
    parts = [bins_of(data, offsets[lo : hi + 1]) for lo, hi in chunks(offsets)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next text's first (or all it has)."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _pieces(batches) -> Iterator[list[tuple]]:
    """Rows (part, tail, id, text) in order, a bounded number of bytes at a time."""
    for batch in batches:
        sizes = np.cumsum([0, *(len(x or b"") for x in batch.column(3).to_pylist())])
        for lo, hi in chunks(sizes):
            yield list(zip(*(c.to_pylist() for c in batch.slice(lo, hi - lo).columns), strict=True))


def _walk(batches):
    """Every row with the row after it.  A part ends with a copy of the row that follows it (tail)."""
    held: list[tuple] = []
    for rows in _pieces(batches):
        rows, held = held + rows, []
        pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if not x[1] and x[0] == y[0]]
        if not rows[-1][1]:
            held = rows[-1:]
        if not pairs:
            continue
        texts = [(x[3] or b"") for x in rows]
        low, some = _all_bins(texts)
        place = {id(x): i for i, x in enumerate(rows)}
        at = np.array([place[id(x)] for x, _ in pairs])
        then = np.array([place[id(y)] for _, y in pairs])
        words = [t.decode("utf-8", "replace") for t in texts]
        new = [edited(words[i], words[j]).encode() for i, j in zip(at, then, strict=True)]
        low_new, some_new = _all_bins(new)
        prints = pack(low[at], some[at])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[2] for x, _ in pairs], pa.int64()),
                pa.array([len(words[i]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in new], pa.string()),
                pa.array(prints, pa.string()),
                pa.array(pack(low_new, some_new), pa.string()),
                pa.array(likeness(low[at], low_new, some[at], some_new)),
                pa.array(likeness(low[at], low[then], some[at], some[then])),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def part_of(column, bounds: list[int]):
    """Number of ``bounds`` (ascending) not above the column, in two short looks."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    count = lambda values: F.size(F.filter(values, lambda b: b <= column))
    array = lambda values: F.array(*[F.lit(int(v)) for v in values])
    group = count(array([g[0] for g in groups]))
    fine = F.element_at(F.array(*[array(g) for g in groups]), F.greatest(group, F.lit(1)))
    return F.when(group == 0, 0).otherwise((group - 1) * step + count(fine)).cast("int")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Shingles are five words, whole texts only; a text of fewer words is one shingle; null and empty texts have the fingerprint "".
    The next document is that of the next doc_id, after the last the first; rows of one doc_id follow each other by
    hash of their text; a null doc_id comes before all others.  A single row is its own next.  An empty table gives
    an empty result.  Columns other than doc_id and text are not read.

    The table is dealt by ranges of doc_id.  Each range gets a copy of the row that follows it, so every
    document meets its next one while a task walks its sorted range; texts are shuffled once.
    """
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    keys = docs.select(order.alias("key"))
    cuts = keys.agg(F.percentile_approx("key", [i / n_parts for i in range(1, n_parts)] or [0.5], max(10000, 20 * n_parts)).alias("cuts"))
    bounds = sorted(set(cuts.first()["cuts"] or []))
    n_parts = len(bounds) + 1
    part = part_of(F.col("key"), bounds)
    # the first key of every range: no more rows than ranges
    heads = sorted((r["part"], r["head"]) for r in keys.groupBy(part.alias("part")).agg(F.min("key").alias("head")).collect())
    follows = [(heads[(i + 1) % len(heads)][1], p) for i, (p, _) in enumerate(heads)]
    to: dict[int, list[int]] = {}
    for head, p in follows:
        to.setdefault(head, []).append(p)
    sent = spark.createDataFrame(list(to.items()), "head long, parts array<int>")
    rows = docs.select(order.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.join(F.broadcast(sent), F.col("key") == F.col("head"), "left").withColumn("own", part)
    copies = F.concat(F.array(F.struct(F.col("own").alias("part"), F.lit(False).alias("tail"))), F.transform(F.coalesce("parts", F.array().cast("array<int>")), lambda p: F.struct(p.alias("part"), F.lit(True).alias("tail"))))
    rows = rows.select("key", "doc_id", "text", F.explode(copies).alias("to")).select("to.part", "to.tail", "key", "doc_id", "text")
    dealt = rows.repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", "tail", "key", F.xxhash64("text"))
    return dealt.select("part", "tail", "doc_id", "text").mapInArrow(_walk, SCHEMA)
