"""Importance resampling of documents towards a target's word statistics.

1. Features are all runs of one to ``longest`` words, hashed by CRC-32 into buckets.  Counts per bucket over all documents and over the
   target make one gain per bucket: an array of fixed length, sent to every task.
2. A document's weight is the floored mean of the gains of its features; its score adds Gumbel noise drawn from its doc_id, so the highest
   scores are a sample without replacement in proportion to the importance.
3. Exact ranks by parallel sorting by regular sampling: scores are written as locally sorted runs; every so many rows of the runs are a
   sample, and regular places of the sorted samples split the order into segments.  Rows change to their segments, segments
   are sorted by themselves, and the counts of the segments before give the rank of a segment's first row.  Segments past the last row
   drawn are not moved at all.

CRC-32 is linear: that of a run of words comes from those of its parts by tables, so no run is ever built as text.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kerbline.llm.lines import by_place, named, placed_fields
from kerbline.llm.words import NOT_ALNUM, as_bytes, chunks, spans
from kerbline.session import materialize

BUCKETS, LONGEST = 10_000, 2
#: At most so many samples reach the driver, and so many segments the tasks, however many rows there are.
SAMPLES, SEGMENTS = 1 << 20, 4096
#: Rows of a segment, if that makes no more than ``SEGMENTS``.
SEGMENT = 100_000
#: Words up to this length go through the tables; longer ones are hashed one by one.
SHORT = 64
SCORED = "doc_id long, n_features long, n_words long, weight long, score long"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _byte_table() -> np.ndarray:
    """The CRC-32 of polynomial 0xEDB88320, byte by byte."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x


_STEP = _byte_table()


def _shift_tables() -> np.ndarray:
    """What a CRC becomes when so many bytes follow, for each of its own four bytes."""
    x = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [x]
    for _ in range(SHORT):
        x = _STEP[x & 255] ^ (x >> 8)
        out.append(x)
    return np.stack(out)


_SHIFT = _shift_tables()


def crc_words(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of every word."""
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-length, kind="stable")
    at, left = start[order], -length[order]
    for i in range(min(SHORT, int(-left[0]) if len(left) else 0)):
        n = np.searchsorted(left, -i)
        crc[:n] = _STEP[(crc[:n] ^ data[at[:n] + i]) & 255] ^ (crc[:n] >> 8)
    out = np.empty_like(crc)
    out[order] = ~crc
    for i in np.flatnonzero(length > SHORT).tolist():
        out[i] = zlib.crc32(data[start[i] : start[i] + length[i]].tobytes())
    return out


def crc_longer(crc: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray, word: np.ndarray) -> np.ndarray:
    """CRC-32 of texts of CRC ``crc``, a space and a word each, whose own CRC is ``word``."""
    state = ~crc
    state = ~(_STEP[(state ^ 0x20) & 255] ^ (state >> 8))
    short = np.minimum(length, SHORT)
    out = word.copy()
    for k in range(4):
        out ^= _SHIFT[short, k, (state >> (8 * k)) & 255]
    for i in np.flatnonzero(length > SHORT).tolist():
        out[i] = zlib.crc32(data[start[i] : start[i] + length[i]].tobytes(), int(state[i]))
    return out


def features(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of the features of the rows of one chunk, runs of one word first; then the words of every row."""
    start, length, first = spans(data, offsets, NOT_ALNUM)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    word = crc = crc_words(data, start, length)
    for run in range(longest):
        if run:
            same = row[run:] == row[:-run]
            # runs that would pass a row's end stop here; those that go on keep their place
            crc = crc_longer(crc[: len(word) - run], data, start[run:], length[run:], word[run:])
            yield (crc[same] % np.uint32(buckets)).astype(np.int64), row[run:][same]
        else:
            yield (crc % np.uint32(buckets)).astype(np.int64), row


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = as_bytes(column)
    return _LOWER[data], offsets


def _counted(longest: int, buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = _lowered(batch.column(0))
            for lo, hi in chunks(offsets):
                for bucket, _ in features(data, offsets[lo : hi + 1], longest, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows; one number per bucket reaches the driver."""
    parts = texts.select(F.col("text").cast("binary")).mapInArrow(_counted(longest, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed target share over the smoothed source share) of every bucket, in doubles."""
    k, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1.0) * (s_all + k)) / ((s + 1.0) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scores(ids: list, text: pa.Array, gain: np.ndarray, longest: int, seed: int) -> list[np.ndarray]:
    """n_features, n_words, weight and score of every row."""
    data, offsets = _lowered(text)
    n, words, total = (np.zeros(len(ids), np.int64) for _ in range(3))
    for lo, hi in chunks(offsets):
        for run, (bucket, row) in enumerate(features(data, offsets[lo : hi + 1], longest, len(gain))):
            # whole numbers below 2^53: the sums are exact in doubles
            total[lo:hi] += np.bincount(row, gain[bucket], hi - lo).astype(np.int64)
            count = np.bincount(row, minlength=hi - lo)
            n[lo:hi] += count
            if not run:
                words[lo:hi] = count
    weight = np.where(n > 0, total // np.maximum(n, 1), 0)
    return [n, words, weight, weight + np.fromiter((noise(d, seed) for d in ids), np.int64, len(ids))]


def _scored(gain, longest: int, seed: int):
    def run(batches):
        for batch in batches:
            columns = _scores(batch.column(0).to_pylist(), batch.column(1), gain.value, longest, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=["doc_id", "n_features", "n_words", "weight", "score"])

    return run


def _order(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The sort key of every row as numbers that ascend: highest score, least doc_id (null last), place in its run."""
    score, doc_id, tie = (batch.column(batch.schema.get_field_index(c)) for c in ("score", "doc_id", "tie"))
    null = doc_id.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
    return [-score.to_numpy(), null, doc_id.fill_null(0).to_numpy(), tie.to_numpy()]


def _regular(step: int):
    """Every ``step``-th row of the sorted runs of a task; where the first is differs from task to task."""

    def run(batches):
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if left is None:
                left = int(hashlib.sha256(str(batch.column(0)[0].as_py()).encode()).hexdigest()[:8], 16) % step
            at = np.arange(left, batch.num_rows, step)
            left += len(at) * step - batch.num_rows
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in _order(batch)], names=["score", "null", "doc_id", "tie"])

    return run


def segment_of(key: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """How many splitters are not after each key; both are columns, compared from the first to the last."""
    lo = np.zeros(len(key[0]), np.int64)
    hi = np.full(len(key[0]), len(splitters[0]))
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) // 2
        after = np.zeros(len(open_), bool)
        tied = ~after
        for k, s in zip(key, splitters, strict=True):
            after |= tied & (s[mid] > k[open_])
            tied &= s[mid] == k[open_]
        hi[open_[after]] = mid[after]
        lo[open_[~after]] = mid[~after] + 1
    return lo


def _segmented(splitters):
    def run(batches):
        for batch in batches:
            segment = segment_of(_order(batch), splitters.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment)], names=[*batch.schema.names, "segment"])

    return run


def ranked(scored: DataFrame, most: int, label: str = "scored") -> DataFrame:
    """``scored`` (doc_id, score, n_words and more long columns) with rank, 1 for the highest score, ties to the smaller doc_id (null
    last), for the first ``most`` rows and null for all others.  Equal rows get ranks of their own."""
    spark = scored.sparkSession
    n = scored.count()
    parts = max(1, min(SEGMENTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SEGMENT))))
    runs = scored.withColumn("tie", F.monotonically_increasing_id())
    runs = materialize(runs.sortWithinPartitions(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "tie"), label)
    step = max(1, -(-n // min(SAMPLES, 256 * parts)))
    found = runs.select("score", "doc_id", "tie").mapInArrow(_regular(step), "score long, null long, doc_id long, tie long").toArrow()
    sample = [found[c].to_numpy() for c in found.column_names]
    order = np.lexsort(sample[::-1])
    at = order[np.unique(len(order) * np.arange(1, parts) // parts)] if len(order) else order
    splitters = spark.sparkContext.broadcast([c[at] for c in sample])
    schema = StructType([*runs.schema.fields, StructField("segment", LongType())])
    placed = runs.mapInArrow(_segmented(splitters), schema)
    # SEGMENTS numbers at most: the rows in the segments before
    sizes = {r["segment"]: r["n"] for r in placed.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = np.concatenate([[0], np.cumsum([sizes.get(i, 0) for i in range(len(at) + 1)])]).tolist()
    last = next((i for i, b in enumerate(before) if b >= most), len(at) + 1)
    begins = spark.createDataFrame(list(enumerate(before)), "segment long, before long")
    inside = Window.partitionBy("segment").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "tie")
    drawn = placed.where(F.col("segment") < last).withColumn("place", F.row_number().over(inside))
    drawn = drawn.join(F.broadcast(begins), "segment").withColumn("rank", (F.col("place") + F.col("before")).cast("long")).drop("place", "before")
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = placed.where(F.col("segment") >= last).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).drop("tie", "segment")


def _model(docs: DataFrame, target: DataFrame, longest: int, buckets: int):
    return docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_features, weight, score, rank, all long.

    Words are runs of letters and digits (A-Z in lower case; all beyond ASCII counts as letters).  Of the N rows with ``min_words`` words or
    more, floor(percent * N / 100) are drawn and ranked by score; rank is null for all others.  Null and empty texts have no features
    and weight 0.  A null doc_id draws its noise as the word null and loses every tie.  Rows of one doc_id are scored and ranked one by one.
    Without target texts the target is uniform over the buckets.  Empty tables give an empty result; other columns are not read.
    """
    gain = _model(docs, target, longest, buckets)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    scored = materialize(plain.mapInArrow(_scored(gain, longest, seed), SCORED), "weights")
    able = scored.where(F.col("n_words") >= min_words)
    out = ranked(able, percent * able.count() // 100)
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return out.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` that :func:`resample` draws, all columns as they are.

    Rows that equal the last one drawn in doc_id and score are drawn with it.  Other columns may have any names but
    __id, __words and __score.
    """
    gain = _model(docs, target, longest, buckets)
    more = ("__id", "__words", "__score")
    schema = StructType([*placed_fields(docs), *[StructField(c, LongType()) for c in more]])

    def run(batches):
        for batch in batches:
            ids, text = (batch.column(batch.num_columns - 2 + i) for i in range(2))
            _, words, _, score = _scores(ids.to_pylist(), text, gain.value, longest, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], ids, pa.array(words), pa.array(score)], names=schema.names)

    marked = docs.select(*by_place(docs), F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("binary").alias("__text"))
    marked = marked.mapInArrow(run, schema).toDF(*docs.columns, *more)
    able = marked.select(F.col("__id").alias("doc_id"), F.col("__words").alias("n_words"), F.col("__score").alias("score")).where(F.col("n_words") >= min_words)
    able = materialize(able, "weights")
    most = percent * able.count() // 100
    last = ranked(able, most).where(F.col("rank") == most).first()
    if last is None:
        return docs.limit(0)
    before = F.col("__score") > last["score"]
    tied = (F.col("__score") == last["score"]) & (F.col("__id").isNotNull() & (F.col("__id") <= last["doc_id"]) if last["doc_id"] is not None else F.lit(True))
    return marked.where((F.col("__words") >= min_words) & (before | tied)).select(*map(named, docs.columns))
