"""Line de-duplication with two Bloom filters.

The first pass puts the hash of every long line into a once-seen filter, or into a twice-seen one if it was there; both are dealt
over tasks by ranges of hashes, as many as a count of the lines asks for.
The second pass lets only lines that the twice-seen filter knows leave their task; the exact count of
documents per line and the choice of the document that keeps it run on those.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from kerbline.llm.bloom import has, repeated
from kerbline.session import materialize

WHITE = b" \t\n\x0b\x0c\r"
SALTS = 16


def line_key(line: bytes) -> bytes:
    """A line without white space at its ends, A-Z in lower case."""
    return line.strip(WHITE).lower()


def _long(key: bytes, least: int) -> bool:
    """Whether the UTF-8 text has ``least`` code points or more."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _keys(text: bytes | None, least: int) -> list[tuple[int, bytes]]:
    if not text or len(text) < least:
        return []
    return [(i, key) for i, line in enumerate(text.split(b"\n")) if len(line) >= least and _long(key := line_key(line), least)]


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)


def _hashed(least: int):
    def run(batch: pa.RecordBatch) -> np.ndarray:
        return _hashes(key for text in batch.column(0).to_pylist() for _, key in _keys(text, least))

    return run


def _suspects(least: int, known):
    def run(batches):
        for batch in batches:
            texts, ids, rows = (batch.column(i).to_pylist() for i in range(3))
            found = [(d, r, i, key) for text, d, r in zip(texts, ids, rows, strict=True) for i, key in _keys(text, least)]
            hit = np.flatnonzero(has(known.value, _hashes(x[3] for x in found)))
            columns = zip(*(found[i] for i in hit), strict=True) if len(hit) else ((), (), (), ())
            types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "row", "line", "key"])

    return run


def _rewritten(batches):
    """(text, gone) to what is left, the number of lines before and of those that went."""
    for batch in batches:
        out = []
        for text, gone in zip(batch.column("__text").to_pylist(), batch.column("__gone").to_pylist(), strict=True):
            lines = (text or b"").split(b"\n")
            if gone:
                gone = set(gone)
                left = b"\n".join(x for i, x in enumerate(lines) if i not in gone)
            else:
                left = text or b""
            out.append((left, len(lines), len(gone or ()), hashlib.sha256(left).hexdigest()))
        left, n, dropped, sha = zip(*out, strict=True) if out else ((), (), (), ())
        columns = [batch.column(i) for i in range(batch.num_columns - 2)]
        columns += [pa.array(left, pa.binary()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-2], "__left", "__lines", "__dropped", "__sha"])


def named(column: str) -> Column:
    """The column of that very name, whatever signs are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def by_place(df: DataFrame) -> list[Column]:
    """All columns, named by their places: ``mapInArrow`` takes no names with dots or back-ticks."""
    return [named(c).alias(f"c{i}") for i, c in enumerate(df.columns)]


def placed_fields(df: DataFrame) -> list[StructField]:
    return [StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)]


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with four more columns: __left (the text that stays), __lines, __dropped, __sha (sha256 of __left).

    Texts are split at newlines; null and empty texts are one empty line.  A line's key is the line
    without white space at its ends, A-Z in lower case.  A key of ``min_chars`` code points or more that is in ``min_docs``
    documents or more goes from all of them but the one of largest doc_id; there all its lines stay.  Rows of one doc_id count as one
    document; a null doc_id is one document, less than all others.  Empty tables stay empty.
    Other columns may have any names that don't begin with two underscores.
    """
    spark = docs.sparkSession
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    body = F.col("text").cast("binary")
    plain = docs.select(body.alias("text"), ident.alias("id"), F.xxhash64("text").alias("row"))
    known = spark.sparkContext.broadcast(repeated(plain.select("text"), _hashed(min_chars), "line-hashes"))
    suspects = plain.mapInArrow(_suspects(min_chars, known), "id long, row long, line int, key binary")
    suspects = materialize(suspects, "lines")
    # one row per key and document first: a line that is everywhere spreads over all tasks
    held = suspects.select("key", "id").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
    # the lines of one key meet its keeper in SALTS tasks, so a line that is everywhere doesn't land in one
    held = held.where(f"n >= {int(min_docs)}").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = suspects.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    gone = salted.join(held, ["key", "salt"]).where("id <> keeper")
    gone = gone.groupBy(F.col("id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_set("line").alias("__gone"))
    all_docs = docs.withColumns({"__id": ident, "__row": F.xxhash64("text"), "__text": body})
    joined = all_docs.join(gone, ["__id", "__row"], "left").select(*by_place(docs), "__text", "__gone")
    more = [StructField("__left", BinaryType()), StructField("__lines", LongType()), StructField("__dropped", LongType()), StructField("__sha", StringType())]
    out = joined.mapInArrow(_rewritten, StructType([*placed_fields(docs), *more])).toDF(*docs.columns, *[f.name for f in more])
    return out.withColumn("__left", F.col("__left").cast("string"))


def without_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with the text that :func:`drop_lines` leaves; all columns, a null text as the empty text."""
    out = drop_lines(docs, min_chars, min_docs)
    return out.select(*[F.col("__left").alias("text") if c == "text" else named(c) for c in docs.columns])


def line_report(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines (before), n_dropped, kept_sha256."""
    out = drop_lines(docs.select("doc_id", "text"), min_chars, min_docs)
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.col("__sha").alias("kept_sha256"))
