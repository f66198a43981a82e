"""Exact de-duplication on an index of cuckoo filters.

A text's digest is the first 60 bits of the SHA-256 of the text with every run of white space as one space.  Digests are dealt into shards.  A shard has
a cuckoo filter (four 16-bit fingerprints a bucket, two buckets a digest) and stored keys: the content of every live digest as its whole SHA-256
and length, the least doc_id that has it and the number of rows.

* Insertion: a digest that the filter denies is new.  A hit is verified against the content of the slots it hit; content that an earlier
  batch stored is looked up in the stored keys, by hits alone.  What differs is new too, whatever the filter said.
* Overflow: a filter that is full, or can't place a fingerprint after ``KICKS`` moves, is built again from the stored keys, twice the size.
* Deletion: a digest without rows leaves its filter and the stored keys; where the least doc_id went, the next one takes its place.

Tables are written and read again, one set for each version of the index; none is changed in place, so a lost executor
costs a task and no state.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm.lines import named
from kerbline.llm.words import U, mix
from kerbline.session import materialize

#: Live digests of a shard, on average at most; a shard's keys and filter are what one task holds.
SHARD = 250_000
SLOTS, KICKS, FULL = 4, 500, 0.9
#: Keys of copies are spread so wide before rows meet them.
SALTS = 16

ROW = "doc_id long, key long, sha binary, size long"
KEY = ("key", "sha", "size")
#: What a shard's task takes and gives: stored or partial keys, keys that hit what is stored, and the filter.
STORED, SUSPECT, FILTER = 0, 1, 2
ENTRY = "kind int, shard int, key long, sha binary, size long, least long, copies long, filter binary"


class Overflow(Exception):
    """A fingerprint found no place."""


#: Where the other bucket of a fingerprint lies, before the mask of a filter's size.
_STEP = mix(np.arange(1 << 16, dtype=np.uint64)).tolist()


def marks(digests: Iterable[int]) -> list[int]:
    """64 well mixed bits of every digest."""
    return mix(np.fromiter(digests, np.int64).view(np.uint64)).tolist()


class Cuckoo:
    """Fingerprints of 64-bit digests in two buckets each; ``ref`` tells whose content a slot stands for (-1: not in this task)."""

    def __init__(self, buckets: int = 256, slots: bytes | None = None):
        self.slots = array("H", slots if slots is not None else bytes(2 * SLOTS * buckets))
        self.buckets = len(self.slots) // SLOTS
        self.ref = array("q", [-1]) * len(self.slots)
        self.n = len(self.slots) - self.slots.count(0)

    def place(self, mark: int) -> tuple[int, int, int]:
        """Fingerprint (never 0) and the two buckets."""
        f, i = mark >> 48 or 1, mark & (self.buckets - 1)
        return f, i, i ^ (_STEP[f] & (self.buckets - 1))

    def hits(self, mark: int) -> list[int]:
        """The slots that hold the fingerprint."""
        f, i, j = self.place(mark)
        return [s for b in ((i,) if i == j else (i, j)) for s in range(SLOTS * b, SLOTS * b + SLOTS) if self.slots[s] == f]

    def add(self, mark: int, ref: int) -> None:
        if self.n >= FULL * len(self.slots):
            raise Overflow
        f, j, i = self.place(mark)
        for turn in range(KICKS):
            for b in (i,) if turn else (j, i):
                for s in range(SLOTS * b, SLOTS * b + SLOTS):
                    if not self.slots[s]:
                        self.slots[s], self.ref[s] = f, ref
                        self.n += 1
                        return
            # the bucket is full: one of its fingerprints makes room and goes to its other bucket
            s = SLOTS * i + (f + turn) % SLOTS
            f, self.slots[s] = self.slots[s], f
            ref, self.ref[s] = self.ref[s], ref
            i ^= _STEP[f] & (self.buckets - 1)
        raise Overflow

    def remove(self, mark: int) -> bool:
        """Takes out one fingerprint of a live digest; which of equal ones doesn't matter, as they share both buckets."""
        hit = self.hits(mark)
        if hit:
            self.slots[hit[0]], self.ref[hit[0]] = 0, -1
            self.n -= 1
        return bool(hit)


def filled(digests: list[int], buckets: int) -> Cuckoo:
    """A filter of stored keys, as large as they need; entry i stands for digest i."""
    while True:
        out = Cuckoo(buckets)
        try:
            for i, mark in enumerate(marks(digests)):
                out.add(mark, i)
            return out
        except Overflow:
            buckets *= 2


class Shard:
    """Insertion into one shard: new keys with their content, and partial keys that may be stored from before."""

    def __init__(self, old: bytes | None, fresh: bool):
        self.filter = Cuckoo(slots=old) if old else Cuckoo()
        self.before, self.fresh = self.filter.n, fresh
        self.keys: list[list] = []
        self.suspects: list[list] = []

    def insert(self, entry: list, mark: int) -> None:
        stored = False
        for slot in self.filter.hits(mark):
            at = self.filter.ref[slot]
            stored |= at < 0
            if at >= 0 and self.keys[at][:3] == entry[:3]:
                return merge(self.keys[at], entry)
        if stored and not self.fresh:
            self.suspects.append(entry)
            return None
        self.keys.append(entry)
        try:
            self.filter.add(mark, len(self.keys) - 1)
        except Overflow:
            # twice the size, from the stored keys; those of earlier batches aren't in this task, so then the shard asks for them
            if self.before:
                raise
            self.filter = filled([k[0] for k in self.keys], 2 * self.filter.buckets)
        return None


def merge(key: list, entry: list) -> None:
    if entry[3] is not None and (key[3] is None or entry[3] < key[3]):
        key[3] = entry[3]
    key[4] += entry[4]


def _table(kind: int, shard: int, rows: list[list]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.table({
        "kind": pa.array([kind] * len(rows), pa.int32()), "shard": pa.array([shard] * len(rows), pa.int32()),
        **{n: pa.array(c, t) for n, c, t in zip(("key", "sha", "size", "least", "copies"), columns, types, strict=True)},
        "filter": pa.nulls(len(rows), pa.binary()),
    })


def _filter_row(shard: int, slots: bytes | None) -> pa.Table:
    row = _table(FILTER, shard, [[0, None, None, None, None]])
    return row.set_column(7, "filter", pa.array([slots], pa.binary()))


def _entries(table: pa.Table) -> Iterator[list[list]]:
    for batch in table.filter(pa.array(table["kind"].to_numpy() != FILTER)).select(["key", "sha", "size", "least", "copies"]).to_batches(65536):
        yield [list(x) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]


def _old_filter(table: pa.Table) -> bytes | None:
    return next((x for x in table["filter"].to_pylist() if x), None)


def _insert(fresh: bool):
    """New keys of a shard and its filter; ``fresh``: all are known not to be stored.  A filter of null asks for a larger one."""

    def run(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        number = group[0].as_py()
        shard = Shard(_old_filter(table), fresh)
        try:
            for batch in _entries(table):
                for entry, mark in zip(batch, marks(e[0] for e in batch), strict=True):
                    shard.insert(entry, mark)
        except Overflow:
            return _filter_row(number, None)
        return pa.concat_tables([_table(STORED, number, shard.keys), _table(SUSPECT, number, shard.suspects), _filter_row(number, shard.filter.slots.tobytes())])

    return run


def _rebuilt(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The filter of all stored keys of a shard, twice as large as it was."""
    old = _old_filter(table)
    digests = [e[0] for batch in _entries(table) for e in batch]
    return _filter_row(group[0].as_py(), filled(digests, 2 * len(old) // (2 * SLOTS) if old else 256).slots.tobytes())


def _removed(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A shard's filter without digests that are live no more."""
    out = Cuckoo(slots=_old_filter(table))
    for batch in _entries(table):
        for mark in marks(e[0] for e in batch):
            out.remove(mark)
    return _filter_row(group[0].as_py(), out.slots.tobytes())


def _probed(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Keys that the shard's filter doesn't deny."""
    old = _old_filter(table)
    found: list[list] = []
    if old:
        known = Cuckoo(slots=old)
        for batch in _entries(table):
            found += [e for e, mark in zip(batch, marks(e[0] for e in batch), strict=True) if known.hits(mark)]
    return _table(SUSPECT, group[0].as_py(), found)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partial key for the equal texts of a batch, so copies don't travel one by one."""
    for batch in batches:
        out = pa.Table.from_batches([batch]).group_by(["key", "sha", "size"]).aggregate([("doc_id", "min"), ([], "count_all")])
        for part in out.select(["key", "sha", "size", "doc_id_min", "count_all"]).rename_columns(["key", "sha", "size", "least", "copies"]).to_batches():
            yield part


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; null as the empty text."""
    return F.coalesce(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), F.lit(""))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, key (the digest), sha and size of the normalised text, for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"))
    rows = rows.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hex"), F.octet_length("text").cast("long").alias("size"))
    return rows.select("doc_id", F.conv(F.substring("hex", 1, 15), 16, 10).cast("long").alias("key"), F.unhex("hex").alias("sha"), "size")


@dataclass(frozen=True)
class Index:
    """Live rows (doc_id, key, sha, size), stored keys (shard, key, sha, size, least, copies) and filters (shard, filter)."""

    shards: int
    rows: DataFrame
    keys: DataFrame
    filters: DataFrame

    def entries(self, rows: DataFrame) -> DataFrame:
        """Partial keys of rows, in their shards."""
        part = rows.mapInArrow(_combined, "key long, sha binary, size long, least long, copies long")
        return _as_entries(part.withColumn("shard", F.pmod("key", F.lit(self.shards)).cast("int")))


def _as_entries(keys: DataFrame, kind: int = STORED) -> DataFrame:
    return keys.select(F.lit(kind).alias("kind"), "shard", *KEY, "least", "copies", F.lit(None).cast("binary").alias("filter"))


def _filters(filters: DataFrame) -> DataFrame:
    null = F.lit(None)
    return filters.select(F.lit(FILTER).alias("kind"), "shard", null.cast("long").alias("key"), null.cast("binary").alias("sha"),
                          null.cast("long").alias("size"), null.cast("long").alias("least"), null.cast("long").alias("copies"), "filter")


def empty(spark: SparkSession, shards: int) -> Index:
    none = spark.createDataFrame([], ENTRY)
    return Index(shards, spark.createDataFrame([], ROW), none.select("shard", *KEY, "least", "copies"), none.select("shard", "filter"))


def _merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("shard", *KEY).agg(F.min("least").alias("least"), F.sum("copies").alias("copies"))


def _placed(index: Index, entries: DataFrame, keys: DataFrame, fresh: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New keys, suspects and the filters of all shards after ``entries``; ``keys`` are what the filters hold now."""
    filters = index.filters
    while True:
        out = materialize(entries.unionByName(_filters(filters)).groupBy("shard").applyInArrow(_insert(fresh), ENTRY), "cuckoo")
        small = out.where(f"kind = {FILTER} and filter is null").select("shard")
        if small.isEmpty():
            break
        # the stored keys of shards that overflow make filters twice as large; then all is tried again
        old = _as_entries(keys).unionByName(_filters(filters)).join(small, "shard", "left_semi")
        larger = old.groupBy("shard").applyInArrow(_rebuilt, ENTRY).select("shard", "filter")
        filters = materialize(larger.unionByName(filters.join(small, "shard", "left_anti")), "filters")
    of = lambda kind: out.where(f"kind = {kind}")
    return of(STORED).select(*keys.columns), of(SUSPECT), of(FILTER).select("shard", "filter")


def insert(index: Index, docs: DataFrame) -> Index:
    """The index with all rows of ``docs`` (doc_id, text; other columns are not read).

    A null text counts as empty.  Of equal texts the least doc_id is the one that stays; rows without doc_id come after all others.
    Rows inserted twice count twice.
    """
    return _inserted(index, materialize(digests(docs), "digests"))


def _inserted(index: Index, rows: DataFrame) -> Index:
    new, suspects, filters = _placed(index, index.entries(rows), index.keys, False)
    keys = index.keys
    if not suspects.isEmpty():
        # hits are verified against stored content: what is there is updated, the rest is new after all
        suspects = materialize(_merged(suspects), "suspects")
        held = suspects.join(keys.select(*KEY), list(KEY), "left_semi")
        held = held.select(*KEY, F.col("least").alias("less"), F.col("copies").alias("more"))
        keys = keys.join(held, list(KEY), "left").select("shard", *KEY, F.least("least", "less").alias("least"), (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies"))
        other = suspects.join(held.select(*KEY), list(KEY), "left_anti")
        if not other.isEmpty():
            step = Index(index.shards, index.rows, index.keys, filters)
            others, _, filters = _placed(step, _as_entries(other), index.keys.unionByName(new), True)
            new = new.unionByName(others)
    keys = materialize(keys.unionByName(new), "keys")
    return Index(index.shards, index.rows.unionByName(rows), keys, filters)


def delete(index: Index, ids: DataFrame) -> Index:
    """The index without the rows whose doc_id is in the first column of ``ids`` (null: those without doc_id)."""
    gone = ids.select(F.col(ids.columns[0]).cast("long").alias("gone")).distinct()
    on = F.col("doc_id").eqNullSafe(F.col("gone"))
    rows = materialize(index.rows.join(gone, on, "left_anti"), "live")
    touched = index.rows.join(gone, on, "left_semi").select(*KEY).distinct()
    left = rows.join(touched, list(KEY), "left_semi").groupBy(*KEY).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    state = touched.join(left, list(KEY), "left").select(*KEY, "first", F.coalesce("n", F.lit(0)).alias("n"))
    keys = index.keys.join(state, list(KEY), "left")
    keys = materialize(keys.select("shard", *KEY, F.when(F.col("n").isNull(), F.col("least")).otherwise(F.col("first")).alias("least"), F.coalesce("n", "copies").alias("copies")), "keys")
    dead = _as_entries(keys.where("copies = 0"))
    filters = dead.unionByName(_filters(index.filters)).groupBy("shard").applyInArrow(_removed, ENTRY)
    return Index(index.shards, rows, keys.where("copies > 0"), materialize(filters.select("shard", "filter"), "filters"))


def lookup(index: Index, docs: DataFrame) -> DataFrame:
    """doc_id, keep_id of every row of ``docs`` whose text is in the index; only what its filters don't deny meets the stored keys."""
    rows = materialize(digests(docs), "digests")
    hits = index.entries(rows).unionByName(_filters(index.filters)).groupBy("shard").applyInArrow(_probed, ENTRY).select(*KEY).distinct()
    known = hits.join(index.keys, list(KEY)).select(*KEY, F.col("least").alias("keep_id"))
    return rows.join(known, list(KEY)).select("doc_id", "keep_id")


def report(index: Index) -> DataFrame:
    """Per live row: doc_id, keep_id, group_size, kept, text_sha256.

    kept marks one row of every group of equal texts: of rows that also have the least doc_id, one.  keep_id is null only where no
    row of the group has a doc_id.
    """
    # only keys of several rows meet the rows, each in SALTS tasks, so the largest group spreads
    several = index.keys.where("copies > 1").select(*KEY, F.col("least").alias("keep_id"), "copies", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = index.rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(several, [*KEY, "salt"], "left")
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    single = rows.where("copies is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    # rows of one text and doc_id are counted and listed again: the first of them can stay
    equal = rows.where("copies is not null").groupBy("doc_id", "keep_id", "copies", "sha").agg(F.count(F.lit(1)).alias("n"))
    equal = equal.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)
    return single.unionByName(equal.select("doc_id", "keep_id", F.col("copies").alias("group_size"), kept.alias("kept"), sha))


def build(docs: DataFrame) -> Index:
    """An index of all rows of ``docs``, with a shard for each ``SHARD`` rows, and for each shuffle partition at least."""
    spark = docs.sparkSession
    rows = materialize(digests(docs), "digests")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SHARD))
    return _inserted(empty(spark, shards), rows)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """:func:`report` of all rows of ``docs``; an empty table gives an empty result."""
    return report(build(docs))


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every group of equal texts, the one of least doc_id; all columns as they are.

    Of rows with the same text and that doc_id, one stays.  Other columns may have any names that don't begin with two underscores.
    """
    index = build(docs)
    several = index.keys.where("copies > 1").select(F.col("sha").alias("__sha"), F.col("least").alias("__least"), F.lit(True).alias("__many"))
    marked = docs.withColumn("__sha", F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256))).join(several, "__sha", "left")
    single = marked.where("__many is null").select(*map(named, docs.columns))
    first = marked.where(F.col("__many") & F.col("doc_id").cast("long").eqNullSafe(F.col("__least"))).dropDuplicates(["__sha"])
    return single.unionAll(first.select(*map(named, docs.columns)))
