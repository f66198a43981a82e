"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

1. One pass over the texts: distinct word shingles, their SuperMinHash signature, and a 128-bit digest of the set.
   Documents of equal sets are linked at once; one of them stands for all from here on.
2. Banding: every ``rows`` values of a signature make a bucket.  Only buckets of two or more go on.
3. First links: in a bucket every member is compared with one centre, the member that shares most
   buckets with others.  Verified links are joined by union-find.
4. Second links: buckets that still hold several components are finished.  Small ones list their pairs across
   components.  In large ones, pieces of bounded size meet in tasks that compare arrays and give out only
   pairs that can still reach the threshold: by set sizes, by the shingles that nobody else in any open large bucket
   has, by the signatures' estimate (six standard deviations of slack), and by bitmaps of the sets, which bound
   what two sets can share.
5. Every pair given out is verified on the full shingle sets.

A pair at the threshold shares no bucket with probability (1 - t^rows)^bands: 4e-8 for 0.8, 3e-11 for 0.85.
No bucket is capped; nobody's pairs are listed in full inside a group of near copies.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm.bloom import bitmap_of, bits_for, has, longs, repeated
from kerbline.llm.components import connected
from kerbline.llm.words import U, Words, as_bytes, chunks, mix
from kerbline.session import materialize

BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
#: Buckets up to this size list their open pairs; larger ones are compared in pieces of so many members.
SMALL, PIECE = 16, 2048
#: Bits of a set's bitmap.
SET_BITS = 2048
SIGNED = "id long, n long, lo long, hi long, buckets array<long>"


def super_minhash(element: np.ndarray, row: np.ndarray, rows: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (rows x slots): round j in the high half of a value, the element's random fraction in the low.

    Every element walks through its own random permutation of the slots, one slot a round; a slot keeps the least
    value.  A value of a later round is never less, so a row stops at the round in which its last
    slot fills, and only the elements of unfinished rows go on.
    """
    empty = np.iinfo(np.uint64).max
    out = np.full(rows * slots, empty, np.uint64)

    def draw(seed: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        x = mix(seed + U((2 * j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        step = ((x >> U(32)) * U(slots - j)) >> U(32)
        return j + step.astype(np.int64), (x & U(0xFFFFFFFF)) | U(j << 32)

    at, value = draw(element, 0)
    np.minimum.at(out, row * slots + at, value)
    left = (out.reshape(rows, slots) == empty).any(1)
    left[np.bincount(row, minlength=rows) == 0] = False
    go = left[row]
    element, row, at = element[go], row[go], at[go]
    order = np.tile(np.arange(slots, dtype=np.uint8), (len(element), 1))
    each = np.arange(len(element))
    order[each, at], order[:, 0] = 0, at
    for j in range(1, slots):
        if not len(element):
            break
        at, value = draw(element, j)
        slot = order[each, at]
        order[each, at] = order[:, j]
        order[:, j] = slot
        np.minimum.at(out, row * slots + slot, value)
        still = (out.reshape(rows, slots)[left] == empty).any(1)
        if not still.all():
            left[left] = still
            go = left[row]
            element, row, order = element[go], row[go], order[go]
            each = np.arange(len(element))
    return out.reshape(rows, slots)


def distinct_sets(data, offsets, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, and the offsets of the rows."""
    element, first = Words(data, offsets).shingles(k)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((element, row))
    element, row = element[order], row[order]
    keep = np.ones(len(element), bool)
    keep[1:] = (element[1:] != element[:-1]) | (row[1:] != row[:-1])
    element, row = element[keep], row[keep]
    return element, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(first) - 1))])


def bucket_keys(sign: np.ndarray) -> np.ndarray:
    """The bucket of every row in each band; the low bits tell the band."""
    key = np.zeros((len(sign), BANDS), np.uint64)
    for r in range(ROWS):
        key = mix(key ^ mix(sign[:, r::ROWS] + U(r + 1)))
    return (key & U(2**64 - BANDS)) | np.arange(BANDS, dtype=np.uint64)


def _signatures(k: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            data, offsets = as_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                element, first = distinct_sets(data, offsets[lo : hi + 1], k)
                n = np.diff(first)
                row = np.repeat(np.arange(hi - lo), n)
                sign = super_minhash(element, row, hi - lo)
                digest = []
                for salt in (1, 2):
                    total = np.zeros(hi - lo, np.uint64)
                    if len(element):
                        full = n > 0
                        total[full] = np.add.reduceat(mix(element + U(salt)), first[:-1][full])
                    digest.append(total.view(np.int64))
                key = bucket_keys(sign)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array(n, pa.int64()),
                        *map(pa.array, digest),
                        pa.ListArray.from_arrays(np.arange(0, (hi - lo + 1) * BANDS, BANDS, dtype=np.int32), pa.array(key.view(np.int64).ravel())),
                    ],
                    names=["id", "n", "lo", "hi", "buckets"],
                )

    return run


def _sets(k: int, wanted):
    def run(batches):
        keep = wanted.value
        for batch in batches:
            batch = batch.filter(pa.array(has(keep, longs(batch))))
            data, offsets = as_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                element, first = distinct_sets(data, offsets[lo : hi + 1], k)
                values = pa.ListArray.from_arrays(first.astype(np.int32), pa.array(element.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), values], names=["id", "items"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets reach the threshold."""
    left, right = (sets.select(F.col("id").alias(x), F.col("items").alias(f"items_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("items_a", "items_b")).cast("long")
    both = both.select("a", "b", shared.alias("i"), (F.size("items_a") + F.size("items_b")).cast("long").alias("s"))
    return both.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b")


def _digests(shared):
    """Of each set: how many of its items are surely in no other, its signature in short, and its bitmap."""

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            item, row = longs(batch), np.repeat(np.arange(len(n)), n)
            own = np.bincount(row[~has(shared.value, item)], minlength=len(n))
            full = super_minhash(item, row, len(n))
            sign = (mix(full) >> U(48)).astype(np.uint16)
            bitmap = np.zeros((len(n), SET_BITS // 8), np.uint8)
            bit = (mix(item + U(9)) % U(SET_BITS)).astype(np.int64)
            np.bitwise_or.at(bitmap, (row, bit >> 3), (1 << (bit & 7)).astype(np.uint8))
            packed = [pa.array([x.tobytes() for x in part], pa.binary()) for part in (sign, bitmap, bucket_keys(full))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(own, pa.int64()), *packed], names=["id", "n", "own", "sign", "bitmap", "keys"])

    return run


def _compare(percent: int):
    """Pieces x and y of a large bucket: pairs of different components that may reach the threshold.

    ``own`` is how many shingles of a member nobody else has; they can't be shared.  Every bit that one bitmap has and
    the other lacks is an item that isn't shared.  A pair that shares the buckets of earlier bands is left to the first
    of them; that is told by the buckets themselves, so it does meet there.
    """
    t = percent / 100
    least = t - 6 * math.sqrt(t * (1 - t) / SLOTS)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        band = key[0].as_py() % BANDS
        x, y = (table.filter(pa.array(table["side"].to_numpy() == s)) for s in (0, 1))
        same = key[1].as_py() == key[2].as_py()
        get = lambda side, c: side[c].to_numpy()
        signs = [np.frombuffer(b"".join(side["sign"].to_pylist()), np.uint16).reshape(-1, SLOTS) for side in (x, y)]
        keys = [np.frombuffer(b"".join(side["keys"].to_pylist()), np.uint64).reshape(-1, BANDS) for side in (x, y)]
        maps = [np.frombuffer(b"".join(side["bitmap"].to_pylist()), np.uint64).reshape(-1, SET_BITS // 64) for side in (x, y)]
        idx, idy, cx, cy, nx, ny = get(x, "id"), get(y, "id"), get(x, "c"), get(y, "c"), get(x, "n"), get(y, "n")
        sx, sy = nx - get(x, "own"), ny - get(y, "own")
        found = [[], []]
        for i in range(len(idx)):
            most = np.minimum(sx[i], sy)
            ok = (cy != cx[i]) & (100 * most >= percent * (nx[i] + ny - most))
            if same:
                ok &= idy > idx[i]
            at = np.flatnonzero(ok)
            if len(at):
                equal = signs[1][at] == signs[0][i]
                at = at[equal.mean(1) >= least]
                at = at[(keys[1][at] == keys[0][i]).argmax(1) == band]
                both = np.bitwise_count(maps[1][at] & maps[0][i]).sum(1, dtype=np.int64)
                alone = [np.bitwise_count(m).sum(-1, dtype=np.int64) - both for m in (maps[0][i], maps[1][at])]
                most = np.minimum(nx[i] - alone[0], ny[at] - alone[1])
                at = at[100 * most >= percent * (nx[i] + ny[at] - most)]
                found[0].append(np.full(len(at), idx[i]))
                found[1].append(idy[at])
        a, b = (np.concatenate([np.zeros(0, np.int64), *f]) for f in found)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id (doc_id), n_shingles, component_id, kept.

    ``docs`` has doc_id and text; other columns are not read.  Documents are linked if their sets of distinct
    ``words``-word shingles have 100 * intersection >= percent * union.  A text of fewer words is one shingle;
    an empty or null text has none and is linked with nothing.  component_id is the least doc_id reachable; kept
    marks that document.  Several rows of one doc_id count as one node: they come out as one row for every input
    row, all of the same component, which joins what any of their texts is linked with.  A null doc_id is linked
    with nothing and kept, its component_id null.  An empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    all_docs = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "text")
    signed = materialize(all_docs.mapInArrow(_signatures(words), SIGNED), "signed")
    # Documents of equal sets, and the one that stands for them.
    real = signed.where(f"n > 0 and id <> {-(2**63)}")
    alike = real.groupBy("n", "lo", "hi").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    alike = materialize(alike, "alike")
    same = real.join(alike.where("copies > 1"), ["n", "lo", "hi"]).where("id <> rep").select("id", "rep")
    one = real.join(alike.select("n", "lo", "hi", F.col("rep").alias("id")), ["n", "lo", "hi", "id"])
    one = materialize(one.groupBy("id", "n", "lo", "hi").agg(F.first("buckets").alias("buckets")), "one")

    # Buckets of two or more.
    rows = one.select("id", F.explode("buckets").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(rows.join(sizes, "bucket"), "members")
    reach = members.groupBy("id").agg(F.sum("size").alias("reach"))
    ranked = members.join(reach, "id")
    centre = ranked.groupBy("bucket").agg(F.max(F.struct("reach", (-F.col("id")).alias("minus"))).alias("top"))
    centre = centre.select("bucket", (-F.col("top.minus")).alias("centre"))
    near = members.join(centre, "bucket").where("id <> centre")
    first = materialize(near.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct(), "first")

    wanted = spark.sparkContext.broadcast(bitmap_of(members.select("id"), longs, bits_for(one.count())))
    sets = materialize(all_docs.mapInArrow(_sets(words, wanted), "id long, items array<long>"), "sets")
    links = materialize(_linked(first, sets, percent).distinct(), "links")

    # Buckets that still hold several components.
    groups = connected(links).select(F.col("node").alias("id"), F.col("component").alias("c"))
    marked = members.join(groups, "id", "left").withColumn("c", F.coalesce("c", "id"))
    mixed = marked.groupBy("bucket").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most")
    open_ = materialize(marked.join(mixed.select("bucket"), "bucket"), "open")
    sized = one.select("id", "n")
    small = open_.where(f"size <= {SMALL}").join(sized, "id")
    x, y = (small.select("bucket", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "c", "n")]) for s in "xy")
    pairs = x.join(y, "bucket").where("id_x < id_y and c_x <> c_y")
    pairs = pairs.where(100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
    pairs = pairs.select(F.col("id_x").alias("a"), F.col("id_y").alias("b"))
    pairs = pairs.union(_large(open_.where(f"size > {SMALL}"), sets, percent))
    more = pairs.distinct().join(first, ["a", "b"], "left_anti")
    links = links.union(_linked(more, sets, percent)).union(same.select(F.col("rep").alias("a"), F.col("id").alias("b")))

    least = connected(links, "near").select(F.col("node").alias("id"), F.col("component"))
    out = signed.select("id", "n").join(least, "id", "left")
    null = F.col("id") == -(2**63)
    component = F.when(~null, F.coalesce("component", "id"))
    doc_id = F.when(~null, F.col("id"))
    return out.select(
        doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(doc_id == component, F.lit(True)).alias("kept")
    )


def _large(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs to verify in open buckets that are too large to list."""
    items = materialize(sets.join(large.select("id").distinct(), "id").select("items", "id"), "large")
    shared = items.sparkSession.sparkContext.broadcast(repeated(items, longs, "large-items"))
    info = items.mapInArrow(_digests(shared), "id long, n long, own long, sign binary, bitmap binary, keys binary")
    pieces = F.ceil(F.col("size") / PIECE).cast("int")
    member = large.join(info, "id").withColumn("pieces", pieces).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    # piece i meets every piece j >= i: as the left side of (i, j) and the right side of (j', i)
    spread = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rest = ("id", "c", "n", "own", "sign", "bitmap", "keys")
    left = spread.where("mine <= other").select("bucket", F.col("mine").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), *rest)
    right = spread.where("other <= mine").select("bucket", F.col("other").alias("i"), F.col("mine").alias("j"), F.lit(1).alias("side"), *rest)
    return left.union(right).groupBy("bucket", "i", "j").applyInArrow(_compare(percent), "a long, b long")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents of a group of near copies but its least doc_id; all columns as they are.

    Rows of one doc_id stay or go together; rows without doc_id stay.
    """
    gone = near_duplicates(docs, words, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
