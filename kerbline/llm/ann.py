"""Approximate nearest neighbours by collision-counting hashing, for the largest inner product.

Vectors get one more component, so that the largest inner product is the least distance.  Every vector is projected on
``LINES`` random lines; each line is a sorted array.  A query opens a window around its own projection on every line and widens
all windows together (virtual rehashing): a vector that lies in the windows of enough lines is verified, its inner product taken in
double precision.  The windows stop widening when enough vectors are verified.

The vectors are dealt into blocks, and every block meets every block of queries once; the best of a query in all
blocks are its result.  All vectors are indexed, none is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINES = 64
#: A vector is verified when it lies in the windows of all lines but so many.
MISSES = 6
#: Half width of the first windows, in standard deviations of the projections, and the factor of each widening.
WIDTH, WIDER = 1.5, 1.1
#: Windows widen until so many times the wanted neighbours, and this share of the block, are verified.
TIMES, SHARE = 2, 0.08
BLOCK, QUERIES = 8192, 1024
SEED = 11
FOUND = "query_id long, vec_id long, score double"


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products with the query, summed from the first component to the last in double precision."""
    out = np.zeros(len(vectors))
    for column, x in zip(vectors.T, query.tolist(), strict=True):
        out += column * x
    return out


def _lines(dim: int) -> np.ndarray:
    """``LINES`` random directions (dim x LINES), at right angles to each other as far as ``dim`` allows."""
    gen = np.random.Generator(np.random.PCG64(SEED))
    bases = [np.linalg.qr(gen.normal(size=(dim, min(dim, LINES))))[0] for _ in range(-(-LINES // dim))]
    return np.concatenate(bases, 1)[:, :LINES]


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, longest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best verified vectors of a block for every query: query_id, vec_id, score."""
    n, dim = vectors.shape
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
    lines = _lines(dim + 1)
    m = lines.shape[1]
    at = np.concatenate([vectors, rest[:, None]], 1) @ lines
    # queries are compared by direction: their length doesn't change the order of inner products
    size = np.sqrt((queries**2).sum(1))
    centre = queries / size[:, None] * longest @ lines[:dim]
    order = np.argsort(at, axis=0, kind="stable").T
    places = np.take_along_axis(at.T, order, 1)
    # where every vector stands on every sorted line
    whole = np.uint16 if n < 1 << 16 else np.uint32
    rank = np.empty((m, n), whole)
    np.put_along_axis(rank, order, np.arange(n, dtype=whole)[None, :], 1)
    half = WIDTH * (float(at.std()) or 1.0)
    want = min(n, int(TIMES * k + SHARE * n))
    windows: list[tuple[np.ndarray, np.ndarray]] = []

    def window(level: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and length of every query's windows on every line, for one width."""
        while level >= len(windows):
            wide = half * WIDER ** len(windows)
            lo, hi = (np.array([np.searchsorted(places[j], centre[:, j] + x, side) for j in range(m)]).T for x, side in ((-wide, "left"), (wide, "right")))
            windows.append((lo.astype(whole), (hi - lo).astype(whole)))
        return windows[level]

    def verified(q: int, level: int) -> np.ndarray:
        """The vectors that all lines but a few have in their windows."""
        lo, length = window(level)
        inside = (rank - lo[q][:, None]) < length[q][:, None]
        return np.flatnonzero(inside.sum(0, dtype=np.uint8) >= max(1, m - MISSES))

    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    level = 0
    for q in range(len(query_ids)):
        # the first width that verifies enough; looked for from the last query's on, as the number only grows with the width
        near = verified(q, level)
        if len(near) >= want:
            while level and len(less := verified(q, level - 1)) >= want:
                near, level = less, level - 1
        else:
            while len(near) < want and (window(level)[1][q] < n).any():
                level += 1
                near = verified(q, level)
        near = near[ids[near] != query_ids[q]]
        # a quick product leaves those that can be among the k best, by more than its rounding
        quick = vectors[near] @ queries[q]
        if len(near) > k:
            near = near[quick >= np.partition(quick, -k)[-k] - 1e-9 * (1 + longest) * size[q]]
        score = exact(vectors[near], queries[q])
        best = np.lexsort((ids[near], -score))[:k]
        out.append((np.full(len(best), query_ids[q]), ids[near][best], score[best]))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, float)))


def _search(k: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        side = table["query"].to_numpy()
        lists = table["vector"].combine_chunks()
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, -1)
        ids = table["vec_id"].to_numpy()
        # the same order whatever way the rows came
        data, query = (x[np.argsort(ids[x], kind="stable")] for x in (np.flatnonzero(~side), np.flatnonzero(side)))
        if not len(data) or not len(query):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        longest = float(table["longest"][0].as_py())
        found = search_block(ids[data], values[data], ids[query], values[query], k, longest)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    return run


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose vec_id is divisible by ``every``.

    ``vectors`` has vec_id and embedding (array of numbers).  Nearest is the largest inner product; ties go to the smaller vec_id; a
    row is no neighbour of its own vec_id.  Rows with a null vec_id, and vectors that are null, empty, zero or have null or
    non-finite components, take no part.  Vectors of different lengths can't be compared, so each length is searched by itself.  Rows of
    one vec_id and equal vectors count once; of different vectors with one vec_id each is searched and may be found, the
    better score standing for the vec_id.  An empty table gives an empty result.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where("vec_id is not null and vector is not null")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("vector", lambda x: x != 0)).distinct()
    rows = rows.withColumn("dim", F.size("vector"))
    longest = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    is_query = F.col("vec_id") % every == 0
    info = rows.groupBy("dim").agg(F.max(longest).alias("longest"), F.count(F.lit(1)).alias("n"), F.sum(is_query.cast("long")).alias("q"))
    blocks = lambda c, size: F.greatest(F.ceil(F.col(c) / size), F.lit(1)).cast("int")
    info = info.where("q > 0").select(F.col("dim").alias("of"), "longest", blocks("n", BLOCK).alias("blocks"), blocks("q", QUERIES).alias("groups"))
    rows = rows.join(info, F.col("dim") == F.col("of")).drop("of")
    # by vector too: a vec_id may stand for any number of vectors
    draw = lambda n, salt: F.pmod(F.xxhash64("vec_id", "vector", F.lit(salt)), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # of equal vectors only the k + 1 least vec_ids can be in a result
    alike = Window.partitionBy("dim", "vector").orderBy("vec_id")
    first = rows.withColumn("nth", F.row_number().over(alike)).where(f"nth <= {int(k) + 1}")
    data = first.select("dim", draw("blocks", 1).alias("block"), all_of("groups").alias("group"), F.lit(False).alias("query"), "vec_id", "vector", "longest")
    query = rows.where(is_query).select("dim", all_of("blocks").alias("block"), draw("groups", 2).alias("group"), F.lit(True).alias("query"), "vec_id", "vector", "longest")
    # few bytes but much work: an explicit number of partitions keeps small blocks from being put into one task
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = data.union(query).repartition(parts, "dim", "block", "group")
    found = pairs.groupBy("dim", "block", "group").applyInArrow(_search(k), FOUND)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(f"rank <= {int(k)}").select("query_id", "rank", "vec_id", "score")
