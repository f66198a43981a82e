"""Ranks, cumulative shares and exact percentiles without a one-task global window.

The rows are first reduced to a histogram (value, count).  The histogram is range
partitioned, each partition is summed, and the offset of each partition comes
from the totals of the partitions before it: one row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS = 256


def _quantile_bins(hist: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """Give every histogram row an order-preserving bin, about equally filled per key.

    Edges come from a mergeable sketch; they only decide how work is split, so
    their inaccuracy cannot change a result.
    """
    side = int(bins**0.5)
    bins = side * side
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges = hist.groupBy(*keys).agg(F.percentile_approx(value, probs, 1000).alias("__edges"))
    if keys:
        from kerbline.plans.series import null_safe_join

        hist = null_safe_join(hist, edges, keys)
    else:
        # one row by construction (a global aggregate)
        hist = hist.crossJoin(F.broadcast(edges))
    # two short searches instead of one over all edges: first among every side-th edge, then inside
    v = F.col(value)
    every = F.sequence(F.lit(side), F.lit(side * (side - 1)), F.lit(side))
    coarse = F.filter(F.transform(every, lambda i: F.get("__edges", i - 1)), lambda e: e < v)
    hist = hist.withColumn("__c", F.size(coarse))
    fine = F.filter(F.slice("__edges", F.col("__c") * side + 1, F.lit(side)), lambda e: e < v)
    return hist.withColumn("__bin", F.col("__c") * side + F.size(fine)).drop("__edges", "__c")


def value_positions(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None,
                    bins: int = BINS) -> DataFrame:
    """Per distinct non-null value: its weight ``n`` and the weight ``below`` it, per key.

    ``total`` is the key's weight.  Everything rank-like follows from these three.
    """
    keys = list(keys)
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(amount.alias("n"))
    hist = _quantile_bins(hist, keys, value, bins)
    totals = hist.groupBy(*keys, "__bin").agg(F.sum("n").alias("__bn"))
    ahead = W.partitionBy(*keys).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        *keys, "__bin",
        F.coalesce(F.sum("__bn").over(ahead), F.lit(0)).alias("__ahead"),
        F.sum("__bn").over(W.partitionBy(*keys)).alias("total"),
    )
    inside = W.partitionBy(*keys, "__bin").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    from kerbline.plans.series import null_safe_join

    out = null_safe_join(
        hist.withColumn("__in", F.coalesce(F.sum("n").over(inside), F.lit(0))), totals, [*keys, "__bin"]
    )
    return out.select(*keys, value, "n", (F.col("__in") + F.col("__ahead")).alias("below"), "total")


def with_rank_columns(df: DataFrame, value: str, columns: dict[str, Column], keys: Sequence[str] = (),
                      weight: str | None = None) -> DataFrame:
    """Join rank-like columns built from ``n``, ``below``, ``total`` back to the rows.

    Rows whose value is NULL get NULL columns.
    """
    keys = list(keys)
    pos = value_positions(df, keys, value, weight).select(*keys, value, *[c.alias(k) for k, c in columns.items()])
    from kerbline.plans.series import null_safe_join

    # rows without a value match nothing; a draw per row spreads them over all tasks
    spread = F.when(F.col(value).isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20))).otherwise(F.lit(0))
    joined = null_safe_join(df.withColumn("__spread", spread), pos.withColumn("__spread", F.lit(0)), ["__spread", *keys, value])
    return joined.drop("__spread")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                      bins: int = BINS) -> DataFrame:
    """Exact linear-interpolated percentiles per key, from value positions.

    Used where a group may hold very many distinct values; for values on a bounded
    whole-second scale the built-in ``percentile`` keeps a bounded buffer anyway.
    """
    keys = list(keys)
    pos = value_positions(df, keys, value, bins=bins)
    aggs = [F.max("total").alias("n")]
    for name, p in probs.items():
        at = F.lit(p) * (F.col("total") - 1)
        for tag, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            holds = (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
            aggs.append(F.max(F.when(holds, F.col(value))).alias(f"__{name}_{tag}"))
    out = pos.groupBy(*keys).agg(*aggs)
    cols = []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("n") - 1)
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return out.select(*keys, "n", *cols)


def rank_many(df: DataFrame, key: str, columns: Sequence[str], rank: Column) -> DataFrame:
    """A rank-like column for many value columns at once: key plus ``<column>`` ranked.

    The columns are stacked into (name, value), ranked together in one pass, and set
    side by side again, instead of one ranking job per column.
    """
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]))
    long = df.select(key, stack.alias("s")).select(key, "s.*").where(F.col("value").isNotNull())
    ranked = with_rank_columns(long, "value", {"rk": rank}, ["name"])
    return ranked.groupBy(key).agg(*[F.max(F.when(F.col("name") == c, F.col("rk"))).alias(c) for c in columns])
