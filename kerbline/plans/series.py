"""Window steps over long series, split so that no key has to fit one task.

A window ``partitionBy(vehicle)`` sends all rows of a key to one task.  Here a
series is cut into chunks of its clock (an hour, a day): the window runs inside
(key, chunk), and what crosses a chunk border comes from a table with one or two
rows per (key, chunk).  Only that small table is windowed over the key alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = "__chunk"
PART = "__part"


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys where NULL equals NULL, keeping the left key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    cond = None
    for k in keys:
        part = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = part if cond is None else cond & part
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def _order_struct(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def with_neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    prev: Mapping[str, str] | None = None,
    next: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add values of the previous and next row, as ``lag``/``lead`` over the whole key would.

    ``chunk`` must not decrease along ``order``; ``order`` should end in a unique column.
    Rows inside a chunk find both neighbours there.  The first and last row of each
    chunk (at most two rows per chunk) form a small series of their own: there, the
    row before a chunk's first row is the last row of the chunk before it.
    Both parts read the same shuffle, which Spark runs once.
    """
    keys, prev, next = list(keys), dict(prev or {}), dict(next or {})
    sources = list(dict.fromkeys([*prev.values(), *next.values()]))
    payload = F.struct(*sources)
    sort = [F.col(c).asc_nulls_first() for c in order]
    w = W.partitionBy(*keys, CHUNK).orderBy(*sort)
    inside = df.withColumn(CHUNK, chunk).withColumns({"__p": F.lag(payload).over(w), "__n": F.lead(payload).over(w)})
    whole = F.col("__p").isNotNull() & F.col("__n").isNotNull()
    along = W.partitionBy(*keys).orderBy(*sort)
    edges = inside.where(~whole).withColumns(
        {"__p": F.coalesce("__p", F.lag(payload).over(along)), "__n": F.coalesce("__n", F.lead(payload).over(along))}
    )
    out = inside.where(whole).unionByName(edges)
    return out.select(
        *df.columns,
        *[F.col("__p").getField(src).alias(dst) for dst, src in prev.items()],
        *[F.col("__n").getField(src).alias(dst) for dst, src in next.items()],
    )


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    value: str,
    out: str,
    how: str = "sum",
    inclusive: bool = True,
) -> DataFrame:
    """Running ``sum``/``max``/``last`` (last non-null) of ``value`` along each key."""
    keys = list(keys)
    # one struct per (key, chunk): never NULL itself, equal where its fields are equal or NULL alike, so the window, the
    # totals and the join back all use one shuffle of the rows
    part = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], chunk.alias(CHUNK))
    w = W.partitionBy(PART).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    rows = w.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    over_chunks = W.partitionBy(*[F.col(f"{PART}.k{i}") for i in range(len(keys))]).orderBy(F.col(f"{PART}.{CHUNK}")).rowsBetween(W.unboundedPreceding, -1)
    if how == "sum":
        local, total, carry = F.sum(value).over(rows), F.sum(value), F.sum("__t").over(over_chunks)
    elif how == "max":
        local, total, carry = F.max(value).over(rows), F.max(value), F.max("__t").over(over_chunks)
    elif how == "last":
        local = F.last(value, ignorenulls=True).over(rows)
        total = F.max_by(value, F.when(F.col(value).isNotNull(), _order_struct(order)))
        carry = F.last("__t", ignorenulls=True).over(over_chunks)
    else:
        raise ValueError(how)
    inside = df.withColumn(PART, part).withColumn("__in", local)
    edge = inside.groupBy(PART).agg(total.alias("__t")).select(F.col(PART).alias("__of"), carry.alias("__carry"))
    joined = inside.join(edge, F.col(PART) == F.col("__of"))
    if how == "sum":
        got = F.when(
            F.col("__in").isNotNull() | F.col("__carry").isNotNull(),
            F.coalesce("__in", F.lit(0)) + F.coalesce("__carry", F.lit(0)),
        )
    elif how == "max":
        got = F.greatest("__in", "__carry")
    else:
        got = F.coalesce("__in", "__carry")
    return joined.withColumn(out, got).drop("__in", "__carry", "__of", PART)
