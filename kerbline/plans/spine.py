"""Dense spines and fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dense_bins(df: DataFrame, column: str, step: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per ``step`` between the smallest and the largest bin (per key)."""
    span = df.groupBy(*keys).agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    span = span.where(F.col("__lo").isNotNull())
    return span.select(*keys, F.explode(F.sequence("__lo", "__hi", F.lit(step).cast("long"))).alias(column))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b as double, NULL where b is 0 or NULL."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
