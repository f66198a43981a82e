"""The list of named queries with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.catalog.inputs import with_ctes
from kerbline.functions import clock

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Dates and decimals as text and doubles, so both engines compare like with like."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register a query; ``ctes`` names the bindings the oracle needs."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf: _plain(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = with_ctes(ctes, sql) if ctes else sql.strip()
        return fn

    return deco


def r(col, digits: int = 4):
    """Rounded double."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), digits)


# ---------------------------------------------------------------- SQL texts of the service clock's tables
def by_hour_sql(hour: str, values: dict[int, object]) -> str:
    """The value of an hour, from a table of the 24 hours; absent hours give NULL."""
    table = ", ".join(f"'{values[h]}'" if isinstance(values.get(h), str) else str(values.get(h, "NULL")) for h in range(24))
    return f"list_extract([{table}], CAST({hour} AS INT) + 1)"


def period_sql(hour: str) -> str:
    names = {h: name for name, lo, hi, _ in clock.PERIODS for h in range(lo, hi + 1)}
    return by_hour_sql(hour, {h: names.get(h, clock.NIGHT[0]) for h in range(24)})


def period_minutes_sql(hour: str) -> str:
    spans = {h: m for _, lo, hi, m in clock.PERIODS for h in range(lo, hi + 1)}
    return by_hour_sql(hour, {h: spans.get(h, clock.NIGHT[1]) for h in range(24)})


def window_sql(hour: str) -> str:
    return by_hour_sql(hour, {h: name for name, lo, hi in clock.TOD_WINDOWS for h in range(lo // 3600, hi // 3600)})
