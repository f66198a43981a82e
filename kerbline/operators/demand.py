"""Ridership: route totals, profiles, recovery and payment mix.

Input ``rides``: bus_route, transit_timestamp, payment_method, fare_class, ridership, transfers.
Every table here is one partial-then-final hash aggregate; the wide input never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.functions.clock import iso_weekday
from kerbline.functions.codes import borough_from_route, route_norm
from kerbline.plans.spine import safe_ratio

HOUR = F.hour


def _weekday() -> Column:
    return iso_weekday(F.col("transit_timestamp")) <= 5


def route_totals(rides: DataFrame) -> DataFrame:
    return (
        rides.groupBy(F.col("bus_route").alias("route"))
        .agg(
            F.sum("ridership").alias("total_boardings"),
            F.sum("transfers").alias("total_transfers"),
            F.min("transit_timestamp").cast("date").alias("first_date"),
            F.max("transit_timestamp").cast("date").alias("last_date"),
        )
        .withColumn("borough", borough_from_route(F.col("route")))
    )


def league(df: DataFrame, col: str, key: str, n: int = 25, positive: bool = True) -> DataFrame:
    """The n largest and the n smallest rows; zero totals never make the bottom list."""
    top = df.orderBy(F.desc_nulls_last(col), F.asc(key)).limit(n).withColumn("side", F.lit("top"))
    low = df.where(F.col(col) > 0) if positive else df
    low = low.orderBy(F.asc_nulls_last(col), F.desc(key)).limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


def _split_week() -> list[Column]:
    return [
        F.sum(F.when(_weekday(), F.col("ridership"))).alias("weekday_boardings"),
        F.sum(F.when(~_weekday(), F.col("ridership"))).alias("weekend_boardings"),
    ]


def hourly_profile(rides: DataFrame) -> DataFrame:
    return rides.groupBy(HOUR("transit_timestamp").alias("hod")).agg(*_split_week())


def hourly_profile_by(rides: DataFrame, key: Column, name: str) -> DataFrame:
    return (
        rides.where(_weekday())
        .groupBy(HOUR("transit_timestamp").alias("hod"), key.alias(name))
        .agg(F.sum("ridership").alias("boardings"))
    )


def yoy(df: DataFrame, year: str, value: str, out: str = "yoy_pct") -> DataFrame:
    """Change against the previous row by year, in percent; one row per year, so one task is enough."""
    before = F.lag(value).over(W.orderBy(year))
    return df.withColumn(out, (safe_ratio(F.col(value), before) - 1) * 100)


def yearly_totals(rides: DataFrame) -> DataFrame:
    return rides.groupBy(F.year("transit_timestamp").alias("yr")).agg(F.sum("ridership").alias("boardings"))


def recovery_yearly(rides: DataFrame, base: int) -> DataFrame:
    by_year = yoy(yearly_totals(rides), "yr", "boardings")
    base_total = F.max(F.when(F.col("yr") == base, F.col("boardings"))).over(W.partitionBy(F.lit(1)))
    return by_year.withColumn("index_vs_base", safe_ratio(F.col("boardings"), base_total) * 100)


def recovery_monthly(rides: DataFrame) -> DataFrame:
    return rides.groupBy(F.trunc("transit_timestamp", "month").alias("month")).agg(F.sum("ridership").alias("boardings"))


def area_totals(rides: DataFrame) -> DataFrame:
    """Routes are summed first, so the area step sees one row per route."""
    per_route = rides.groupBy("bus_route").agg(F.sum("ridership").alias("b"))
    return per_route.groupBy(borough_from_route(F.col("bus_route")).alias("borough")).agg(
        F.count(F.lit(1)).alias("n_routes"), F.sum("b").alias("total_boardings")
    )


def payment_by_year(rides: DataFrame) -> DataFrame:
    return rides.groupBy(F.year("transit_timestamp").alias("yr"), "payment_method").agg(F.sum("ridership").alias("boardings"))


def payment_mix(rides: DataFrame, methods: list[str]) -> DataFrame:
    """Share of each payment method per year, one column per method."""
    wide = payment_by_year(rides).groupBy("yr").pivot("payment_method", methods).agg(F.sum("boardings"))
    total = sum((F.coalesce(F.col(m), F.lit(0.0)) for m in methods), F.lit(0.0))
    return wide.select("yr", *[(100 * F.coalesce(F.col(m), F.lit(0.0)) / total).alias(f"share_{m.lower()}") for m in methods])


def class_share(rides: DataFrame) -> DataFrame:
    by_class = rides.groupBy("fare_class").agg(F.sum("ridership").alias("boardings"))
    total = F.sum("boardings").over(W.partitionBy(F.lit(1)))
    return by_class.withColumn("share_pct", 100 * F.col("boardings") / total)


def route_hourly(rides: DataFrame) -> DataFrame:
    return (
        rides.groupBy(F.col("bus_route").alias("route"), HOUR("transit_timestamp").alias("hod"))
        .agg(*_split_week(), F.sum("ridership").alias("total_boardings"))
        .withColumn("borough", borough_from_route(F.col("route")))
    )


def avg_weekday(rides: DataFrame, since: str) -> DataFrame:
    """Mean weekday boardings per normalised route: daily sums first, then their mean."""
    daily = (
        rides.where(_weekday() & (F.col("transit_timestamp") >= F.lit(since).cast("timestamp")))
        .groupBy(route_norm(F.col("bus_route")).alias("route_norm"), F.to_date("transit_timestamp").alias("d"))
        .agg(F.sum("ridership").alias("b"))
    )
    return daily.groupBy("route_norm").agg(F.avg("b").alias("avg_weekday_boardings"))


# ------------------------------------------------------------------ enforcement programs
def ace_summary(violations: DataFrame, program: DataFrame) -> DataFrame:
    v = (
        violations.where(F.col("route").isNotNull())
        .groupBy("route")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("first_occurrence").alias("first_violation"),
            F.max("first_occurrence").alias("last_violation"),
        )
    )
    return v.join(program, "route", "full_outer").select(
        "route", "program", F.col("start_date").alias("implementation_date"),
        F.coalesce("n", F.lit(0)).alias("violations_total"), "first_violation", "last_violation",
    )


def violations_by_year(violations: DataFrame) -> DataFrame:
    return (
        violations.where(F.col("route").isNotNull())
        .groupBy("route", F.year("first_occurrence").alias("year"))
        .agg(F.count(F.lit(1)).alias("violations"))
    )
