"""Trip-weighted road speeds per segment, route and area.

Input ``facts``: route_id, borough, from_stop, to_stop, hour_of_day, day_of_week, obs_date, speed, trips, miles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions.clock import is_peak, is_weekday
from kerbline.plans.spine import safe_ratio

MIN_SEGMENT_MILES = 0.1


def _weighted(facts: DataFrame, keys: Sequence[str], *extra) -> DataFrame:
    out = facts.groupBy(*keys).agg(
        F.sum(F.col("speed") * F.col("trips")).alias("__sv"), F.sum("trips").alias("n_trips"), *extra
    )
    return out.withColumn("wt_speed_mph", safe_ratio(F.col("__sv"), F.col("n_trips"))).drop("__sv")


def peak_weekday(facts: DataFrame) -> DataFrame:
    return facts.where(is_weekday(F.col("day_of_week")) & is_peak(F.col("hour_of_day")) & (F.col("speed") > 0))


def segment_speed(facts: DataFrame, min_n: int = 500) -> DataFrame:
    f = peak_weekday(facts).where(
        F.col("from_stop").isNotNull() & F.col("to_stop").isNotNull() & (F.col("miles") >= MIN_SEGMENT_MILES)
    )
    out = _weighted(f, ["route_id", "borough", "from_stop", "to_stop"], F.avg("miles").alias("seg_miles"))
    return out.where(F.col("n_trips") >= min_n)


def route_speed(facts: DataFrame, min_n: int = 2000) -> DataFrame:
    return _weighted(peak_weekday(facts), ["route_id"], F.min("borough").alias("borough")).where(F.col("n_trips") >= min_n)


def speed_by_area_hour(facts: DataFrame) -> DataFrame:
    return _weighted(facts.where(is_weekday(F.col("day_of_week")) & (F.col("speed") > 0)), ["borough", "hour_of_day"])


def slowest(df: DataFrame, n: int = 25) -> DataFrame:
    return df.orderBy(F.asc_nulls_last("wt_speed_mph"), "route_id", "from_stop", "to_stop").limit(n)


def before_after(facts: DataFrame, programs: DataFrame, days: int = 120, min_n: int = 500) -> DataFrame:
    """Speed before and after each program's start, all programs in one pass.

    Facts are summed to (route, day) before the join, so a hot route reaches it
    as one row per day however many observations it has.
    """
    daily = (
        peak_weekday(facts)
        .groupBy(F.upper("route_id").alias("route_norm"), "obs_date")
        .agg(F.sum(F.col("speed") * F.col("trips")).alias("sv"), F.sum("trips").alias("n"))
    )
    p = programs.withColumn("route_norm", F.upper(F.replace(F.col("route"), F.lit("+"), F.lit(""))))
    near = F.col("obs_date").between(F.date_sub("start_date", days), F.date_add("start_date", days))
    j = daily.join(p, "route_norm").where(near)
    after = F.col("obs_date") >= F.col("start_date")
    agg = j.groupBy("route", "program", "start_date").agg(
        F.sum(F.when(~after, F.col("sv"))).alias("sv0"), F.sum(F.when(~after, F.col("n"))).alias("pre_trips"),
        F.sum(F.when(after, F.col("sv"))).alias("sv1"), F.sum(F.when(after, F.col("n"))).alias("post_trips"),
    )
    agg = agg.where((F.col("pre_trips") >= min_n) & (F.col("post_trips") >= min_n))
    pre, post = safe_ratio(F.col("sv0"), F.col("pre_trips")), safe_ratio(F.col("sv1"), F.col("post_trips"))
    return agg.select(
        "route", "program", F.col("start_date").alias("implementation_date"),
        pre.alias("pre_speed_mph"), post.alias("post_speed_mph"), (post - pre).alias("delta_mph"),
        ((post - pre) / pre * 100).alias("pct_change"), "pre_trips", "post_trips",
    )
