"""Stop passages, headways, bunching and schedule deviation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.functions import clock
from kerbline.functions.codes import route_norm
from kerbline.operators.trajectory import hour_chunk
from kerbline.plans.series import null_safe_join, with_neighbour
from kerbline.plans.spine import safe_ratio

MIN_HEADWAY_S = 30
MAX_HEADWAY_S = 7_200
SHORT_FRAC = 0.5

STOP_KEYS = ["route_id", "direction_id", "stop_id"]


def archive_span(pings: DataFrame) -> DataFrame:
    """First and last report, depth and distinct counts of the archive.

    Distinct counts are taken over one pre-reduced table, not as one Expand of the archive.
    """
    p = pings.where(F.col("stop_id").isNotNull() & (F.col("stop_id") != ""))
    hour = F.floor(F.col("ts") / 3600)
    small = p.groupBy("vehicle_id", "route_id", hour.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return small.agg(
        F.min("a").alias("t0"), F.max("b").alias("t1"), F.sum("n").alias("frames"), F.countDistinct("vehicle_id").alias("vehicles"),
        F.countDistinct("route_id").alias("routes"), F.countDistinct("h").alias("distinct_hours"),
    ).withColumn("depth_hours", (F.col("t1") - F.col("t0")) / 3600.0)


def passages(pings: DataFrame) -> DataFrame:
    """Reports where a vehicle's stop differs from its previous one."""
    p = pings.where(F.col("stop_id").isNotNull() & (F.col("stop_id") != "") & F.col("route_id").isNotNull())
    p = with_neighbour(p, ["vehicle_id"], ["ts", "event_id"], hour_chunk(), {"prev_stop": "stop_id"})
    return p.where(F.col("prev_stop").isNull() | (F.col("stop_id") != F.col("prev_stop"))).drop("prev_stop")


def headways(events: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """Seconds since the previous event at the same key; the first has none."""
    h = with_neighbour(events, list(keys), [ts, tie], F.floor(F.col(ts) / 3600), {"prev_ts": ts})
    return h.withColumn("headway_s", F.col(ts) - F.col("prev_ts")).drop("prev_ts")


def headway_stats(hw: DataFrame, keys: Sequence[str], min_n: int) -> DataFrame:
    """Count, median, mean and coefficient of variation of headways, in minutes.

    Headways are whole seconds below three hours, which bounds the buffer of ``median``.
    """
    m = F.col("headway_s") / 60.0
    per_stop = [F.countDistinct("stop_id").alias("n_stops")] if "stop_id" not in keys else []
    g = hw.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_headways"), *per_stop, (F.median("headway_s") / 60.0).alias("median_headway_min"),
        F.avg(m).alias("mean_headway_min"), F.stddev_samp(m).alias("sd"),
    )
    return g.where(F.col("n_headways") >= min_n).withColumn("bunching_cv", F.col("sd") / F.nullif(F.col("mean_headway_min"), F.lit(0.0))).drop("sd")


def headway_vs_schedule(obs: DataFrame, sched: DataFrame, period: Column) -> DataFrame:
    """Observed minus scheduled headway per route for one clock period."""
    s = sched.where(F.col("period") == period).groupBy(route_norm(F.col("route")).alias("route_norm")).agg(F.avg("headway_min").alias("scheduled_headway_min"))
    j = obs.withColumn("route_norm", route_norm(F.col("route_id"))).join(s, "route_norm")
    return j.select("route_id", "n_headways", "median_headway_min", "scheduled_headway_min",
                    (F.col("median_headway_min") - F.col("scheduled_headway_min")).alias("obs_minus_sched_min"), "bunching_cv")


def arrivals_stopped(pings: DataFrame) -> DataFrame:
    """Earliest time each trip is reported as stopped at a stop."""
    p = pings.where((F.col("current_status") == 1) & F.col("stop_id").isNotNull())
    return p.groupBy("feed", *STOP_KEYS, "trip_id").agg(F.min("ts").alias("arr_ts"))


def headway_hourly(arrivals: DataFrame, hi: int = 7200) -> DataFrame:
    """Headways per cell of stop, date and hour, with the share below half the cell's median."""
    h = headways(arrivals, ["feed", *STOP_KEYS], "arr_ts", "trip_id").where((F.col("headway_s") > 0) & (F.col("headway_s") < hi))
    at = F.timestamp_seconds("arr_ts")
    keys = ["feed", *STOP_KEYS, "date", "hour"]
    h = h.withColumns({"date": F.date_format(at, "yyyy-MM-dd"), "hour": F.hour(at)})
    return _with_short_share(h, keys, [
        F.count(F.lit(1)).alias("n_headways"), F.median("headway_s").alias("median_headway_s"), F.avg("headway_s").alias("mean_headway_s"),
        F.min("headway_s").alias("min_headway_s"), F.max("headway_s").alias("max_headway_s"),
    ], "bunching_index")


def _with_short_share(h: DataFrame, keys: list[str], aggs: list[Column], name: str) -> DataFrame:
    """Aggregate cells and add the share of gaps below half their median.

    Gaps are whole seconds, so the second step works on (cell, gap) counts.
    """
    cells = h.groupBy(*keys).agg(*aggs)
    gaps = h.groupBy(*keys, "headway_s").agg(F.count(F.lit(1)).alias("__n"))
    g = null_safe_join(gaps, cells.select(*keys, F.col("median_headway_s").alias("__m")), keys)
    short = g.groupBy(*keys).agg((F.sum(F.when(F.col("headway_s") < SHORT_FRAC * F.col("__m"), F.col("__n")).otherwise(0)) / F.sum("__n")).alias(name))
    return null_safe_join(cells, short, keys)


# ------------------------------------------------------------------ schedule joins
def join_schedule(arrivals: DataFrame, sched: DataFrame) -> DataFrame:
    """Arrivals with the nearest scheduled visit of the same trip and stop, and the deviation.

    A trip that serves a stop twice keeps one row per arrival; deviations are
    wrapped to half a day so midnight does not add 24 h.
    """
    local = clock.local_seconds(F.col("arr_ts"))
    a = arrivals.withColumn("local_sec", F.pmod(local, F.lit(clock.DAY_S)))
    s = sched.select("trip_id", "stop_id", "stop_seq", "sched_arr_sec")
    dev = clock.wrap_half_day(F.col("local_sec") - F.pmod(F.col("sched_arr_sec"), F.lit(clock.DAY_S)))
    j = a.join(s, ["trip_id", "stop_id"], "left").withColumn("deviation_s", dev)
    keys = [*arrivals.columns, "local_sec"]
    best = F.min_by(F.struct("stop_seq", "sched_arr_sec", "deviation_s"), F.struct(F.abs("deviation_s"), "stop_seq"))
    return j.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def adherence_stopped(arrivals: DataFrame, sched: DataFrame) -> DataFrame:
    """Clock second of a stopped arrival minus the scheduled second, per matching visit."""
    j = arrivals.join(sched.select("trip_id", "stop_id", "sched_arr_sec"), ["trip_id", "stop_id"])
    return j.select("feed", "route_id", "trip_id", "stop_id", "arr_ts", "sched_arr_sec",
                    clock.wrap_half_day(F.pmod("arr_ts", F.lit(clock.DAY_S)) - F.pmod("sched_arr_sec", F.lit(clock.DAY_S))).alias("adherence_s"))


def join_coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Share of rows of ``a`` whose key occurs in ``b``; rows are counted per key before the join."""
    per = a.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hit = per.join(b.select(key).distinct().withColumn("__hit", F.lit(1)), key, "left")
    return hit.agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("__hit") == 1, F.col("n"))), F.lit(0)).alias("matched")).withColumn(
        "coverage_pct", 100 * safe_ratio(F.col("matched"), F.col("rows")))


def follow_up_rate(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``a`` and how many of them occur in ``b``."""
    k = a.select(key).distinct().join(b.select(key).distinct().withColumn("__hit", F.lit(1)), key, "left")
    return k.agg(F.count(F.lit(1)).alias("total"), F.count("__hit").alias("followed")).withColumn("follow_up_pct", 100 * safe_ratio(F.col("followed"), F.col("total")))


# ------------------------------------------------------------------ cells
def scheduled_gaps(sched: DataFrame) -> DataFrame:
    """Median scheduled headway per stop and hour over the distinct scheduled seconds (at most one day of them)."""
    d = sched.select(*STOP_KEYS, "sched_arr_sec").distinct()
    gap = F.col("sched_arr_sec") - F.lag("sched_arr_sec").over(W.partitionBy(*STOP_KEYS).orderBy("sched_arr_sec"))
    hour = F.floor(F.pmod("sched_arr_sec", F.lit(clock.DAY_S)) / 3600).cast("int")
    g = d.withColumns({"gap": gap, "local_hour": hour}).where((F.col("gap") > 0) & (F.col("gap") <= MAX_HEADWAY_S))
    return g.groupBy(*STOP_KEYS, "local_hour").agg(F.median("gap").alias("sched_median_headway_s"))


def observed_headways(arrivals: DataFrame) -> DataFrame:
    """Arrivals with headway, local date and hour, inside the accepted band."""
    h = headways(arrivals, STOP_KEYS, "arr_ts", "trip_id").where(F.col("headway_s").between(MIN_HEADWAY_S, MAX_HEADWAY_S))
    local = clock.local_seconds(F.col("arr_ts"))
    return h.withColumns({"arr_local": local, "local_date": clock.local_date(local), "local_hour": clock.local_hour(local)})


def headway_cells(arrivals: DataFrame, sched_hw: DataFrame) -> DataFrame:
    """Headway statistics per route x direction x stop x local date x hour."""
    keys = [*STOP_KEYS, "local_date", "local_hour"]
    obs = observed_headways(arrivals)
    obs = null_safe_join(obs, sched_hw, [*STOP_KEYS, "local_hour"])
    short = F.when(F.col("sched_median_headway_s").isNotNull(), (F.col("headway_s") < SHORT_FRAC * F.col("sched_median_headway_s")).cast("double"))
    mean, sd = F.avg("headway_s"), F.stddev_samp("headway_s")
    cells = _with_short_share(obs.withColumn("__short", short), keys, [
        F.count(F.lit(1)).alias("n_headways"), F.countDistinct("arr_ts").alias("n_arrivals"), F.median("headway_s").alias("median_headway_s"),
        mean.alias("mean_headway_s"), F.when(mean > 0, sd / mean).alias("headway_cv"), F.min("headway_s").alias("min_headway_s"),
        F.max("headway_s").alias("max_headway_s"), F.max("sched_median_headway_s").alias("sched_median_headway_s"),
        F.avg("__short").alias("bunch_share_lt50_sched"), F.median("deviation_s").alias("median_deviation_s"),
    ], "bunch_share_lt50_obs")
    a, b = F.col("headway_cv"), F.col("bunch_share_lt50_sched")
    present = a.isNotNull().cast("int") + b.isNotNull().cast("int")
    index = (F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))) / F.nullif(present, F.lit(0))
    return cells.withColumns({"headway_deviation_s": F.col("median_headway_s") - F.col("sched_median_headway_s"), "bunching_index": index})


# ------------------------------------------------------------------ adherence along a trip
def earliest_arrival(arr: DataFrame) -> DataFrame:
    """One arrival per (trip, stop_seq): the earliest."""
    rest = [c for c in arr.columns if c not in ("trip_id", "stop_seq")]
    best = arr.where(F.col("stop_seq").isNotNull()).groupBy("trip_id", "stop_seq").agg(F.min_by(F.struct(*rest), F.struct("arr_ts", "stop_id")).alias("r"))
    return best.select("trip_id", "stop_seq", "r.*")


def segment_run_delta(arr: DataFrame) -> DataFrame:
    """Observed minus scheduled running time between consecutive stops of a trip."""
    n = with_neighbour(arr, ["trip_id"], ["stop_seq"], F.floor(F.col("stop_seq") / 100), next={"to_stop": "stop_id", "t1": "arr_ts", "s1": "sched_arr_sec"})
    n = n.withColumns({"obs_run_s": F.col("t1") - F.col("arr_ts"), "sched_run_s": F.col("s1") - F.col("sched_arr_sec")})
    n = n.where((F.col("sched_run_s") > 0) & (F.col("obs_run_s") > 0) & (F.col("obs_run_s") <= MAX_HEADWAY_S))
    return n.select("trip_id", "route_id", "direction_id", F.col("stop_id").alias("from_stop"), "to_stop", "stop_seq", "obs_run_s", "sched_run_s",
                    (F.col("obs_run_s") - F.col("sched_run_s")).alias("run_delta_s"))


def trip_adherence(arr: DataFrame) -> DataFrame:
    """Start and end delay and running-time deltas per trip with at least two observed stops."""
    ends = arr.groupBy("trip_id", "route_id", "direction_id").agg(
        F.count(F.lit(1)).alias("n_stops_observed"), F.min_by("deviation_s", "stop_seq").alias("start_delay_s"), F.max_by("deviation_s", "stop_seq").alias("end_delay_s"))
    runs = segment_run_delta(arr).groupBy("trip_id").agg(
        F.count(F.lit(1)).alias("n_segments"), F.avg("run_delta_s").alias("mean_running_delta_s"), F.sum("run_delta_s").alias("total_running_delta_s"))
    return ends.where(F.col("n_stops_observed") >= 2).join(runs, "trip_id", "left").withColumn("n_segments", F.coalesce("n_segments", F.lit(0)))


# ------------------------------------------------------------------ packaging
def package_headways(cells: DataFrame, excluded: DataFrame, depth_days: Column, min_headways: int = 2) -> DataFrame:
    """Published rows: excluded local hours and thin cells dropped, numbers rounded."""
    keep = cells.join(excluded.select("local_date", "local_hour").distinct(), ["local_date", "local_hour"], "left_anti").where(F.col("n_headways") >= min_headways)
    tenth = ["median_headway_s", "mean_headway_s", "min_headway_s", "max_headway_s", "sched_median_headway_s", "headway_deviation_s", "median_deviation_s"]
    fine = ["headway_cv", "bunch_share_lt50_sched", "bunch_share_lt50_obs", "bunching_index"]
    out = keep.select(*STOP_KEYS, "local_date", "local_hour", "n_arrivals", "n_headways", *[F.round(F.col(c).cast("double"), 1).alias(c) for c in tenth],
                      *[F.round(c, 4).alias(c) for c in fine])
    return out.withColumn("archive_depth_days", depth_days).withColumn("preliminary", F.col("archive_depth_days") < 14)


def package_manifest(packaged: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows published and rows before filtering, per local date."""
    after = packaged.groupBy("local_date").agg(F.count(F.lit(1)).alias("rows"))
    return cells.groupBy("local_date").agg(F.count(F.lit(1)).alias("rows_before_filter")).join(after, "local_date", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
