"""Five-minute service indicators, alerts, coverage flags, archive depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions import clock
from kerbline.functions.codes import LINE_ORDER, alert_severity
from kerbline.plans.series import with_neighbour, with_running
from kerbline.plans.spine import dense_bins, safe_ratio

BIN_S = clock.BIN_S
BUNCH_PAIR_FRAC = 0.25
PARTIAL_FRAC = 0.60
FULL_DAY_HOURS = 20
DEPTH_DAYS = 14
TIERS = ("high", "medium", "low")


def _bin(local: Column) -> Column:
    return F.floor(local / BIN_S) * BIN_S


def vehicles_reporting(pings: DataFrame) -> DataFrame:
    """Distinct vehicles in the last poll of each 5-minute bin.

    (poll, vehicle) pairs are reduced first, so the count per poll is a plain sum.
    """
    p = pings.where(F.col("vehicle_id").isNotNull()).select((F.col("poll_ts") - clock.LOCAL_OFFSET_S).alias("local_ts"), "vehicle_id").distinct()
    per_poll = p.groupBy("local_ts").agg(F.count(F.lit(1)).alias("veh"))
    return per_poll.groupBy(_bin(F.col("local_ts")).alias("bin_local")).agg(F.max_by("veh", "local_ts").alias("vehicles_reporting"))


def alerts_by_bin(alerts: DataFrame) -> DataFrame:
    """Distinct alerts advertised per bin, by severity; an alert's first poll in the bin decides its tier."""
    local = F.col("poll_ts") - clock.LOCAL_OFFSET_S
    a = alerts.where(F.col("alert_id").isNotNull()).select("alert_id", _bin(local).alias("bin_local"), local.alias("t"), F.coalesce("effect", F.lit(8)).alias("e"))
    one = a.groupBy("bin_local", "alert_id").agg(F.min_by("e", F.struct("t", "e")).alias("e")).withColumn("sev", alert_severity(F.col("e")))
    return one.groupBy("bin_local").agg(*[F.count_if(F.col("sev") == t).alias(f"alerts_{t}") for t in TIERS], F.count(F.lit(1)).alias("alerts_total"))


def ffill(df: DataFrame, column: str, order: str = "bin_local", keys: tuple[str, ...] = ()) -> DataFrame:
    """Carry the last known value over empty bins and flag carried rows."""
    w = with_running(df, list(keys), [order], F.floor(F.col(order) / clock.DAY_S), column, "__f", how="last")
    return w.withColumn(f"{column}_stale", F.col(column).isNull().cast("int")).withColumn(column, F.col("__f")).drop("__f")


def trailing_mean(events: DataFrame, local: str, value: str, span: int = 3600) -> DataFrame:
    """Mean of the values in (bin - span, bin] for each bin that has any.

    Events are summed per 5-minute step first; a step then feeds the twelve bins it belongs to.
    """
    step = (F.ceil(F.col(local) / BIN_S) * BIN_S).alias("step")
    s = events.where(F.col(value).isNotNull()).groupBy(step).agg(F.sum(value).alias("sv"), F.count(F.lit(1)).alias("n"))
    e = s.select("sv", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(span // BIN_S - 1)), lambda i: F.col("step") + i * BIN_S)).alias("bin_local"))
    return e.groupBy("bin_local").agg((F.sum("sv") / F.sum("n")).alias("trailing_mean"), F.sum("n").alias("n_trailing"))


def kpis(pings: DataFrame, active: DataFrame, observed: DataFrame, alerts: DataFrame) -> DataFrame:
    """The systemwide indicator table on dense 5-minute bins.

    ``active``: bin_sec, scheduled_active.  ``observed``: arr_local, headway_s, sched_median_headway_s.
    """
    veh = vehicles_reporting(pings)
    k = dense_bins(veh, "bin_local", BIN_S).join(veh, "bin_local", "left")
    k = ffill(k, "vehicles_reporting").withColumnRenamed("vehicles_reporting_stale", "vehicles_stale")
    k = k.withColumn("bin_sec", F.pmod("bin_local", F.lit(clock.DAY_S))).join(active, "bin_sec", "left").drop("bin_sec")
    k = k.withColumns({"scheduled_active": F.coalesce("scheduled_active", F.lit(0))})
    k = k.withColumn("service_ratio", safe_ratio(F.col("vehicles_reporting"), F.col("scheduled_active")))
    o = observed.withColumn("dev", F.abs(F.col("headway_s") - F.col("sched_median_headway_s")))
    pairs = o.where(F.col("headway_s") < BUNCH_PAIR_FRAC * F.col("sched_median_headway_s")).groupBy(_bin(F.col("arr_local")).alias("bin_local")).agg(
        F.count(F.lit(1)).alias("active_bunching_pairs"))
    trail = trailing_mean(o, "arr_local", "dev").withColumnsRenamed({"trailing_mean": "mean_abs_headway_dev_s", "n_trailing": "n_arrivals_trailing60"})
    k = k.join(pairs, "bin_local", "left").join(trail, "bin_local", "left").join(alerts_by_bin(alerts), "bin_local", "left")
    for t in (*TIERS, "total"):
        k = ffill(k, f"alerts_{t}").drop(f"alerts_{t}_stale")
    zero = ["active_bunching_pairs", "n_arrivals_trailing60", *[f"alerts_{t}" for t in (*TIERS, "total")]]
    return k.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero}).withColumns(
        {"bin_utc": F.col("bin_local") + clock.LOCAL_OFFSET_S, "local_hour": clock.local_hour(F.col("bin_local"))})


def last_available(k: DataFrame, column: str, now_bin: int) -> DataFrame:
    """Newest non-null value of a column and its lag in minutes."""
    v = k.where(F.col(column).isNotNull()).agg(F.max_by(column, "bin_local").alias("value"), F.max("bin_local").alias("bin_local"))
    return v.withColumn("lag_min", F.round((F.lit(now_bin) - F.col("bin_local")) / 60).cast("long"))


# ------------------------------------------------------------------ coverage of the archive
def hourly_counts(rows: DataFrame, ts: str = "poll_ts") -> DataFrame:
    at = F.timestamp_seconds(ts)
    return rows.groupBy("feed", F.date_format(at, "yyyy-MM-dd").alias("day"), F.hour(at).alias("hour")).agg(F.count(F.lit(1)).alias("rows"))


def data_quality(counts: DataFrame, gaps: DataFrame, now_ts: int, full_hours: int = FULL_DAY_HOURS) -> DataFrame:
    """Coverage and status of every feed-hour against the median of full days.

    ``gaps``: feed, gap_start, gap_end (epoch seconds) of known interruptions.
    """
    full = counts.groupBy("feed", "day").agg(F.count(F.lit(1)).alias("h")).where(F.col("h") >= full_hours)
    base = counts.join(full, ["feed", "day"], "left_semi").groupBy("feed", "hour").agg(F.median("rows").alias("baseline"))
    spine = counts.select("feed", "day").distinct().select("feed", "day", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    start = F.unix_timestamp(F.col("day"), "yyyy-MM-dd") + F.col("hour") * 3600
    q = spine.join(counts, ["feed", "day", "hour"], "left").join(base, ["feed", "hour"], "left").withColumns({"rows": F.coalesce("rows", F.lit(0)), "start": start})
    hit = q.join(gaps, "feed").where((F.col("start") < F.col("gap_end")) & (F.col("start") + 3600 > F.col("gap_start")))
    q = q.join(hit.select("feed", "day", "hour").distinct().withColumn("known", F.lit(True)), ["feed", "day", "hour"], "left")
    cov = F.when(F.col("baseline") > 0, F.round(100.0 * F.col("rows") / F.col("baseline"), 1)).when(F.col("rows") > 0, 100.0)
    q = q.withColumn("coverage_pct", cov)
    none, low = F.col("rows") == 0, F.col("coverage_pct") < PARTIAL_FRAC * 100
    running = F.col("start") + 3600 > F.lit(now_ts)
    status = (
        F.when(running & none, "in_progress").when(F.coalesce("known", F.lit(False)) & (none | (F.col("coverage_pct") < 100)), "known_gap")
        .when(none, "missing").when(low, "partial").otherwise("ok")
    )
    q = q.withColumn("status", status)
    return q.select("feed", "day", "hour", "rows", "coverage_pct", "status", F.col("status").isin("partial", "known_gap", "missing").alias("excluded"))


def stale_runs(polls: DataFrame, max_age: int = 300) -> DataFrame:
    """Polls whose feed header has stood still for more than ``max_age`` seconds (batch form).

    Input one row per (feed, poll): poll_ts, header_ts.
    """
    p = with_neighbour(polls, ["feed"], ["poll_ts"], F.floor(F.col("poll_ts") / 3600), prev={"prev_header": "header_ts"})
    moved = F.col("prev_header").isNull() | (F.col("header_ts") != F.col("prev_header"))
    p = p.withColumn("__moved", F.when(moved, F.col("poll_ts")))
    p = with_running(p, ["feed"], ["poll_ts"], F.floor(F.col("poll_ts") / 3600), "__moved", "since", how="last")
    return p.withColumn("stale", F.col("poll_ts") - F.col("since") > max_age).select("feed", "poll_ts", "header_ts", "since", "stale")


def stale_changes(polls: DataFrame, max_age: int = 300, late: int = 600) -> DataFrame:
    """(feed, header_ts, since, at, stale): a row when a feed's header has stood still for ``max_age`` seconds and one when it moves again.

    A header stands until the next one; the last one of a feed until its last poll, or ``late`` seconds before the last poll of all
    feeds.  Input one row per (feed, poll): poll_ts, header_ts.
    """
    polls = polls.where("header_ts is not null and poll_ts is not null")
    hour = F.floor(F.col("poll_ts") / 3600)
    p = with_neighbour(polls, ["feed"], ["poll_ts"], hour, prev={"prev_header": "header_ts"})
    moved = p.where(F.col("prev_header").isNull() | (F.col("header_ts") != F.col("prev_header"))).select("feed", "header_ts", F.col("poll_ts").alias("since"))
    moved = with_neighbour(moved, ["feed"], ["since"], F.floor(F.col("since") / 3600), prev={"before": "since"}, next={"until": "since"})
    last = polls.groupBy("feed").agg(F.max("poll_ts").alias("last"))
    runs = moved.join(last, "feed").crossJoin(F.broadcast(polls.agg((F.max("poll_ts") - late).alias("known"))))  # one row
    stood = F.coalesce("until", F.greatest("last", "known")) - F.col("since") > max_age
    still = runs.where(stood).select("feed", "header_ts", "since", (F.col("since") + max_age).alias("at"), F.lit(True).alias("stale"))
    again = runs.where(F.col("since") - F.col("before") > max_age).select("feed", "header_ts", "since", F.col("since").alias("at"), F.lit(False).alias("stale"))
    return still.unionByName(again)


def stamp_depth(df: DataFrame, days: DataFrame) -> DataFrame:
    """Archive depth in days and the PRELIMINARY mark below 14 days."""
    depth = days.agg(F.countDistinct("day").alias("archive_depth_days"))
    return df.crossJoin(F.broadcast(depth)).withColumn("preliminary", F.col("archive_depth_days") < DEPTH_DAYS)  # one row


# ------------------------------------------------------------------ the wall at an instant
def current_alerts(alerts: DataFrame, within: int = 60) -> DataFrame:
    """Distinct alerts of the freshest poll with severity and sorted routes."""
    newest = alerts.agg(F.max("poll_ts").alias("__m"))
    fresh = alerts.crossJoin(F.broadcast(newest)).where(F.col("poll_ts") >= F.col("__m") - within)  # one row
    g = fresh.where(F.col("alert_id").isNotNull()).groupBy("alert_id").agg(
        F.min_by(F.coalesce("effect", F.lit(8)), F.struct("poll_ts", "event_id")).alias("e"),
        F.array_join(F.array_sort(F.collect_set("route_id")), ",").alias("routes"), F.bool_or("is_subway").alias("subway"))
    return g.select("alert_id", alert_severity(F.col("e")).alias("severity"), "routes", "subway")


def alert_tally(current: DataFrame) -> DataFrame:
    return current.agg(*[F.count_if(F.col("severity") == t).alias(t) for t in TIERS], F.count(F.lit(1)).alias("total"))


def line_status(trains: DataFrame, alerted: DataFrame) -> DataFrame:
    """Trains per line with an alert flag, known lines in display order, others after."""
    n = trains.where(F.col("route_id").isNotNull()).groupBy(F.upper("route_id").alias("line")).agg(F.count(F.lit(1)).alias("count"))
    a = alerted.select(F.upper("route_id").alias("line")).distinct().withColumn("alerted", F.lit(True))
    pos = F.array_position(F.array(*[F.lit(v) for v in LINE_ORDER]), F.col("line"))
    j = n.join(a, "line", "full_outer").withColumn("pos", pos)
    j = j.where((F.col("pos") > 0) | F.col("count").isNotNull())
    return j.select("line", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("alerted", F.lit(False)).alias("alerted"),
                    F.when(F.col("pos") > 0, F.col("pos")).cast("int").alias("display_order"))


def spliced_series(k: DataFrame, live: DataFrame, now_bin: int, bins: int = 36) -> DataFrame:
    """The last ``bins`` rollup bins followed by live bins after the seam; never blended."""
    hist = k.where((F.col("bin_local") > now_bin - bins * BIN_S) & (F.col("bin_local") <= now_bin)).withColumn("basis", F.lit("rollup"))
    seam = hist.agg(F.max("bin_local").alias("seam"))
    fresh = live.crossJoin(F.broadcast(seam)).where((F.col("bin_local") > F.coalesce("seam", F.lit(0))) & (F.col("bin_local") <= now_bin)).drop("seam")
    both = hist.unionByName(fresh.withColumn("basis", F.lit("live")), allowMissingColumns=True)
    return both.crossJoin(F.broadcast(seam))  # one row


def wall(now_ts: int, vehicles: DataFrame, active: DataFrame, pairs: DataFrame, current: DataFrame) -> DataFrame:
    """Counts, ratio, bunching pairs and alerts at an instant, as one row."""
    bin_sec = (now_ts - clock.LOCAL_OFFSET_S) // BIN_S * BIN_S % clock.DAY_S
    v = vehicles.agg(F.count(F.lit(1)).alias("vehicles"))
    a = active.where(F.col("bin_sec") == bin_sec).agg(F.coalesce(F.max("scheduled_active"), F.lit(0)).alias("scheduled_active"))
    p = pairs.agg(F.count(F.lit(1)).alias("bunching_pairs"), F.countDistinct("route_id").alias("routes_bunching"))
    one = v.crossJoin(a).crossJoin(p).crossJoin(alert_tally(current))  # global aggregates, one row each
    return one.withColumn("service_ratio", safe_ratio(F.col("vehicles"), F.col("scheduled_active")))
