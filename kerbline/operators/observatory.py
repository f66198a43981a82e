"""Summaries over headway cells: route lists, series, leagues, distributions, dossiers.

``cells`` is the output of ``headways.headway_cells``: one row per stop-hour, so a
route's rows are bounded by stops x hours x days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.plans.ranks import with_rank_columns
from kerbline.plans.series import with_neighbour, with_running

MIN_DAYS, MIN_HEADWAYS, DEPTH_DAYS = 3, 50, 14


def route_stats(cells: DataFrame) -> DataFrame:
    """Reliability of each route on the latest observed day."""
    last = cells.agg(F.max("local_date").alias("__d"))
    c = cells.crossJoin(F.broadcast(last)).where(F.col("local_date") == F.col("__d"))  # one row
    return c.groupBy("route_id").agg(
        F.max("local_date").alias("date"), F.median("median_headway_s").alias("median_headway_s"), F.avg("bunching_index").alias("bunching_index"),
        F.avg("sched_median_headway_s").alias("sched_median_headway_s"), F.sum("n_headways").alias("n_headways"),
        F.countDistinct("stop_id").alias("n_stops_observed"), F.countDistinct("local_hour").alias("coverage_hours"))


def headway_series(cells: DataFrame, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Route-hour series inside an optional date range; dates are partition values of the stored table."""
    c = cells
    if lo:
        c = c.where(F.col("local_date") >= lo)
    if hi:
        c = c.where(F.col("local_date") <= hi)
    g = c.groupBy("route_id", "local_date", "local_hour").agg(
        F.median("median_headway_s").alias("median_headway_s"), F.median("sched_median_headway_s").alias("sched_median_headway_s"),
        F.avg("bunching_index").alias("bunching_index"), F.sum("n_headways").alias("n_headways"), F.countDistinct("stop_id").alias("n_stops"))
    return g.withColumn("headway_deviation_s", F.col("median_headway_s") - F.col("sched_median_headway_s"))


def stop_series(cells: DataFrame, stop_id: str) -> DataFrame:
    """Stop-hour rows of one stop, all routes."""
    return cells.where(F.col("stop_id") == stop_id).select(
        "route_id", "direction_id", "local_date", "local_hour", "median_headway_s", "sched_median_headway_s", "headway_deviation_s", "n_headways")


def headway_stop_summary(cells: DataFrame, offsets: DataFrame) -> DataFrame:
    """Stops of each route and direction with their position along the line."""
    g = cells.groupBy("route_id", "direction_id", "stop_id").agg(
        F.median("median_headway_s").alias("median_headway_s"), F.median("sched_median_headway_s").alias("sched_median_headway_s"),
        F.avg("bunching_index").alias("bunching_index"), F.max("headway_cv").alias("max_headway_cv"), F.sum("n_headways").alias("n_headways"),
        F.countDistinct("local_date").alias("observed_days"))
    return g.join(offsets.select("route_id", "direction_id", "stop_id", "stop_offset_ft"), ["route_id", "direction_id", "stop_id"], "left")


def gated_routes(cells: DataFrame, min_days: int = MIN_DAYS, min_headways: int = MIN_HEADWAYS) -> DataFrame:
    g = cells.groupBy("route_id").agg(
        F.countDistinct("local_date").alias("observed_days"), F.sum("n_headways").alias("n_headways"), F.avg("bunching_index").alias("bunching_index"),
        F.avg("headway_cv").alias("headway_cv"), F.median("median_headway_s").alias("median_headway_s"), F.median("headway_deviation_s").alias("median_deviation_s"),
        F.median(F.abs("headway_deviation_s")).alias("median_abs_deviation_s"))
    thin = (F.col("observed_days") < min_days) | (F.col("n_headways") < min_headways) | F.col("bunching_index").isNull()
    return g.withColumn("qualifies", ~thin)


def leagues(cells: DataFrame, n: int = 15) -> DataFrame:
    """Most and least reliable qualifying routes with the number of routes left out."""
    g = gated_routes(cells)
    out = g.agg(F.count_if(~F.col("qualifies")).alias("excluded_thin_routes"))
    q = g.where("qualifies").drop("qualifies")
    best = q.orderBy("bunching_index", "route_id").limit(n).withColumn("board", F.lit("most_reliable"))
    worst = q.orderBy(F.desc("bunching_index"), F.desc("route_id")).limit(n).withColumn("board", F.lit("least_reliable"))
    return best.unionByName(worst).crossJoin(F.broadcast(out))  # one row


def most_improved(cells: DataFrame, n: int = 15, min_dates: int = 4) -> DataFrame:
    """Change of the mean absolute deviation between the first and second half of the dates."""
    dates = cells.select("local_date").distinct()
    place = dates.select("local_date", F.row_number().over(W.orderBy("local_date")).alias("i"), F.count(F.lit(1)).over(W.partitionBy(F.lit(1))).alias("nd"))
    place = place.where(F.col("nd") >= min_dates)  # one row per calendar day
    late = F.col("i") > F.floor(F.col("nd") / 2)
    dev = F.abs("headway_deviation_s")
    g = cells.join(place, "local_date").groupBy("route_id").agg(F.avg(F.when(~late, dev)).alias("early_abs_dev_s"), F.avg(F.when(late, dev)).alias("late_abs_dev_s"))
    q = gated_routes(cells).where("qualifies").select("route_id")
    g = g.join(q, "route_id", "left_semi").withColumn("improvement_s", F.col("early_abs_dev_s") - F.col("late_abs_dev_s")).where(F.col("improvement_s").isNotNull())
    return g.orderBy(F.desc("improvement_s"), "route_id").limit(n)


def hour_profile(series: DataFrame) -> DataFrame:
    """Typical hour: mean over dates of the hourly medians, in minutes."""
    return series.groupBy("route_id", "local_hour").agg(
        (F.avg("median_headway_s") / 60).alias("observed_min"), (F.avg("sched_median_headway_s") / 60).alias("scheduled_min"))


def metric_distribution(routes: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Histogram of a metric over routes; a route table is small, the span comes from one aggregate."""
    v = routes.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    span = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n_routes"))
    j = v.crossJoin(F.broadcast(span))  # one row
    b = F.least(F.lit(bins), F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins) + 1)
    return j.groupBy(F.coalesce(b, F.lit(1)).cast("int").alias("bin"), "lo", "hi", "n_routes").agg(F.count(F.lit(1)).alias("n"))


def upper_median(routes: DataFrame, column: str) -> DataFrame:
    """The element at position n/2 of the sorted values."""
    v = routes.where(F.col(column).isNotNull())
    ranked = with_rank_columns(v, column, {"b": F.col("below"), "k": F.col("n"), "t": F.col("total")})
    at = F.floor(F.col("t") / 2)
    return ranked.where((F.col("b") <= at) & (at < F.col("b") + F.col("k"))).agg(F.max(column).alias("upper_median"))


def adherence_summary(daily: DataFrame, min_pings: int = 500) -> DataFrame:
    """Route adherence pooled over days; routes with few positions are left out."""
    g = daily.groupBy("route_id").agg(
        F.sum("n_on_route").alias("on"), F.sum("n_pings").alias("n_pings"), F.sum("n_trips").alias("n_trips"),
        F.median("median_perp_ft").alias("median_perp_ft"), F.max("p90_perp_ft").alias("worst_day_p90_perp_ft"), F.count(F.lit(1)).alias("observed_days"))
    return g.where(F.col("n_pings") >= min_pings).withColumn("adherence_pct", 100.0 * F.col("on") / F.col("n_pings")).drop("on")


# ------------------------------------------------------------------ shapes, spacing, ribbons
def shape_length(points: DataFrame, chunk: int = 1000) -> DataFrame:
    """Cumulative length at each vertex of each shape."""
    c = F.floor(F.col("seq") / chunk)
    p = with_neighbour(points.select("shape_id", "seq", "x_ft", "y_ft"), ["shape_id"], ["seq"], c, prev={"px": "x_ft", "py": "y_ft"})
    p = p.withColumn("step", F.coalesce(F.hypot(F.col("x_ft") - F.col("px"), F.col("y_ft") - F.col("py")), F.lit(0.0)))
    return with_running(p, ["shape_id"], ["seq"], c, "step", "cum_ft").drop("step", "px", "py")


def stop_spacing(offsets: DataFrame) -> DataFrame:
    """Gaps between consecutive stop offsets of each shape; a shape has at most some hundred stops."""
    w = W.partitionBy("shape_id").orderBy("stop_offset_ft", "stop_id")
    g = offsets.withColumn("gap", F.col("stop_offset_ft") - F.lag("stop_offset_ft").over(w)).where(F.col("gap").isNotNull())
    return g.groupBy("shape_id").agg(
        (F.count(F.lit(1)) + 1).alias("n_stops"), F.median("gap").alias("median_spacing_ft"), F.avg("gap").alias("mean_spacing_ft"),
        F.min("gap").alias("min_spacing_ft"), F.max("gap").alias("max_spacing_ft"))


def pctile_within(df: DataFrame, key: str, col: str, out: str) -> DataFrame:
    """Share of the other rows of the group that are strictly lower; 0.5 for a single row."""
    share = F.when(F.col("total") > 1, F.col("below") / (F.col("total") - 1)).otherwise(0.5)
    return with_rank_columns(df, col, {out: share}, [key])


def ribbon(segs: DataFrame, geom: DataFrame) -> DataFrame:
    """Segments that have a place on the map, with their speed percentile within the route."""
    j = segs.join(geom, ["route_id", "from_stop", "to_stop"], "left")
    placed = j.where(F.col("from_lat").isNotNull() & F.col("to_lat").isNotNull() & F.col("wt_speed_mph").isNotNull())
    return pctile_within(placed, "route_id", "wt_speed_mph", "speed_pctile")


def best_worst(df: DataFrame, area: str, score: str, key: str, n: int = 10) -> DataFrame:
    """N best and N worst rows per area; the rank filter keeps only N rows per map task before the shuffle."""
    def side(order, label):
        rk = F.row_number().over(W.partitionBy(area).orderBy(*order))
        return df.withColumn("rank_in_area", rk).where(F.col("rank_in_area") <= n).withColumn("side", F.lit(label))

    best = side([F.desc_nulls_last(score), F.asc(key)], "best")
    return best.unionByName(side([F.asc_nulls_last(score), F.desc(key)], "worst"))


# ------------------------------------------------------------------ time-space diagram
def live_points(latest: DataFrame, offsets: DataFrame) -> DataFrame:
    """Newest vehicle positions placed at their next stop's offset."""
    return latest.join(offsets, ["route_id", "direction_id", "stop_id"]).select(
        "vehicle_id", "trip_id", "route_id", "direction_id", "ts", F.round("stop_offset_ft", 1).alias("offset_ft"))


def merge_live(observed: DataFrame, live: DataFrame) -> DataFrame:
    """Observed points plus newer live ones; trips only seen live are added."""
    last = observed.groupBy("trip_id").agg(F.max("ts").alias("__last"))
    fresh = live.join(last, "trip_id", "left").where(F.col("__last").isNull() | (F.col("__last") < F.col("ts")))
    cols = ["trip_id", "ts", "offset_ft"]
    return observed.select(*cols, F.lit(False).alias("live")).unionByName(fresh.select(*cols, F.lit(True).alias("live")))


def trip_heads(merged: DataFrame) -> DataFrame:
    """Newest point of each trip."""
    return merged.groupBy("trip_id").agg(F.max_by(F.struct("ts", "offset_ft", "live"), "ts").alias("h")).select("trip_id", "h.*")


def convergence(traj: DataFrame, step: int, gap: int = 150, band: float = 300.0) -> DataFrame:
    """First point where a trip comes within ``gap`` seconds of the trip before it at the same offset.

    Trips are ordered by start within route and direction; every second sample is tested.
    """
    keys = ["route_id", "direction_id"]
    starts = traj.groupBy(*keys, "trip_id").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n")).where("n > 1")
    order = with_neighbour(starts, keys, ["start", "trip_id"], F.floor(F.col("start") / 86400), prev={"before": "trip_id"}).where(F.col("before").isNotNull())
    b = traj.join(order.select("trip_id", "start", "before"), "trip_id").withColumn("k", (F.col("ts") - F.col("start")) / step)
    b = b.where(F.col("k") % 2 == 0).select("trip_id", "before", F.col("ts").alias("bt"), F.col("offset_ft").alias("bo"))
    b = b.withColumn("bin", F.explode(F.array(*[(F.floor(F.col("bo") / band) + i) for i in (-1, 0, 1)])))
    a = traj.select(F.col("trip_id").alias("before"), F.col("ts").alias("at"), F.col("offset_ft").alias("ao"), F.floor(F.col("offset_ft") / band).alias("bin"))
    near = b.join(a, ["before", "bin"]).where(F.abs(F.col("ao") - F.col("bo")) < band).withColumn("dt", F.abs(F.col("at") - F.col("bt")))
    near = near.where(F.col("dt") < gap)
    best = near.groupBy("trip_id", "before").agg(F.min_by(F.struct("bt", "at", "bo"), F.struct("bt", "dt", "at")).alias("m"))
    return best.select("trip_id", "before", ((F.col("m.bt") + F.col("m.at")) / 2).alias("ts"), F.col("m.bo").alias("offset_ft"))


def delay_vs_schedule(points: DataFrame, sched: DataFrame, stops: DataFrame, band: float = 400.0, limit: int = 3600) -> DataFrame:
    """Minutes behind the nearest scheduled point in the offset band, and the nearest stop.

    The time limit is part of the join key too, so only points that can count are paired.  Points of one line, second and offset are
    looked up once, among distinct scheduled seconds: what meets is bounded by the seconds of the time limit, not by the number of trips.
    """
    keys = ["route_id", "direction_id"]
    near3 = lambda c, w: F.array(*[(F.floor(c / w) + i) for i in (-1, 0, 1)])
    at = [*keys, "ts", "offset_ft"]
    p = points.select(*at).distinct().withColumn("ob", F.explode(near3(F.col("offset_ft"), band))).withColumn("tb", F.explode(near3(F.col("ts"), limit)))
    s = sched.select(*at).distinct().select(*keys, F.col("ts").alias("st"), F.col("offset_ft").alias("so"), F.floor(F.col("offset_ft") / band).alias("ob"), F.floor(F.col("ts") / limit).alias("tb"))
    j = p.join(s, [*keys, "ob", "tb"]).where((F.abs(F.col("so") - F.col("offset_ft")) < band) & (F.abs(F.col("st") - F.col("ts")) < limit))
    near = j.groupBy(*at).agg(F.min(F.struct(F.abs(F.col("st") - F.col("ts")).alias("d"), "st")).alias("b"))
    best = points.select("trip_id", *at).join(near, at).groupBy("trip_id", "ts").agg(F.min("b").alias("b")).select("trip_id", "ts", F.col("b.st").alias("sched_ts"))
    # a line's stops are a short list: one array per line, searched in place
    line = stops.groupBy(*keys).agg(F.collect_list(F.struct("stop_offset_ft", "stop_id")).alias("__stops"))
    out = points.join(best, ["trip_id", "ts"], "left").join(line, keys, "left")
    nearest = F.array_min(F.transform("__stops", lambda x: F.struct(F.abs(x.stop_offset_ft - F.col("offset_ft")).alias("d"), x.stop_offset_ft.alias("o"), x.stop_id.alias("stop_id"))))
    return out.select("trip_id", "ts", "offset_ft", nearest.getField("stop_id").alias("nearest_stop"), F.round((F.col("ts") - F.col("sched_ts")) / 60).cast("long").alias("delay_min"))


def planner_table(routes: DataFrame, stats: DataFrame, adherence: DataFrame, route_alerts: DataFrame, lines: DataFrame) -> DataFrame:
    """Bus routes and rail lines under one schema."""
    r = routes.join(stats, "route_id", "left").join(adherence, "route_id", "left").join(route_alerts, "route_id", "left")
    r = r.select(F.lit("bus").alias("mode"), F.col("route_id").alias("id"), "trips", "median_headway_s", "bunching_index", "adherence_pct", F.coalesce("alerts", F.lit(0)).alias("alerts"))
    ln = lines.select(F.lit("subway").alias("mode"), F.col("line").alias("id"), F.col("count").alias("trips"), F.col("alerted").cast("long").alias("alerts"))
    return r.unionByName(ln, allowMissingColumns=True)


def upcoming(updates: DataFrame, now: int, grace: int = 30, n: int = 16) -> DataFrame:
    """The soonest arrivals of every station; the rank filter bounds what is shuffled."""
    u = updates.where(F.col("arrival_time") >= now - grace)
    rk = F.row_number().over(W.partitionBy("stop_id").orderBy("arrival_time", "trip_id"))
    return u.withColumn("rk", rk).where(F.col("rk") <= n).select("stop_id", "trip_id", "route_id", "arrival_time", F.greatest(F.lit(0), F.col("arrival_time") - now).alias("eta_s"), "rk")


def interpolate_trains(rows: DataFrame, hops: DataFrame, now: int) -> DataFrame:
    """Place a train between its previous and next stop by elapsed share of the scheduled hop.

    The share stays in [0.05, 0.95]; an incoming train is at least 0.85 along.
    ``hops``: route_id, stop_id, hop_s, line (array of x, y along the hop).
    """
    share = F.least(F.lit(0.95), F.greatest(F.lit(0.05), (F.lit(now) - F.col("ts")) / F.nullif(F.col("hop_s"), F.lit(0))))
    share = F.when(F.col("incoming"), F.greatest(share, F.lit(0.85))).otherwise(share)
    j = rows.join(hops, ["route_id", "stop_id"]).withColumn("fraction", F.coalesce(share, F.lit(0.5)))
    from kerbline.functions import planar as P

    j = j.withColumns({"__len": P.line_length(F.col("line")), "__edges": P.edges(F.col("line"))}).withColumn("__goal", F.col("fraction") * F.col("__len"))
    start = F.struct(F.lit(0.0).alias("done"), F.col("line")[0].x.alias("x"), F.col("line")[0].y.alias("y"))

    def walk(acc, e):
        length = F.hypot(e.x1 - e.x0, e.y1 - e.y0)
        u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("__goal") - acc.done) / F.nullif(length, F.lit(0.0))))
        u = F.coalesce(u, F.lit(0.0))
        moved = F.struct((acc.done + length).alias("done"), (e.x0 + u * (e.x1 - e.x0)).alias("x"), (e.y0 + u * (e.y1 - e.y0)).alias("y"))
        return F.when(acc.done < F.col("__goal"), moved).otherwise(acc)

    j = j.withColumn("__at", F.aggregate("__edges", start, walk))
    return j.select("vehicle_id", "route_id", "stop_id", "fraction", F.col("__at.x").alias("x"), F.col("__at.y").alias("y"))


# ------------------------------------------------------------------ one record per route
def dossier(ridership: DataFrame, slow: DataFrame, enforcement: DataFrame, stats: DataFrame, n: int = 5) -> DataFrame:
    """All routes at once: ridership, slowest segments, enforcement and reliability, one row per route."""
    hourly = ridership.groupBy("route_id").agg(
        F.sum("total_boardings").alias("total_boardings"),
        F.max_by("hod", F.struct("total_boardings", -F.col("hod"))).alias("peak_hour"))
    rk = F.row_number().over(W.partitionBy("route_id").orderBy("wt_speed_mph", "from_stop", "to_stop"))
    worst = slow.withColumn("rk", rk).where(F.col("rk") <= n).groupBy("route_id").agg(
        F.min("wt_speed_mph").alias("slowest_mph"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "from_stop", "to_stop"))), lambda x: F.concat(x.from_stop, F.lit(">"), x.to_stop)), ",").alias("slowest_segments"))
    out = hourly.join(worst, "route_id", "full_outer").join(enforcement, "route_id", "full_outer").join(stats, "route_id", "full_outer")
    return out.select("route_id", "total_boardings", "peak_hour", "slowest_mph", "slowest_segments", F.coalesce("violations_total", F.lit(0)).alias("violations_total"),
                      "median_headway_s", "bunching_index")


