"""Queries on headway cells, shapes and the time-space diagram."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.catalog import demand as DQ
from kerbline.catalog import inputs as I
from kerbline.catalog import realtime as R
from kerbline.catalog.registry import query, r
from kerbline.functions import planar
from kerbline.operators import demand as D
from kerbline.operators import observatory as O
from kerbline.operators import speed as SP
from kerbline.operators import supply as S
from kerbline.operators import trajectory as T
from kerbline.operators.thinning import thin
from kerbline.plans.spread import dealt
from kerbline.session import materialize

P = I.pings


def cells(s, d):
    return materialize(R.cells(s, d), "cells")


STATS = """SELECT route_id, max(local_date) AS date, median(median_headway_s) AS median_headway_s, round(avg(bunching_index), 4) AS bunching_index, round(avg(sched_median_headway_s), 4) AS sched_median_headway_s,
  CAST(sum(n_headways) AS BIGINT) AS n_headways, count(DISTINCT stop_id) AS n_stops_observed, count(DISTINCT local_hour) AS coverage_hours FROM hcells WHERE local_date = (SELECT max(local_date) FROM hcells) GROUP BY 1"""


def stats(s, d):
    return O.route_stats(cells(s, d)).withColumns({"bunching_index": r("bunching_index"), "sched_median_headway_s": r("sched_median_headway_s")})


query("agg62_route_stats", STATS, "hcells")(stats)
ALL_DAYS = """SELECT route_id, local_date, local_hour, median(median_headway_s) AS median_headway_s, median(sched_median_headway_s) AS sched_median_headway_s, round(avg(bunching_index), 4) AS bunching_index,
  CAST(sum(n_headways) AS BIGINT) AS n_headways, count(DISTINCT stop_id) AS n_stops, median(median_headway_s) - median(sched_median_headway_s) AS headway_deviation_s
FROM hcells {days} GROUP BY 1, 2, 3"""
SERIES = ALL_DAYS.format(days="WHERE local_date BETWEEN '2024-01-01' AND '2024-01-03'")


def series(s, d, first="2024-01-01", last="2024-01-03"):
    return O.headway_series(cells(s, d), first, last).withColumn("bunching_index", r("bunching_index"))


query("agg63_headway_series", SERIES, "hcells")(series)
query("agg63_stop_series", "SELECT route_id, direction_id, local_date, local_hour, median_headway_s, sched_median_headway_s, headway_deviation_s, n_headways FROM hcells WHERE stop_id = 'S3'", "hcells")(
    lambda s, d: O.stop_series(R.cells(s, d), "S3"))
query("agg64_stop_summary", """
SELECT h.route_id, h.direction_id, h.stop_id, median(median_headway_s) AS median_headway_s, median(sched_median_headway_s) AS sched_median_headway_s, round(avg(bunching_index), 4) AS bunching_index,
  round(max(headway_cv), 4) AS max_headway_cv, CAST(sum(n_headways) AS BIGINT) AS n_headways, count(DISTINCT local_date) AS observed_days, any_value(stop_offset_ft) AS stop_offset_ft
FROM hcells h LEFT JOIN line_stops l ON l.route_id = h.route_id AND l.direction_id = h.direction_id AND l.stop_id = h.stop_id GROUP BY 1, 2, 3""", "hcells line_stops")(
    lambda s, d: O.headway_stop_summary(R.cells(s, d), I.line_stops(s, d)).withColumns({"bunching_index": r("bunching_index"), "max_headway_cv": r("max_headway_cv")}))
GATED = """SELECT *, NOT (observed_days < 3 OR n_headways < 50 OR bunching_index IS NULL) AS q FROM (SELECT route_id, count(DISTINCT local_date) AS observed_days, CAST(sum(n_headways) AS BIGINT) AS n_headways,
  avg(bunching_index) AS bunching_index, avg(headway_cv) AS headway_cv, median(median_headway_s) AS median_headway_s, median(headway_deviation_s) AS median_deviation_s,
  median(abs(headway_deviation_s)) AS median_abs_deviation_s FROM hcells GROUP BY 1)"""


def _rounds():
    return {"bunching_index": r("bunching_index"), "headway_cv": r("headway_cv")}


query("agg65_leagues", f"""WITH g AS ({GATED}), x AS (SELECT 'most_reliable' AS board, * FROM (SELECT * FROM g WHERE q ORDER BY bunching_index, route_id LIMIT 3)
  UNION ALL SELECT 'least_reliable', * FROM (SELECT * FROM g WHERE q ORDER BY bunching_index DESC, route_id DESC LIMIT 3))
SELECT * EXCLUDE (q) REPLACE (round(bunching_index, 4) AS bunching_index, round(headway_cv, 4) AS headway_cv), (SELECT count(*) FROM g WHERE NOT q) AS excluded_thin_routes FROM x""", "hcells")(
    lambda s, d: O.leagues(cells(s, d), 3).withColumns(_rounds()))
query("agg66_most_improved", f"""WITH ds AS (SELECT local_date, row_number() OVER (ORDER BY local_date) AS i, count(*) OVER () AS nd FROM (SELECT DISTINCT local_date FROM hcells)),
m AS (SELECT route_id, avg(abs(headway_deviation_s)) FILTER (i <= nd // 2) AS e, avg(abs(headway_deviation_s)) FILTER (i > nd // 2) AS l FROM hcells JOIN ds USING (local_date) WHERE nd >= 4 GROUP BY 1)
SELECT route_id, round(e, 4) AS early_abs_dev_s, round(l, 4) AS late_abs_dev_s, round(e - l, 4) AS improvement_s FROM m WHERE e - l IS NOT NULL AND route_id IN (SELECT route_id FROM ({GATED}) WHERE q)
ORDER BY e - l DESC, route_id LIMIT 15""", "hcells")(lambda s, d: O.most_improved(cells(s, d)).withColumns({c: r(c) for c in ("early_abs_dev_s", "late_abs_dev_s", "improvement_s")}))
query("agg77_hour_profile", f"SELECT route_id, local_hour, round(avg(median_headway_s) / 60, 4) AS observed_min, round(avg(sched_median_headway_s) / 60, 4) AS scheduled_min FROM ({ALL_DAYS.format(days='')}) GROUP BY 1, 2", "hcells")(
    lambda s, d: O.hour_profile(series(s, d, "0001-01-01", "9999-12-31")).withColumns({"observed_min": r("observed_min"), "scheduled_min": r("scheduled_min")}))
# route speeds of the segment table stand in for a metric with many routes
RS = f"SELECT route_id, sum(speed * trips) / sum(trips) AS v FROM segment_speeds WHERE {DQ.PW} GROUP BY 1"
query("agg78_metric_distribution", f"""WITH v AS (SELECT round(v, 6) AS v FROM ({RS})), s AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n_routes FROM v)
SELECT CAST(least(20, floor((v - lo) / (hi - lo) * 20) + 1) AS INT) AS bin, lo, hi, n_routes, count(*) AS n FROM v, s GROUP BY ALL""", "segment_speeds")(
    lambda s, d: O.metric_distribution(SP.route_speed(I.segment_speeds(s, d), 0).withColumn("wt_speed_mph", r("wt_speed_mph", 6)), "wt_speed_mph"))
query("agg78_upper_median", f"SELECT list_sort(list(round(v, 6)))[count(*) // 2 + 1] AS upper_median FROM ({RS})", "segment_speeds")(
    lambda s, d: O.upper_median(SP.route_speed(I.segment_speeds(s, d), 0).withColumn("wt_speed_mph", r("wt_speed_mph", 6)), "wt_speed_mph"))

# ------------------------------------------------------------------ shapes
query("win11_shape_length", """
SELECT shape_id, seq, round(sum(coalesce(step, 0)) OVER (PARTITION BY shape_id ORDER BY seq), 4) AS cum_ft FROM (
  SELECT *, sqrt(pow(x_ft - lag(x_ft) OVER w, 2) + pow(y_ft - lag(y_ft) OVER w, 2)) AS step FROM shape_points WINDOW w AS (PARTITION BY shape_id ORDER BY seq))""", "shape_points")(
    lambda s, d: O.shape_length(I.shape_points(s, d)).select("shape_id", "seq", r("cum_ft").alias("cum_ft")))
query("win12_stop_spacing", """
SELECT shape_id, count(*) + 1 AS n_stops, median(gap) AS median_spacing_ft, round(avg(gap), 4) AS mean_spacing_ft, min(gap) AS min_spacing_ft, max(gap) AS max_spacing_ft FROM (
  SELECT shape_id, stop_offset_ft - lag(stop_offset_ft) OVER (PARTITION BY shape_id ORDER BY stop_offset_ft, stop_id) AS gap FROM stop_offsets) WHERE gap IS NOT NULL GROUP BY 1""", "stop_offsets")(
    lambda s, d: O.stop_spacing(I.stop_offsets(s, d)).withColumn("mean_spacing_ft", r("mean_spacing_ft")))
query("win18_pctile_within", f"""SELECT route_id, from_stop, to_stop, wt_speed_mph, round(CASE WHEN count(*) OVER (PARTITION BY route_id) = 1 THEN 0.5 ELSE percent_rank() OVER (PARTITION BY route_id ORDER BY wt_speed_mph) END, 4) AS speed_pctile
FROM ({DQ.SEG})""", "segment_speeds")(lambda s, d: O.pctile_within(DQ._seg(s, d), "route_id", "wt_speed_mph", "speed_pctile").select(
    "route_id", "from_stop", "to_stop", "wt_speed_mph", r("speed_pctile").alias("speed_pctile")))


def seg_geometry(s, d):
    g = I.segment_speeds(s, d).select("route_id", "from_stop", "to_stop").distinct()
    n = F.substring("from_stop", 2, 5).cast("int")
    return g.where(n < 9).select("route_id", "from_stop", "to_stop", (F.lit(40.6) + n * 0.01).alias("from_lat"), (F.lit(40.6) + n * 0.01 + 0.005).alias("to_lat"))


query("jon25_ribbon", f"""WITH p AS (SELECT *, CAST(from_stop[2:] AS INT) AS n FROM ({DQ.SEG}) WHERE CAST(from_stop[2:] AS INT) < 9)
SELECT route_id, from_stop, to_stop, wt_speed_mph, round(40.6 + n * 0.01, 6)::DOUBLE AS from_lat, round(CASE WHEN count(*) OVER (PARTITION BY route_id) = 1 THEN 0.5 ELSE percent_rank() OVER (PARTITION BY route_id ORDER BY wt_speed_mph) END, 4) AS speed_pctile FROM p""", "segment_speeds")(
    lambda s, d: O.ribbon(DQ._seg(s, d), seg_geometry(s, d)).select("route_id", "from_stop", "to_stop", "wt_speed_mph", r("from_lat", 6).alias("from_lat"), r("speed_pctile").alias("speed_pctile")))
query("win20_best_worst", """WITH b AS (SELECT site_id, site_name, nation, score FROM sites)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY score DESC, site_id) AS rank_in_area, 'best' AS side FROM b) WHERE rank_in_area <= 2
UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY score, site_id DESC) AS rank_in_area, 'worst' AS side FROM b) WHERE rank_in_area <= 2""", "sites")(
    lambda s, d: O.best_worst(I.sites(s, d).select("site_id", "site_name", "nation", "score"), "nation", "score", "site_id", 2).withColumn("rank_in_area", F.col("rank_in_area").cast("long")))

# ------------------------------------------------------------------ time-space diagram
OFFS = "SELECT route_id, direction_id, stop_id, min(offset_ft) AS stop_offset_ft FROM pings GROUP BY 1, 2, 3"


def ping_offsets(s, d):
    return P(s, d).groupBy("route_id", "direction_id", "stop_id").agg(F.min("offset_ft").alias("stop_offset_ft"))


def live(s, d):
    return O.live_points(T.latest_two(P(s, d), 43200), ping_offsets(s, d))


LIVE = f"""SELECT w.vehicle_id, w.trip_id, w.route_id, w.direction_id, w.ts, round(stop_offset_ft, 1) AS offset_ft FROM (SELECT * FROM pings QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, event_id DESC) = 1) w
JOIN ({OFFS}) o ON o.route_id = w.route_id AND o.direction_id = w.direction_id AND o.stop_id = w.stop_id WHERE w.ts >= (SELECT max(ts) FROM pings) - 43200"""
query("jon31_live_points", LIVE, "pings")(live)
MERGED = f"""SELECT trip_id, ts, offset_ft, FALSE AS live FROM traj UNION ALL SELECT l.trip_id, l.ts, l.offset_ft, TRUE FROM ({LIVE}) l LEFT JOIN (SELECT trip_id, max(ts) AS m FROM traj GROUP BY 1) t ON t.trip_id = l.trip_id WHERE m IS NULL OR m < l.ts"""
query("jon34_merge_live", f"SELECT trip_id, ts, round(offset_ft, 6) AS offset_ft, live FROM ({MERGED})", "pings traj")(
    lambda s, d: O.merge_live(R.traj(s, d), live(s, d)).withColumn("offset_ft", r("offset_ft", 6)))
query("jon34_trip_heads", f"SELECT trip_id, max(ts) AS ts, round(arg_max(offset_ft, ts), 6) AS offset_ft, arg_max(live, ts) AS live FROM ({MERGED}) GROUP BY 1", "pings traj")(
    lambda s, d: O.trip_heads(O.merge_live(R.traj(s, d), live(s, d))).withColumn("offset_ft", r("offset_ft", 6)))
query("jon32_convergence", """
WITH st AS (SELECT route_id, direction_id, trip_id, min(ts) AS start FROM traj GROUP BY ALL HAVING count(*) > 1),
o AS (SELECT *, lag(trip_id) OVER (PARTITION BY route_id, direction_id ORDER BY start, trip_id) AS before FROM st),
n AS (SELECT b.trip_id, before, b.ts AS bt, a.ts AS a_t, b.offset_ft AS bo, abs(a.ts - b.ts) AS dt FROM o JOIN traj b ON b.trip_id = o.trip_id JOIN traj a ON a.trip_id = o.before AND abs(a.offset_ft - b.offset_ft) < 300 AND abs(a.ts - b.ts) < 900
  WHERE (b.ts - start) // 600 % 2 = 0)
SELECT trip_id, before, (bt + a_t) / 2 AS ts, round(bo, 6) AS offset_ft FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY bt, dt, a_t) AS rn FROM n) WHERE rn = 1""", "traj")(
    lambda s, d: O.convergence(materialize(R.traj(s, d), "traj"), I.STEP, 900, 300.0).withColumn("offset_ft", r("offset_ft", 6)))


def sched_points(s, d):
    """Scheduled passage times of the lines' stops for the observed trips, in epoch seconds."""
    t = I.rt_schedule(s, d).join(I.line_stops(s, d), ["route_id", "direction_id", "stop_id"])
    day = F.split_part("trip_id", F.lit("-"), F.lit(2)).cast("long")
    return t.select("route_id", "direction_id", (day * 86400 + F.col("sched_arr_sec") + 14400).alias("ts"), F.col("stop_offset_ft").alias("offset_ft"))


query("jon33_delay_vs_schedule", """
WITH sp AS (SELECT r.route_id, r.direction_id, CAST(split_part(trip_id, '-', 2) AS BIGINT) * 86400 + sched_arr_sec + 14400 AS st, stop_offset_ft AS so FROM rt_sched r JOIN line_stops l
  ON l.route_id = r.route_id AND l.direction_id = r.direction_id AND l.stop_id = r.stop_id),
p AS (SELECT c.trip_id, c.route_id, c.direction_id, c.arr_ts AS ts, stop_offset_ft + 130 AS offset_ft FROM cross_ c JOIN line_stops l ON l.route_id = c.route_id AND l.direction_id = c.direction_id AND l.stop_id = c.stop_id),
b AS (SELECT p.trip_id, p.ts, arg_min(st, abs(st - p.ts) * 10000000000 + st) AS sts FROM p JOIN sp ON sp.route_id = p.route_id AND sp.direction_id = p.direction_id AND abs(so - offset_ft) < 400 AND abs(st - p.ts) < 3600 GROUP BY 1, 2),
n AS (SELECT p.trip_id, p.ts, p.offset_ft, arg_min(l.stop_id, abs(l.stop_offset_ft - offset_ft)) AS nearest_stop FROM p JOIN line_stops l ON l.route_id = p.route_id AND l.direction_id = p.direction_id GROUP BY 1, 2, 3)
SELECT n.*, CAST(round((n.ts - sts) / 60) AS BIGINT) AS delay_min FROM n LEFT JOIN b ON b.trip_id = n.trip_id AND b.ts = n.ts""", "cross_ line_stops rt_sched")(
    lambda s, d: O.delay_vs_schedule(R.cross(s, d).join(I.line_stops(s, d), ["route_id", "direction_id", "stop_id"]).select(
        "trip_id", "route_id", "direction_id", F.col("arr_ts").alias("ts"), (F.col("stop_offset_ft") + 130).alias("offset_ft")), sched_points(s, d), I.line_stops(s, d)))
query("win19_thin_series", f"""WITH RECURSIVE pings AS ({I.CTE['pings'][1]}), p AS (SELECT DISTINCT trip_id, ts FROM pings),
k(trip_id, ts) AS (SELECT trip_id, min(ts) FROM p GROUP BY 1 UNION ALL SELECT k.trip_id, (SELECT min(ts) FROM p WHERE p.trip_id = k.trip_id AND p.ts >= k.ts + 3000) FROM k
  WHERE EXISTS (SELECT 1 FROM p WHERE p.trip_id = k.trip_id AND p.ts >= k.ts + 3000))
SELECT event_id, pings.trip_id, pings.ts FROM pings JOIN (SELECT trip_id, ts FROM k UNION SELECT trip_id, max(ts) FROM p GROUP BY 1) m ON m.trip_id = pings.trip_id AND m.ts = pings.ts""")(
    lambda s, d: thin(P(s, d).select("event_id", "trip_id", "ts"), "trip_id", "ts", 3000))
NOW = 1704323400
query("str12_upcoming", f"""
SELECT stop_id, trip_id, route_id, arrival_time, greatest(0, arrival_time - {NOW}) AS eta_s, rk FROM (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY arrival_time, trip_id) AS rk FROM (
  SELECT st.stop_id, st.trip_id, t.route_id, {NOW} - 43200 + sched_sec AS arrival_time FROM stop_times st JOIN trips t ON t.trip_id = st.trip_id) WHERE arrival_time >= {NOW} - 30) WHERE rk <= 16""", "stop_times trips")(
    lambda s, d: O.upcoming(S.typed_stop_times(I.stop_times(s, d)).join(I.trips(s, d).select("trip_id", "route_id"), "trip_id").select(
        "stop_id", "trip_id", "route_id", (F.lit(NOW - 43200) + F.col("sched_arr_sec")).cast("long").alias("arrival_time")), NOW).withColumns({"rk": F.col("rk").cast("long"), "eta_s": F.col("eta_s").cast("long")}))


def trains(s, d):
    """Trains under way: the last scheduled stop of each trip, reported shortly before now."""
    st = S.typed_stop_times(I.stop_times(s, d)).join(I.trips(s, d).select("trip_id", "route_id"), "trip_id")
    last = st.groupBy("trip_id", "route_id").agg(F.max_by("stop_id", "stop_seq").alias("stop_id"), F.max("sched_arr_sec").alias("sec")).select(
        F.col("trip_id").alias("vehicle_id"), "route_id", "stop_id", (F.lit(NOW) - F.col("sec") % 600).alias("ts"), (F.col("sec") % 4 == 0).alias("incoming"))
    return dealt(last, "route_id", "stop_id", rows=I.trips(s, d).count())


def hops(s, d):
    pred = S.canonical_predecessor(S.typed_stop_times(I.stop_times(s, d)), I.trips(s, d))
    xy = I.stops(s, d).select("stop_id", "lat", "lon")
    a = xy.select(F.col("stop_id").alias("pred"), F.col("lat").alias("la"), F.col("lon").alias("lo"))
    j = pred.join(xy, "stop_id").join(a, "pred")
    bend = planar.point((F.col("lo") + F.col("lon")) / 2, F.col("la"))
    return j.select("route_id", "stop_id", (F.col("n") % 5 * 60 + 120).alias("hop_s"), F.array(planar.point(F.col("lo"), F.col("la")), bend, planar.point(F.col("lon"), F.col("lat"))).alias("line"))


query("jon28_interpolate_trains")(lambda s, d: O.interpolate_trains(trains(s, d), hops(s, d), NOW))
query("jon35_planner_table", f"""WITH rt AS (SELECT route AS route_id, count(*) AS trips FROM wk_trips GROUP BY 1), st AS (SELECT x.*, n.route_short_name FROM ({STATS}) x JOIN routes n ON 'R' || n.route_id = x.route_id),
al AS (SELECT n.route_short_name, count(DISTINCT alert_id) AS alerts FROM alerts a JOIN routes n ON 'R' || n.route_id = a.route_id GROUP BY 1), ad AS (SELECT route, round(100.0::DOUBLE * avg(CASE WHEN start_sec % 2 = 0 THEN 1 ELSE 0 END), 4) AS p FROM wk_trips GROUP BY 1)
SELECT 'bus' AS mode, rt.route_id AS id, rt.trips, st.median_headway_s, st.bunching_index, ad.p AS adherence_pct, coalesce(al.alerts, 0) AS alerts FROM rt LEFT JOIN st ON st.route_short_name = rt.route_id
  LEFT JOIN ad ON ad.route = rt.route_id LEFT JOIN al ON al.route_short_name = rt.route_id
UNION ALL SELECT 'subway', line, n, NULL, NULL, NULL, CAST(al AS BIGINT) FROM (SELECT 'L' || direction_id AS line, count(*) AS n, bool_or(stop_id = 'error') AS al FROM pings GROUP BY 1)""", "wk_trips routes alerts hcells")(
    lambda s, d: (lambda names, wk: O.planner_table(
        wk.groupBy(F.col("route").alias("route_id")).agg(F.count(F.lit(1)).alias("trips")),
        stats(s, d).join(names, "route_id").select(F.col("name").alias("route_id"), "median_headway_s", "bunching_index"),
        wk.groupBy(F.col("route").alias("route_id")).agg(r(100.0 * F.avg(F.when(F.col("start_sec") % 2 == 0, 1).otherwise(0))).alias("adherence_pct")),
        I.alerts(s, d).join(names, "route_id").groupBy(F.col("name").alias("route_id")).agg(F.countDistinct("alert_id").alias("alerts")),
        P(s, d).groupBy(F.concat(F.lit("L"), F.col("direction_id").cast("string")).alias("line")).agg(F.count(F.lit(1)).alias("count"), F.bool_or(F.col("stop_id") == "error").alias("alerted"))))(
        I.routes(s, d).select(F.concat(F.lit("R"), "route_id").alias("route_id"), F.col("route_short_name").alias("name")), R.wk(s, d)))
query("agg67_dossier", f"""WITH rd AS (SELECT 'R' || regexp_extract(bus_route, '([0-9]+)$', 1) AS route_id, hour(transit_timestamp) AS hod, sum(ridership) AS b FROM rides GROUP BY 1, 2),
h AS (SELECT route_id, round(sum(b), 2) AS total_boardings, CAST(arg_max(hod, b) AS INT) AS peak_hour FROM rd GROUP BY 1),
sl AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY wt_speed_mph, from_stop, to_stop) AS rk FROM ({DQ.SEG})),
w AS (SELECT upper(route_id) AS route_id, min(wt_speed_mph) AS slowest_mph, string_agg(from_stop || '>' || to_stop, ',' ORDER BY rk) AS slowest_segments FROM sl WHERE rk <= 3 GROUP BY 1),
e AS (SELECT coalesce(v.route, p.route) AS route_id, coalesce(n, 0) AS violations_total FROM (SELECT route, count(*) AS n FROM enforcement WHERE route IS NOT NULL GROUP BY 1) v FULL OUTER JOIN programs p ON p.route = v.route)
SELECT coalesce(h.route_id, w.route_id, e.route_id, s.route_id) AS route_id, total_boardings, peak_hour, slowest_mph, slowest_segments, coalesce(violations_total, 0) AS violations_total, median_headway_s, bunching_index
FROM h FULL OUTER JOIN w ON w.route_id = h.route_id FULL OUTER JOIN e ON e.route_id = coalesce(h.route_id, w.route_id) FULL OUTER JOIN ({STATS}) s ON s.route_id = coalesce(h.route_id, w.route_id, e.route_id)""",
      "rides segment_speeds enforcement programs hcells")(
    lambda s, d: O.dossier(
        D.route_hourly(I.rides(s, d).withColumn("bus_route", F.concat(F.lit("R"), F.regexp_extract("bus_route", "([0-9]+)$", 1)))).select(F.col("route").alias("route_id"), "hod", "total_boardings"),
        DQ._seg(s, d).withColumn("route_id", F.upper("route_id")),
        D.ace_summary(I.enforcement(s, d), I.programs(s, d)).select(F.col("route").alias("route_id"), "violations_total"),
        stats(s, d).select("route_id", "median_headway_s", "bunching_index"), 3).withColumn("total_boardings", r("total_boardings", 2)))
