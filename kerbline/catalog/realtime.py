"""Queries on vehicle positions: passages, trajectories, headways, adherence."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.catalog import inputs as I
from kerbline.catalog.registry import period_sql, query, r
from kerbline.catalog.supply import SCHED_HEADWAY, wk
from kerbline.functions import clock, planar
from kerbline.operators import headways as H
from kerbline.operators import places
from kerbline.operators import supply as S
from kerbline.operators import trajectory as T
from kerbline.session import materialize

P = I.pings

query("win01_passages", """
SELECT event_id, route_id, direction_id, stop_id, vehicle_id, ts FROM (SELECT *, lag(stop_id) OVER (PARTITION BY vehicle_id ORDER BY ts, event_id) AS ps FROM pings)
WHERE ps IS NULL OR ps <> stop_id""", "pings")(lambda s, d: H.passages(P(s, d)).select("event_id", "route_id", "direction_id", "stop_id", "vehicle_id", "ts"))
PASS = "SELECT * FROM (SELECT *, lag(stop_id) OVER (PARTITION BY vehicle_id ORDER BY ts, event_id) AS ps FROM pings) WHERE ps IS NULL OR ps <> stop_id"
HW = f"""SELECT * FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY route_id, direction_id, stop_id ORDER BY ts, event_id) AS headway_s FROM ({PASS})) WHERE headway_s > 0 AND headway_s < 10800"""


def hw(s, d):
    h = H.headways(H.passages(P(s, d)), H.STOP_KEYS, "ts", "event_id")
    return h.where((F.col("headway_s") > 0) & (F.col("headway_s") < 10800))


STATS = """SELECT {keys}, count(*) AS n_headways, {stops} round(median(headway_s) / 60, 4) AS median_headway_min, round(avg(headway_s / 60.0::DOUBLE), 6) AS mean_headway_min,
  round(stddev_samp(headway_s / 60.0::DOUBLE) / avg(headway_s / 60.0::DOUBLE), 4) AS bunching_cv FROM ({hw}) GROUP BY {keys} HAVING count(*) >= {n}"""


def _rounds():
    return {"median_headway_min": r("median_headway_min"), "mean_headway_min": r("mean_headway_min", 6), "bunching_cv": r("bunching_cv")}


ROUTE_STATS = STATS.format(keys="route_id", stops="count(DISTINCT stop_id) AS n_stops,", hw=HW, n=5)
query("win02_headways", f"SELECT event_id, route_id, direction_id, stop_id, headway_s FROM ({HW})", "pings")(
    lambda s, d: hw(s, d).select("event_id", "route_id", "direction_id", "stop_id", "headway_s"))
query("agg19_headway_stats_route", ROUTE_STATS, "pings")(lambda s, d: H.headway_stats(hw(s, d), ["route_id"], 5).withColumns(_rounds()))
query("agg19_headway_stats_stop", STATS.format(keys="route_id, direction_id, stop_id", stops="", hw=HW, n=4), "pings")(
    lambda s, d: H.headway_stats(hw(s, d), H.STOP_KEYS, 4).withColumns(_rounds()))
query("agg18_archive_span", """
SELECT min(ts) AS t0, max(ts) AS t1, count(*) AS frames, count(DISTINCT vehicle_id) AS vehicles, count(DISTINCT route_id) AS routes,
  count(DISTINCT ts // 3600) AS distinct_hours, round((max(ts) - min(ts)) / 3600, 4) AS depth_hours FROM pings""", "pings")(
    lambda s, d: H.archive_span(P(s, d)).withColumn("depth_hours", r("depth_hours")))


def obs_routes(s, d):
    """Route statistics under the schedule's route names."""
    names = I.routes(s, d).select(F.concat(F.lit("R"), "route_id").alias("route_id"), "route_short_name")
    return H.headway_stats(hw(s, d), ["route_id"], 5).join(names, "route_id").withColumn("route_id", F.col("route_short_name")).drop("route_short_name")


query("agg20_headway_vs_schedule", f"""
WITH span AS (SELECT (min(ts) + max(ts)) // 2 - 14400 AS middle FROM pings), now AS (SELECT {period_sql('middle % 86400 // 3600')} AS name FROM span),
plan AS (SELECT upper(regexp_replace(replace(route, '-SBS', ''), '[^A-Za-z0-9]', '', 'g')) AS rn, avg(headway_min) AS sh FROM ({SCHED_HEADWAY}), now WHERE period = now.name GROUP BY rn),
seen AS (SELECT routes.route_short_name AS route_id, n_headways, median_headway_min, bunching_cv FROM routes JOIN ({ROUTE_STATS}) live ON live.route_id = concat('R', routes.route_id))
SELECT route_id, n_headways, median_headway_min, round(sh, 4) AS scheduled_headway_min, round(median_headway_min - sh, 3) AS obs_minus_sched_min, bunching_cv
FROM seen JOIN plan ON plan.rn = upper(regexp_replace(replace(route_id, '-SBS', ''), '[^A-Za-z0-9]', '', 'g'))""", "pings routes wk_trips")(
    lambda s, d: (lambda mid: H.headway_vs_schedule(
        obs_routes(s, d).withColumns(_rounds()), S.scheduled_headway(wk(s, d)).join(mid), F.col("now_period")).withColumns(
            {"scheduled_headway_min": r("scheduled_headway_min"), "obs_minus_sched_min": r("obs_minus_sched_min", 3)}))(
        F.broadcast(H.archive_span(P(s, d)).select(clock.period_of(clock.local_hour(clock.local_seconds(F.floor((F.col("t0") + F.col("t1")) / 2)))).alias("now_period")))))

STOPPED = "SELECT feed, route_id, direction_id, stop_id, trip_id, min(ts) AS arr_ts FROM pings WHERE current_status = 1 GROUP BY ALL"
query("win03_arrivals_stopped", f"""
SELECT *, arr_ts - lag(arr_ts) OVER (PARTITION BY feed, route_id, direction_id, stop_id ORDER BY arr_ts, trip_id) AS headway_s FROM ({STOPPED})""", "pings")(
    lambda s, d: H.headways(H.arrivals_stopped(P(s, d)), ["feed", *H.STOP_KEYS], "arr_ts", "trip_id"))
query("agg21_headway_hourly", f"""
WITH visit AS ({STOPPED}),
gap AS (SELECT v.* EXCLUDE (arr_ts), arr_ts, arr_ts - lag(arr_ts) OVER same_stop AS g FROM visit v WINDOW same_stop AS (PARTITION BY feed, route_id, direction_id, stop_id ORDER BY arr_ts, trip_id)),
cell AS (SELECT feed, route_id, direction_id, stop_id, arr_ts // 3600 AS slot, list(g) AS gaps FROM gap WHERE g BETWEEN 1 AND 7199 GROUP BY ALL)
SELECT feed, route_id, direction_id, stop_id, strftime(make_timestamp(slot * 3600000000), '%Y-%m-%d') AS date, CAST(slot % 24 AS INT) AS hour, len(gaps) AS n_headways,
  CAST(list_median(gaps) AS DOUBLE) AS median_headway_s, round(list_avg(gaps), 4) AS mean_headway_s, list_min(gaps) AS min_headway_s, list_max(gaps) AS max_headway_s,
  round(len(list_filter(gaps, lambda x: 2 * x < list_median(gaps))) / len(gaps), 4) AS bunching_index FROM cell""", "pings")(
    lambda s, d: H.headway_hourly(H.arrivals_stopped(P(s, d))).withColumns({"mean_headway_s": r("mean_headway_s"), "bunching_index": r("bunching_index")}))
HAV = "2 * 6371000 * asin(sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2)))"
query("prj11_haversine", f"""
SELECT event_id, round({HAV}, 4) AS dist_m, round({HAV} * 2.23694 / 600, 4) AS mph FROM (SELECT event_id, lat, lon, 40.7::DOUBLE AS plat, -73.95::DOUBLE AS plon FROM pings)""", "pings")(
    lambda s, d: P(s, d).withColumn("m", planar.haversine_m(F.lit(40.7), F.lit(-73.95), F.col("lat"), F.col("lon"))).select(
        "event_id", r("m").alias("dist_m"), r(F.col("m") * planar.MPS_TO_MPH / 600).alias("mph")))
query("agg22_segment_speed_from_pings", f"""
WITH n AS (SELECT pings.*, row_number() OVER (PARTITION BY feed, trip_id ORDER BY ts, event_id) AS i FROM pings),
move AS (SELECT b.feed, b.route_id, b.direction_id, a.stop_id AS from_stop, b.stop_id AS to_stop, b.ts // 3600 AS slot, b.ts - a.ts AS s, a.lat AS plat, a.lon AS plon, b.lat AS lat, b.lon AS lon
  FROM n a JOIN n b ON b.trip_id = a.trip_id AND b.feed = a.feed AND b.i = a.i + 1 WHERE b.ts - a.ts BETWEEN 1 AND 900),
leg AS (SELECT * EXCLUDE (plat, plon, lat, lon), {HAV} AS m FROM move),
fast AS (SELECT *, m / s * 2.23694 AS mph FROM leg WHERE m > 0)
SELECT feed, route_id, direction_id, from_stop, to_stop, strftime(make_timestamp(slot * 3600000000), '%Y-%m-%d') AS date, CAST(slot % 24 AS INT) AS hour,
  count(*) AS n_segments, round(median(mph), 4) AS median_mph, round(avg(mph), 4) AS mean_mph, round(sum(m), 3) AS total_dist_m, CAST(sum(s) AS BIGINT) AS total_time_s
FROM fast WHERE mph < 80 GROUP BY ALL""", "pings")(
    lambda s, d: T.segment_speed_from_pings(P(s, d)).withColumns({"median_mph": r("median_mph"), "mean_mph": r("mean_mph"), "total_dist_m": r("total_dist_m", 3)}))

# ------------------------------------------------------------------ trajectories
query("set05_dedupe_pings", "SELECT trip_id, ts, event_id, offset_ft FROM dd", "dd")(lambda s, d: T.dedupe_pings(P(s, d)).select("trip_id", "ts", "event_id", "offset_ft"))


def mono(s, d):
    return T.monotonic(T.dedupe_pings(P(s, d)))


def traj(s, d):
    return T.resample(mono(s, d).where("keep"), I.STEP)


def cross(s, d):
    return T.crossings(traj(s, d), I.line_stops(s, d), ["route_id", "direction_id"])


def arrivals(s, d):
    return H.join_schedule(cross(s, d), I.rt_schedule(s, d))


def cells(s, d):
    return H.headway_cells(materialize(arrivals(s, d), "arrivals"), H.scheduled_gaps(I.rt_schedule(s, d)))


query("win09_monotonic", "SELECT trip_id, ts, keep, round(offset_mono, 4) AS offset_mono FROM mono", "mono")(
    lambda s, d: mono(s, d).select("trip_id", "ts", "keep", r("offset_mono").alias("offset_mono")))
query("win10_resample", "SELECT trip_id, route_id, direction_id, ts, round(offset_ft, 6) AS offset_ft FROM traj", "traj")(lambda s, d: traj(s, d).withColumn("offset_ft", r("offset_ft", 6)))
query("jon17_crossings", "SELECT * FROM cross_", "cross_")(cross)
FS = "SELECT trip_id FROM cross_ WHERE stop_id = 'S8'"
query("jon07_first_seen", f"""
SELECT trip_id, stop_id, min(route_id) AS route_id, min(direction_id) AS direction_id, min(ts) AS arr_ts, 'first_seen' AS method FROM pings WHERE trip_id NOT IN ({FS}) GROUP BY 1, 2
""", "pings cross_")(lambda s, d: T.first_seen_arrivals(P(s, d), cross(s, d).where("stop_id = 'S8'")))
LO, HI = 0.02, 1.0
SPD = f"""SELECT trip_id, route_id, direction_id, ts, offset_ft, (offset_ft - lag(offset_ft) OVER w) / (ts - lag(ts) OVER w) AS fps FROM traj WINDOW w AS (PARTITION BY trip_id ORDER BY ts)"""
query("win22_along_shape_speed", f"SELECT trip_id, ts, round(fps, 6) AS speed_fps FROM ({SPD}) WHERE fps BETWEEN {LO} AND {HI}", "traj")(
    lambda s, d: T.along_shape_speed(traj(s, d), LO, HI).select("trip_id", "ts", r("speed_fps", 6).alias("speed_fps")))
TABLE = f"""WITH sp AS (SELECT *, CAST(floor(offset_ft / 2640) AS INT) AS seg_bin FROM ({SPD}) WHERE fps BETWEEN {LO} AND {HI})
SELECT 'segment' AS level, route_id, direction_id, seg_bin, count(*) AS n, round(median(fps), 5) AS median_fps FROM sp GROUP BY ALL
UNION ALL SELECT 'route', route_id, NULL, NULL, count(*), round(median(fps), 5) FROM sp GROUP BY route_id
UNION ALL SELECT 'city', NULL, NULL, NULL, count(*), round(median(fps), 5) FROM sp"""


def speed_table(s, d):
    return T.speed_table(materialize(T.along_shape_speed(traj(s, d), LO, HI), "speeds")).withColumn("median_fps", r("median_fps", 5))


query("agg27_speed_table", TABLE, "traj")(speed_table)

# ------------------------------------------------------------------ arrivals, cells, adherence
query("jon04_join_schedule", "SELECT trip_id, stop_id, arr_ts, stop_seq, sched_arr_sec, deviation_s FROM arr", "arr")(
    lambda s, d: arrivals(s, d).select("trip_id", "stop_id", "arr_ts", "stop_seq", "sched_arr_sec", "deviation_s"))
query("jon23_adherence_stopped", f"""
SELECT a.feed, a.route_id, a.trip_id, a.stop_id, arr_ts, CAST(sec AS INT) AS sched_arr_sec, 43200 - ((43200 - (arr_ts % 86400 - sec % 86400)) % 86400 + 86400) % 86400 AS adherence_s
FROM ({STOPPED}) a JOIN (SELECT trip_id, stop_id, (max(ts) // 60 * 60) % 86400 AS sec FROM pings GROUP BY 1, 2) s ON s.trip_id = a.trip_id AND s.stop_id = a.stop_id""", "pings")(
    lambda s, d: H.adherence_stopped(H.arrivals_stopped(P(s, d)), P(s, d).groupBy("trip_id", "stop_id").agg(((F.floor(F.max("ts") / 60) * 60) % 86400).cast("int").alias("sched_arr_sec"))))
query("jon06_join_coverage", """
SELECT count(*) AS rows, count(t.trip_id) AS matched, round(100 * count(t.trip_id) / count(*), 4) AS coverage_pct FROM stop_times s LEFT JOIN wk_trips t ON t.trip_id = s.trip_id""", "stop_times wk_trips")(
    lambda s, d: H.join_coverage(I.stop_times(s, d), wk(s, d), "trip_id").withColumn("coverage_pct", r("coverage_pct")))
query("jon24_follow_up_rate", """
SELECT count(DISTINCT o_custkey) AS total, count(DISTINCT CASE WHEN o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN o_custkey END) AS followed,
  round(100 * count(DISTINCT CASE WHEN o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN o_custkey END) / count(DISTINCT o_custkey), 4) AS follow_up_pct
FROM orders WHERE o_orderstatus = 'O'""")(lambda s, d: (lambda o: H.follow_up_rate(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), "o_custkey").withColumn(
    "follow_up_pct", r("follow_up_pct")))(I.table(s, d, "orders")))


def _round_cells():
    return {c: r(c) for c in ("mean_headway_s", "headway_cv", "bunch_share_lt50_sched", "bunch_share_lt50_obs", "bunching_index")}


query("agg23_headway_cells", """SELECT * REPLACE (round(mean_headway_s, 4) AS mean_headway_s, round(headway_cv, 4) AS headway_cv, round(bunch_share_lt50_sched, 4) AS bunch_share_lt50_sched,
  round(bunch_share_lt50_obs, 4) AS bunch_share_lt50_obs, round(bunching_index, 4) AS bunching_index) FROM hcells""", "hcells")(lambda s, d: cells(s, d).withColumns(_round_cells()))
query("set06_earliest_arrival", "SELECT trip_id, stop_seq, min(arr_ts) AS arr_ts FROM arr WHERE stop_seq IS NOT NULL GROUP BY 1, 2", "arr")(
    lambda s, d: H.earliest_arrival(arrivals(s, d)).select("trip_id", "stop_seq", "arr_ts"))
RUN = """SELECT * FROM (SELECT trip_id, route_id, direction_id, stop_id AS from_stop, lead(stop_id) OVER w AS to_stop, stop_seq, lead(arr_ts) OVER w - arr_ts AS obs_run_s,
  lead(sched_arr_sec) OVER w - sched_arr_sec AS sched_run_s, lead(arr_ts) OVER w - arr_ts - (lead(sched_arr_sec) OVER w - sched_arr_sec) AS run_delta_s FROM arr
  WINDOW w AS (PARTITION BY trip_id ORDER BY stop_seq)) WHERE sched_run_s > 0 AND obs_run_s > 0 AND obs_run_s <= 7200"""
query("win17_segment_run_delta", RUN, "arr")(lambda s, d: H.segment_run_delta(H.earliest_arrival(arrivals(s, d))))
query("agg25_trip_adherence", f"""
SELECT a.trip_id, a.route_id, a.direction_id, count(*) AS n_stops_observed, arg_min(deviation_s, stop_seq) AS start_delay_s, arg_max(deviation_s, stop_seq) AS end_delay_s,
  coalesce(any_value(n), 0) AS n_segments, round(any_value(m), 4) AS mean_running_delta_s, CAST(any_value(t) AS BIGINT) AS total_running_delta_s
FROM arr a LEFT JOIN (SELECT trip_id, count(*) AS n, avg(run_delta_s) AS m, sum(run_delta_s) AS t FROM ({RUN}) GROUP BY 1) x ON x.trip_id = a.trip_id GROUP BY 1, 2, 3 HAVING count(*) >= 2""", "arr")(
    lambda s, d: H.trip_adherence(H.earliest_arrival(arrivals(s, d))).withColumn("mean_running_delta_s", r("mean_running_delta_s")))

# ------------------------------------------------------------------ packaging
EXCL = "SELECT local_date, local_hour FROM hcells GROUP BY 1, 2 HAVING sum(n_headways) < 20"


def package(s, d):
    c = materialize(cells(s, d), "cells")
    excl = c.groupBy("local_date", "local_hour").agg(F.sum("n_headways").alias("n")).where("n < 20")
    depth = F.lit(c.agg(F.count_distinct("local_date")).first()[0])
    return H.package_headways(c, excl, depth), c


PKG = f"""SELECT route_id, direction_id, stop_id, h.local_date, h.local_hour, n_arrivals, n_headways, round(median_headway_s, 1) AS median_headway_s, round(mean_headway_s, 1) AS mean_headway_s,
  round(min_headway_s::DOUBLE, 1) AS min_headway_s, round(max_headway_s::DOUBLE, 1) AS max_headway_s, round(sched_median_headway_s, 1) AS sched_median_headway_s,
  round(headway_deviation_s, 1) AS headway_deviation_s, round(median_deviation_s, 1) AS median_deviation_s, round(headway_cv, 4) AS headway_cv,
  round(bunch_share_lt50_sched, 4) AS bunch_share_lt50_sched, round(bunch_share_lt50_obs, 4) AS bunch_share_lt50_obs, round(bunching_index, 4) AS bunching_index,
  (SELECT count(DISTINCT local_date) FROM hcells) AS archive_depth_days, TRUE AS preliminary FROM hcells h WHERE n_headways >= 2 AND NOT EXISTS (SELECT 1 FROM ({EXCL}) e WHERE e.local_date = h.local_date AND e.local_hour = h.local_hour)"""
query("src19_package_headways", PKG, "hcells")(lambda s, d: package(s, d)[0])
query("src19_package_manifest", f"""SELECT h.local_date, count(*) AS rows_before_filter, coalesce(any_value(n), 0) AS "rows" FROM hcells h
LEFT JOIN (SELECT local_date, count(*) AS n FROM ({PKG}) GROUP BY 1) p ON p.local_date = h.local_date GROUP BY 1""", "hcells")(lambda s, d: H.package_manifest(*package(s, d)))

# ------------------------------------------------------------------ live motion
TWO = """WITH w AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, event_id DESC) AS rn FROM pings),
lt AS (SELECT l.*, p.ts AS prev_ts, p.lat AS prev_lat, p.lon AS prev_lon, p.x_ft AS prev_x, p.y_ft AS prev_y, p.offset_ft AS prev_offset_ft FROM w l
  LEFT JOIN w p ON p.vehicle_id = l.vehicle_id AND p.rn = 2 WHERE l.rn = 1 AND l.ts >= (SELECT max(ts) FROM pings) - 43200)"""


def two(s, d):
    return T.latest_two(P(s, d), 43200)


query("win06_latest_two", f"{TWO} SELECT vehicle_id, event_id, ts, round(lat, 6) AS lat, prev_ts, round(prev_lat, 6) AS prev_lat FROM lt", "pings")(
    lambda s, d: two(s, d).select("vehicle_id", "event_id", "ts", r("lat", 6).alias("lat"), "prev_ts", r("prev_lat", 6).alias("prev_lat")))
GUARD = """SELECT *, x_ft - 980000 > 5000 AS off_shape, NOT (x_ft - 980000 > 5000) AND coalesce(offset_ft < prev_offset_ft - 500, FALSE) AS non_monotonic FROM lt"""


def guarded(s, d):
    return T.motion_guards(two(s, d).withColumn("perp_ft", (F.col("x_ft") - 980000) / 25))


query("win24_motion_guards", f"{TWO} SELECT vehicle_id, off_shape, non_monotonic, NOT off_shape AND NOT non_monotonic AS keep_shape FROM ({GUARD})", "pings")(
    lambda s, d: guarded(s, d).select("vehicle_id", "off_shape", "non_monotonic", "keep_shape"))
query("jon27_speed_estimate", f"""{TWO}, st AS ({TABLE}), g AS (SELECT *, sqrt(pow(x_ft - prev_x, 2) + pow(y_ft - prev_y, 2)) / (ts - prev_ts) AS o FROM ({GUARD}))
SELECT vehicle_id, g.route_id, round(coalesce(CASE WHEN ts - prev_ts > 0 AND ts - prev_ts < 900 AND o BETWEEN 1 AND 90 THEN o END, a.median_fps, b.median_fps, 12.0), 4) AS speed_est_fps,
  CASE WHEN ts - prev_ts > 0 AND ts - prev_ts < 900 AND o BETWEEN 1 AND 90 THEN 'observed' WHEN a.median_fps IS NOT NULL THEN 'segment' WHEN b.median_fps IS NOT NULL THEN 'route' ELSE 'default' END AS speed_basis
FROM g LEFT JOIN st a ON a.level = 'segment' AND a.route_id = g.route_id AND a.direction_id = g.direction_id AND a.seg_bin = CASE WHEN NOT off_shape AND NOT non_monotonic THEN CAST(floor(offset_ft / 2640) AS INT) END
LEFT JOIN st b ON b.level = 'route' AND b.route_id = g.route_id""", "pings traj")(
    lambda s, d: (lambda t: T.speed_estimate(guarded(s, d), t.where("level = 'segment'"), t.where("level = 'route'")).withColumn("speed_est_fps", r("speed_est_fps")))(speed_table(s, d)))
query("agg73_prediction_error", """
WITH q AS (SELECT route_id, abs(offset_ft + value / 100 * (least(dt, 40) + greatest(least(dt - 40, 45), 0) - pow(greatest(least(dt - 40, 45), 0), 2) / 90) - o1) AS e FROM (
  SELECT *, (lead(ts) OVER w - ts)::DOUBLE AS dt, lead(offset_ft) OVER w AS o1 FROM dd WINDOW w AS (PARTITION BY trip_id ORDER BY ts)) WHERE dt IS NOT NULL)
SELECT route_id, count(*) AS n, round(median(e), 4) AS median_err_ft, round(quantile_cont(e, 0.9), 4) AS p90_err_ft FROM q GROUP BY 1""", "dd")(
    lambda s, d: T.prediction_error(T.dedupe_pings(P(s, d)).withColumn("speed_fps", F.col("value") / 100)).withColumns({"median_err_ft": r("median_err_ft"), "p90_err_ft": r("p90_err_ft")}))
query("prj10_viewport", "SELECT event_id FROM pings WHERE lon BETWEEN -73.98 AND -73.93 AND lat BETWEEN 40.61 AND 40.66", "pings")(
    lambda s, d: places.bbox_filter(P(s, d), "-73.98,40.61,-73.93,40.66").select("event_id"))
query("prj21_recent", "SELECT event_id, poll_ts FROM pings WHERE poll_ts >= 1704323400 - 12 * 3600", "pings")(
    lambda s, d: places.recent(P(s, d), "poll_ts", 12, 1704323400).select("event_id", "poll_ts"))
