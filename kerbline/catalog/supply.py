"""Queries on the static schedule."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.catalog import inputs as I
from kerbline.catalog.demand import AVG_WEEKDAY, bor
from kerbline.catalog.registry import period_minutes_sql, period_sql, query, r, window_sql
from kerbline.functions import clock, codes
from kerbline.operators import demand as D
from kerbline.operators import supply as S

query("prj02_route_norm", """
SELECT feed, route_id, upper(regexp_replace(replace(route_short_name, '-SBS', ''), '[^A-Za-z0-9]', '', 'g')) AS route_norm FROM routes
""", "routes")(lambda s, d: I.routes(s, d).select("feed", "route_id", codes.route_norm(F.col("route_short_name")).alias("route_norm")))
query("prj03_gtfs_seconds", """
SELECT trip_id, stop_sequence, arrival_time, CAST(sched_sec AS INT) AS sec FROM stop_times
""", "stop_times")(lambda s, d: I.stop_times(s, d).select("trip_id", "stop_sequence", "arrival_time", clock.gtfs_seconds(F.col("arrival_time")).alias("sec")))
query("prj05_period_and_window", f"""
SELECT {period_sql('h')} AS period, {period_minutes_sql('h')} AS span_min, {window_sql('h')} AS tod_window,
  count(*) AS n FROM (SELECT (sched_sec // 3600) % 24 AS h FROM stop_times) GROUP BY ALL""", "stop_times")(
    lambda s, d: (lambda t: t.groupBy(clock.period_of(F.col("h")).alias("period"), clock.period_minutes(F.col("h")).alias("span_min"),
                                      clock.tod_window(F.col("sec")).alias("tod_window")).agg(F.count(F.lit(1)).alias("n")))(
        I.stop_times(s, d).select(clock.gtfs_seconds(F.col("arrival_time")).alias("sec")).withColumn("h", F.floor(F.col("sec") / 3600) % 24)))
query("prj20_premium_flag", """
SELECT route_id, route_short_name, route_id LIKE '%+' OR upper(route_short_name) LIKE '%SBS%' AS sbs FROM routes
""", "routes")(lambda s, d: I.routes(s, d).select("route_id", "route_short_name", codes.is_sbs(F.col("route_id"), F.col("route_short_name")).alias("sbs")))


def wk(s, d):
    return S.weekday_trips(I.trips(s, d), I.routes(s, d), I.stop_times(s, d))


query("jon01_weekday_trips", "SELECT feed, trip_id, route_id, route, route_norm, direction_id, CAST(start_sec AS INT) AS start_sec, start_hour FROM wk_trips", "wk_trips")(wk)
query("agg14_trips_per_hour", f"SELECT route, {bor('route')} AS borough, direction_id, start_hour AS hour, count(*) AS trips FROM wk_trips GROUP BY ALL", "wk_trips")(
    lambda s, d: S.trips_per_hour(wk(s, d)))
query("agg14_system_trips_per_hour", "SELECT start_hour AS hour, count(*) AS trips FROM wk_trips GROUP BY ALL", "wk_trips")(lambda s, d: S.system_trips_per_hour(wk(s, d)))
SCHED_HEADWAY = f"""SELECT route, direction_id, period, max(minutes) AS span_min, count(*) AS trips, round(max(minutes) / count(*), 1) AS headway_min
FROM (SELECT route, direction_id, {period_sql('start_hour')} AS period, {period_minutes_sql('start_hour')} AS minutes FROM wk_trips) GROUP BY ALL"""
query("agg15_scheduled_headway", SCHED_HEADWAY, "wk_trips")(lambda s, d: S.scheduled_headway(wk(s, d)))
query("agg16_stop_service", """
SELECT st.stop_id, any_value(sp.stop_name) AS stop_name, count(*) AS weekday_arrivals, count(DISTINCT route) AS n_routes
FROM stop_times st JOIN wk_trips w ON st.trip_id = w.trip_id LEFT JOIN stops sp ON sp.stop_id = st.stop_id GROUP BY 1
""", "wk_trips stops")(lambda s, d: S.stop_service(I.stop_times(s, d), wk(s, d), I.stops(s, d)))
DVS = f"""SELECT s.route_norm, s.borough, gtfs_route, weekday_trips, round(avg_b, 4) AS avg_weekday_boardings, round(avg_b / weekday_trips, 1) AS boardings_per_trip
FROM (SELECT route_norm, {bor('route')} AS borough, min(route) AS gtfs_route, count(*) AS weekday_trips FROM wk_trips GROUP BY 1, 2) s
JOIN ({AVG_WEEKDAY}) d ON d.route_norm = s.route_norm WHERE weekday_trips >= 20"""


def dvs(s, d):
    return S.demand_vs_supply(wk(s, d), D.avg_weekday(I.rides(s, d), "1997-07-01")).withColumn("avg_weekday_boardings", r("avg_weekday_boardings"))


query("jon02_demand_vs_supply", DVS, "wk_trips rides")(dvs)
query("top04_crowding_league", f"""WITH ds AS ({DVS})
SELECT * EXCLUDE (rn) FROM (SELECT *, 'most' AS side, row_number() OVER (ORDER BY boardings_per_trip DESC, route_norm) AS rn FROM ds) WHERE rn <= 5
UNION ALL SELECT * EXCLUDE (rn) FROM (SELECT *, 'least' AS side, row_number() OVER (ORDER BY boardings_per_trip, route_norm DESC) AS rn FROM ds WHERE avg_weekday_boardings > 500) WHERE rn <= 5
""", "wk_trips rides")(lambda s, d: S.crowding_league(dvs(s, d), 5))
query("set07_weekday_services", "SELECT DISTINCT feed, service_id FROM trips WHERE service_id ILIKE '%weekday%' AND service_id NOT ILIKE '%SDon%'", "trips")(
    lambda s, d: S.weekday_services(I.trips(s, d)))
REP = """SELECT feed, route_id, service_id, n_trips FROM (SELECT *, row_number() OVER (PARTITION BY feed, route_id ORDER BY n_trips DESC, service_id) AS rn
  FROM (SELECT feed, route_id, service_id, count(*) AS n_trips FROM trips WHERE service_id ILIKE '%Weekday%' GROUP BY ALL)) WHERE rn = 1"""
query("win04_representative_service", REP, "trips")(lambda s, d: S.representative_service(I.trips(s, d)))
query("set03_active_services", "SELECT CAST(day AS VARCHAR) AS day, service_id FROM active", "active")(
    lambda s, d: S.active_services(I.calendar(s, d), I.calendar_dates(s, d), I.service_days(s, d)))
CLASSES = """SELECT coalesce(c.service_id, v.service_id) AS service_id, CASE WHEN k IS NULL OR k = 'other' THEN coalesce(bucket, k) ELSE k END AS period
FROM (SELECT service_id, CASE WHEN wk = '1' THEN 'weekday' WHEN sat = '1' THEN 'saturday' ELSE 'other' END AS k FROM calendar) c
FULL OUTER JOIN (SELECT service_id, bucket FROM (SELECT service_id, bucket, row_number() OVER (PARTITION BY service_id ORDER BY n DESC, bucket) AS rn FROM (
  SELECT service_id, CASE dayofweek(strptime(date, '%Y%m%d')) WHEN 6 THEN 'saturday' WHEN 0 THEN 'sunday' ELSE 'weekday' END AS bucket, count(*) AS n
  FROM calendar_dates WHERE exception_type = '1' GROUP BY ALL)) WHERE rn = 1) v ON v.service_id = c.service_id"""


def undeclared(cal):
    """Calendar with the Saturday flag of half the services cleared, so both rules are used."""
    return cal.withColumn("saturday", F.when(F.col("service_id") < "3", "0").otherwise(F.col("saturday")))


query("set04_classify_service", CLASSES.replace("WHEN sat = '1'", "WHEN sat = '1' AND service_id >= '3'"), "calendar calendar_dates")(
    lambda s, d: S.classify_service(undeclared(I.calendar(s, d)), I.calendar_dates(s, d)))
query("src16_gtfs_index", """
SELECT t.trip_id, t.route_id, t.direction_id, t.service_id, t.shape_id, st.stop_id, st.stop_sequence AS stop_seq,
  CAST(sched_sec AS INT) AS sched_arr_sec, CAST(sched_sec AS INT) AS sched_dep_sec FROM trips t JOIN stop_times st ON t.trip_id = st.trip_id
""", "trips stop_times")(lambda s, d: (lambda g: g["trip_meta"].drop("feed").join(g["stop_times"], "trip_id"))(S.gtfs_index(raw(s, d))))


def raw(s, d):
    return {"trips": I.trips(s, d), "routes": I.routes(s, d), "stop_times": I.stop_times(s, d), "calendar": I.calendar(s, d),
            "calendar_dates": I.calendar_dates(s, d), "shape_points": I.shape_points(s, d)}


def typed(s, d):
    return S.typed_stop_times(I.stop_times(s, d))


query("agg45_stop_windows", f"""
WITH ch AS ({REP}), ev AS (SELECT DISTINCT stop_id, st.trip_id, (sched_sec // 3600) % 24 AS hr FROM stop_times st JOIN trips t ON st.trip_id = t.trip_id
  JOIN ch ON ch.feed = t.feed AND ch.route_id = t.route_id AND ch.service_id = t.service_id)
SELECT *, round(trips_am / 3, 2) AS tph_am, round(trips_midday / 6, 2) AS tph_midday, round(trips_eve / 3, 2) AS tph_eve FROM (
SELECT stop_id, count(DISTINCT trip_id) FILTER (hr BETWEEN 7 AND 9) AS trips_am, count(DISTINCT trip_id) FILTER (hr BETWEEN 10 AND 15) AS trips_midday,
  count(DISTINCT trip_id) FILTER (hr BETWEEN 19 AND 21) AS trips_eve, count(DISTINCT trip_id) FILTER (hr BETWEEN 5 AND 21) AS trips_daytime FROM ev GROUP BY 1)
""", "trips stop_times")(lambda s, d: S.stop_windows(I.stop_times(s, d), I.trips(s, d), S.representative_service(I.trips(s, d))))
query("jon08_match_flag", """
SELECT stop_id, stop_name, stop_id IN (SELECT stop_id FROM stop_times JOIN wk_trips USING (trip_id) WHERE start_hour < 8) AS gtfs_matched FROM stops
""", "stops wk_trips")(lambda s, d: S.with_match_flag(
    I.stops(s, d).select("stop_id", "stop_name"), I.stop_times(s, d).join(wk(s, d).where("start_hour < 8"), "trip_id", "left_semi"), "stop_id", "gtfs_matched"))
query("agg51_frequent_stops", """
SELECT stop_id, count(*) AS am_trips FROM stop_times WHERE departure_time >= '07:00:00' AND departure_time < '09:00:00' GROUP BY 1 HAVING count(*) >= 8
""".replace("departure_time", "arrival_time"), "stop_times")(lambda s, d: S.frequent_stops(I.stop_times(s, d)))
SCHED_CELLS = """SELECT day, route_id, direction_id, stop_id, CAST((sec // 3600) % 24 AS INT) AS local_hour, median(gap) AS m, count(*) AS sched_n FROM (
  SELECT *, sec - lag(sec) OVER (PARTITION BY day, route_id, direction_id, stop_id ORDER BY sec) AS gap FROM (
    SELECT day, route_id, direction_id, stop_id, sched_sec AS sec FROM stop_times JOIN trips USING (trip_id) JOIN active USING (service_id)))
  WHERE gap > 0 AND gap <= 7200 GROUP BY ALL"""
query("agg24_scheduled_headway_cells", f"""
SELECT CAST(day AS VARCHAR) AS day, route_id, direction_id, stop_id, local_hour, CAST(m AS DOUBLE) AS sched_median_headway_s, sched_n FROM ({SCHED_CELLS})
""", "stop_times trips active")(lambda s, d: S.scheduled_headway_cells(
    typed(s, d), I.trips(s, d), S.active_services(I.calendar(s, d), I.calendar_dates(s, d), I.service_days(s, d))))
query("jon16_active_in_bin", """
WITH sp AS (SELECT trip_id, min(sched_sec) AS a, max(sched_sec) AS b FROM stop_times GROUP BY 1)
SELECT CAST(bin_sec AS BIGINT) AS bin_sec, count(*) AS scheduled_active FROM range(0, 86400, 300) AS x(bin_sec)
JOIN sp ON (a <= bin_sec AND bin_sec <= b) OR (a <= bin_sec + 86400 AND bin_sec + 86400 <= b) GROUP BY 1
""", "stop_times")(lambda s, d: S.active_in_bin(S.trip_spans(typed(s, d))))
query("jon26_scheduled_series", """
WITH p AS (SELECT t.trip_id, t.route_id, t.direction_id, CAST(sched_sec AS INT) AS sched_arr_sec, stop_offset_ft FROM stop_times st JOIN trips t ON t.trip_id = st.trip_id
  JOIN stop_offsets o ON o.shape_id = t.shape_id AND o.stop_id = st.stop_id
  WHERE sched_sec BETWEEN 28800 AND 43200 AND t.service_id IN (SELECT service_id FROM active WHERE day = DATE '2024-01-10'))
SELECT * FROM p WHERE trip_id IN (SELECT trip_id FROM p GROUP BY 1 HAVING count(*) >= 2)
""", "stop_times trips stop_offsets active")(lambda s, d: S.scheduled_series(
    I.trips(s, d), typed(s, d), I.stop_offsets(s, d),
    S.active_services(I.calendar(s, d), I.calendar_dates(s, d), I.service_days(s, d)).where("day = DATE'2024-01-10'"), 28800, 43200))
query("jon29_owned_routes", """
WITH listed AS (SELECT f.feed, route_id, route_short_name FROM routes, (SELECT DISTINCT feed FROM trips) f)
SELECT route_id, min(feed) AS feed, min(route_short_name) AS route_short_name FROM listed l
WHERE EXISTS (SELECT 1 FROM trips t WHERE t.feed = l.feed AND t.route_id = l.route_id) GROUP BY 1
""", "routes trips")(lambda s, d: S.owned_routes(
    I.union_all([I.routes(s, d).withColumn("feed", F.lit(f)) for f in ("bus_a", "bus_b")]), I.trips(s, d)))
CANON = """SELECT route_id, direction_id, shape_id, rep_trip, n_trips, n_points FROM (SELECT *, row_number() OVER (PARTITION BY route_id, direction_id ORDER BY {by} DESC, shape_id) AS rn FROM (
  SELECT route_id, direction_id, t.shape_id, count(*) AS n_trips, min(trip_id) AS rep_trip, coalesce(any_value(np), 0) AS n_points FROM trips t
  LEFT JOIN (SELECT shape_id, count(*) AS np FROM shape_points GROUP BY 1) p ON p.shape_id = t.shape_id GROUP BY 1, 2, 3)) WHERE rn = 1"""
query("top07_shape_most_used", CANON.format(by="n_trips"), "trips shape_points")(lambda s, d: S.canonical_shape(I.trips(s, d), I.shape_points(s, d), "trips"))
query("top07_shape_most_detailed", CANON.format(by="n_points"), "trips shape_points")(lambda s, d: S.canonical_shape(I.trips(s, d), I.shape_points(s, d), "points"))
query("top07_trunk_stop", """
SELECT route_id, stop_id, visits FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY visits DESC, stop_id) AS rn FROM (
  SELECT route_id, stop_id, count(*) AS visits FROM stop_times JOIN trips USING (trip_id) GROUP BY 1, 2)) WHERE rn = 1
""", "stop_times trips")(lambda s, d: S.trunk_stop(I.stop_times(s, d), I.trips(s, d)))
query("jon30_route_stops", f"""
WITH c AS ({CANON.format(by="n_points")}) SELECT DISTINCT c.route_id, sp.stop_id, stop_name, lat, lon
FROM c JOIN stop_times st ON st.trip_id = c.rep_trip JOIN stops sp ON sp.stop_id = st.stop_id
""", "trips shape_points stop_times stops")(lambda s, d: S.route_stops(I.trips(s, d), I.shape_points(s, d), I.stop_times(s, d), I.stops(s, d)))
query("agg74_station_catalog", """
WITH rep AS (SELECT shape_id, min(trip_id) AS trip_id, min(route_id) AS route_id FROM trips GROUP BY 1),
sv AS (SELECT DISTINCT sp.parent_station AS station_id, rep.route_id FROM rep JOIN stop_times st ON st.trip_id = rep.trip_id JOIN stops sp ON sp.stop_id = st.stop_id)
SELECT sv.station_id, string_agg(route_id, ',' ORDER BY route_id) AS routes, count(*) AS n_routes, any_value(stop_name) AS stop_name, any_value(lat) AS lat, any_value(lon) AS lon
FROM sv JOIN stops ON stops.stop_id = sv.station_id GROUP BY 1
""", "trips stop_times stops")(lambda s, d: S.station_catalog(I.stops(s, d), I.trips(s, d), I.stop_times(s, d)))
query("jon22_canonical_predecessor", """
WITH a AS (SELECT route_id, stop_id, lag(stop_id) OVER w AS p, lead(stop_id) OVER w AS nx FROM stop_times JOIN trips USING (trip_id) WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence)),
v AS (SELECT route_id, stop_id, p IS NOT NULL AS inner_, coalesce(p, nx) AS pred, count(*) AS n FROM a WHERE p IS NOT NULL OR nx IS NOT NULL GROUP BY ALL)
SELECT route_id, stop_id, pred, inner_ AS "inner", n FROM (SELECT *, row_number() OVER (PARTITION BY route_id, stop_id ORDER BY inner_ DESC, n DESC, pred) AS rn FROM v) WHERE rn = 1
""", "stop_times trips")(lambda s, d: S.canonical_predecessor(typed(s, d), I.trips(s, d)))


# ------------------------------------------------------------------ two feeds with the same ids
def wk2(s, d):
    t, r_, st = I.two_feed_schedule(s, d)
    return S.weekday_trips(t, r_, st)


query("jon01_weekday_trips_two_feeds", "SELECT feed, trip_id, route_id, route, route_norm, direction_id, CAST(start_sec AS INT) AS start_sec, start_hour FROM wk_trips2", "wk_trips2")(wk2)
query("agg16_stop_service_two_feeds", """
SELECT st.feed, st.stop_id, any_value(sp.stop_name) AS stop_name, count(*) AS weekday_arrivals, count(DISTINCT route) AS n_routes
FROM stop_times2 st JOIN wk_trips2 w ON st.trip_id = w.trip_id AND st.feed = w.feed LEFT JOIN stops sp ON sp.stop_id = st.stop_id GROUP BY 1, 2
""", "wk_trips2 stops")(lambda s, d: S.stop_service(I.two_feed_schedule(s, d)[2], wk2(s, d), I.stops(s, d)))
query("agg45_stop_windows_two_feeds", f"""
WITH ch AS ({REP.replace("FROM trips", "FROM trips2")}), ev AS (SELECT DISTINCT st.feed, stop_id, st.trip_id, (sched_sec // 3600) % 24 AS hr FROM stop_times2 st JOIN trips2 t ON st.trip_id = t.trip_id AND st.feed = t.feed
  JOIN ch ON ch.feed = t.feed AND ch.route_id = t.route_id AND ch.service_id = t.service_id)
SELECT feed, stop_id, trips_am, trips_midday, trips_eve, trips_daytime, round(trips_am / 3, 2) AS tph_am, round(trips_midday / 6, 2) AS tph_midday, round(trips_eve / 3, 2) AS tph_eve FROM (
SELECT feed, stop_id, count(DISTINCT trip_id) FILTER (hr IN (7, 8, 9)) AS trips_am, count(DISTINCT trip_id) FILTER (hr >= 10 AND hr < 16) AS trips_midday,
  count(DISTINCT trip_id) FILTER (hr IN (19, 20, 21)) AS trips_eve, count(DISTINCT trip_id) FILTER (hr >= 5 AND hr < 22) AS trips_daytime FROM ev GROUP BY ALL)
""", "trips2 stop_times2")(lambda s, d: (lambda t, _, st: S.stop_windows(st, t, S.representative_service(t)))(*I.two_feed_schedule(s, d)))
query("agg51_frequent_stops_two_feeds", """
SELECT feed, stop_id, count(*) AS am_trips FROM stop_times2 WHERE sched_sec >= 25200 AND sched_sec < 32400 GROUP BY 1, 2 HAVING count(*) >= 8
""", "stop_times2")(lambda s, d: S.frequent_stops(I.two_feed_schedule(s, d)[2]))
query("src16_gtfs_index_two_feeds", """
SELECT t.feed, t.trip_id, t.route_id, t.direction_id, t.service_id, t.shape_id, st.stop_id, st.stop_sequence AS stop_seq,
  CAST(sched_sec AS INT) AS sched_arr_sec, CAST(sched_sec AS INT) AS sched_dep_sec FROM trips2 t JOIN stop_times2 st ON t.trip_id = st.trip_id AND t.feed = st.feed
""", "trips2 stop_times2")(lambda s, d: (lambda t, r_, st: (lambda g: g["trip_meta"].join(g["stop_times"], ["feed", "trip_id"]))(
    S.gtfs_index({"trips": t, "routes": r_, "stop_times": st, "calendar": I.calendar(s, d), "calendar_dates": I.calendar_dates(s, d)})))(*I.two_feed_schedule(s, d)))
