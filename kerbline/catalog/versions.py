"""Queries on differences between schedule versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.catalog import inputs as I
from kerbline.catalog.registry import query
from kerbline.catalog.supply import CLASSES
from kerbline.functions import clock
from kerbline.operators import changes as C
from kerbline.operators import gtfsdiff as G
from kerbline.operators import supply as S
from kerbline.session import materialize

FEED, TS1, TS2, TS3 = "gtfs_supplemented", "20240101T000000Z", "20240108_base", "20240115T120000"


def ab(s, d):
    return I.snapshot(s, d, "A"), I.snapshot(s, d, "B")


def _t(name, v):
    return name + ("_b" if v == "B" else "")


def period_trips(v):
    return f"(SELECT t.*, coalesce(c.period, 'other') AS service_period FROM {_t('trips', v)} t LEFT JOIN ({CLASSES}) c ON c.service_id = t.service_id)"


def trunk(v):
    st, pt = _t("stop_times", v), period_trips(v)
    return f"""SELECT route_id, service_period, tod_window, direction_id, floor((median(gap) * 10 + 3) / 6) / 100 AS headway_min FROM (
  SELECT *, sched_sec - lag(sched_sec) OVER (PARTITION BY route_id, service_period, tod_window, direction_id ORDER BY sched_sec) AS gap FROM (
    SELECT p.route_id, service_period, direction_id, sched_sec, CASE WHEN m >= 21600 AND m < 36000 THEN 'am_peak' WHEN m >= 36000 AND m < 57600 THEN 'midday'
      WHEN m >= 57600 AND m < 72000 THEN 'pm_peak' WHEN m >= 72000 THEN 'evening' END AS tod_window
    FROM (SELECT *, sched_sec % 86400 AS m FROM {st}) s JOIN {pt} p ON p.trip_id = s.trip_id
    JOIN (SELECT route_id, stop_id FROM (SELECT route_id, stop_id, row_number() OVER (PARTITION BY route_id ORDER BY count(*) DESC, stop_id) AS rn
      FROM {st} JOIN {_t('trips', v)} USING (trip_id) GROUP BY 1, 2) WHERE rn = 1) k ON k.route_id = p.route_id AND k.stop_id = s.stop_id)
  WHERE tod_window IS NOT NULL) q GROUP BY 1, 2, 3, 4
  HAVING count(*) >= 3 AND count(*) FILTER (gap > 0) >= 2""".replace("median(gap)", "median(CASE WHEN gap > 0 THEN gap END)")


def spans(v):
    return f"SELECT route_id, service_period, min(sched_sec) AS a, max(sched_sec) AS b FROM {_t('stop_times', v)} JOIN {period_trips(v)} USING (trip_id) GROUP BY 1, 2"


CT = "trips routes stop_times stops calendar calendar_dates trips_b routes_b stop_times_b stops_b"


def hm(c):
    return f"lpad(CAST({c} // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST({c} % 3600 // 60 AS VARCHAR), 2, '0')"


def sql_parts(a, b):
    ra, rb, sa, sb = _t("routes", a), _t("routes", b), _t("stops", a), _t("stops", b)
    names = f"(SELECT route_id, min(route_short_name) AS route_name FROM {rb} GROUP BY 1)"
    return {
        "routes": f"""SELECT route_id, min(route_short_name) AS route_name, 'added' AS side FROM {rb} WHERE route_id NOT IN (SELECT route_id FROM {ra}) GROUP BY 1
          UNION ALL SELECT route_id, min(route_short_name), 'removed' FROM {ra} WHERE route_id NOT IN (SELECT route_id FROM {rb}) GROUP BY 1""",
        "stops": f"""SELECT stop_id, stop_name, 'added' AS side FROM {sb} WHERE stop_id NOT IN (SELECT stop_id FROM {sa})
          UNION ALL SELECT stop_id, stop_name, 'removed' FROM {sa} WHERE stop_id NOT IN (SELECT stop_id FROM {sb})""",
        "counts": f"""SELECT *, CASE WHEN from_trips > 0 THEN round((to_trips - from_trips) / from_trips * 100, 1) END AS pct, CAST(to_trips - from_trips AS DOUBLE) AS magnitude FROM (
          SELECT n.route_id, n.route_name, (SELECT count(*) FROM {_t('trips', a)} t WHERE t.route_id = n.route_id) AS from_trips,
            (SELECT count(*) FROM {_t('trips', b)} t WHERE t.route_id = n.route_id) AS to_trips FROM {names} n WHERE n.route_id IN (SELECT route_id FROM {ra})) WHERE from_trips <> to_trips""",
        "headways": f"""SELECT x.route_id, x.service_period, x.tod_window, x.direction_id, x.headway_min AS from_headway_min, y.headway_min AS to_headway_min,
          coalesce(route_name, x.route_id) AS route_name, round((y.headway_min - x.headway_min) / x.headway_min * 100, 1) AS pct
          FROM ({trunk(a)}) x JOIN ({trunk(b)}) y ON x.route_id = y.route_id AND x.service_period = y.service_period AND x.tod_window = y.tod_window AND x.direction_id = y.direction_id
          LEFT JOIN {names} n ON n.route_id = x.route_id WHERE x.headway_min > 0 AND abs((y.headway_min - x.headway_min) / x.headway_min * 100) > 10""",
        "spans": f"""SELECT x.route_id, coalesce(route_name, x.route_id) AS route_name, x.service_period, {hm('x.a')} AS from_first, {hm('y.a')} AS to_first,
          {hm('x.b')} AS from_last, {hm('y.b')} AS to_last, round((y.a - x.a) / 60, 1) AS d_first_min, round((y.b - x.b) / 60, 1) AS d_last_min,
          round(greatest(abs((y.a - x.a) / 60), abs((y.b - x.b) / 60)), 1) AS magnitude FROM ({spans(a)}) x JOIN ({spans(b)}) y
          ON x.route_id = y.route_id AND x.service_period = y.service_period LEFT JOIN {names} n ON n.route_id = x.route_id WHERE abs(y.a - x.a) > 300 OR abs(y.b - x.b) > 300""",
        "moves": f"""SELECT stop_id, stop_name, round(d, 1) AS meters, round(d, 1) AS magnitude FROM (SELECT y.stop_id, y.stop_name, 2 * 6371000 * asin(sqrt(
          pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2))) AS d
          FROM {sa} x JOIN {sb} y ON x.stop_id = y.stop_id) WHERE d > 25""",
        "shapes": f"""SELECT g.route_id, coalesce(route_name, g.route_id) AS route_name, n AS trips_with_new_shape, CAST(n AS DOUBLE) AS magnitude FROM (
          SELECT y.route_id, count(*) AS n FROM {_t('trips', a)} x JOIN {_t('trips', b)} y ON x.trip_id = y.trip_id WHERE x.shape_id <> y.shape_id GROUP BY 1) g
          LEFT JOIN {names} nm ON nm.route_id = g.route_id""",
    }


AB = sql_parts("A", "B")


def sql_deltas(a, b, from_ts, to_ts):
    """All change records as DuckDB text, with the fields the sentences need."""
    p = sql_parts(a, b)
    head = f"SELECT '{FEED}' AS feed, '{from_ts}' AS from_ts, '{to_ts}' AS to_ts,"
    none = "NULL AS service_period, NULL AS tod_window, NULL AS direction"
    num = lambda c: f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"
    pretty = "CASE tod_window WHEN 'am_peak' THEN 'AM peak' WHEN 'pm_peak' THEN 'PM peak' ELSE tod_window END"
    cap = "upper(service_period[1:1]) || service_period[2:]"

    def mins(c):
        v = f"CAST(round_even({c}, 0) AS INT)"
        return (f"CASE WHEN {v} < 0 THEN '-' ELSE '+' END || CASE WHEN abs({v}) < 60 THEN CAST(abs({v}) AS VARCHAR) || ' min' ELSE "
                f"CAST(abs({v}) // 60 AS VARCHAR) || 'h' || lpad(CAST(abs({v}) % 60 AS VARCHAR), 2, '0') || 'm' END")

    return f"""
{head} 'route_' || side AS change_type, route_id, NULL::DOUBLE AS magnitude, {none}, '{{"route_name": "' || route_name || '"}}' AS dj,
  route_name || ': route ' || CASE side WHEN 'added' THEN 'added to' ELSE 'removed from' END || ' the schedule' AS phrase FROM ({p['routes']})
UNION ALL {head} 'stop_' || side, NULL, NULL, {none}, '{{"stop_id": "' || stop_id || '", "stop_name": "' || stop_name || '"}}', '?: stop ' || stop_id || ' ' || side FROM ({p['stops']})
UNION ALL {head} 'trip_count_delta', route_id, magnitude, {none},
  '{{"from_trips": ' || from_trips || ', "pct": ' || coalesce(CAST(pct AS VARCHAR), 'null') || ', "route_name": "' || route_name || '", "to_trips": ' || to_trips || '}}',
  route_name || ': daily scheduled trips ' || from_trips || ' → ' || to_trips || ' (' || coalesce(printf('%+.1f%%', pct), 'None') || ') — ' || CASE WHEN magnitude < 0 THEN 'less service' ELSE 'more service' END FROM ({p['counts']})
UNION ALL {head} 'headway_delta', route_id, pct, service_period, tod_window, CAST(direction_id AS VARCHAR),
  '{{"direction": ' || direction_id || ', "from_headway_min": ' || from_headway_min || ', "pct": ' || pct || ', "route_name": "' || route_name || '", "service_period": "' || service_period ||
  '", "to_headway_min": ' || to_headway_min || ', "tod_window": "' || tod_window || '"}}',
  route_name || ': ' || {cap} || ' ' || {pretty} || ' headway ' || {num('from_headway_min')} || ' → ' || {num('to_headway_min')} || ' min — ' ||
  CASE WHEN pct > 0 THEN 'less service' ELSE 'more service' END FROM ({p['headways']})
UNION ALL {head} 'service_span_change', route_id, magnitude, service_period, NULL, NULL,
  '{{"d_first_min": ' || d_first_min || ', "d_last_min": ' || d_last_min || ', "from_first": "' || from_first || '", "from_last": "' || from_last || '", "route_name": "' || route_name ||
  '", "service_period": "' || service_period || '", "to_first": "' || to_first || '", "to_last": "' || to_last || '"}}',
  route_name || ': ' || {cap} || ' service span ' || from_first || '–' || from_last || ' → ' || to_first || '–' || to_last || ' (' ||
  CASE WHEN d_first_min <> 0 AND d_last_min <> 0 THEN 'first trip ' || {mins('d_first_min')} || ', last trip ' || {mins('d_last_min')}
       WHEN d_first_min <> 0 THEN 'first trip ' || {mins('d_first_min')} WHEN d_last_min <> 0 THEN 'last trip ' || {mins('d_last_min')} ELSE 'span shifted' END || ')' FROM ({p['spans']})
UNION ALL {head} 'stop_relocated', NULL, magnitude, {none}, '{{"meters": ' || meters || ', "stop_id": "' || stop_id || '", "stop_name": "' || stop_name || '"}}',
  '?: stop ' || stop_id || ' moved ' || {num('meters')} || ' m' FROM ({p['moves']})
UNION ALL {head} 'shape_change', route_id, magnitude, {none}, '{{"route_name": "' || route_name || '", "trips_with_new_shape": ' || trips_with_new_shape || '}}',
  route_name || ': ' || trips_with_new_shape || ' trip(s) changed routing (shape)' FROM ({p['shapes']})"""


def deltas(s, d):
    a, b = ab(s, d)
    return G.gtfs_diff(a, b, FEED, TS1, TS2)


def two_pairs(s, d):
    a, b = map(G.prepared, ab(s, d))
    both = G.gtfs_diff(a, b, FEED, TS1, TS2).unionByName(G.gtfs_diff(b, a, FEED, TS2, TS3))
    return materialize(both, "deltas")


D1 = sql_deltas("A", "B", TS1, TS2)
D2 = f"{D1} UNION ALL {sql_deltas('B', 'A', TS2, TS3)}"
SIG = "feed, coalesce(route_id, ''), change_type, coalesce(service_period, ''), coalesce(tod_window, ''), coalesce(direction, '')"
CHANGES = f"""SELECT substr(sha1(concat_ws('|', feed, from_ts, to_ts, change_type, coalesce(route_id, 'None'), dj)), 1, 12) AS id, feed, coalesce(route_id, 'None') AS route_id,
  change_type, 'Subway' AS borough, phrase || CASE WHEN recur < 2 THEN ' (planned work window)' ELSE '' END AS summary,
  CASE WHEN recur < 2 THEN 'temporary' ELSE 'persisted' END AS classification,
  CASE change_type WHEN 'headway_delta' THEN CASE WHEN magnitude > 0 THEN 'less service' ELSE 'more service' END
    WHEN 'trip_count_delta' THEN CASE WHEN magnitude < 0 THEN 'less service' ELSE 'more service' END ELSE '' END AS service_direction,
  magnitude, from_ts, to_ts, CASE to_ts WHEN '{TS2}' THEN '2024-01-08 00:00:00' ELSE '2024-01-15 12:00:00' END AS detected_at
FROM (SELECT *, len(list_distinct(list(from_ts) OVER (PARTITION BY {SIG}))) AS recur FROM ({D2}))"""


def changes(s, d):
    return C.classify_changes(two_pairs(s, d))


query("win21_trunk_headways", trunk("A"), CT)(
    lambda s, d: (lambda a: S.trunk_headways(a["stop_times"], G._with_period(a)))(I.snapshot(s, d, "A")))
query("set02_set_difference", AB["stops"], CT)(lambda s, d: G.set_diff(*[v["stops"].select("stop_id", "stop_name") for v in ab(s, d)], "stop_id"))
query("dif01_routes_and_stops", f"""SELECT 'route' AS kind, route_id AS id, route_name AS name, side FROM ({AB['routes']})
UNION ALL SELECT 'stop', stop_id, stop_name, side FROM ({AB['stops']})""", CT)(
    lambda s, d: G.diff_routes(*ab(s, d)).select(F.lit("route").alias("kind"), F.col("route_id").alias("id"), F.col("route_name").alias("name"), "side")
    .unionByName(G.diff_stops(*ab(s, d)).select(F.lit("stop").alias("kind"), F.col("stop_id").alias("id"), F.col("stop_name").alias("name"), "side")))
query("dif02_trip_counts", AB["counts"], CT)(lambda s, d: G.diff_trip_counts(*ab(s, d)))
query("dif03_headways", f"SELECT * FROM ({AB['headways']})", CT)(lambda s, d: G.diff_headways(*ab(s, d)).drop("magnitude"))
query("dif04_spans", AB["spans"], CT)(lambda s, d: G.diff_spans(*ab(s, d)))
query("dif05_stop_moves", AB["moves"], CT)(lambda s, d: G.diff_stop_moves(*ab(s, d)))
query("dif06_shapes", AB["shapes"], CT)(lambda s, d: G.diff_shapes(*ab(s, d)))
query("dif07_summary", f"""SELECT feed, from_ts, to_ts, change_type, count(*) AS n, CAST(list_position(['route_added', 'route_removed', 'headway_delta', 'service_span_change',
  'trip_count_delta', 'stop_added', 'stop_removed', 'stop_relocated', 'shape_change'], change_type) AS INT) AS log_order FROM ({D1}) GROUP BY ALL""", CT)(
    lambda s, d: G.diff_summary(deltas(s, d)))
query("dif_all_records", f"SELECT feed, from_ts, to_ts, change_type, route_id, magnitude, dj AS detail_json FROM ({D1})", CT)(
    lambda s, d: deltas(s, d).drop("detail"))
query("dif08_pending_pairs", """
WITH ix AS (SELECT DISTINCT service_id AS feed, date AS ts FROM calendar_dates), p AS (SELECT feed, lag(ts) OVER (PARTITION BY feed ORDER BY ts) AS from_ts, ts AS to_ts FROM ix)
SELECT * FROM p WHERE from_ts IS NOT NULL AND NOT (feed LIKE '%Saturday')
""", "calendar_dates")(lambda s, d: (lambda ix: G.pending_pairs(ix, G.pending_pairs(ix.where("feed like '%Saturday'"), ix.limit(0).select("feed", F.col("ts").alias("from_ts"), F.col("ts").alias("to_ts")))))(
    I.calendar_dates(s, d).select(F.col("service_id").alias("feed"), F.col("date").alias("ts")).distinct()))
query("prj13_change_id", f"SELECT id, change_type, route_id FROM ({CHANGES})", CT)(
    lambda s, d: (lambda x: x.select(C.change_id(x).alias("id"), "change_type", F.coalesce("route_id", F.lit("None")).alias("route_id")))(two_pairs(s, d)))
query("prj14_change_summary", f"SELECT id, summary, service_direction FROM ({CHANGES})", CT)(lambda s, d: changes(s, d).select("id", "summary", "service_direction"))
query("prj15_version_timestamps", """
SELECT t AS stamp, count(*) AS n, CASE WHEN k = 3 THEN '1970-01-01 00:00:00' WHEN k = 2 THEN strftime(d, '%Y-%m-%d 00:00:00') ELSE strftime(d, '%Y-%m-%d 07:08:09') END AS parsed FROM (
  SELECT o_orderdate AS d, o_orderkey % 4 AS k, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y%m%dT070809Z') WHEN 1 THEN strftime(o_orderdate, '%Y%m%dT070809_base')
    WHEN 2 THEN strftime(o_orderdate, '%Y%m%d_base') ELSE 'v' || strftime(o_orderdate, '%Y') END AS t FROM orders) GROUP BY ALL""")(
    lambda s, d: (lambda o: o.groupBy("stamp").agg(F.count(F.lit(1)).alias("n")).withColumn("parsed", F.date_format(clock.parse_version_ts(F.col("stamp")), "yyyy-MM-dd HH:mm:ss")))(
        I.table(s, d, "orders").select(F.element_at(F.array(
            F.date_format("o_orderdate", "yyyyMMdd'T070809Z'"), F.date_format("o_orderdate", "yyyyMMdd'T070809_base'"),
            F.date_format("o_orderdate", "yyyyMMdd'_base'"), F.concat(F.lit("v"), F.date_format("o_orderdate", "yyyy"))), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("stamp"))))
query("agg60_classified_changes", CHANGES, CT)(lambda s, d: changes(s, d).withColumn("detected_at", F.date_format("detected_at", "yyyy-MM-dd HH:mm:ss")))
query("agg60_change_facets", f"""WITH ch AS ({CHANGES}) SELECT 'feed' AS facet, feed AS value, count(*) AS n FROM ch GROUP BY 2 UNION ALL SELECT 'borough', borough, count(*) FROM ch GROUP BY 2
UNION ALL SELECT 'change_type', change_type, count(*) FROM ch GROUP BY 2 UNION ALL SELECT 'classification', classification, count(*) FROM ch GROUP BY 2""", CT)(lambda s, d: C.change_facets(changes(s, d)))
ORDER = "ORDER BY detected_at DESC, coalesce(abs(magnitude), 0) DESC, id"
query("top05_change_page", f"""SELECT id, detected_at, magnitude, (SELECT count(*) FROM ({CHANGES}) WHERE classification = 'persisted') AS total
FROM ({CHANGES}) WHERE classification = 'persisted' {ORDER} LIMIT 50 OFFSET 50""", CT)(
    lambda s, d: C.page(changes(s, d).withColumn("detected_at", F.date_format("detected_at", "yyyy-MM-dd HH:mm:ss")), 2, 50, {"classification": "persisted"}).select("id", "detected_at", "magnitude", "total"))
query("top06_change_feed", f"SELECT id, summary, magnitude FROM ({CHANGES}) {ORDER} LIMIT 200", CT)(lambda s, d: C.change_feed(changes(s, d), 200).select("id", "summary", "magnitude"))
