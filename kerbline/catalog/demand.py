"""Queries on ridership, enforcement and segment speeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.catalog import inputs as I
from kerbline.catalog.registry import query, r
from kerbline.functions import clock, codes
from kerbline.operators import demand as D
from kerbline.operators import speed as S

# DuckDB text of the route -> area rule.
BOROUGH = " ".join(["CASE", *[f"WHEN regexp_matches(upper({{c}}), '{p}') THEN '{area}'" for p, area in codes.AREA_BY_PREFIX], f"ELSE '{codes.AREA_OTHER}' END"])


def bor(c):
    return BOROUGH.replace("{c}", c)


TOTALS = f"""SELECT bus_route AS route, {bor('bus_route')} AS borough, round(sum(ridership), 2) AS total_boardings,
  round(sum(transfers), 3) AS total_transfers, strftime(min(transit_timestamp), '%Y-%m-%d') AS first_date,
  strftime(max(transit_timestamp), '%Y-%m-%d') AS last_date FROM rides GROUP BY bus_route"""


def _totals(spark, sf):
    return D.route_totals(I.rides(spark, sf)).withColumns(
        {"total_boardings": r("total_boardings", 2), "total_transfers": r("total_transfers", 3)}
    )


query("agg01_route_totals", TOTALS, "rides")(_totals)

query("top01_route_league", f"""
WITH t AS ({TOTALS})
SELECT * EXCLUDE (rn) FROM (SELECT *, 'top' AS side, row_number() OVER (ORDER BY total_boardings DESC, route) AS rn FROM t) WHERE rn <= 25
UNION ALL
SELECT * EXCLUDE (rn) FROM (SELECT *, 'bottom' AS side, row_number() OVER (ORDER BY total_boardings, route DESC) AS rn FROM t WHERE total_boardings > 0) WHERE rn <= 25
""", "rides")(lambda s, d: D.league(_totals(s, d), "total_boardings", "route"))

query("agg02_hourly_profile", """
SELECT CAST(hour(transit_timestamp) AS INT) AS hod, round(sum(ridership) FILTER (isodow(transit_timestamp) <= 5), 2) AS weekday_boardings,
  round(sum(ridership) FILTER (isodow(transit_timestamp) > 5), 2) AS weekend_boardings FROM rides GROUP BY 1
""", "rides")(lambda s, d: D.hourly_profile(I.rides(s, d)).select("hod", r("weekday_boardings", 2).alias("weekday_boardings"), r("weekend_boardings", 2).alias("weekend_boardings")))

query("agg03_hourly_profile_borough", f"""
SELECT CAST(hour(transit_timestamp) AS INT) AS hod, {bor('bus_route')} AS borough, round(sum(ridership), 2) AS boardings
FROM rides WHERE isodow(transit_timestamp) <= 5 GROUP BY 1, 2
""", "rides")(lambda s, d: D.hourly_profile_by(I.rides(s, d), codes.borough_from_route(F.col("bus_route")), "borough").withColumn("boardings", r("boardings", 2)))

query("agg04_recovery_yearly", """
WITH y AS (SELECT CAST(year(transit_timestamp) AS INT) AS yr, sum(ridership) AS b FROM rides GROUP BY 1)
SELECT yr, round(b, 2) AS boardings, round((b / lag(b) OVER (ORDER BY yr) - 1) * 100, 4) AS yoy_pct,
  round(b / (SELECT b FROM y WHERE yr = 1996) * 100, 4) AS index_vs_base FROM y
""", "rides")(lambda s, d: D.recovery_yearly(I.rides(s, d), 1996).select("yr", r("boardings", 2).alias("boardings"), r("yoy_pct").alias("yoy_pct"), r("index_vs_base").alias("index_vs_base")))

query("win16_yoy_change", """
WITH y AS (SELECT CAST(year(transit_timestamp) AS INT) AS yr, sum(ridership) AS b FROM rides GROUP BY 1)
SELECT yr, round(100 * (b - p) / p, 4) AS yoy_pct FROM (SELECT yr, b, lag(b) OVER (ORDER BY yr) AS p FROM y)
""", "rides")(lambda s, d: D.yoy(D.yearly_totals(I.rides(s, d)), "yr", "boardings").select("yr", r("yoy_pct").alias("yoy_pct")))

query("agg05_recovery_monthly", """
SELECT strftime(date_trunc('month', transit_timestamp), '%Y-%m-%d') AS month, round(sum(ridership), 2) AS boardings FROM rides GROUP BY 1
""", "rides")(lambda s, d: D.recovery_monthly(I.rides(s, d)).withColumn("boardings", r("boardings", 2)))

query("agg06_area_totals", f"""
SELECT {bor('bus_route')} AS borough, count(DISTINCT bus_route) AS n_routes, round(sum(ridership), 2) AS total_boardings FROM rides GROUP BY 1
""", "rides")(lambda s, d: D.area_totals(I.rides(s, d)).withColumn("total_boardings", r("total_boardings", 2)))

query("agg07_payment_mix", """
SELECT CAST(year(transit_timestamp) AS INT) AS yr, round(100 * sum(CASE WHEN payment_method = 'F' THEN ridership ELSE 0 END) / sum(ridership), 4) AS share_f,
  round(100 * sum(CASE WHEN payment_method = 'O' THEN ridership ELSE 0 END) / sum(ridership), 4) AS share_o,
  round(100 * sum(CASE WHEN payment_method = 'P' THEN ridership ELSE 0 END) / sum(ridership), 4) AS share_p FROM rides GROUP BY 1
""", "rides")(lambda s, d: D.payment_mix(I.rides(s, d), ["F", "O", "P"]).select("yr", *[r(c).alias(c) for c in ("share_f", "share_o", "share_p")]))

query("agg07_payment_by_year", """
SELECT CAST(year(transit_timestamp) AS INT) AS yr, payment_method, round(sum(ridership), 2) AS boardings FROM rides GROUP BY 1, 2
""", "rides")(lambda s, d: D.payment_by_year(I.rides(s, d)).withColumn("boardings", r("boardings", 2)))

query("agg08_class_share", """
SELECT fare_class, round(b, 2) AS boardings, round(100 * b / sum(b) OVER (), 4) AS share_pct
FROM (SELECT fare_class, sum(ridership) AS b FROM rides GROUP BY 1)
""", "rides")(lambda s, d: D.class_share(I.rides(s, d)).select("fare_class", r("boardings", 2).alias("boardings"), r("share_pct").alias("share_pct")))

query("agg13_route_hourly", f"""
SELECT bus_route AS route, {bor('bus_route')} AS borough, CAST(hour(transit_timestamp) AS INT) AS hod,
  round(sum(ridership) FILTER (isodow(transit_timestamp) <= 5), 2) AS weekday_boardings,
  round(sum(ridership) FILTER (isodow(transit_timestamp) > 5), 2) AS weekend_boardings, round(sum(ridership), 2) AS total_boardings
FROM rides GROUP BY 1, 2, 3
""", "rides")(lambda s, d: D.route_hourly(I.rides(s, d)).withColumns({c: r(c, 2) for c in ("weekday_boardings", "weekend_boardings", "total_boardings")}))

AVG_WEEKDAY = """SELECT rn AS route_norm, avg(b) AS avg_b FROM (
  SELECT upper(regexp_replace(bus_route, '[^A-Za-z0-9]', '', 'g')) AS rn, CAST(transit_timestamp AS DATE) AS d, sum(ridership) AS b
  FROM rides WHERE transit_timestamp >= TIMESTAMP '1997-07-01' AND isodow(transit_timestamp) <= 5 GROUP BY 1, 2) GROUP BY 1"""
query("agg17_avg_weekday", f"SELECT route_norm, round(avg_b, 4) AS avg_weekday_boardings FROM ({AVG_WEEKDAY})", "rides")(
    lambda s, d: D.avg_weekday(I.rides(s, d), "1997-07-01").withColumn("avg_weekday_boardings", r("avg_weekday_boardings")))

# ------------------------------------------------------------------ speeds
PW = "lower(day_of_week) NOT IN ('saturday', 'sunday') AND hour_of_day IN (7, 8, 9, 16, 17, 18, 19) AND speed > 0"
SEG = f"""SELECT route_id, borough, from_stop, to_stop, CAST(sum(trips) AS BIGINT) AS n_trips, round(avg(miles), 4) AS seg_miles,
  round(sum(speed * trips) / sum(trips), 4) AS wt_speed_mph FROM segment_speeds WHERE {PW} AND miles >= 0.1 GROUP BY ALL HAVING sum(trips) >= 100"""


def _seg(spark, sf):
    return S.segment_speed(I.segment_speeds(spark, sf), 100).withColumns({"seg_miles": r("seg_miles"), "wt_speed_mph": r("wt_speed_mph")})


query("agg09_segment_speed", SEG, "segment_speeds")(_seg)
query("top02_slowest_segments", f"SELECT * FROM ({SEG}) ORDER BY wt_speed_mph, route_id, from_stop, to_stop LIMIT 25", "segment_speeds")(lambda s, d: S.slowest(_seg(s, d), 25))
query("agg10_route_speed", f"""
SELECT route_id, min(borough) AS borough, CAST(sum(trips) AS BIGINT) AS n_trips, round(sum(speed * trips) / sum(trips), 4) AS wt_speed_mph
FROM segment_speeds WHERE {PW} GROUP BY 1 HAVING sum(trips) >= 2000""", "segment_speeds")(
    lambda s, d: S.route_speed(I.segment_speeds(s, d), 2000).withColumn("wt_speed_mph", r("wt_speed_mph")))
query("agg11_speed_by_area_hour", """
SELECT borough, hour_of_day, CAST(sum(trips) AS BIGINT) AS n_trips, round(sum(speed * trips) / sum(trips), 4) AS wt_speed_mph
FROM segment_speeds WHERE lower(day_of_week) NOT IN ('saturday', 'sunday') AND speed > 0 GROUP BY 1, 2""", "segment_speeds")(
    lambda s, d: S.speed_by_area_hour(I.segment_speeds(s, d)).withColumn("wt_speed_mph", r("wt_speed_mph")))
query("jon05_before_after", f"""
WITH f AS (SELECT route, program, start_date, obs_date >= start_date AS post, speed, trips FROM segment_speeds
  JOIN programs ON upper(route_id) = upper(replace(route, '+', '')) AND obs_date BETWEEN start_date - 120 AND start_date + 120 WHERE {PW}),
g AS (SELECT route, program, start_date, sum(speed * trips) FILTER (NOT post) / sum(trips) FILTER (NOT post) AS v0,
  sum(speed * trips) FILTER (post) / sum(trips) FILTER (post) AS v1, CAST(sum(trips) FILTER (NOT post) AS BIGINT) AS pre_trips,
  CAST(sum(trips) FILTER (post) AS BIGINT) AS post_trips FROM f GROUP BY 1, 2, 3)
SELECT route, program, CAST(start_date AS VARCHAR) AS implementation_date, round(v0, 4) AS pre_speed_mph, round(v1, 4) AS post_speed_mph,
  round(v1 - v0, 4) AS delta_mph, round((v1 - v0) / v0 * 100, 4) AS pct_change, pre_trips, post_trips
FROM g WHERE pre_trips >= 50 AND post_trips >= 50""", "segment_speeds programs")(
    lambda s, d: S.before_after(I.segment_speeds(s, d), I.programs(s, d), 120, 50).withColumns(
        {c: r(c) for c in ("pre_speed_mph", "post_speed_mph", "delta_mph", "pct_change")}))

# ------------------------------------------------------------------ enforcement
query("agg12_violations_by_year", """
SELECT route, CAST(year(first_occurrence) AS INT) AS year, count(*) AS violations FROM enforcement WHERE route IS NOT NULL GROUP BY 1, 2
""", "enforcement")(lambda s, d: D.violations_by_year(I.enforcement(s, d)))
query("jon03_ace_summary", """
WITH v AS (SELECT route, count(*) AS n, min(first_occurrence) AS a, max(first_occurrence) AS b FROM enforcement WHERE route IS NOT NULL GROUP BY 1)
SELECT coalesce(v.route, p.route) AS route, program, CAST(start_date AS VARCHAR) AS implementation_date, coalesce(n, 0) AS violations_total,
  CAST(a AS VARCHAR) AS first_violation, CAST(b AS VARCHAR) AS last_violation FROM v FULL OUTER JOIN programs p ON v.route = p.route
""", "enforcement programs")(lambda s, d: D.ace_summary(I.enforcement(s, d), I.programs(s, d)))

# ------------------------------------------------------------------ peak and weekday predicates
query("prj04_peak_weekday", """
SELECT hour_of_day, day_of_week, hour_of_day IN (7, 8, 9, 16, 17, 18, 19) AS peak, day_of_week NOT IN ('Saturday', 'Sunday') AS weekday, count(*) AS n
FROM segment_speeds GROUP BY ALL""", "segment_speeds")(
    lambda s, d: I.segment_speeds(s, d).groupBy(
        "hour_of_day", "day_of_week", clock.is_peak(F.col("hour_of_day")).alias("peak"),
        clock.is_weekday(F.col("day_of_week")).alias("weekday")).agg(F.count(F.lit(1)).alias("n")))
query("prj01_borough_from_route", f"SELECT ride_id, bus_route, {bor('bus_route')} AS borough FROM rides", "rides")(
    lambda s, d: I.rides(s, d).select("ride_id", "bus_route", codes.borough_from_route(F.col("bus_route")).alias("borough")))
