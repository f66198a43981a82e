"""Bindings: the given tables read as transit inputs.

Each binding exists twice: as a Spark projection (a function here) and as a
DuckDB common table expression (``CTE``).  Operators never see the given tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions import planar as P
from kerbline.plans.spread import dealt
from kerbline.session import configure

T0 = 1_704_067_200  # 2024-01-01 00:00 UTC
PREFIXES = ["M", "B", "Q", "S", "BX", "BM", "QM", "SIM", "X", "Z"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def pick(key, labels):
    """Label by key modulo the list."""
    return F.element_at(F.array(*[F.lit(v) for v in labels]), (key % len(labels) + 1).cast("int"))


def sql_pick(key, labels):
    return f"list_extract([{', '.join(repr(v) for v in labels)}], CAST({key} % {len(labels)} + 1 AS INT))"


CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def with_ctes(names: str, body: str) -> str:
    """Prefix ``body`` with the named CTEs and everything they need."""
    seen: list[str] = []

    def add(name):
        for dep in CTE[name][0]:
            add(dep)
        if name not in seen:
            seen.append(name)

    for name in names.split():
        add(name)
    parts = ", ".join(f"{n} AS ({CTE[n][1]})" for n in seen)
    body = body.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {parts}, {body[4:]}"
    return f"WITH {parts} {body}"


# ---------------------------------------------------------------- vehicle positions
def pings(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    t = F.lit(T0) + F.expr(f"(unix_micros(cast(ts as timestamp)) - {T0}000000) div 10000000")
    return e.select(
        "event_id",
        F.when(F.col("user_id") % 2 == 0, "bus_a").otherwise("bus_b").alias("feed"),
        F.col("user_id").cast("string").alias("vehicle_id"),
        F.concat(F.lit("R"), (F.col("user_id") % 5).cast("string")).alias("route_id"),
        F.expr("cast((user_id div 5) % 2 as int)").alias("direction_id"),
        F.col("event_type").alias("stop_id"),
        t.alias("ts"),
        (F.floor(t / 30) * 30).alias("poll_ts"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.floor(t / 86400).cast("string")).alias("trip_id"),
        F.when(F.col("event_id") % 3 == 0, 1).otherwise(2).alias("current_status"),
        (F.lit(980000.0) + k * 100).alias("x_ft"),
        (F.lit(190000.0) + F.col("value") * 20).alias("y_ft"),
        (F.lit(40.6) + F.col("value") * 0.0002).alias("lat"),
        (F.lit(-74.0) + k * 0.001).alias("lon"),
        ((t % 86400) / 10.0 + F.col("value") - F.when(k < 5, 2000.0).otherwise(0.0)).alias("offset_ft"),
        F.col("value"),
        k.alias("k"),
    )


CTE["pings"] = ((), f"""
SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'bus_a' ELSE 'bus_b' END AS feed,
  CAST(user_id AS VARCHAR) AS vehicle_id, 'R' || CAST(user_id % 5 AS VARCHAR) AS route_id,
  CAST((user_id // 5) % 2 AS INT) AS direction_id, event_type AS stop_id, t AS ts, (t // 30) * 30 AS poll_ts,
  CAST(user_id AS VARCHAR) || '-' || CAST(t // 86400 AS VARCHAR) AS trip_id,
  CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS current_status,
  980000.0::DOUBLE + k * 100 AS x_ft, 190000.0::DOUBLE + value * 20 AS y_ft,
  40.6::DOUBLE + value * 0.0002::DOUBLE AS lat, -74.0::DOUBLE + k * 0.001::DOUBLE AS lon,
  (t % 86400) / 10.0::DOUBLE + value - CASE WHEN k < 5 THEN 2000.0::DOUBLE ELSE 0.0::DOUBLE END AS offset_ft,
  value, k
FROM (SELECT *, {T0} + (epoch_us(ts) - {T0}000000) // 10000000 AS t,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
      FROM (SELECT event_id, ts, user_id, event_type, value, props FROM events))""")


def alerts(spark, sf):
    p = pings(spark, sf).where("stop_id = 'error'")
    aid = F.col("vehicle_id").cast("long") % 40
    return p.select(
        "event_id", "poll_ts", aid.cast("string").alias("alert_id"),
        F.when(F.col("event_id") % 7 != 0, (F.col("k") % 11 + 1).cast("int")).alias("effect"),
        F.col("route_id"), (F.col("event_id") % 2 == 0).alias("is_subway"),
    )


CTE["alerts"] = (("pings",), """
SELECT event_id, poll_ts, CAST(CAST(vehicle_id AS BIGINT) % 40 AS VARCHAR) AS alert_id,
  CASE WHEN event_id % 7 <> 0 THEN CAST(k % 11 + 1 AS INT) END AS effect, route_id, event_id % 2 = 0 AS is_subway
FROM pings WHERE stop_id = 'error'""")


# ---------------------------------------------------------------- ridership and speeds
def rides(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.select(
        F.col("o_orderkey").alias("ride_id"),
        F.concat(pick(F.col("n_nationkey"), PREFIXES), (F.col("o_custkey") % 30).cast("string")).alias("bus_route"),
        (F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(F.col("o_orderkey") % 24).cast("int"))).alias("transit_timestamp"),
        F.col("o_orderstatus").alias("payment_method"),
        F.col("o_orderpriority").alias("fare_class"),
        F.col("o_totalprice").alias("ridership"),
        (F.col("o_totalprice") / 10).alias("transfers"),
    )


CTE["rides"] = ((), f"""
SELECT o_orderkey AS ride_id, {sql_pick('n_nationkey', PREFIXES)} || CAST(o_custkey % 30 AS VARCHAR) AS bus_route,
  o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS transit_timestamp,
  o_orderstatus AS payment_method, o_orderpriority AS fare_class, o_totalprice AS ridership, o_totalprice / 10 AS transfers
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")

DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
AREAS = ["Manhattan", "Bronx", "Brooklyn", "Queens", "Staten Island"]


def segment_speeds(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat(F.lit("r"), (F.col("l_suppkey") % 25).cast("string")).alias("route_id"),
        pick(F.col("l_suppkey") % 25, AREAS).alias("borough"),
        F.concat(F.lit("s"), (F.col("l_partkey") % 12).cast("string")).alias("from_stop"),
        F.concat(F.lit("s"), ((F.col("l_partkey") + 1) % 12).cast("string")).alias("to_stop"),
        (F.col("l_orderkey") % 24).cast("int").alias("hour_of_day"),
        pick(F.weekday("l_shipdate"), DAYS).alias("day_of_week"),
        F.col("l_shipdate").cast("date").alias("obs_date"),
        F.col("l_quantity").alias("speed"),
        (F.col("l_linenumber") + 1).cast("long").alias("trips"),
        (F.col("l_discount") + 0.05).alias("miles"),
    )


CTE["segment_speeds"] = ((), f"""
SELECT 'r' || CAST(l_suppkey % 25 AS VARCHAR) AS route_id, {sql_pick('(l_suppkey % 25)', AREAS)} AS borough,
  's' || CAST(l_partkey % 12 AS VARCHAR) AS from_stop, 's' || CAST((l_partkey + 1) % 12 AS VARCHAR) AS to_stop,
  CAST(l_orderkey % 24 AS INT) AS hour_of_day, {sql_pick('(isodow(l_shipdate) - 1)', DAYS)} AS day_of_week,
  CAST(l_shipdate AS DATE) AS obs_date, l_quantity AS speed, CAST(l_linenumber + 1 AS BIGINT) AS trips,
  l_discount + 0.05::DOUBLE AS miles
FROM lineitem""")


def programs(spark, sf):
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("R"), F.col("s_suppkey").cast("string")).alias("route"),
        pick(F.col("s_suppkey"), ["ABLE", "ACE"]).alias("program"),
        F.date_add(F.lit("1996-01-01").cast("date"), (F.col("s_suppkey") * 60).cast("int")).alias("start_date"),
    )


CTE["programs"] = ((), f"""
SELECT 'R' || CAST(s_suppkey AS VARCHAR) AS route, {sql_pick('s_suppkey', ['ABLE', 'ACE'])} AS program,
  DATE '1996-01-01' + CAST(s_suppkey * 60 AS INT) AS start_date FROM supplier""")


def enforcement(spark, sf):
    """Violations: one per line item, some without a route."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.when(F.col("l_suppkey") % 13 != 0, F.concat(F.lit("R"), (F.col("l_suppkey") % 40).cast("string"))).alias("route"),
        F.col("l_shipdate").cast("date").alias("first_occurrence"),
    )


CTE["enforcement"] = ((), """
SELECT CASE WHEN l_suppkey % 13 <> 0 THEN 'R' || CAST(l_suppkey % 40 AS VARCHAR) END AS route,
  CAST(l_shipdate AS DATE) AS first_occurrence FROM lineitem""")


# ---------------------------------------------------------------- static schedule (version A)
def trips(spark, sf):
    o = table(spark, sf, "orders")
    r = F.col("o_custkey") % 40
    d = F.expr("(o_orderkey div 3) % 2")
    suffix = F.when(F.col("o_orderkey") % 5 == 3, "Weekday-SDon").when(F.col("o_orderkey") % 5 == 4, "Saturday").otherwise("Weekday")
    return o.select(
        F.when(r % 2 == 0, "bus_a").otherwise("bus_b").alias("feed"),
        F.col("o_orderkey").cast("string").alias("trip_id"),
        r.cast("string").alias("route_id"),
        d.cast("int").alias("direction_id"),
        F.concat(F.col("o_orderpriority"), F.lit("-"), suffix).alias("service_id"),
        F.concat(r.cast("string"), F.lit("-"), d.cast("string"), F.lit("-"), (F.col("o_orderkey") % 3).cast("string")).alias("shape_id"),
    )


CTE["trips"] = ((), """
SELECT CASE WHEN r % 2 = 0 THEN 'bus_a' ELSE 'bus_b' END AS feed, CAST(o_orderkey AS VARCHAR) AS trip_id,
  CAST(r AS VARCHAR) AS route_id, CAST(d AS INT) AS direction_id,
  o_orderpriority || '-' || CASE o_orderkey % 5 WHEN 3 THEN 'Weekday-SDon' WHEN 4 THEN 'Saturday' ELSE 'Weekday' END AS service_id,
  CAST(r AS VARCHAR) || '-' || CAST(d AS VARCHAR) || '-' || CAST(o_orderkey % 3 AS VARCHAR) AS shape_id
FROM (SELECT *, o_custkey % 40 AS r, (o_orderkey // 3) % 2 AS d FROM orders)""")


def routes(spark, sf):
    """Route list: one row per (feed, route) that customers' keys name."""
    c = table(spark, sf, "customer").select((F.col("c_custkey") % 40).alias("r")).distinct()
    return c.select(
        F.when(F.col("r") % 2 == 0, "bus_a").otherwise("bus_b").alias("feed"),
        F.col("r").cast("string").alias("route_id"),
        F.concat(pick(F.col("r"), PREFIXES), F.col("r").cast("string"), F.when(F.col("r") % 7 == 0, "-SBS").otherwise("")).alias("route_short_name"),
    )


CTE["routes"] = ((), f"""
SELECT CASE WHEN r % 2 = 0 THEN 'bus_a' ELSE 'bus_b' END AS feed, CAST(r AS VARCHAR) AS route_id,
  {sql_pick('r', PREFIXES)} || CAST(r AS VARCHAR) || CASE WHEN r % 7 = 0 THEN '-SBS' ELSE '' END AS route_short_name
FROM (SELECT DISTINCT c_custkey % 40 AS r FROM customer)""")


def stop_times(spark, sf):
    """One row per (trip, stop_sequence); times as text with hours above 24.

    Lines are dealt by trip, so what is done by trip later needs no other shuffle of them.
    """
    li = dealt(table(spark, sf, "lineitem").withColumn("trip_id", F.col("l_orderkey").cast("string")), "trip_id")
    g = li.groupBy("trip_id", "l_orderkey", (F.col("l_linenumber") * 600 + F.col("l_partkey") % 600).alias("seq")).agg(
        F.min("l_suppkey").alias("stop")
    )
    sec = (F.col("l_orderkey") % 23 + 5) * 3600 + (F.col("l_orderkey") % 12) * 300 + F.col("seq")
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    text = F.concat(two(F.floor(sec / 3600)), F.lit(":"), two(F.floor(sec % 3600 / 60)), F.lit(":"), two(sec % 60))
    return g.select(
        "trip_id", F.col("stop").cast("string").alias("stop_id"),
        F.col("seq").cast("long").alias("stop_sequence"), text.alias("arrival_time"), text.alias("departure_time"),
    )


CTE["stop_times"] = ((), """
SELECT CAST(l_orderkey AS VARCHAR) AS trip_id, CAST(stop AS VARCHAR) AS stop_id, CAST(seq AS BIGINT) AS stop_sequence,
  lpad(CAST(sec // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST((sec % 3600) // 60 AS VARCHAR), 2, '0') || ':' ||
  lpad(CAST(sec % 60 AS VARCHAR), 2, '0') AS arrival_time, sec AS sched_sec
FROM (SELECT *, (l_orderkey % 23 + 5) * 3600 + (l_orderkey % 12) * 300 + seq AS sec
      FROM (SELECT l_orderkey, l_linenumber * 600 + l_partkey % 600 AS seq, min(l_suppkey) AS stop FROM lineitem GROUP BY 1, 2))""")


def two_feeds(df, late=0):
    """The rows under two feeds, x and y, with the same ids; clocks of feed y run ``late`` hours later."""
    y = df.withColumn("feed", F.lit("y"))
    for c in ("arrival_time", "departure_time"):
        if late and c in df.columns:
            hour = F.substring_index(c, ":", 1).cast("int") + late
            y = y.withColumn(c, F.concat(F.lpad(hour.cast("string"), 2, "0"), F.substring(c, 3, 6)))
    return df.withColumn("feed", F.lit("x")).unionByName(y)


def two_feed_schedule(spark, sf):
    """trips, routes, stop_times of two feeds that number their trips, stops and routes alike; odd trips run in x only."""
    t = two_feeds(trips(spark, sf)).where("feed = 'x' or cast(trip_id as bigint) % 2 = 0")
    r = two_feeds(routes(spark, sf)).withColumn("route_short_name", F.concat(F.upper("feed"), "route_short_name"))
    return t, r, dealt(two_feeds(stop_times(spark, sf), 2), "feed", "trip_id", rows=2 * table(spark, sf, "lineitem").count())


CTE["stop_times2"] = (("stop_times",), """
SELECT f.feed, s.* REPLACE (sched_sec + CASE f.feed WHEN 'y' THEN 7200 ELSE 0 END AS sched_sec) FROM stop_times s, (VALUES ('x'), ('y')) f(feed)""")
CTE["trips2"] = (("trips",), """
SELECT t.* REPLACE (f.feed AS feed) FROM trips t, (VALUES ('x'), ('y')) f(feed) WHERE f.feed = 'x' OR CAST(trip_id AS BIGINT) % 2 = 0""")
CTE["wk_trips2"] = (("trips2", "routes", "stop_times2"), """
SELECT t.feed, t.trip_id, t.route_id, upper(t.feed) || r.route_short_name AS route, t.direction_id, s.start_sec, CAST((s.start_sec // 3600) % 24 AS INT) AS start_hour,
  upper(regexp_replace(replace(upper(t.feed) || r.route_short_name, '-SBS', ''), '[^A-Za-z0-9]', '', 'g')) AS route_norm
FROM trips2 t JOIN routes r ON t.route_id = r.route_id
JOIN (SELECT feed, trip_id, min(sched_sec) AS start_sec FROM stop_times2 GROUP BY 1, 2) s ON s.trip_id = t.trip_id AND s.feed = t.feed
WHERE t.service_id ILIKE '%weekday%' AND t.service_id NOT ILIKE '%SDon%'""")


def stops(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.cast("string").alias("stop_id"), F.col("s_name").alias("stop_name"),
        (F.lit(40.6) + (k * 37 % 500) * 0.0005).alias("lat"), (F.lit(-74.0) + (k * 91 % 400) * 0.0005).alias("lon"),
        F.expr("cast(s_suppkey - s_suppkey % 4 as string)").alias("parent_station"),
        (F.lit(500.0) + k % 40 * 200.0).alias("stop_offset_ft"),
    )


CTE["stops"] = ((), """
SELECT CAST(s_suppkey AS VARCHAR) AS stop_id, s_name AS stop_name,
  40.6::DOUBLE + (s_suppkey * 37 % 500) * 0.0005::DOUBLE AS lat, -74.0::DOUBLE + (s_suppkey * 91 % 400) * 0.0005::DOUBLE AS lon,
  CAST(s_suppkey - s_suppkey % 4 AS VARCHAR) AS parent_station, 500.0::DOUBLE + s_suppkey % 40 * 200.0::DOUBLE AS stop_offset_ft
FROM supplier""")


def calendar(spark, sf):
    s = trips(spark, sf).select("service_id").distinct()
    wk = F.when(F.col("service_id").contains("Weekday"), "1").otherwise("0")
    sat = F.when(F.col("service_id").contains("Saturday"), "1").otherwise("0")
    days = ["monday", "tuesday", "wednesday", "thursday", "friday"]
    return s.select("service_id", *[wk.alias(d) for d in days], sat.alias("saturday"), F.lit("0").alias("sunday"),
                    F.lit("20240101").alias("start_date"), F.lit("20240131").alias("end_date"))


CTE["calendar"] = (("trips",), """
SELECT service_id, CASE WHEN service_id LIKE '%Weekday%' THEN '1' ELSE '0' END AS wk,
  CASE WHEN service_id LIKE '%Saturday%' THEN '1' ELSE '0' END AS sat, '20240101' AS start_date, '20240131' AS end_date
FROM (SELECT DISTINCT service_id FROM trips)""")


def calendar_dates(spark, sf):
    o = trips(spark, sf).join(table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("trip_id"), "o_custkey"), "trip_id")
    d = (F.col("o_custkey") % 28 + 1).cast("int")
    e = (F.substring("service_id", 1, 1).cast("int") + d) % 3
    return o.select(
        "service_id", F.concat(F.lit("202401"), F.lpad(d.cast("string"), 2, "0")).alias("date"), e.cast("string").alias("exception_type")
    ).where("exception_type <> '0'").distinct()


CTE["calendar_dates"] = (("trips",), """
SELECT DISTINCT service_id, '202401' || lpad(CAST(d AS VARCHAR), 2, '0') AS date, CAST(e AS VARCHAR) AS exception_type
FROM (SELECT service_id, o_custkey % 28 + 1 AS d, (CAST(substr(service_id, 1, 1) AS INT) + o_custkey % 28 + 1) % 3 AS e
      FROM trips JOIN orders ON trip_id = CAST(o_orderkey AS VARCHAR)) WHERE e <> 0""")


# ---------------------------------------------------------------- schedule version B
def snapshot(spark, sf, version):
    """Tables of one schedule version; B drops, adds, shifts and moves rows by key rules."""
    t, r, st, sp = trips(spark, sf), routes(spark, sf), stop_times(spark, sf), stops(spark, sf)
    st = st.withColumn("sched_sec", _sched_seconds(F.col("trip_id").cast("long"), F.col("stop_sequence")))
    if version == "B":
        tid, rid, sid = F.col("trip_id").cast("long"), F.col("route_id").cast("int"), F.col("stop_id").cast("long")
        t = t.where(tid % 17 != 0).withColumn(
            "shape_id", F.when(tid % 19 == 0, F.concat("shape_id", F.lit("x"))).otherwise(F.col("shape_id"))
        )
        t = t.where(rid % 13 != 0).withColumn("route_id", F.when(rid % 11 == 0, F.concat(F.lit("9"), "route_id")).otherwise(F.col("route_id")))
        r = r.where(rid % 13 != 0).withColumn("route_id", F.when(rid % 11 == 0, F.concat(F.lit("9"), "route_id")).otherwise(F.col("route_id")))
        st = st.withColumn("sched_sec", F.col("sched_sec") + F.when(tid % 5 == 0, 600).otherwise(0) + F.when(tid % 7 == 0, 900).otherwise(0))
        sp = sp.where(sid % 17 != 0).select(
            F.when(sid % 19 == 0, (sid + 1000000).cast("string")).otherwise(F.col("stop_id")).alias("stop_id"), "stop_name",
            (F.col("lat") + F.when(sid % 7 == 0, 0.0004).otherwise(0.0)).alias("lat"), "lon",
        )
    return {"trips": t, "routes": r, "stop_times": st.select("trip_id", "stop_id", "stop_sequence", "sched_sec"),
            "stops": sp.select("stop_id", "stop_name", "lat", "lon"), "calendar": calendar(spark, sf), "calendar_dates": calendar_dates(spark, sf)}


def _sched_seconds(trip, seq):
    return (trip % 23 + 5) * 3600 + (trip % 12) * 300 + seq


CTE["trips_b"] = (("trips",), """
SELECT feed, trip_id, CASE WHEN CAST(route_id AS INT) % 11 = 0 THEN '9' || route_id ELSE route_id END AS route_id, direction_id,
  service_id, CASE WHEN CAST(trip_id AS BIGINT) % 19 = 0 THEN shape_id || 'x' ELSE shape_id END AS shape_id
FROM trips WHERE CAST(trip_id AS BIGINT) % 17 <> 0 AND CAST(route_id AS INT) % 13 <> 0""")
CTE["routes_b"] = (("routes",), """
SELECT feed, CASE WHEN CAST(route_id AS INT) % 11 = 0 THEN '9' || route_id ELSE route_id END AS route_id, route_short_name
FROM routes WHERE CAST(route_id AS INT) % 13 <> 0""")
CTE["stop_times_b"] = (("stop_times",), """
SELECT trip_id, stop_id, stop_sequence, sched_sec + CASE WHEN CAST(trip_id AS BIGINT) % 5 = 0 THEN 600 ELSE 0 END
  + CASE WHEN CAST(trip_id AS BIGINT) % 7 = 0 THEN 900 ELSE 0 END AS sched_sec FROM stop_times""")
CTE["stops_b"] = (("stops",), """
SELECT CASE WHEN s % 19 = 0 THEN CAST(s + 1000000 AS VARCHAR) ELSE stop_id END AS stop_id, stop_name,
  lat + CASE WHEN s % 7 = 0 THEN 0.0004::DOUBLE ELSE 0.0::DOUBLE END AS lat, lon
FROM (SELECT *, CAST(stop_id AS BIGINT) AS s FROM stops) WHERE s % 17 <> 0""")


# ---------------------------------------------------------------- places
def sites(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.cast("string").alias("site_id"), F.col("s_name").alias("site_name"),
        (F.lit(980000.0) + k * 7919 % 19997).alias("sx"), (F.lit(190000.0) + k * 10459 % 19991).alias("sy"),
        F.col("s_acctbal").alias("score"), F.col("s_nationkey").alias("nation"),
    )


CTE["sites"] = ((), """
SELECT CAST(s_suppkey AS VARCHAR) AS site_id, s_name AS site_name, 980000.0::DOUBLE + s_suppkey * 7919 % 19997 AS sx,
  190000.0::DOUBLE + s_suppkey * 10459 % 19991 AS sy, s_acctbal AS score, s_nationkey AS nation FROM supplier""")


def points(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("point_id"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("amount"),
        (F.lit(980000.0) + k * 6007 % 19997).alias("x"), (F.lit(190000.0) + k * 12007 % 19991).alias("y"),
    )


CTE["points"] = ((), """
SELECT c_custkey AS point_id, c_mktsegment AS kind, c_acctbal AS amount,
  980000.0::DOUBLE + c_custkey * 6007 % 19997 AS x, 190000.0::DOUBLE + c_custkey * 12007 % 19991 AS y FROM customer""")


def areas(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    k = F.col("n_nationkey")
    x0, y0 = F.lit(980000.0) + k % 5 * 4000, F.lit(190000.0) + F.expr("n_nationkey div 5") * 4000
    return j.select(
        F.col("n_name").alias("area"), F.col("r_name").alias("borough"),
        x0.alias("ax0"), y0.alias("ay0"), (x0 + 4000).alias("ax1"), (y0 + 4000).alias("ay1"),
        F.array(P.rectangle(x0, y0, x0 + 4000, y0 + 4000)).alias("rings"),
    )


CTE["areas"] = ((), """
SELECT n_name AS area, r_name AS borough, 980000.0::DOUBLE + n_nationkey % 5 * 4000 AS ax0, 190000.0::DOUBLE + n_nationkey // 5 * 4000 AS ay0,
  980000.0::DOUBLE + n_nationkey % 5 * 4000 + 4000 AS ax1, 190000.0::DOUBLE + n_nationkey // 5 * 4000 + 4000 AS ay1
FROM nation JOIN region ON n_regionkey = r_regionkey""")


def blocks(spark, sf):
    """City blocks: axis-aligned boxes of 180 x 140 ft with people and income."""
    k = F.col("p_partkey")
    x0, y0 = F.lit(980000.0) + k * 200 % 20000, F.lit(190000.0) + F.expr("p_partkey div 100") * 200 % 20000
    return table(spark, sf, "part").select(
        F.concat(F.lit("36061"), F.lpad(k.cast("string"), 10, "0")).alias("geoid"), k.alias("block_id"),
        pick(k, AREAS).alias("borough"), F.col("p_size").cast("long").alias("pop"),
        F.when(k % 50 == 0, F.lit(-666666666.0)).otherwise(F.col("p_retailprice")).alias("income_raw"),
        (F.col("p_size") % 7 * 10).cast("long").alias("jobs"),
        x0.alias("bx0"), y0.alias("by0"), (x0 + 180).alias("bx1"), (y0 + 140).alias("by1"),
        (x0 + 90).alias("cx"), (y0 + 70).alias("cy"),
    )


CTE["blocks"] = ((), f"""
SELECT '36061' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS geoid, p_partkey AS block_id, {sql_pick('p_partkey', AREAS)} AS borough,
  CAST(p_size AS BIGINT) AS pop, CASE WHEN p_partkey % 50 = 0 THEN -666666666.0::DOUBLE ELSE p_retailprice END AS income_raw,
  CAST(p_size % 7 * 10 AS BIGINT) AS jobs, bx0, by0, bx0 + 180 AS bx1, by0 + 140 AS by1, bx0 + 90 AS cx, by0 + 70 AS cy
FROM (SELECT *, 980000.0::DOUBLE + p_partkey * 200 % 20000 AS bx0, 190000.0::DOUBLE + (p_partkey // 100) * 200 % 20000 AS by0 FROM part)""")


def streets(spark, sf):
    """Street centre lines: horizontal or vertical two-vertex lines."""
    k = F.col("p_partkey")
    x0, y0 = F.lit(980000.0) + k * 6011 % 19997, F.lit(190000.0) + k * 3571 % 19991
    x0, y0 = F.floor(x0 / 400) * 400.0, F.floor(y0 / 400) * 400.0
    hor = k % 2 == 0
    x1, y1 = x0 + F.when(hor, 400.0).otherwise(0.0), y0 + F.when(hor, 0.0).otherwise(400.0)
    return table(spark, sf, "part").select(
        k.alias("street_id"), F.col("p_name").alias("street"), pick(F.col("p_size"), AREAS).alias("borough"),
        F.when(k % 9 != 0, (F.col("p_size") % 20 + 20).cast("string")).otherwise("n/a").alias("width_text"),
        x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"),
    )


CTE["streets"] = ((), f"""
SELECT street_id, street, borough, width_text, x0, y0, x0 + CASE WHEN street_id % 2 = 0 THEN 400.0::DOUBLE ELSE 0.0::DOUBLE END AS x1,
  y0 + CASE WHEN street_id % 2 = 0 THEN 0.0::DOUBLE ELSE 400.0::DOUBLE END AS y1
FROM (SELECT p_partkey AS street_id, p_name AS street, {sql_pick('p_size', AREAS)} AS borough,
  CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_size % 20 + 20 AS VARCHAR) ELSE 'n/a' END AS width_text,
  floor((980000.0::DOUBLE + p_partkey * 6011 % 19997) / 400) * 400.0::DOUBLE AS x0,
  floor((190000.0::DOUBLE + p_partkey * 3571 % 19991) / 400) * 400.0::DOUBLE AS y0 FROM part)""")


def union_all(dfs):
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


# ---------------------------------------------------------------- shapes and stop offsets
def shape_points(spark, sf):
    """Vertices of the route shapes, as far as orders name them."""
    o = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 40).alias("r"), F.expr("(o_orderkey div 3) % 2").alias("d"), (F.col("o_orderkey") % 3).alias("k"),
        F.expr("(o_orderkey div 18) % 12").alias("seq"),
    ).distinct()
    return o.select(
        F.concat_ws("-", F.col("r").cast("string"), F.col("d").cast("string"), F.col("k").cast("string")).alias("shape_id"),
        F.col("seq").cast("long").alias("seq"),
        (F.lit(980000.0) + F.col("r") * 400 + F.col("seq") * 700).alias("x_ft"),
        (F.lit(190000.0) + F.col("d") * 5000 + F.col("k") * 60 + F.col("seq") * F.col("seq") * 37 % 500).alias("y_ft"),
    )


CTE["shape_points"] = ((), """
SELECT CAST(r AS VARCHAR) || '-' || CAST(d AS VARCHAR) || '-' || CAST(k AS VARCHAR) AS shape_id, CAST(seq AS BIGINT) AS seq,
  980000.0::DOUBLE + r * 400 + seq * 700 AS x_ft, 190000.0::DOUBLE + d * 5000 + k * 60 + seq * seq * 37 % 500 AS y_ft
FROM (SELECT DISTINCT o_custkey % 40 AS r, (o_orderkey // 3) % 2 AS d, o_orderkey % 3 AS k, (o_orderkey // 18) % 12 AS seq FROM orders)""")


def stop_offsets(spark, sf):
    """Offset of each stop along each shape, from the sequence its trips visit it in."""
    st, t = stop_times(spark, sf), trips(spark, sf)
    return st.join(t.select("trip_id", "shape_id"), "trip_id").groupBy("shape_id", "stop_id").agg(
        (F.min("stop_sequence") * 2.0).alias("stop_offset_ft"))


CTE["stop_offsets"] = (("stop_times", "trips"), """
SELECT shape_id, stop_id, min(stop_sequence) * 2.0::DOUBLE AS stop_offset_ft FROM stop_times JOIN trips USING (trip_id) GROUP BY 1, 2""")


def line_stops(spark, sf):
    """Nine stops per (route, direction) of the vehicle positions, 1000 ft apart."""
    rd = pings(spark, sf).select("route_id", "direction_id").distinct()
    return rd.select("route_id", "direction_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i")).select(
        "route_id", "direction_id", F.concat(F.lit("S"), F.col("i").cast("string")).alias("stop_id"),
        (F.col("i") * 1000.0 + 500.0).alias("stop_offset_ft"))


CTE["line_stops"] = (("pings",), """
SELECT route_id, direction_id, 'S' || CAST(i AS VARCHAR) AS stop_id, i * 1000.0::DOUBLE + 500.0::DOUBLE AS stop_offset_ft
FROM (SELECT DISTINCT route_id, direction_id FROM pings), range(0, 9) AS x(i)""")


def fixes(spark, sf):
    """Vehicle positions near the shape of their trip."""
    p = pings(spark, sf)
    u, d = F.col("vehicle_id").cast("long"), F.col("direction_id")
    return p.select(
        "event_id", "trip_id", "route_id", "vehicle_id", "ts", "direction_id",
        F.concat_ws("-", (u % 40).cast("string"), d.cast("string"), (u % 3).cast("string")).alias("shape_id"),
        (F.lit(980000.0) + u % 40 * 400 + F.col("k") * 85).alias("x_ft"),
        (F.lit(190000.0) + d * 5000 + u % 3 * 60 + F.col("value")).alias("y_ft"),
    )


CTE["fixes"] = (("pings",), """
SELECT event_id, trip_id, route_id, vehicle_id, ts, direction_id,
  CAST(u % 40 AS VARCHAR) || '-' || CAST(direction_id AS VARCHAR) || '-' || CAST(u % 3 AS VARCHAR) AS shape_id,
  980000.0::DOUBLE + u % 40 * 400 + k * 85 AS x_ft, 190000.0::DOUBLE + direction_id * 5000 + u % 3 * 60 + value AS y_ft
FROM (SELECT *, CAST(vehicle_id AS BIGINT) AS u FROM pings)""")


def service_days(spark, sf):
    """Calendar days named by the exceptions table."""
    return calendar_dates(spark, sf).select(F.to_date("date", "yyyyMMdd").alias("day")).distinct()


CTE["service_days"] = (("calendar_dates",), """
SELECT DISTINCT CAST(strptime(date, '%Y%m%d') AS DATE) AS day, date AS ymd FROM calendar_dates""")
CTE["active"] = (("calendar", "calendar_dates", "service_days"), """
SELECT day, service_id FROM (
  SELECT d.day, d.ymd, c.service_id FROM service_days d JOIN calendar c ON d.ymd BETWEEN c.start_date AND c.end_date
    AND CASE WHEN isodow(d.day) <= 5 THEN c.wk WHEN isodow(d.day) = 6 THEN c.sat ELSE '0' END = '1'
  UNION SELECT d.day, d.ymd, x.service_id FROM service_days d JOIN calendar_dates x ON x.date = d.ymd AND x.exception_type = '1') q
WHERE NOT EXISTS (SELECT 1 FROM calendar_dates x WHERE x.date = q.ymd AND x.service_id = q.service_id AND x.exception_type = '2')""")
CTE["wk_trips"] = (("trips", "routes", "stop_times"), """
SELECT t.feed, t.trip_id, t.route_id, r.route_short_name AS route, t.direction_id, s.start_sec, CAST((s.start_sec // 3600) % 24 AS INT) AS start_hour,
  upper(regexp_replace(replace(r.route_short_name, '-SBS', ''), '[^A-Za-z0-9]', '', 'g')) AS route_norm
FROM trips t JOIN routes r ON t.feed = r.feed AND t.route_id = r.route_id
JOIN (SELECT trip_id, min(sched_sec) AS start_sec FROM stop_times GROUP BY 1) s ON s.trip_id = t.trip_id
WHERE t.service_id ILIKE '%weekday%' AND t.service_id NOT ILIKE '%SDon%'""")


# ---------------------------------------------------------------- derived vehicle tables (DuckDB text)
STEP = 600  # resampling step that suits the given data (a trip lasts a day)

CTE["dd"] = (("pings",), "SELECT * FROM pings QUALIFY row_number() OVER (PARTITION BY trip_id, ts ORDER BY event_id) = 1")
CTE["mono"] = (("dd",), """
SELECT *, before_max IS NULL OR offset_ft >= before_max - 500 AS keep, greatest(offset_ft, coalesce(before_max, offset_ft)) AS offset_mono
FROM (SELECT *, max(offset_ft) OVER (PARTITION BY trip_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_max FROM dd)""")
CTE["traj"] = (("mono",), f"""
SELECT trip_id, route_id, direction_id, g.ts AS ts, CASE WHEN g.ts = p.ts THEN o ELSE o + (o1 - o) * (g.ts - p.ts) / (t1 - p.ts) END AS offset_ft
FROM (SELECT *, lead(ts) OVER w AS t1, lead(o) OVER w AS o1, min(ts) OVER (PARTITION BY trip_id) AS tmin, max(ts) OVER (PARTITION BY trip_id) AS tmax
      FROM (SELECT trip_id, route_id, direction_id, ts, offset_mono AS o FROM mono WHERE keep) WINDOW w AS (PARTITION BY trip_id ORDER BY ts)) p
JOIN (SELECT x.ts FROM (SELECT min(ts) // {STEP} * {STEP} AS a, max(ts) + {STEP} AS b FROM pings), range(a, b, {STEP}) AS x(ts)) g
  ON g.ts >= p.ts AND (g.ts < p.t1 OR (p.t1 IS NULL AND g.ts = p.ts)) AND p.tmin < p.tmax""")
CTE["cross_"] = (("traj", "line_stops"), """
SELECT s.trip_id, s.route_id, s.direction_id, l.stop_id, min(CAST(floor(t0 + (stop_offset_ft - o0) / (o1 - o0) * (t1 - t0)) AS BIGINT)) AS arr_ts
FROM (SELECT trip_id, route_id, direction_id, lag(ts) OVER w AS t0, ts AS t1, lag(offset_ft) OVER w AS o0, offset_ft AS o1 FROM traj WINDOW w AS (PARTITION BY trip_id ORDER BY ts)) s
JOIN line_stops l ON l.route_id = s.route_id AND l.direction_id = s.direction_id AND o0 < stop_offset_ft AND stop_offset_ft <= o1 GROUP BY ALL""")
CTE["rt_sched"] = (("pings", "line_stops"), """
SELECT p.trip_id, l.route_id, l.direction_id, l.stop_id, CAST(floor(l.stop_offset_ft / 1000) AS INT) AS stop_seq,
  CAST((CAST(l.stop_offset_ft * 10 AS BIGINT) + 72000) % 86400 + CAST(vehicle_id AS BIGINT) % 7 * 600 AS INT) AS sched_arr_sec
FROM (SELECT DISTINCT trip_id, vehicle_id, route_id, direction_id FROM pings) p JOIN line_stops l ON l.route_id = p.route_id AND l.direction_id = p.direction_id""")
CTE["arr"] = (("cross_", "rt_sched"), """
SELECT * FROM (SELECT c.*, s.stop_seq, s.sched_arr_sec, (c.arr_ts - 14400) % 86400 AS local_sec,
  43200 - ((43200 - ((c.arr_ts - 14400) % 86400 - s.sched_arr_sec % 86400)) % 86400 + 86400) % 86400 AS deviation_s
FROM cross_ c LEFT JOIN rt_sched s ON s.trip_id = c.trip_id AND s.stop_id = c.stop_id)
QUALIFY row_number() OVER (PARTITION BY trip_id, stop_id, arr_ts ORDER BY abs(deviation_s), stop_seq) = 1""")
CTE["hcells"] = (("arr", "rt_sched"), """
SELECT o.route_id, o.direction_id, o.stop_id, local_date, o.local_hour, count(*) AS n_headways, count(DISTINCT arr_ts) AS n_arrivals,
  CAST(median(headway_s) AS DOUBLE) AS median_headway_s, avg(headway_s) AS mean_headway_s, stddev_samp(headway_s) / avg(headway_s) AS headway_cv,
  min(headway_s) AS min_headway_s, max(headway_s) AS max_headway_s, CAST(max(sm) AS DOUBLE) AS sched_median_headway_s,
  avg(CASE WHEN sm IS NOT NULL THEN CASE WHEN headway_s < 0.5 * sm THEN 1.0 ELSE 0.0 END END) AS bunch_share_lt50_sched,
  CAST(median(deviation_s) AS DOUBLE) AS median_deviation_s, avg(CASE WHEN headway_s < 0.5 * cm THEN 1.0 ELSE 0.0 END) AS bunch_share_lt50_obs,
  CAST(median(headway_s) AS DOUBLE) - CAST(max(sm) AS DOUBLE) AS headway_deviation_s,
  CASE WHEN count(*) > 1 AND max(sm) IS NOT NULL THEN (stddev_samp(headway_s) / avg(headway_s) + avg(CASE WHEN headway_s < 0.5 * sm THEN 1.0 ELSE 0.0 END)) / 2
    WHEN count(*) > 1 THEN stddev_samp(headway_s) / avg(headway_s) WHEN max(sm) IS NOT NULL THEN avg(CASE WHEN headway_s < 0.5 * sm THEN 1.0 ELSE 0.0 END) END AS bunching_index
FROM (SELECT *, median(headway_s) OVER (PARTITION BY route_id, direction_id, stop_id, local_date, local_hour) AS cm FROM (
    SELECT *, strftime(make_timestamp((arr_ts - 14400) * 1000000), '%Y-%m-%d') AS local_date, CAST((arr_ts - 14400) % 86400 // 3600 AS INT) AS local_hour
    FROM (SELECT *, arr_ts - lag(arr_ts) OVER (PARTITION BY route_id, direction_id, stop_id ORDER BY arr_ts, trip_id) AS headway_s FROM arr)
    WHERE headway_s BETWEEN 30 AND 7200)) o
LEFT JOIN (SELECT route_id, direction_id, stop_id, CAST(sched_arr_sec % 86400 // 3600 AS INT) AS local_hour, median(gap) AS sm FROM (
    SELECT *, sched_arr_sec - lag(sched_arr_sec) OVER (PARTITION BY route_id, direction_id, stop_id ORDER BY sched_arr_sec) AS gap FROM (
      SELECT DISTINCT route_id, direction_id, stop_id, sched_arr_sec FROM rt_sched)) WHERE gap > 0 AND gap <= 7200 GROUP BY ALL) s
  ON s.route_id = o.route_id AND s.direction_id = o.direction_id AND s.stop_id = o.stop_id AND s.local_hour = o.local_hour
GROUP BY o.route_id, o.direction_id, o.stop_id, local_date, o.local_hour""")


def rt_schedule(spark, sf):
    """Scheduled arrival of each observed trip at the line's stops."""
    t = pings(spark, sf).select("trip_id", "vehicle_id", "route_id", "direction_id").distinct()
    sec = (F.col("stop_offset_ft") * 10 + 72000).cast("long") % 86400 + F.col("vehicle_id").cast("long") % 7 * 600
    return t.join(line_stops(spark, sf), ["route_id", "direction_id"]).select(
        "trip_id", "route_id", "direction_id", "stop_id", F.round(F.col("stop_offset_ft") / 1000 - 0.5).cast("int").alias("stop_seq"), sec.cast("int").alias("sched_arr_sec"))
