"""Queries on ingestion, catalog and streams.  Each round trip starts from the given tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.catalog import inputs as I
from kerbline.catalog import service as SV
from kerbline.catalog import spatial as SP
from kerbline.catalog.registry import query, r
from kerbline.functions import planar
from kerbline.operators import headways as H
from kerbline.operators.spatial import valid_share
from kerbline.session import materialize, scratch_path
from kerbline.sources import lake as L
from kerbline.streaming import live as ST

P = I.pings
RIDE_SCHEMA = "ride_id long, bus_route string, transit_timestamp timestamp, payment_method string, fare_class string, ridership double, transfers double"


def ride_csv(s, d):
    """Rides written as two CSV sources, as published files would arrive."""
    rides = I.rides(s, d)
    paths = [scratch_path(s, "csv") for _ in range(2)]
    for i, p in enumerate(paths):
        rides.where(F.year("transit_timestamp") < 1998 if i == 0 else F.year("transit_timestamp") >= 1998).write.option("header", "true").option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(p)
    return paths


PART_TEXTS = [
    "MULTIPOLYGON (((0 0, 10 0, 10 10, 0 10, 0 0)), ((20 0, 30 0, 30 10, 20 10, 20 0)))",
    "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))",
    "MULTIPOLYGON(((0 0,10 0,10 10,0 10,0 0),(1 1,3 1,3 3,1 3,1 1)),((20 0,30 0,30 10,20 10,20 0)))",
]
META = {"dataset_id_or_url": "abcd-1234 / https://example.org/data", "retrieved_at": "2026-01-02", "time_coverage": "1995-2001"}
PROV = "'abcd-1234' AS source_dataset_id, '2026-01-02' AS retrieved_at, '1995-2001' AS vintage"
query("src01_ingest_partitioned", f"SELECT ride_id, bus_route, CAST(year(transit_timestamp) AS INT) AS year, ridership, {PROV} FROM rides", "rides")(
    lambda s, d: L.ingest_partitioned(s, [(p, META) for p in ride_csv(s, d)], RIDE_SCHEMA, F.year("transit_timestamp"), scratch_path(s, "rides")).select(
        "ride_id", "bus_route", "year", "ridership", "source_dataset_id", "retrieved_at", "vintage"))
query("src02_ingest_csv", f"SELECT ride_id, upper(bus_route) AS route, hour(transit_timestamp)::INT AS hod, ridership, {PROV} FROM rides", "rides")(
    lambda s, d: L.ingest_csv(s, ride_csv(s, d), RIDE_SCHEMA, {"route": F.upper("bus_route"), "hod": F.hour("transit_timestamp")}, META).select("ride_id", "route", "hod", "ridership", "source_dataset_id", "retrieved_at", "vintage"))
query("src03_provenance", "SELECT n_name, 'xyz-1' AS source_dataset_id, '' AS retrieved_at, '2020' AS vintage FROM nation")(
    lambda s, d: L.with_provenance(I.table(s, d, "nation").select("n_name"), {"data_id": "xyz-1", "dataset_id": "shell", "vintage": "2020"}))
query("src05_ingest_geojson", """
SELECT area, CASE g WHEN 0 THEN 'Polygon' WHEN 1 THEN 'MultiPolygon' WHEN 2 THEN 'Point' WHEN 3 THEN 'MultiLineString' END AS geometry_type, 'EPSG:2263' AS geometry_crs,
  CAST(CASE g WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS INT) AS n_parts, round(CASE g WHEN 0 THEN w * h WHEN 1 THEN w * h + 50.0 * 50 - 100 END, 2) AS area_sqft, g IN (0, 2) AS one_part
FROM (SELECT area, row_number() OVER (ORDER BY area) % 4 AS g, ax1 - ax0 AS w, ay1 - ay0 AS h FROM areas)""", "areas")(lambda s, d: geojson(s, d))
query("src05_ingest_degrees", "SELECT area, borough, 'EPSG:4326' AS geometry_crs, round((ax1 - ax0) * (ay1 - ay0) / 1000) AS area_ksqft FROM areas", "areas")(lambda s, d: geojson_degrees(s, d))


def geojson(s, d):
    """Areas in feet as features of several types: a polygon, one with a second polygon that has a hole, a point, two lines."""
    p = lambda x, y: F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]"))
    x0, y0, x1, y1 = (F.col(c) for c in ("ax0", "ay0", "ax1", "ay1"))
    joined = lambda *xs: F.concat(F.lit("["), F.concat_ws(",", *xs), F.lit("]"))
    ring = lambda a, b, c, e: joined(p(a, b), p(c, b), p(c, e), p(a, e), p(a, b))
    box = joined(ring(x0, y0, x1, y1))
    second = joined(ring(x0 - 100, y0 - 100, x0 - 50, y0 - 50), ring(x0 - 90, y0 - 90, x0 - 80, y0 - 80))
    lines = joined(joined(p(x0, y0), p(x1, y1)), joined(p(x0, y1), p(x1, y0)))
    shapes = [("Polygon", box), ("MultiPolygon", joined(box, second)), ("Point", p(x0, y0)), ("MultiLineString", lines)]
    a = I.areas(s, d).withColumn("g", F.row_number().over(W.orderBy("area")) % 4)  # a row per nation
    kind, text = (F.coalesce(*[F.when(F.col("g") == i, F.lit(x[k]) if k == 0 else x[k]) for i, x in enumerate(shapes)]) for k in (0, 1))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"area":"'), "area", F.lit('"},"geometry":{"type":"'), kind, F.lit('","coordinates":'), text, F.lit("}}"))
    path = scratch_path(s, "geojson")
    a.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}")).alias("value")).write.text(path)
    g = L.ingest_geojson(s, path, T.StructType([T.StructField("area", T.StringType())]), "EPSG:2263")
    area = F.when(F.col("geometry_type").endswith("Polygon"), F.round(planar.parts_area(F.col("parts")), 2))
    return g.select("area", "geometry_type", "geometry_crs", F.size("parts").alias("n_parts"), area.alias("area_sqft"), F.col("rings").isNotNull().alias("one_part"))


def geojson_degrees(s, d):
    """Areas written as GeoJSON feature collections in degrees and read back."""
    a = I.areas(s, d).withColumn("rings", F.transform("rings", lambda q: F.transform(q, lambda p: planar.point(planar.to_lonlat(p.x, p.y).lon, planar.to_lonlat(p.x, p.y).lat))))
    path = scratch_path(s, "geojson")
    L.export_layer(a, ["area", "borough"], 9).select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "feature", F.lit("]}")).alias("value")).write.text(path)
    g = L.ingest_geojson(s, path, T.StructType([T.StructField("area", T.StringType()), T.StructField("borough", T.StringType())]))
    return g.select("area", "borough", "geometry_crs", F.round(planar.polygon_area(F.col("rings")) / 1000).alias("area_ksqft"))


query("src06_multipart_area", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 200.0::DOUBLE WHEN s_suppkey % 3 = 1 THEN 96.0 ELSE 196.0 END AS area FROM supplier")(lambda s, d: L.ingest_wkt(
    I.table(s, d, "supplier").select("s_suppkey", F.element_at(F.array(*[F.lit(x) for x in PART_TEXTS]), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("wkt")), "wkt", "EPSG:2263").select(
        "s_suppkey", planar.parts_area(F.col("parts")).alias("area")))
query("src06_ingest_wkt", "SELECT s_suppkey, 3 AS n_points, (-74 - s_suppkey % 7)::DOUBLE AS first_lon, 40.25::DOUBLE + s_suppkey % 3 AS second_lat, 'EPSG:4326' AS geometry_crs FROM supplier WHERE s_suppkey % 9 <> 0 AND s_suppkey % 10 <> 3")(
    lambda s, d: L.ingest_wkt(I.table(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 9 == 0, "POLYGON EMPTY").when(F.col("s_suppkey") % 10 == 3, F.lit(None)).otherwise(
        F.concat(F.lit("LINESTRING ("), (-74 - F.col("s_suppkey") % 7).cast("string"), F.lit(" 40.5, -73.5 "), (40 + F.col("s_suppkey") % 3).cast("string"), F.lit(".25, -73.25 40.75)"))).alias("the_geom")), "the_geom").select(
        "s_suppkey", F.size(F.col("rings_source")[0]).alias("n_points"), F.col("rings_source")[0][0].x.alias("first_lon"), F.col("rings_source")[0][1].y.alias("second_lat"), "geometry_crs"))
query("src07_ingest_points", f"SELECT stop_id, CASE WHEN k % 6 <> 0 THEN x_ft END AS x_ft, CASE WHEN k % 6 <> 0 THEN 'EPSG:4326' END AS geometry_crs FROM (SELECT p.stop_id, CAST(p.stop_id AS BIGINT) AS k, p.x_ft FROM ({SP._lcc_sql()}) p)", "stops")(
    lambda s, d: L.ingest_points(I.stops(s, d).select("stop_id", F.when(F.col("stop_id").cast("long") % 6 != 0, F.col("lat").cast("string")).otherwise("n/a").alias("lat"), "lon"), "lat", "lon").select("stop_id", F.round("point.x", 4).alias("x_ft"), "geometry_crs"))
query("src08_ingest_parts", "SELECT n_name, n_regionkey, NULL::DOUBLE AS extra, 'first' AS part FROM nation WHERE n_regionkey < 2 UNION ALL SELECT n_name, n_regionkey, n_nationkey * 1.5::DOUBLE, 'second' FROM nation WHERE n_regionkey >= 2")(
    lambda s, d: (lambda n: L.ingest_parts([("first", n.where("n_regionkey < 2").select("n_name", "n_regionkey")), ("second", n.where("n_regionkey >= 2").select("n_regionkey", "n_name", (F.col("n_nationkey") * 1.5).alias("extra")))]))(I.table(s, d, "nation")))
query("set01_union_by_name", "SELECT s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_name, c_acctbal, c_mktsegment FROM customer")(
    lambda s, d: I.union_all([I.table(s, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), I.table(s, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"))]))
query("src09_ingest_stations", """SELECT s_suppkey AS station_id, s_suppkey % 30 AS num_bikes, '["KEY","' || CAST(s_suppkey % 3 AS VARCHAR) || '"]' AS rental_methods, '{"a":' || CAST(s_suppkey % 5 AS VARCHAR) || '}' AS eightd FROM supplier""")(
    lambda s, d: (lambda path: L.ingest_gbfs(s.read.schema("data array<struct<station_id:long,num_bikes:long,rental_methods:array<string>,eightd:struct<a:long>>>").json(path), "data"))(station_json(s, d)))


def station_json(s, d):
    k = F.col("s_suppkey")
    st = I.table(s, d, "supplier").select(F.struct(k.alias("station_id"), (k % 30).alias("num_bikes"), F.array(F.lit("KEY"), (k % 3).cast("string")).alias("rental_methods"), F.struct((k % 5).alias("a")).alias("eightd")).alias("x"), (k % 4).alias("g"))
    path = scratch_path(s, "stations")
    st.select(F.to_json(F.struct(F.array("x").alias("data"))).alias("value")).write.text(path)
    return path


query("src10_gtfs_union", "SELECT route_id, route_short_name, NULL AS route_color, feed FROM routes WHERE feed = 'bus_a' UNION ALL SELECT route_id, NULL, 'ff' || lpad(route_id, 4, '0'), feed FROM routes WHERE feed = 'bus_b'", "routes")(
    lambda s, d: (lambda x: L.gtfs_union({"bus_a": x.where("feed = 'bus_a'").select("route_id", "route_short_name"), "bus_b": x.where("feed = 'bus_b'").select(F.col("route_id").cast("int"), F.concat(F.lit("ff"), F.lpad("route_id", 4, "0")).alias("route_color")), "bus_c": None}))(I.routes(s, d)))
query("src12_canonical_positions", """SELECT feed, poll_ts, vehicle_id, trip_id, CAST(direction_id AS BIGINT) AS direction_id, lat, ts AS "timestamp", CAST(CASE WHEN feed = 'bus_b' THEN current_status END AS BIGINT) AS current_status FROM pings""", "pings")(
    lambda s, d: (lambda p: L.canonical_positions([p.where("feed = 'bus_a'").drop("current_status"), p.where("feed = 'bus_b'").withColumn("lat", F.col("lat").cast("string"))]).select(
        "feed", "poll_ts", "vehicle_id", "trip_id", "direction_id", "lat", "timestamp", "current_status"))(P(s, d).withColumnRenamed("ts", "timestamp")))


def alert_json(s, d):
    a = I.alerts(s, d).select(F.lit("bus_alerts").alias("feed"), "poll_ts", F.col("poll_ts").alias("header_ts"), "alert_id", "effect", F.array(F.concat(F.lit("Delay on "), "route_id")).alias("header_text"),
                              F.array(F.struct("route_id")).alias("informed_entity"))
    path = scratch_path(s, "alerts")
    a.write.json(path)
    return path


query("src13_read_alerts", "SELECT alert_id, poll_ts, effect, route_id, 'Delay on ' || route_id AS header FROM alerts", "alerts")(
    lambda s, d: L.read_alerts(s, alert_json(s, d)).select("alert_id", "poll_ts", "effect", F.explode("informed_entity.route_id").alias("route_id"), F.col("header_text")[0].alias("header")))
query("src14_category_view", "SELECT p_partkey, p_type FROM part WHERE p_type IN ('ECONOMY', 'PROMO')")(lambda s, d: L.category_view(I.table(s, d, "part").select("p_partkey", "p_type"), "p_type", ["ECONOMY", "PROMO"]))


def archived(s, d):
    path = scratch_path(s, "archive")
    L.archive_sink(P(s, d).select("event_id", "feed", "poll_ts", "vehicle_id"), path)
    return path


query("src15_archive_sink", "SELECT event_id, strftime(make_timestamp(poll_ts * 1000000), '%Y-%m-%d') AS date, CAST(poll_ts % 86400 // 3600 AS INT) AS hour FROM pings", "pings")(
    lambda s, d: s.read.parquet(archived(s, d)).select("event_id", F.col("date").cast("string").alias("date"), F.col("hour").cast("int").alias("hour")))


def stored(s, d):
    a, b = scratch_path(s, "t_rides"), scratch_path(s, "t_stops")
    I.rides(s, d).withColumn("year", F.year("transit_timestamp")).hint("rebalance", "year").write.partitionBy("year").parquet(a)
    I.stops(s, d).write.parquet(b)
    return {"kb_rides": ("giant", a), "kb_stops": ("table", b)}


query("src11_register_catalog", "SELECT 'kb_rides' AS name, 'giant' AS kind, count(*) AS \"rows\" FROM rides UNION ALL SELECT 'kb_stops', 'table', count(*) FROM stops", "rides stops")(
    lambda s, d: L.register_catalog(s, stored(s, d)).drop("source"))
query("agg72_lake_inventory", "SELECT 'kb_rides' AS name, count(*) AS \"rows\", TRUE AS has_files, TRUE AS has_bytes FROM rides UNION ALL SELECT 'kb_stops', count(*), TRUE, TRUE FROM stops", "rides stops")(
    lambda s, d: L.lake_inventory(s, {n: p for n, (_, p) in stored(s, d).items()}).select("name", "rows", (F.col("files") > 0).alias("has_files"), (F.col("bytes") > 0).alias("has_bytes")))
def changed_archive(s, d):
    """Days changed since their signatures were recorded: every third day is written anew, every fourth comes only afterwards."""
    path, day = scratch_path(s, "archive"), F.floor(F.col("ts") / 86400)
    p = P(s, d).select("event_id", "ts", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd").alias("date"))
    files = lambda: L.day_files(s, path)
    p.where(day % 4 != 0).hint("rebalance", "date").write.partitionBy("date").parquet(path)
    state = materialize(L.day_signatures(files()), "signatures")
    again = p.where((day % 3 == 0) | (day % 4 == 0)).hint("rebalance", "date")
    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    return L.changed_days(files(), state).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


query("src17_changed_days", """WITH f AS (SELECT ts // 86400 AS day, ts // 3600 AS file, max(ts) AS mtime FROM pings GROUP BY 1, 2)
SELECT day, count(*) AS n_files, max(mtime) AS max_mtime FROM f GROUP BY 1 HAVING day % 3 <> 0""", "pings")(
    lambda s, d: (lambda f: L.changed_days(f, f.groupBy("day").agg(F.count(F.lit(1)).alias("n_files"), (F.max("mtime") + F.when(F.col("day") % 3 == 0, 0).otherwise(-5)).alias("max_mtime"))))(
        P(s, d).groupBy(F.floor(F.col("ts") / 86400).alias("day"), F.floor(F.col("ts") / 3600).alias("file")).agg(F.max("ts").alias("mtime"))))
query("src17_changed_archive", "SELECT DISTINCT strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS day FROM pings WHERE ts // 86400 % 3 = 0 OR ts // 86400 % 4 = 0", "pings")(changed_archive)


def versions(s, d):
    """Four versions of the stop list: 1 and 2 alike, 3 moved, 4 like 3 in another order."""
    st = I.stops(s, d).select("stop_id", "stop_name", "lat")
    move = F.when(F.col("stop_id").cast("long") % 5 == 0, 0.001).otherwise(0.0)
    v = [st, st.orderBy(F.desc("stop_name")), st.withColumn("lat", F.round(F.col("lat") + move, 6)), st.withColumn("lat", F.round(F.col("lat") + move, 6)).orderBy("lat")]
    return I.union_all([x.withColumns({"feed": F.lit("bus"), "ts": F.lit(i + 1)}) for i, x in enumerate(v)])


query("src18_dedupe_snapshots", "SELECT 'bus' AS feed, ts::INT AS ts, n AS \"rows\" FROM (SELECT count(*) AS n FROM stops), (VALUES (1), (3)) v(ts)", "stops")(
    lambda s, d: L.dedupe_snapshots(L.content_hash(versions(s, d), ["feed", "ts"], ["stop_id", "stop_name", "lat"])).select("feed", "ts", "rows"))
query("src18_content_hash", """
WITH v AS (SELECT CAST(ts AS INT) AS ts, '=' || stop_id || chr(31) || '=' || stop_name || chr(31) || '=' || CAST(CASE WHEN ts > 2 THEN round(lat + CASE WHEN CAST(stop_id AS BIGINT) % 5 = 0 THEN 0.001 ELSE 0.0 END, 6) ELSE lat END AS VARCHAR) AS line
  FROM stops, (VALUES (1), (2), (3), (4)) n(ts)),
p AS (SELECT ts, list_transform([1, 13, 25, 37], lambda i: CAST('0x' || substr(sha256(line), i, 12) AS BIGINT)) AS q FROM v),
t AS (SELECT ts, count(*) AS n, sum(q[1]) AS a, sum(q[2]) AS b, sum(q[3]) AS c, sum(q[4]) AS d FROM p GROUP BY ts)
SELECT 'bus' AS feed, ts, n AS "rows", sha256(concat_ws('-', n, a, b, c, d)) AS content_hash FROM t""", "stops")(lambda s, d: L.content_hash(versions(s, d), ["feed", "ts"], ["stop_id", "stop_name", "lat"]))
query("src20_export_layer")(lambda s, d: L.export_layer(SP.block_rings(s, d), ["block_id", "borough", "pop"], 1))
def doctor(s, d):
    """Health of tables that changed since they were written: repeated orders, parts and stops lost, a layer of two systems, broken outlines."""
    table = lambda t: I.table(s, d, t)
    made = {"customers": (True, table("customer")), "orders": (True, table("orders")), "parts": (False, table("part")), "stops": (False, table("supplier")), "events": (False, table("events"))}
    paths = {n: scratch_path(s, f"doctor-{n}") for n in made}
    rows = {n: (exact, L.write_counted(df, paths[n])) for n, (exact, df) in made.items()}
    rows.pop("events")
    table("orders").where("o_orderkey % 1000 = 1").write.mode("append").parquet(paths["orders"])
    for n, kept in (("parts", "p_partkey > 7"), ("stops", "s_suppkey > 60")):
        made[n][1].where(kept).write.mode("overwrite").parquet(paths[n])
    blocks, areas = SP.block_rings(s, d), I.areas(s, d)
    crs = L.crs_counts({"blocks": blocks.withColumn("geometry_crs", F.lit("EPSG:2263")), "areas": areas.withColumn("geometry_crs", F.when(F.col("borough") < "ASIA", "EPSG:4326").otherwise("EPSG:2263"))})
    orders, customers = s.read.parquet(paths["orders"]), s.read.parquet(paths["customers"]).select(F.col("c_custkey").alias("o_custkey"))
    joins = {"orders->customers": customers, "orders->some customers": customers.where("o_custkey % 50 <> 0")}
    cov = I.union_all([H.join_coverage(orders, c, "o_custkey").select(F.lit(n).alias("name"), "rows", "matched") for n, c in joins.items()])
    layers = {"blocks": blocks, "blocks with open outlines": SP.some_open_rings(s, d)}
    val = I.union_all([valid_share(df, 0.5, "block_id").select(F.lit(n).alias("name"), "sampled", "invalid") for n, df in layers.items()])
    return L.doctor(materialize(L.row_counts(s, paths, rows), "counts"), crs, cov, val)


query("agg61_doctor", """WITH c(name, exact, expected, actual) AS (SELECT 'customers', TRUE, (SELECT count(*) FROM customer), (SELECT count(*) FROM customer)
  UNION ALL SELECT 'orders', TRUE, (SELECT count(*) FROM orders), (SELECT count(*) + count(*) FILTER (o_orderkey % 1000 = 1) FROM orders)
  UNION ALL SELECT 'parts', FALSE, (SELECT count(*) FROM part), (SELECT count(*) FROM part WHERE p_partkey > 7)
  UNION ALL SELECT 'stops', FALSE, (SELECT count(*) FROM supplier), (SELECT count(*) FROM supplier WHERE s_suppkey > 60)
  UNION ALL SELECT 'events', FALSE, NULL, (SELECT count(*) FROM events)),
o AS (SELECT o_custkey FROM orders UNION ALL SELECT o_custkey FROM orders WHERE o_orderkey % 1000 = 1),
j AS (SELECT 100.0::DOUBLE * count(c_custkey) / count(*) AS p, 100.0::DOUBLE * count(c_custkey) FILTER (c_custkey % 50 <> 0) / count(*) AS q FROM o LEFT JOIN customer ON c_custkey = o_custkey),
g AS (SELECT coalesce(count(*) FILTER (block_id % 17 = 0) / nullif(count(*), 0), 0)::DOUBLE AS bad FROM blocks WHERE CAST('0x' || substr(md5('42:' || block_id), 1, 8) AS BIGINT) < 2147483648),
a AS (SELECT count(DISTINCT borough < 'ASIA') AS n FROM areas)
SELECT 'ROWCOUNTS' AS "check", name, CASE WHEN expected IS NULL THEN 'INFO' WHEN exact AND expected = actual THEN 'PASS' WHEN NOT exact AND (expected - actual BETWEEN 0 AND greatest(10, floor(expected * 0.0005)) OR abs(expected - actual) <= 2) THEN 'PASS' ELSE 'FAIL' END AS status, actual::DOUBLE AS value FROM c
UNION ALL SELECT 'VIEWS', name, CASE WHEN actual > 0 THEN 'PASS' ELSE 'FAIL' END, actual::DOUBLE FROM c
UNION ALL SELECT 'CRS', 'blocks', 'PASS', 1::DOUBLE UNION ALL SELECT 'CRS', 'areas', CASE WHEN n = 1 THEN 'PASS' ELSE 'FAIL' END, n::DOUBLE FROM a
UNION ALL SELECT 'GEOID_JOIN', 'orders->customers', CASE WHEN p >= 99 THEN 'PASS' ELSE 'FAIL' END, round(p, 2) FROM j
UNION ALL SELECT 'GEOID_JOIN', 'orders->some customers', CASE WHEN q >= 99 THEN 'PASS' ELSE 'FAIL' END, round(q, 2) FROM j
UNION ALL SELECT 'GEOMVALID', 'blocks', 'PASS', 0.0::DOUBLE
UNION ALL SELECT 'GEOMVALID', 'blocks with open outlines', CASE WHEN bad <= 0.05 THEN 'PASS' ELSE 'FAIL' END, round(bad, 4) FROM g""", "blocks areas")(doctor)


# ------------------------------------------------------------------ streams
def landed(s, d, df, label):
    """Snapshot files landed one after the other in the order of the first column, read as a stream of a quarter of the rows a batch.

    A quarter is as many files as the shuffle has partitions, fewer for small ones; rows without time land first.
    """
    path, at = scratch_path(s, label), df.columns[0]
    df = materialize(df, label)
    cuts = df.agg(F.percentile_approx(at, [0.25, 0.5, 0.75])).first()[0] or []
    quarter = sum((F.coalesce(F.col(at) > c, F.lit(False)).cast("int") for c in cuts), F.lit(0))
    sizes = {r["q"]: r["n"] for r in df.groupBy(quarter.alias("q")).agg(F.count(F.lit(1)).alias("n")).collect()}
    files = max(1, min(int(s.conf.get("spark.sql.shuffle.partitions")), min(sizes.values(), default=0) // 1000))
    for q in sorted(sizes):
        df.where(quarter == q).repartition(files).write.mode("append").parquet(path)
    if not sizes:
        df.write.parquet(path)
    return ST.read_stream(s, path, df.schema, files=files)


def stream_of(s, d):
    return landed(s, d, P(s, d).select("ts", "event_id", "poll_ts", "feed", "vehicle_id", "trip_id", "route_id", "direction_id", "stop_id", "lat", "lon"), "landed")


query("str01_stream_archive", "SELECT event_id, strftime(make_timestamp(poll_ts * 1000000), '%Y-%m-%d') AS date, strftime(make_timestamp(poll_ts * 1000000), '%H') AS hour FROM pings", "pings")(
    lambda s, d: ST.run_to_table(ST.stream_archive(stream_of(s, d)), "archive", ("date", "hour")).select("event_id", "date", "hour"))
query("str02_stream_dedupe", "SELECT DISTINCT trip_id, ts FROM pings", "pings")(
    lambda s, d: ST.run_to_table(ST.stream_dedupe(landed(s, d, (lambda p: p.unionByName(p))(P(s, d).select("ts", "trip_id", "event_id")), "twice"), "1 hour"), "dedupe").select("trip_id", "ts"))
query("str03_stream_latest", """WITH w AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, event_id DESC) AS rn FROM pings)
SELECT l.vehicle_id, l.ts, l.event_id, l.stop_id, round(l.lat, 6) AS lat, p.ts AS prev_ts, p.event_id AS prev_event_id, round(p.lat, 6) AS prev_lat FROM w l LEFT JOIN w p ON p.vehicle_id = l.vehicle_id AND p.rn = 2 WHERE l.rn = 1""", "pings")(
    lambda s, d: ST.run_changes(ST.stream_latest(stream_of(s, d)), "latest", "vehicle_id", "ts").select("vehicle_id", "ts", "event_id", "stop_id", r("lat", 6).alias("lat"), "prev_ts", "prev_event_id", r("prev_lat", 6).alias("prev_lat")))
CLOSED = "(SELECT max({c}) FROM {t}) - 600"
query("str04_stream_vehicles", f"SELECT ts // 300 * 300 - 14400 AS bin_local, count(DISTINCT vehicle_id) AS vehicles, count(DISTINCT (vehicle_id, ts)) AS reports FROM pings GROUP BY 1 HAVING max(ts) // 300 * 300 + 300 <= {CLOSED.format(c='ts', t='pings')}", "pings")(
    lambda s, d: ST.run_to_table(ST.stream_vehicles(stream_of(s, d)), "vehicles"))
query("str04_stream_bunching", f"""
WITH n AS (SELECT vehicle_id, ts // 300 * 300 AS bin, arg_max(route_id, (ts, event_id)) AS route_id, arg_max(direction_id, (ts, event_id)) AS direction_id, arg_max(lat, (ts, event_id)) AS lat,
  -74.0::DOUBLE + CAST(vehicle_id AS BIGINT) % 7 * 0.001::DOUBLE AS lon FROM pings GROUP BY 1, 2),
h AS (SELECT route_id, direction_id, count(*) % 7 * 100.0::DOUBLE + 200.0 AS hw FROM pings GROUP BY 1, 2),
c AS (SELECT a.bin, a.route_id, a.direction_id, a.vehicle_id AS vehicle_id_a, b.vehicle_id AS vehicle_id_b, hw * 4.5::DOUBLE AS expected_m,
  2 * 6371000 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS gap_m
  FROM n a JOIN n b ON a.bin = b.bin AND a.route_id = b.route_id AND a.direction_id = b.direction_id AND a.vehicle_id < b.vehicle_id JOIN h ON h.route_id = a.route_id AND h.direction_id = a.direction_id)
SELECT bin - 14400 AS bin_local, route_id, direction_id, vehicle_id_a, vehicle_id_b, round(gap_m, 4) AS gap_m FROM c
WHERE gap_m < least(0.25 * expected_m, 500) AND bin + 300 <= {CLOSED.format(c='ts', t='pings')}""", "pings")(
    lambda s, d: ST.listed_pairs(ST.run_to_table(ST.stream_bunching(
        landed(s, d, P(s, d).select("ts", "event_id", "vehicle_id", "route_id", "direction_id", "lat", (F.lit(-74.0) + F.col("vehicle_id").cast("long") % 7 * 0.001).alias("lon")), "near"),
        materialize(SV.route_headway(s, d), "headway"), listed=False), "bunching")).select("bin_local", "route_id", "direction_id", "vehicle_id_a", "vehicle_id_b", r("gap_m").alias("gap_m")))
query("str04_stream_short_headways", f"""WITH e AS (SELECT arr_local + 14400 AS t, headway_s < 0.25 * sm AS short FROM ({SV.OBS}))
SELECT t // 300 * 300 - 14400 AS bin_local, count(*) FILTER (short) AS active_bunching_pairs, count(*) AS arrivals FROM e GROUP BY 1 HAVING max(t) // 300 * 300 + 300 <= {CLOSED.format(c='t', t='e')}""", "arr rt_sched")(
    lambda s, d: ST.run_to_table(ST.stream_short_headways(landed(s, d, SV.observed(s, d).select((F.col("arr_local") + 14400).alias("arr_ts"), "headway_s", "sched_median_headway_s"), "arrivals")), "short"))
query("str11_stream_alerts", f"SELECT poll_ts // 300 * 300 - 14400 AS bin_local, count(DISTINCT alert_id) AS alerts_total FROM alerts GROUP BY 1 HAVING max(poll_ts) // 300 * 300 + 300 <= {CLOSED.format(c='poll_ts', t='alerts')}", "alerts")(
    lambda s, d: ST.run_to_table(ST.stream_alerts(landed(s, d, I.alerts(s, d).select("poll_ts", "alert_id", "effect"), "alerts")), "alerts"))
query("str05_stream_trailing", f"""WITH e AS (SELECT arr_local + 14400 AS t, abs(headway_s - sm) AS dev FROM ({SV.OBS}) WHERE sm IS NOT NULL)
SELECT b - 14400 AS bin_local, round(avg(dev), 4) AS mean_dev, count(*) AS n FROM e JOIN (SELECT unnest(range(min(t) // 300 * 300, max(t) + 7200, 300)) AS b FROM e) ON t >= b - 3600 AND t < b GROUP BY b HAVING b <= (SELECT max(t) FROM e) - 600""", "arr rt_sched")(
    lambda s, d: ST.run_to_table(ST.stream_trailing(landed(s, d, SV.observed(s, d).where("sched_median_headway_s is not null").select(
        (F.col("arr_local") + 14400).alias("arr_ts"), F.abs(F.col("headway_s") - F.col("sched_median_headway_s")).alias("dev")), "arrivals")), "trailing").withColumn("mean_dev", r("mean_dev")))
query("str06_stream_passages", "SELECT event_id, vehicle_id, stop_id, ts FROM (SELECT *, lag(stop_id) OVER (PARTITION BY vehicle_id ORDER BY ts, event_id) AS ps FROM pings) WHERE ps IS NULL OR ps <> stop_id", "pings")(
    lambda s, d: ST.run_to_table(ST.stream_passages(stream_of(s, d)), "passages").select("event_id", "vehicle_id", "stop_id", "ts"))
query("str06_stream_headways", f"""WITH h AS (SELECT *, ts - lag(ts) OVER (PARTITION BY route_id, direction_id, stop_id ORDER BY ts, event_id) AS headway_s FROM (
  SELECT *, lag(stop_id) OVER (PARTITION BY vehicle_id ORDER BY ts, event_id) AS ps FROM pings) WHERE ps IS NULL OR ps <> stop_id)
SELECT event_id, vehicle_id, route_id, direction_id, stop_id, headway_s FROM h WHERE ts < {CLOSED.format(c='ts', t='pings').replace('600', '3600')}""", "pings")(
    lambda s, d: ST.run_to_table(ST.stream_headways(stream_of(s, d)), "headways", chained=True).select("event_id", "vehicle_id", "route_id", "direction_id", "stop_id", "headway_s"))


def polls(s, d):
    """A feed's polls; its header moves every half hour only."""
    return P(s, d).groupBy("poll_ts", "feed").agg(F.max(F.floor(F.col("ts") / 1800) * 1800).alias("header_ts"))


STALE = """WITH p AS (SELECT feed, poll_ts, max(ts // 1800 * 1800) AS header_ts FROM pings GROUP BY 1, 2),
m AS (SELECT feed, header_ts, poll_ts AS since FROM p WINDOW w AS (PARTITION BY feed ORDER BY poll_ts) QUALIFY lag(header_ts) OVER w IS NULL OR lag(header_ts) OVER w <> header_ts),
n AS (SELECT m.*, lead(since) OVER w AS until, lag(since) OVER w AS before, (SELECT max(poll_ts) FROM p x WHERE x.feed = m.feed) AS last, (SELECT max(poll_ts) - 600 FROM p) AS known FROM m WINDOW w AS (PARTITION BY feed ORDER BY since))
SELECT feed, header_ts, since, since + 300 AS "at", TRUE AS stale FROM n WHERE coalesce(until, greatest(last, known)) - since > 300
UNION ALL SELECT feed, header_ts, since, since, FALSE FROM n WHERE since - before > 300"""
query("str07_stream_stale", STALE, "pings")(lambda s, d: ST.run_to_table(ST.stream_stale(landed(s, d, polls(s, d), "polls")), "stale"))
query("str07_stale_changes", STALE, "pings")(lambda s, d: SV.Q.stale_changes(polls(s, d)))
