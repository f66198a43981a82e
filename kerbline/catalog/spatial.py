"""Queries on places: cells, containment, distance, overlap, lines, streets."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.catalog import inputs as I
from kerbline.catalog.registry import query, r
from kerbline.functions import planar as P
from kerbline.operators import observatory as O
from kerbline.operators import scores
from kerbline.operators import spatial as S
from kerbline.session import materialize

R = 1312.336
SIZE = 330.0


def block_rings(s, d):
    return I.blocks(s, d).withColumn("rings", F.array(P.rectangle(F.col("bx0"), F.col("by0"), F.col("bx1"), F.col("by1"))))


def sidewalks(s, d):
    """Strips along the streets: left where key % 3 <> 0, right where key % 4 <> 0."""
    st = I.streets(s, d)
    k, hor, w = F.col("street_id"), F.col("street_id") % 2 == 0, F.col("street_id") % 10 + 4.0
    def strip(lo, hi):
        return F.when(hor, P.rectangle(F.col("x0"), F.col("y0") + lo, F.col("x1"), F.col("y0") + hi)).otherwise(P.rectangle(F.col("x0") + lo, F.col("y0"), F.col("x0") + hi, F.col("y1")))
    both = F.array(F.when(k % 3 != 0, F.struct(F.lit("a").alias("side"), strip(F.lit(18.0), F.lit(18.0) + w).alias("ring"))),
                   F.when(k % 4 != 0, F.struct(F.lit("b").alias("side"), strip(F.lit(-18.0) - w, F.lit(-18.0)).alias("ring"))))
    e = st.select("street_id", "borough", F.explode(F.filter(both, lambda v: v.isNotNull())).alias("s"))
    return e.select("street_id", "borough", F.concat(k.cast("string"), F.col("s.side")).alias("poly_id"), F.array(F.col("s.ring")).alias("rings"))


# own strips per street, with the strip's size
STRIPS = """SELECT street_id, borough, w, side FROM (SELECT street_id, borough, street_id % 10 + 4.0::DOUBLE AS w FROM streets), (VALUES ('a'), ('b')) v(side) WHERE (side = 'a' AND street_id % 3 <> 0) OR (side = 'b' AND street_id % 4 <> 0)"""

def _lcc_sql():
    n, f, rho0 = P.lcc_constants()
    e = P._e()
    rho = f"({P.LCC_A * f!r} * pow(tan(0.7853981633974483 - radians(lat) / 2) / pow((1 - {e!r} * sin(radians(lat))) / (1 + {e!r} * sin(radians(lat))), {e / 2!r}), {n!r}))"
    th = f"({n!r} * radians(lon + 74.0))"
    return f"SELECT stop_id, round((300000.0 + {rho} * sin({th})) / 0.3048006096, 4) AS x_ft, round(({rho0!r} - {rho} * cos({th})) / 0.3048006096, 4) AS y_ft FROM stops"


query("prj12_projection_round_trip", f"SELECT *, TRUE AS lon_back, TRUE AS lat_back FROM ({_lcc_sql()})", "stops")(lambda s, d: I.stops(s, d).withColumn("f", P.to_feet(F.col("lon"), F.col("lat"))).withColumn("b", P.to_lonlat(F.col("f.x"), F.col("f.y"))).select(
    "stop_id", F.round("f.x", 4).alias("x_ft"), F.round("f.y", 4).alias("y_ft"), (F.abs(F.col("b.lon") - F.col("lon")) < 1e-10).alias("lon_back"), (F.abs(F.col("b.lat") - F.col("lat")) < 1e-10).alias("lat_back")))
query("prj12_projection", _lcc_sql(), "stops")(lambda s, d: I.stops(s, d).withColumn("f", P.to_feet(F.col("lon"), F.col("lat"))).select("stop_id", F.round("f.x", 4).alias("x_ft"), F.round("f.y", 4).alias("y_ft")))

# ------------------------------------------------------------------ cells
CELLS = f"SELECT DISTINCT CAST(floor(x / {SIZE}) AS BIGINT) AS cx, CAST(floor(y / {SIZE}) AS BIGINT) AS cy FROM points"


def cells(s, d):
    return S.with_cell(I.points(s, d), "x", "y", SIZE).select("cx", "cy").distinct()


query("geo01_cell_ids", f"SELECT point_id, CAST(floor(x / {SIZE}) AS BIGINT) * 4294967296 + CAST(floor(y / {SIZE}) AS BIGINT) AS cell FROM points", "points")(
    lambda s, d: I.points(s, d).select("point_id", S.cell_id(F.col("x"), F.col("y"), SIZE).alias("cell")))
NBR = f"""SELECT a.cx, a.cy, b.cx AS nx, b.cy AS ny, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) * {SIZE} AS dist_ft FROM ({CELLS}) a JOIN ({CELLS}) b
  ON abs(a.cx - b.cx) <= 3 AND abs(a.cy - b.cy) <= 3 AND sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) * {SIZE} <= {R}"""
query("jon15_neighbour_map", f"SELECT cx, cy, nx, ny, round(dist_ft, 4) AS dist_ft FROM ({NBR})", "points")(lambda s, d: S.neighbour_map(cells(s, d), SIZE, R).withColumn("dist_ft", r("dist_ft")))
LAYER = f"SELECT CAST(floor(x / {SIZE}) AS BIGINT) AS cx, CAST(floor(y / {SIZE}) AS BIGINT) AS cy, count(*) AS n, count(*) FILTER (kind = 'MACHINERY') AS n_machinery, round(sum(amount), 2) AS amount FROM points GROUP BY 1, 2"


def layer(s, d):
    return S.bin_layer(I.points(s, d), "x", "y", SIZE, [F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "MACHINERY").alias("n_machinery"), F.round(F.sum("amount"), 2).alias("amount")])


query("agg57_bin_layer", LAYER, "points")(layer)
query("jon15_roll_up", f"SELECT m.cx, m.cy, CAST(sum(n) AS BIGINT) AS n_400m, round(sum(amount), 2) AS amount_400m FROM ({NBR}) m JOIN ({LAYER}) l ON l.cx = m.nx AND l.cy = m.ny GROUP BY 1, 2", "points")(
    lambda s, d: S.roll_up(layer(s, d), S.neighbour_map(cells(s, d), SIZE, R), [F.sum("n").alias("n_400m"), F.round(F.sum("amount"), 2).alias("amount_400m")]))

# ------------------------------------------------------------------ containment
IN = "x >= ax0 AND x < ax1 AND y >= ay0 AND y < ay1"
query("jon09_point_in_polygon", f"SELECT point_id, area, borough FROM points LEFT JOIN areas ON {IN}", "points areas")(
    lambda s, d: S.assign_area(I.points(s, d), I.areas(s, d), "x", "y", ["area", "borough"]).select("point_id", "area", "borough"))


def holed(s, d):
    """Areas with a square hole in the middle and a second part far to the north-east."""
    hole = P.rectangle(F.col("ax0") + 1000, F.col("ay0") + 1000, F.col("ax0") + 2000, F.col("ay0") + 2000)
    return I.areas(s, d).select("area", "borough", F.array(F.get("rings", 0), hole).alias("rings"))


query("geo03_polygon_with_hole", f"SELECT point_id, area FROM points JOIN areas ON {IN} AND NOT (x >= ax0 + 1000 AND x < ax0 + 2000 AND y >= ay0 + 1000 AND y < ay0 + 2000)", "points areas")(
    lambda s, d: S.assign_area(I.points(s, d), holed(s, d), "x", "y", ["area"], how="inner").select("point_id", "area"))


def multi(s, d):
    part = lambda dx, w: F.array(P.rectangle(F.col("ax0") + dx, F.col("ay0") + dx, F.col("ax0") + dx + w, F.col("ay0") + dx + w))
    a = I.areas(s, d)
    return a.select("area", F.when(F.col("borough") < "ASIA", "moderate").otherwise("extreme").alias("kind"), F.array(part(0, 700.0), part(1500, 900.0)).alias("parts"))


query("geo08_explode_parts", "SELECT area, CAST(part AS INT) AS part, CASE part WHEN 0 THEN 490000.0 ELSE 810000.0 END::DOUBLE AS area_sqft FROM areas, (VALUES (0), (1)) v(part)", "areas")(
    lambda s, d: S.explode_parts(multi(s, d)).select("area", "part", P.polygon_area(F.col("rings")).alias("area_sqft")))
HIT = "((cxx >= ax0 AND cxx < ax0 + 700 AND cyy >= ay0 AND cyy < ay0 + 700) OR (cxx >= ax0 + 1500 AND cxx < ax0 + 2400 AND cyy >= ay0 + 1500 AND cyy < ay0 + 2400))"
query("agg58_hazard_flags", f"""SELECT cx, cy, coalesce(bool_or(borough < 'ASIA'), FALSE) AS in_moderate, coalesce(bool_or(borough >= 'ASIA'), FALSE) AS in_extreme
FROM (SELECT *, cx * {SIZE} + 165 AS cxx, cy * {SIZE} + 165 AS cyy FROM ({CELLS})) LEFT JOIN areas ON {HIT} GROUP BY 1, 2""", "points areas")(
    lambda s, d: S.hazard_flags(cells(s, d).withColumns({"px": F.col("cx") * SIZE + 165, "py": F.col("cy") * SIZE + 165}), multi(s, d), "px", "py", ["moderate", "extreme"]).drop("px", "py"))

# ------------------------------------------------------------------ distance
DIST = "sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy))"
query("jon11_radius_count", f"SELECT site_id, count(point_id) AS n FROM sites LEFT JOIN points ON {DIST} <= {R} GROUP BY 1", "sites points")(
    lambda s, d: S.radius_count(I.sites(s, d), I.points(s, d), R).select("site_id", "n"))
SEGD = """sqrt(pow(x - (x0 + u * (x1 - x0)), 2) + pow(y - (y0 + u * (y1 - y0)), 2))"""
U = "least(1.0, greatest(0.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))))"
NEAR = f"SELECT street_id, count(*) AS n FROM (SELECT *, {U} AS u FROM streets JOIN points ON x BETWEEN least(x0, x1) - 100 AND greatest(x0, x1) + 100 AND y BETWEEN least(y0, y1) - 100 AND greatest(y0, y1) + 100) WHERE {SEGD} <= 100 GROUP BY 1"
query("jon12_near_segment_count", f"SELECT s.street_id, coalesce(n, 0) AS n_points FROM streets s LEFT JOIN ({NEAR}) c ON c.street_id = s.street_id", "streets points")(
    lambda s, d: S.near_segment_count(I.streets(s, d), I.points(s, d), 100.0, "street_id").select("street_id", "n_points"))
query("geo11_distance_band", f"SELECT site_id, point_id, round({DIST}, 4) AS dist FROM sites JOIN points ON {DIST} <= 800", "sites points")(
    lambda s, d: S.point_pairs_within(I.sites(s, d), I.points(s, d), "sx", "sy", "x", "y", 800.0, split=2).select("site_id", "point_id", r("dist").alias("dist")))
query("jon13_nearest_site", f"SELECT point_id, site_id, round(dist, 4) AS dist_ft FROM (SELECT point_id, site_id, {DIST} AS dist FROM points, sites) QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY dist, site_id) = 1", "points sites")(
    lambda s, d: S.nearest(I.points(s, d), I.sites(s, d), "point_id", "x", "y").select("point_id", "site_id", r("dist_ft").alias("dist_ft")))
query("jon13_nearest_by_rings", f"SELECT point_id, site_id, round(dist, 4) AS dist_ft FROM (SELECT point_id, site_id, {DIST} AS dist FROM points, sites) QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY dist, site_id) = 1", "points sites")(
    lambda s, d: S.nearest(I.points(s, d), I.sites(s, d), "point_id", "x", "y", 600.0).select("point_id", "site_id", r("dist_ft").alias("dist_ft")))
query("jon14_k_nearest", f"SELECT site_id, point_id, kind, round(dist, 4) AS dist_ft, rk FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY dist, point_id) AS rk FROM (SELECT site_id, point_id, kind, {DIST} AS dist FROM sites JOIN points ON {DIST} <= {R})) WHERE rk <= 5", "sites points")(
    lambda s, d: S.k_nearest_within(I.sites(s, d).select("site_id", F.col("sx").alias("qx"), F.col("sy").alias("qy")), I.points(s, d), R, 5, "site_id", "point_id").select(
        "site_id", "point_id", "kind", r("dist_ft").alias("dist_ft"), F.col("rk").cast("long").alias("rk")))

# ------------------------------------------------------------------ overlap
query("jon10_disc_overlap")(lambda s, d: S.overlap_with_discs(I.sites(s, d), block_rings(s, d), R, "site_id", "block_id", digits=2).select("site_id", "block_id", "overlap_sqft"))
query("agg43_walkshed")(lambda s, d: S.walkshed(I.sites(s, d), block_rings(s, d), R, "site_id", "block_id", ["pop", "jobs"]).select(
    "site_id", r("pop_walkshed", 2).alias("pop_walkshed"), r("jobs_walkshed", 2).alias("jobs_walkshed")))
query("geo05_overlap_share")(lambda s, d: S.overlap_with_discs(I.sites(s, d), I.areas(s, d), R, "site_id", "area").groupBy("site_id").agg(r(F.sum("overlap_sqft"), 1).alias("covered_sqft")))
SW = "CASE WHEN street_id % 2 = 0 THEN {h} ELSE {v} END"
STRIP_BOX = f"""SELECT street_id, CASE WHEN street_id % 2 = 0 THEN x0 ELSE x0 + lo END AS px0, CASE WHEN street_id % 2 = 0 THEN x1 ELSE x0 + hi END AS px1,
  CASE WHEN street_id % 2 = 0 THEN y0 + lo ELSE y0 END AS py0, CASE WHEN street_id % 2 = 0 THEN y0 + hi ELSE y1 END AS py1
FROM (SELECT s.*, CASE side WHEN 'a' THEN 18.0 ELSE -18.0 - w END AS lo, CASE side WHEN 'a' THEN 18.0 + w ELSE -18.0 END AS hi FROM ({STRIPS}) t JOIN streets s ON s.street_id = t.street_id)"""
PROV = f"""SELECT block_id, borough, pop, income_raw, round(coalesce(a, 0), 3) AS sidewalk_area_sqft, 25200.0::DOUBLE AS block_area_sqft, 640.0::DOUBLE AS perimeter_ft, coalesce(a, 0) / 640 AS ratio, coalesce(a, 0) / nullif(pop, 0) AS per_head, coalesce(a, 0) AS a
FROM blocks LEFT JOIN (SELECT block_id AS bid, sum((least(bx1, px1) - greatest(bx0, px0)) * (least(by1, py1) - greatest(by0, py0))) AS a FROM blocks JOIN ({STRIP_BOX}) ON px0 < bx1 AND px1 > bx0 AND py0 < by1 AND py1 > by0 GROUP BY 1) ON bid = block_id"""
query("agg36_block_provision", f"SELECT block_id, sidewalk_area_sqft, block_area_sqft, perimeter_ft, round(ratio, 7) AS coverage_ratio_ft, round(per_head, 6) AS sqft_per_capita FROM ({PROV})", "blocks streets")(
    lambda s, d: provision(s, d).select("block_id", r("sidewalk_area_sqft", 3).alias("sidewalk_area_sqft"), r("block_area_sqft", 3).alias("block_area_sqft"), r("perimeter_ft", 3).alias("perimeter_ft"), r("coverage_ratio_ft", 7).alias("coverage_ratio_ft"), r("sqft_per_capita", 6).alias("sqft_per_capita")))


def provision(s, d):
    return S.block_provision(block_rings(s, d), sidewalks(s, d), "block_id", "poly_id")


query("agg32_coverage_class")(lambda s, d: coverage(s, d).select("street_id", "borough", r("sidewalk_area_sqft", 2).alias("sidewalk_area_sqft"), "has_left", "has_right", "coverage_class"))
query("geo06_side_of_segment", """SELECT street_id, side, CASE WHEN (side = 'a') = (street_id % 2 = 0) THEN 1 ELSE -1 END AS sign FROM (SELECT street_id, side FROM ({})) """.format(STRIPS), "streets")(
    lambda s, d: sidewalks(s, d).drop("borough").join(I.streets(s, d), "street_id").select("street_id", F.substring("poly_id", -1, 1).alias("side"), S.side_of_segment(F.col("rings"), *[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("sign")))


def coverage(s, d):
    return S.coverage_class(I.streets(s, d), sidewalks(s, d), "street_id", "poly_id")


# ------------------------------------------------------------------ measures
query("geo02_measures", "SELECT block_id, 25200.0::DOUBLE AS area_sqft, 640.0::DOUBLE AS perimeter_ft, cx, cy, bx0 AS min_x, by0 AS min_y, bx1 AS max_x, by1 AS max_y FROM blocks", "blocks")(
    lambda s, d: S.geom_measures(block_rings(s, d).drop("cx", "cy"), "block_id").withColumns({c: r(c, 6) for c in ("area_sqft", "perimeter_ft", "cx", "cy")}))
query("geo12_strip_width", f"SELECT street_id, side, round(2 * (400 * w) / (800 + 2 * w), 4) AS width_ft FROM ({STRIPS})", "streets")(
    lambda s, d: sidewalks(s, d).select("street_id", F.substring("poly_id", -1, 1).alias("side"), r(S.strip_width(F.col("rings"))).alias("width_ft")))
WIDTH = f"SELECT street_id, any_value(borough) AS borough, round(median(x), 4) AS width_median_ft, round(min(x), 4) AS width_min_ft, round(quantile_cont(x, 0.9), 4) AS width_p90_ft, count(*) AS n_polys FROM (SELECT *, 2 * (400 * w) / (800 + 2 * w) AS x FROM ({STRIPS})) WHERE x BETWEEN 2 AND 120 GROUP BY 1"


def widths(s, d):
    return S.segment_width(sidewalks(s, d), "street_id").withColumns({c: r(c) for c in ("width_median_ft", "width_min_ft", "width_p90_ft")})


query("agg34_segment_width", f"SELECT * EXCLUDE (borough) FROM ({WIDTH})", "streets")(widths)
query("agg35_width_summary", f"""SELECT borough, count(*) AS n, round(quantile_cont(width_median_ft, 0.1), 4) AS p10, round(median(width_median_ft), 4) AS median, round(quantile_cont(width_median_ft, 0.9), 4) AS p90 FROM ({WIDTH}) GROUP BY 1
UNION ALL SELECT 'Citywide', count(*), round(quantile_cont(width_median_ft, 0.1), 4), round(median(width_median_ft), 4), round(quantile_cont(width_median_ft, 0.9), 4) FROM ({WIDTH})""", "streets")(
    lambda s, d: S.width_summary(widths(s, d).join(I.streets(s, d).select("street_id", "borough"), "street_id"), "borough", "width_median_ft").withColumns({c: r(c) for c in ("p10", "median", "p90")}))


def some_open_rings(s, d):
    """Blocks, every 17th with an outline that doesn't close."""
    ring = F.col("rings")[0]
    return block_rings(s, d).withColumn("rings", F.when(F.col("block_id") % 17 == 0, F.array(F.slice(ring, 1, F.size(ring) - 1))).otherwise(F.col("rings")))


query("geo10_validity_sample", "SELECT count(*) AS sampled, count(*) FILTER (block_id % 17 = 0) AS invalid FROM blocks WHERE CAST('0x' || substr(md5('42:' || block_id), 1, 8) AS BIGINT) < 2147483648", "blocks")(
    lambda s, d: S.valid_share(some_open_rings(s, d), 0.5, "block_id"))


def published(s, d):
    return I.streets(s, d).withColumn("published", F.col("width_text").try_cast("double"))


# streets run along an axis, so the nearest point of one is the clamped point
def _nearest_published(points, key):
    return f"""SELECT * FROM (SELECT p.*, street_id, published, sqrt(pow(x - greatest(x0, least(x1, x)), 2) + pow(y - greatest(y0, least(y1, y)), 2)) AS dist
FROM {points} p JOIN (SELECT *, TRY_CAST(width_text AS DOUBLE) AS published FROM streets) l ON published IS NOT NULL AND x BETWEEN x0 - 25 AND x1 + 25 AND y BETWEEN y0 - 25 AND y1 + 25)
WHERE dist <= 25 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY round(dist, 6), street_id) = 1"""


MIDDLES = """SELECT street_id || side AS poly_id, 2 * (400 * w) / (800 + 2 * w) AS width_ft, CASE WHEN hor THEN x0 + 200 ELSE x0 + off END AS x, CASE WHEN hor THEN y0 + off ELSE y0 + 200 END AS y
FROM (SELECT *, street_id % 2 = 0 AS hor, street_id % 10 + 4.0::DOUBLE AS w, CASE WHEN side = 'a' THEN 1 ELSE -1 END * (18 + (street_id % 10 + 4.0::DOUBLE) / 2) AS off
  FROM streets, (VALUES ('a'), ('b')) v(side) WHERE (side = 'a' AND street_id % 3 <> 0) OR (side = 'b' AND street_id % 4 <> 0))"""

query("jon19_match_nearest_line", f"SELECT point_id, round(dist, 4) AS dist_ft, street_id, published FROM ({_nearest_published('points', 'point_id')})", "points streets")(
    lambda s, d: S.match_nearest_line(I.points(s, d), published(s, d), 25.0, "point_id").select("point_id", r("dist_ft").alias("dist_ft"), "street_id", "published"))
query("jon19_width_agreement", f"""WITH m AS ({_nearest_published(f'({MIDDLES})', 'poly_id')}),
rk AS (SELECT *, rank() OVER (ORDER BY round(width_ft, 6)) + (count(*) OVER (PARTITION BY round(width_ft, 6)) - 1) / 2 AS ra, rank() OVER (ORDER BY published) + (count(*) OVER (PARTITION BY published) - 1) / 2 AS rb FROM m)
SELECT count(*) AS n_matched, CASE WHEN count(*) >= 30 THEN round(corr(width_ft, published), 6) END AS pearson, CASE WHEN count(*) >= 30 THEN round(corr(ra, rb), 6) END AS spearman,
  round(median(dist), 4) AS median_dist_ft, round(median(width_ft), 4) AS median_measured_ft, round(median(published), 4) AS median_published_ft FROM rk""", "streets")(
    lambda s, d: scores.width_agreement(
        S.match_nearest_line(S.measured_widths(sidewalks(s, d), "poly_id").withColumn("width_ft", r("width_ft", 6)), published(s, d), 25.0, "poly_id"), "width_ft", "published", "dist_ft",
    ).withColumns({"pearson": r("pearson", 6), "spearman": r("spearman", 6), **{c: r(c) for c in ("median_dist_ft", "median_measured_ft", "median_published_ft")}}))

# ------------------------------------------------------------------ lines
LINES = """SELECT *, lead(x_ft) OVER w AS x1, lead(y_ft) OVER w AS y1 FROM (SELECT *, sum(coalesce(step, 0)) OVER (PARTITION BY shape_id ORDER BY seq) AS cum FROM (
  SELECT *, sqrt(pow(x_ft - lag(x_ft) OVER w, 2) + pow(y_ft - lag(y_ft) OVER w, 2)) AS step FROM shape_points WINDOW w AS (PARTITION BY shape_id ORDER BY seq))) WINDOW w AS (PARTITION BY shape_id ORDER BY seq)"""
LOC = f"""SELECT event_id, trip_id, route_id, ts, shape_id, perp, off, len FROM (SELECT f.*, len, sqrt(pow(f.x_ft - (s.x_ft + u * (x1 - s.x_ft)), 2) + pow(f.y_ft - (s.y_ft + u * (y1 - s.y_ft)), 2)) AS perp, cum + u * sqrt(pow(x1 - s.x_ft, 2) + pow(y1 - s.y_ft, 2)) AS off
  FROM (SELECT f.*, s.cum, s.x_ft AS sx, s.y_ft AS sy, s.x1, s.y1, s.len, least(1.0, greatest(0.0, ((f.x_ft - s.x_ft) * (s.x1 - s.x_ft) + (f.y_ft - s.y_ft) * (s.y1 - s.y_ft)) / (pow(s.x1 - s.x_ft, 2) + pow(s.y1 - s.y_ft, 2)))) AS u
        FROM fixes f JOIN (SELECT *, max(cum) OVER (PARTITION BY shape_id) AS len FROM ({LINES})) s ON s.shape_id = f.shape_id AND s.x1 IS NOT NULL) f, LATERAL (SELECT f.sx AS x_ft, f.sy AS y_ft) s)
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY perp, off) = 1"""


def located(s, d):
    return S.line_locate(I.fixes(s, d), S.shape_lines(I.shape_points(s, d)))


query("geo04_line_locate", f"SELECT event_id, round(off, 3) AS offset_ft, round(perp, 3) AS perp_ft FROM ({LOC})", "fixes shape_points")(
    lambda s, d: located(s, d).select("event_id", r("offset_ft", 3).alias("offset_ft"), r("perp_ft", 3).alias("perp_ft")))
query("geo07_route_polylines", f"SELECT shape_id, count(*) AS n_points, round(max(cum), 4) AS shape_len_ft, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS vertices FROM ({LINES}) GROUP BY 1", "shape_points")(
    lambda s, d: S.shape_lines(I.shape_points(s, d)).select("shape_id", "n_points", r("shape_len_ft").alias("shape_len_ft"), F.array_join(F.transform("line", lambda p: p.seq.cast("string")), ",").alias("vertices")))
ADH = f"""SELECT route_id, ts // 86400 AS day, count(*) AS n_pings, count(*) FILTER (perp <= 100) AS n_on_route, count(DISTINCT trip_id) AS n_trips, median(perp) AS mp, quantile_cont(perp, 0.9) AS p90
FROM ({LOC}) WHERE off >= 500 AND off <= len - 500 GROUP BY 1, 2"""


def adherence(s, d):
    return S.route_adherence(materialize(located(s, d), "located"))


query("agg26_route_adherence", f"SELECT route_id, day, n_pings, n_on_route, n_trips, round(mp, 3) AS median_perp_ft, round(p90, 3) AS p90_perp_ft, round(100.0::DOUBLE * n_on_route / n_pings, 4) AS adherence_pct FROM ({ADH})", "fixes shape_points")(
    lambda s, d: adherence(s, d).withColumns({"median_perp_ft": r("median_perp_ft", 3), "p90_perp_ft": r("p90_perp_ft", 3), "adherence_pct": r("adherence_pct")}))
query("agg68_adherence_summary", f"""SELECT route_id, CAST(sum(n_pings) AS BIGINT) AS n_pings, CAST(sum(n_trips) AS BIGINT) AS n_trips, round(median(mp), 3) AS median_perp_ft, round(max(p90), 3) AS worst_day_p90_perp_ft, count(*) AS observed_days,
  round(100.0::DOUBLE * sum(n_on_route) / sum(n_pings), 4) AS adherence_pct FROM ({ADH}) GROUP BY 1 HAVING sum(n_pings) >= 50""", "fixes shape_points")(
    lambda s, d: O.adherence_summary(adherence(s, d), 50).withColumns({"median_perp_ft": r("median_perp_ft", 3), "worst_day_p90_perp_ft": r("worst_day_p90_perp_ft", 3), "adherence_pct": r("adherence_pct")}))

# ------------------------------------------------------------------ street network
NODES = """SELECT nx, ny, count(*) AS degree, count(DISTINCT street_id) AS n_segments, CASE WHEN count(*) >= 3 THEN 'intersection (>=3)' WHEN count(*) = 2 THEN 'midblock pseudo-node' ELSE 'dead end' END AS kind
FROM (SELECT street_id, round(x0) AS nx, round(y0) AS ny FROM streets UNION ALL SELECT street_id, round(x1), round(y1) FROM streets) GROUP BY 1, 2"""


def nodes(s, d):
    return S.network_nodes(I.streets(s, d), "street_id")


query("agg41_network_nodes", NODES, "streets")(nodes)
query("geo09_snap_to_foot", "SELECT point_id, round(x + 0.3) AS gx, round(y + 0.7) AS gy FROM points", "points")(lambda s, d: I.points(s, d).select("point_id", F.round(F.col("x") + 0.3).alias("gx"), F.round(F.col("y") + 0.7).alias("gy")))


def ramps(s, d):
    """Ramps near the street grid: customers moved towards grid corners."""
    p, k = I.points(s, d), F.col("point_id")
    return p.select((F.floor(F.col("x") / 400) * 400 + k % 60).alias("x"), (F.floor(F.col("y") / 400) * 400 + k % 45).alias("y"),
                    F.when(k % 8 == 0, 100.0).otherwise((k % 13).cast("double")).alias("slope"))


RAMPS = "SELECT floor(x / 400) * 400 + point_id % 60 AS x, floor(y / 400) * 400 + point_id % 45 AS y, CASE WHEN point_id % 8 = 0 THEN 100.0::DOUBLE ELSE (point_id % 13)::DOUBLE END AS slope FROM points"
INTER = f"""SELECT n.nx, n.ny, n.degree, count(x) AS n_ramps, count(*) FILTER (slope > 8.33 AND slope < 100) AS n_ramps_steep, CASE WHEN count(x) > 0 THEN 1 ELSE 0 END AS has_ramp
FROM ({NODES}) n LEFT JOIN ({RAMPS}) r ON sqrt(pow(x - nx, 2) + pow(y - ny, 2)) <= 50 WHERE degree >= 3 GROUP BY 1, 2, 3"""


def inter(s, d):
    return S.ramps_at_intersections(nodes(s, d), ramps(s, d))


query("agg42_ramps_at_intersections", INTER, "streets points")(inter)
query("agg42_ramp_coverage", f"""WITH i AS (SELECT i.*, a.borough FROM ({INTER}) i JOIN areas a ON nx >= ax0 AND nx < ax1 AND ny >= ay0 AND ny < ay1)
SELECT coalesce(borough, 'Citywide') AS borough, count(*) AS n_intersections, CAST(sum(has_ramp) AS BIGINT) AS n_with_ramp, CAST(sum(n_ramps) AS BIGINT) AS total_ramps, CAST(sum(n_ramps_steep) AS BIGINT) AS steep_ramps,
  round(100 * sum(has_ramp) / count(*), 1) AS ramp_coverage_pct, round(100 * sum(n_ramps_steep) / nullif(sum(n_ramps), 0), 1) AS steep_ramp_pct FROM i GROUP BY ROLLUP (borough)""", "streets points areas")(
    lambda s, d: S.ramp_coverage(S.assign_area(inter(s, d), I.areas(s, d), "nx", "ny", ["borough"], how="inner"), "borough"))


def classed(s, d):
    """Streets with the sides their own strips lie on."""
    k = F.col("street_id")
    a, b = (k % 3 != 0).cast("int"), (k % 4 != 0).cast("int")
    return I.streets(s, d).withColumns({"has_left": a, "has_right": b, "seg_len_ft": F.lit(400.0), "coverage_class": S.class_of_sides(a, b)})


CLASSED = "SELECT *, CASE WHEN street_id % 3 <> 0 THEN 1 ELSE 0 END AS l, CASE WHEN street_id % 4 <> 0 THEN 1 ELSE 0 END AS rr FROM streets"
query("agg75_edge_miles", f"""SELECT area, round(sum(400 * (l + rr)) / 5280, 4) AS edge_mi, round(count(*) * 400 / 5280, 4) AS centerline_mi FROM ({CLASSED}) JOIN areas
ON (x0 + x1) / 2 >= ax0 AND (x0 + x1) / 2 < ax1 AND (y0 + y1) / 2 >= ay0 AND (y0 + y1) / 2 < ay1 GROUP BY 1""", "streets areas")(
    lambda s, d: S.edge_miles(classed(s, d), I.areas(s, d)).withColumns({"edge_mi": r("edge_mi"), "centerline_mi": r("centerline_mi")}))
query("agg33_coverage_summary", f"""SELECT coalesce(borough, 'Citywide') AS borough, count(*) FILTER (l + rr = 0) AS "none", count(*) FILTER (l + rr = 1) AS one_side, count(*) FILTER (l + rr = 2) AS both_sides, count(*) AS total,
  round(100 * count(*) FILTER (l + rr = 2) / count(*), 1) AS pct_both, round(100 * count(*) FILTER (l + rr = 0) / count(*), 1) AS pct_none FROM ({CLASSED}) GROUP BY ROLLUP (borough)""", "streets")(
    lambda s, d: S.coverage_summary(classed(s, d), "borough"))
