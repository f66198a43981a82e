"""Queries on scores, equity, buildings and cordon counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.catalog import inputs as I
from kerbline.catalog import spatial as SP
from kerbline.catalog.registry import query, r
from kerbline.functions import codes
from kerbline.operators import buildings as B
from kerbline.operators import scores as S
from kerbline.operators import spatial as SPO
from kerbline.operators import supply
from kerbline.session import materialize
from kerbline.sources import lake

SIZE, R = SP.SIZE, SP.R

# ------------------------------------------------------------------ small columns
MARKS = ["MANHATTAN", "Bronx", "BROOKLYN", "Queens", "STATEN ISLAND", "NOWHERE"]
BOARD = f"lpad(CAST(c_custkey % 18 + 1 AS VARCHAR), 2, '0') || ' ' || {I.sql_pick('c_custkey', MARKS)}"
DIST = "CASE {n} WHEN 'MANHATTAN' THEN 'MN' WHEN 'BRONX' THEN 'BX' WHEN 'BROOKLYN' THEN 'BK' WHEN 'QUEENS' THEN 'QN' WHEN 'STATEN ISLAND' THEN 'SI' END"
query("prj06_district_code", f"""
SELECT c_custkey, CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE {DIST.format(n='upper(' + I.sql_pick('c_custkey', MARKS) + ')')} || lpad(CAST(c_custkey % 18 + 1 AS VARCHAR), 2, '0') END AS district,
  {DIST.format(n="CASE WHEN c_custkey % 4 = 0 THEN CASE c_custkey % 5 WHEN 0 THEN 'MANHATTAN' WHEN 1 THEN 'BRONX' WHEN 2 THEN 'BROOKLYN' WHEN 3 THEN 'QUEENS' ELSE 'STATEN ISLAND' END ELSE CASE c_custkey % 5 WHEN 0 THEN 'MANHATTAN' WHEN 1 THEN 'BRONX' WHEN 2 THEN 'BROOKLYN' WHEN 3 THEN 'QUEENS' ELSE 'STATEN ISLAND' END END")}
  || lpad(CAST(c_custkey % 18 + 1 AS VARCHAR), 2, '0') AS street_district FROM customer""")(
    lambda s, d: (lambda c: c.select(
        "c_custkey", codes.district_code(F.when(F.col("c_custkey") % 23 == 0, "UNKNOWN").otherwise(F.concat(F.lpad((F.col("c_custkey") % 18 + 1).cast("string"), 2, "0"), F.lit(" "), I.pick(F.col("c_custkey"), MARKS)))).alias("district"),
        codes.district_from_street_code(
            F.when(F.col("c_custkey") % 4 == 0, F.concat((F.col("c_custkey") % 5 + 1).cast("string"), F.lit("0417"))).otherwise("9X"),
            F.concat(F.lit("HW2"), I.pick(F.col("c_custkey"), ["M", "X", "K", "Q", "S"]), F.when(F.col("c_custkey") % 2 == 0, "CO").otherwise("")),
            F.concat(F.lit("CB "), (F.col("c_custkey") % 18 + 1).cast("string"))).alias("street_district")))(I.table(s, d, "customer")))
query("prj07_null_sentinel", "SELECT block_id, CASE WHEN income_raw > -666666666 THEN income_raw END AS income FROM blocks", "blocks")(
    lambda s, d: I.blocks(s, d).select("block_id", codes.null_sentinel(F.col("income_raw"), F.col("income_raw") <= -666666666).alias("income")))
ENTITIES = "html"
for _name, _char in (("lt;", "<"), ("gt;", ">"), ("quot;", '"'), ("#39;", "''"), ("copy;", "©"), ("middot;", "·"), ("amp;", "&")):
    ENTITIES = f"replace({ENTITIES}, '&{_name}', '{_char}')"
# an ampersand's semicolon may be cut off at the end of a page
query("prj19_clean_text", f"SELECT page_id, CASE WHEN html LIKE '%&amp' THEN left(t, length(t) - 3) ELSE t END AS clean FROM (SELECT page_id, html, coalesce({ENTITIES}, '') AS t FROM pages)")(lambda s, d: I.table(s, d, "pages").select("page_id", codes.clean_text(F.col("html")).alias("clean")))


def blocks(s, d):
    return I.blocks(s, d).withColumn("income", codes.null_sentinel(F.col("income_raw"), F.col("income_raw") < 0))


# ------------------------------------------------------------------ percentiles
query("win07_pctile_cume", """
SELECT site_id, round(100.0::DOUBLE * cume_dist() OVER (ORDER BY score), 4) AS score_pctile, round(100.0::DOUBLE * cume_dist() OVER (ORDER BY CASE WHEN score > 2000 THEN round(score / 500) END NULLS LAST), 4) AS band_pctile FROM sites""", "sites")(
    lambda s, d: S.pctile_cume(I.sites(s, d).select("site_id", "score", F.when(F.col("score") > 2000, F.round(F.col("score") / 500)).alias("band")), "site_id", ["score", "band"]).withColumns(
        {"score_pctile": r("score_pctile"), "band_pctile": r("band_pctile")}))
query("win07_pctile_defined_only", """
SELECT site_id, CASE WHEN b IS NOT NULL THEN round(100.0::DOUBLE * cume_dist() OVER (PARTITION BY b IS NULL ORDER BY b), 4) END AS band_pctile FROM (SELECT site_id, CASE WHEN score > 2000 THEN round(score / 500) END AS b FROM sites)""", "sites")(
    lambda s, d: S.pctile_cume(I.sites(s, d).select("site_id", F.when(F.col("score") > 2000, F.round(F.col("score") / 500)).alias("band")), "site_id", ["band"], True).withColumn("band_pctile", r("band_pctile")))
AVGR = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / count({c}) OVER () * 100"
query("win08_pctile_avg", f"SELECT block_id, pop, round(100 - {AVGR.format(c='pop')}, 4) AS pct FROM blocks", "blocks")(
    lambda s, d: S.pctile_avg(I.blocks(s, d).select("block_id", "pop"), "pop", "pct", True).withColumn("pct", r("pct")))
query("win08_minmax", "SELECT site_id, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) * 100, 4) AS scaled FROM sites", "sites")(
    lambda s, d: S.minmax(I.sites(s, d).select("site_id", "score"), "score", "scaled").select("site_id", r("scaled").alias("scaled")))
query("prj16_good_percentile", """
SELECT block_id, round(100 - 100.0::DOUBLE * cume_dist() OVER (ORDER BY jobs), 4) AS good_jobs, round(100.0::DOUBLE * cume_dist() OVER (ORDER BY pop), 4) AS good_pop FROM blocks""", "blocks")(
    lambda s, d: S.pctile_cume(I.blocks(s, d), "block_id", ["jobs", "pop"]).select(
        "block_id", r(S.good_percentile(F.col("jobs_pctile"), True)).alias("good_jobs"), r(S.good_percentile(F.col("pop_pctile"), False)).alias("good_pop")))

# ------------------------------------------------------------------ stop index
WEIGHTS = {"population": 0.5, "amount": 0.3, "safety": 0.2}
STOPS = f"SELECT s.site_id, s.site_name, s.nation % 5 AS area, s.nation % 2 = 0 AS premium, count(point_id) AS n_points, count(*) FILTER (kind = 'MACHINERY') AS n_mach, round(s.score) AS amount_raw FROM sites s LEFT JOIN points ON {SP.DIST} <= 1312.336 GROUP BY ALL"


def stop_inputs(s, d):
    sites, pts = I.sites(s, d), I.points(s, d)
    a = SPO.radius_count(sites, pts, R, "n_points")
    b = SPO.radius_count(sites, pts.where("kind = 'MACHINERY'"), R, "n_mach").select("site_id", "n_mach")
    j = a.join(b, "site_id")
    return j.select("site_id", "site_name", (F.col("nation") % 5).alias("area"), (F.col("nation") % 2 == 0).alias("premium"), "n_points", "n_mach", F.round("score").alias("amount_raw"))


SPEC = {"population": ("n_points", False), "amount": ("amount_raw", False), "safety": ("n_mach", True)}
INDEX = f"""WITH st AS ({STOPS}), sub AS (SELECT site_id, area, n_mach, round({AVGR.format(c='n_points')}, 2) AS population, round({AVGR.format(c='amount_raw')}, 2) AS amount, round(100 - {AVGR.format(c='n_mach')}, 2) AS safety FROM st),
ix AS (SELECT *, round(population * 0.5 + amount * 0.3 + safety * 0.2, 2) AS score, round((population + amount + safety) / 3, 2) AS score_equal_weight FROM sub),
fin AS (SELECT *, rank() OVER (ORDER BY score DESC) AS score_rank, round({AVGR.format(c='score')}, 1) AS score_pctile FROM ix)"""


def index(s, d):
    return S.composite_index(stop_inputs(s, d), "site_id", SPEC, WEIGHTS)


query("agg46_composite_index", f"{INDEX} SELECT * EXCLUDE (area, n_mach) FROM fin", "sites points")(index)
query("top03_index_league", f"""{INDEX} SELECT site_id, score, side FROM (SELECT site_id, score, 'best' AS side, row_number() OVER (ORDER BY score DESC, site_id) AS rn FROM fin
UNION ALL SELECT site_id, score, 'worst', row_number() OVER (ORDER BY score, site_id DESC) FROM fin) WHERE rn <= 10""", "sites points")(lambda s, d: S.index_league(index(s, d).select("site_id", "score"), "score", "site_id", 10))
query("agg47_index_summary", f"{INDEX} SELECT area, count(*) AS n_rows, round(avg(score), 4) AS score_mean, round(median(score), 4) AS score_median, round(100.0::DOUBLE * avg(CASE WHEN n_mach > 0 THEN 1 ELSE 0 END), 4) AS pct_n_mach FROM fin GROUP BY 1", "sites points")(
    lambda s, d: (lambda i: S.index_summary(materialize(index(s, d).select("site_id", "score"), "index").join(i.select("site_id", "area", "n_mach"), "site_id"), "area", "score", ["n_mach"]).withColumns({c: r(c) for c in ("score_mean", "score_median", "pct_n_mach")}))(stop_inputs(s, d)))
query("agg76_amenity_share", f"WITH st AS ({STOPS}) SELECT premium, round(100.0::DOUBLE * avg(CASE WHEN n_mach > 0 THEN 1 ELSE 0 END), 4) AS share_pct, count(*) AS n FROM st GROUP BY 1", "sites points")(
    lambda s, d: S.amenity_share(stop_inputs(s, d), "premium", "n_mach").withColumn("share_pct", r("share_pct")))
query("agg44_stop_base", "SELECT stop_id, count(DISTINCT route_id) AS n_routes, string_agg(DISTINCT route_id, ', ' ORDER BY route_id) AS routes, bool_or(direction_id = 1) AS any_inbound FROM stop_times JOIN trips USING (trip_id) GROUP BY 1", "stop_times trips")(
    lambda s, d: supply.stop_base(I.stop_times(s, d), I.trips(s, d), F.col("direction_id") == 1).withColumnRenamed("any_flag", "any_inbound"))
query("agg40_correlation", """
WITH rk AS (SELECT pop, income_raw AS inc, rank() OVER (ORDER BY pop) + (count(*) OVER (PARTITION BY pop) - 1) / 2 AS ra, rank() OVER (ORDER BY income_raw) + (count(*) OVER (PARTITION BY income_raw) - 1) / 2 AS rb FROM blocks WHERE income_raw > 0)
SELECT round(corr(pop, inc), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM rk""", "blocks")(
    lambda s, d: S.correlation(blocks(s, d), "pop", "income").withColumns({"pearson": r("pearson", 6), "spearman": r("spearman", 6)}))
COND = "SELECT nation AS area, count(*) AS complaints, count(*) FILTER (score > 5000) AS violations, CASE WHEN nation % 7 = 0 THEN 0.0 ELSE nation + 1.5 END::DOUBLE AS edge_mi, CASE WHEN nation % 3 <> 0 THEN avg(score) END AS damage FROM sites GROUP BY nation"
query("agg39_condition_index", f"""
WITH c AS (SELECT *, complaints / nullif(edge_mi, 0) AS cp, violations / nullif(edge_mi, 0) AS vp FROM ({COND})),
z AS (SELECT *, (cp - avg(cp) OVER ()) / stddev_samp(cp) OVER () AS z1, (vp - avg(vp) OVER ()) / stddev_samp(vp) OVER () AS z2, (damage - avg(damage) OVER ()) / stddev_samp(damage) OVER () AS z3 FROM c)
SELECT area, round(cp, 4) AS complaints_per_mi, round(vp, 4) AS violations_per_mi, round((coalesce(z1, 0) + coalesce(z2, 0) + coalesce(z3, 0)) / nullif((z1 IS NOT NULL)::INT + (z2 IS NOT NULL)::INT + (z3 IS NOT NULL)::INT, 0), 4) AS condition_z FROM z""", "sites")(
    lambda s, d: S.condition_index(I.sites(s, d).groupBy(F.col("nation").alias("area")).agg(F.count(F.lit(1)).alias("complaints"), F.count_if(F.col("score") > 5000).alias("violations"), F.avg("score").alias("sc")).withColumns(
        {"edge_mi": F.when(F.col("area") % 7 == 0, 0.0).otherwise(F.col("area") + 1.5), "damage": F.when(F.col("area") % 3 != 0, F.col("sc"))}), ["complaints", "violations"], "edge_mi", ["damage"]).select(
        "area", r("complaints_per_mi").alias("complaints_per_mi"), r("violations_per_mi").alias("violations_per_mi"), r("condition_z").alias("condition_z")))

# ------------------------------------------------------------------ equity
PROV = f"SELECT p.*, CASE WHEN income_raw > 0 THEN income_raw END AS income FROM ({SP.PROV}) p"


def provided(s, d):
    p = SP.provision(s, d).withColumn("income", codes.null_sentinel(F.col("income_raw"), F.col("income_raw") < 0))
    return materialize(p, "provision")


query("agg37_area_provision", f"""SELECT borough, count(*) AS n_blocks, round(sum(a), 2) AS sidewalk_area_sqft, sum(perimeter_ft) AS frontage_ft, CAST(sum(pop) AS BIGINT) AS total_pop, round(median(income), 4) AS med_income,
  round(sum(a) / sum(perimeter_ft), 6) AS coverage_ratio_ft, round(sum(a) / sum(pop), 6) AS sqft_per_capita FROM ({PROV}) GROUP BY 1""", "blocks streets")(
    lambda s, d: S.area_provision(provided(s, d), "borough").withColumns({"sidewalk_area_sqft": r("sidewalk_area_sqft", 2), "frontage_ft": r("frontage_ft", 2), "med_income": r("med_income"), "coverage_ratio_ft": r("coverage_ratio_ft", 6), "sqft_per_capita": r("sqft_per_capita", 6)}))
query("agg37_provision_gaps", f"SELECT block_id, pop FROM ({PROV}) WHERE pop >= 40 AND a = 0", "blocks streets")(lambda s, d: S.provision_gaps(provided(s, d), 40).select("block_id", "pop"))
query("agg38_quintile_equity", f"""
WITH b AS (SELECT * FROM ({PROV}) WHERE income IS NOT NULL AND pop > 0), e AS (SELECT quantile_cont(income, 0.2) AS e1, quantile_cont(income, 0.4) AS e2, quantile_cont(income, 0.6) AS e3, quantile_cont(income, 0.8) AS e4 FROM b)
SELECT CASE WHEN income <= e1 THEN 1 WHEN income <= e2 THEN 2 WHEN income <= e3 THEN 3 WHEN income <= e4 THEN 4 ELSE 5 END AS income_q, count(*) AS n_blocks, CAST(sum(pop) AS BIGINT) AS population, min(income) AS income_low, max(income) AS income_high,
  round(sum(coalesce(ratio, 0) * pop) / sum(pop), 6) AS mean_coverage_ratio_ft, round(sum(a) / sum(pop), 6) AS sqft_per_capita, round(100.0::DOUBLE * avg(CASE WHEN a = 0 THEN 1 ELSE 0 END), 4) AS pct_zero_blocks FROM b, e GROUP BY 1""", "blocks streets")(
    lambda s, d: S.quintile_equity(provided(s, d)).withColumns({"mean_coverage_ratio_ft": r("mean_coverage_ratio_ft", 6), "sqft_per_capita": r("sqft_per_capita", 6), "pct_zero_blocks": r("pct_zero_blocks")}))
query("agg48_density", "SELECT borough, CAST(sum(pop) AS BIGINT) AS pop, round(count(*) * 25200.0::DOUBLE / 27878400, 6) AS land_sqmi, round(sum(pop) / (count(*) * 25200.0::DOUBLE / 27878400), 4) AS pop_density_sqmi FROM blocks GROUP BY 1", "blocks")(
    lambda s, d: S.density(I.blocks(s, d).withColumn("sqft", (F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0"))), "borough", "pop", "sqft").withColumns({"land_sqmi": r("land_sqmi", 6), "pop_density_sqmi": r("pop_density_sqmi")}))
WB = """WITH b AS (SELECT geoid, pop, jobs, income_raw AS inc FROM blocks WHERE income_raw > 0 AND pop > 0),
c AS (SELECT *, round(inc / 50) AS band FROM b), q AS (SELECT *, CAST(floor(least(sum(pop) OVER (ORDER BY band, geoid) / sum(pop) OVER () * 10, 9.9999)) AS INT) + 1 AS bucket FROM c)"""


def banded(s, d):
    return blocks(s, d).select("geoid", "pop", "jobs", F.round(F.col("income") / 50).alias("band"), (F.col("jobs") > 30).alias("frequent"))


query("win13_weighted_bucket", f"{WB} SELECT geoid, bucket FROM q", "blocks")(lambda s, d: S.weighted_bucket(banded(s, d), "band", "pop", "geoid").select("geoid", "bucket"))
query("agg53_weighted_deciles", f"""{WB} SELECT bucket AS income_decile, min(band) AS income_low, max(band) AS income_high, CAST(sum(pop) AS BIGINT) AS population, count(*) AS n_blocks, round(sum(jobs * pop) / sum(pop), 4) AS mean_jobs_reachable,
  round(sum(CASE WHEN jobs > 30 THEN pop ELSE 0 END) / sum(pop), 4) AS frequent_access_share FROM q GROUP BY 1""", "blocks")(
    lambda s, d: S.weighted_deciles(banded(s, d), "band", "pop", "geoid", "jobs", "frequent").withColumns({"mean_jobs_reachable": r("mean_jobs_reachable"), "frequent_access_share": r("frequent_access_share")}))
OD = "SELECT 'P' || CAST(l_suppkey % 20 AS VARCHAR) AS origin, 'P' || CAST(l_partkey % 20 AS VARCHAR) AS destination, l_orderkey % 24 AS hour_of_day, l_quantity AS riders FROM lineitem"


def od(s, d):
    li = I.table(s, d, "lineitem")
    name = lambda c: F.concat(F.lit("P"), (F.col(c) % 20).cast("string"))
    return li.select(name("l_suppkey").alias("origin"), name("l_partkey").alias("destination"), (F.col("l_orderkey") % 24).alias("hour_of_day"), F.col("l_quantity").alias("riders"))


query("agg49_top_flows", f"SELECT origin, destination, round(sum(riders), 1) AS est_avg_riders FROM ({OD}) WHERE origin <> destination GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 100")(lambda s, d: S.top_flows(od(s, d), 100))
query("agg49_top_flows_8am", f"SELECT origin, destination, round(sum(riders), 1) AS est_avg_riders FROM ({OD}) WHERE origin <> destination AND hour_of_day = 8 GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 100")(lambda s, d: S.top_flows(od(s, d), 100, 8))
EXPO = f"SELECT s.street_id, s.street_id % 5 + 1 AS demand_rank, coalesce(n, 0) AS n_points FROM streets s LEFT JOIN ({SP.NEAR}) c ON c.street_id = s.street_id"


def exposure(s, d):
    return SPO.near_segment_count(I.streets(s, d), I.points(s, d), 100.0, "street_id").select("street_id", (F.col("street_id") % 5 + 1).alias("demand_rank"), "n_points")


query("agg50_exposure_gradient", f"SELECT demand_rank, count(*) AS n_segments, CAST(sum(n_points) AS BIGINT) AS total, round(avg(n_points), 4) AS mean_per_segment FROM ({EXPO}) GROUP BY 1", "streets points")(
    lambda s, d: S.exposure_gradient(exposure(s, d), "demand_rank", "n_points").withColumn("mean_per_segment", r("mean_per_segment")))
query("agg50_worst_segments", f"SELECT * FROM ({EXPO}) ORDER BY n_points DESC, street_id LIMIT 50", "streets points")(lambda s, d: S.worst_segments(exposure(s, d), "n_points", "street_id", 50))
JOBS = f"SELECT CAST(floor(cx / {SIZE}) AS BIGINT) AS nx, CAST(floor(cy / {SIZE}) AS BIGINT) AS ny, CAST(sum(jobs) AS BIGINT) AS jobs FROM blocks GROUP BY 1, 2"


def reach(s, d):
    cells = I.blocks(s, d).select(F.floor(F.col("cx") / SIZE).cast("long").alias("cx"), F.floor(F.col("cy") / SIZE).cast("long").alias("cy")).distinct()
    cover = SPO.neighbour_map(cells, SIZE, 1400.0).select(F.col("cx").alias("ox"), F.col("cy").alias("oy"), "nx", "ny")
    jobs = I.blocks(s, d).groupBy(F.floor(F.col("cx") / SIZE).cast("long").alias("nx"), F.floor(F.col("cy") / SIZE).cast("long").alias("ny")).agg(F.sum("jobs").alias("jobs"))
    return S.reachable_sum(cover, jobs)


REACH = f"""SELECT a.nx AS ox, a.ny AS oy, CAST(sum(b.jobs) AS BIGINT) AS jobs_reachable, count(*) AS n_cells, round(sum(b.jobs) / (SELECT sum(jobs) FROM blocks), 6) AS jobs_reachable_pct FROM ({JOBS}) a JOIN ({JOBS}) b
  ON sqrt((a.nx - b.nx) * (a.nx - b.nx) + (a.ny - b.ny) * (a.ny - b.ny)) * {SIZE} <= 1400 GROUP BY 1, 2"""
query("agg52_reachable_sum", REACH, "blocks")(lambda s, d: reach(s, d).withColumn("jobs_reachable_pct", r("jobs_reachable_pct", 6)))
query("jon21_inherit_parent", f"""SELECT block_id, jobs_reachable, med_income FROM blocks b LEFT JOIN ({REACH}) p ON p.ox = CAST(floor(b.cx / {SIZE}) AS BIGINT) AND p.oy = CAST(floor(b.cy / {SIZE}) AS BIGINT)
LEFT JOIN (SELECT substr(geoid, 1, 12) AS bg, CASE WHEN min(income_raw) >= 0 THEN min(income_raw) END AS med_income FROM blocks GROUP BY 1) a ON a.bg = substr(b.geoid, 1, 12)""", "blocks")(
    lambda s, d: S.inherit_parent(I.blocks(s, d).withColumns({"px": F.floor(F.col("cx") / SIZE).cast("long"), "py": F.floor(F.col("cy") / SIZE).cast("long")}),
                                  reach(s, d).select(F.col("ox").alias("px"), F.col("oy").alias("py"), "jobs_reachable"),
                                  I.blocks(s, d).groupBy(F.substring("geoid", 1, 12).alias("bg_geoid")).agg(F.min("income_raw").alias("med_income"))).select("block_id", "jobs_reachable", "med_income"))

# ------------------------------------------------------------------ wide cells and profiles
GRID = f"""SELECT c.cx, c.cy, n, n_machinery, coalesce(q.insp, 0) AS insp, coalesce(q.fail, 0) AS fail, coalesce(f.flood, FALSE) AS flood, round(CASE WHEN q.insp > 0 THEN q.fail / q.insp END, 6) AS rodent_fail_rate
FROM ({SP.CELLS}) c JOIN (SELECT cx, cy, n, n_machinery FROM ({SP.LAYER})) b ON b.cx = c.cx AND b.cy = c.cy
LEFT JOIN (SELECT CAST(floor(sx / {SIZE}) AS BIGINT) AS cx, CAST(floor(sy / {SIZE}) AS BIGINT) AS cy, count(*) AS insp, count(*) FILTER (score < 3000) AS fail FROM sites GROUP BY 1, 2) q ON q.cx = c.cx AND q.cy = c.cy
LEFT JOIN (SELECT DISTINCT cx, cy, TRUE AS flood FROM ({SP.CELLS}) WHERE cx % 3 = 0) f ON f.cx = c.cx AND f.cy = c.cy"""


def grid(s, d):
    c = SP.cells(s, d)
    q = SPO.bin_layer(I.sites(s, d), "sx", "sy", SIZE, [F.count(F.lit(1)).alias("insp"), F.count_if(F.col("score") < 3000).alias("fail")])
    return S.assemble_cells(c, SP.layer(s, d).select("cx", "cy", "n", "n_machinery"), q, c.where("cx % 3 = 0").withColumn("flood", F.lit(True))).withColumn("rodent_fail_rate", r("rodent_fail_rate", 6))


query("jon20_assemble_cells", GRID, "points sites")(grid)
PROF = f"""WITH g AS ({GRID}), p AS (SELECT site_id, sx, sy, CAST(floor(sx / {SIZE}) AS BIGINT) AS c0, CAST(floor(sy / {SIZE}) AS BIGINT) AS c1 FROM sites),
pr AS (SELECT p.site_id, g.cx, g.cy, CAST(greatest(abs(g.cx - c0), abs(g.cy - c1)) AS INT) AS ring, n, flood FROM p LEFT JOIN g ON abs(g.cx - c0) <= 4 AND abs(g.cy - c1) <= 4
  QUALIFY row_number() OVER (PARTITION BY p.site_id ORDER BY greatest(abs(g.cx - c0), abs(g.cy - c1)), sqrt(pow((g.cx + 0.5) * {SIZE} - sx, 2) + pow((g.cy + 0.5) * {SIZE} - sy, 2)), g.cx, g.cy) = 1)"""


def profile(s, d):
    return S.profiles(I.sites(s, d).select("site_id", F.col("sx").alias("x"), F.col("sy").alias("y")), grid(s, d).select("cx", "cy", "n", "flood"), "site_id", SIZE)


query("agg71_profiles", f"{PROF} SELECT * FROM pr", "points sites")(profile)
query("agg71_compare", f"""{PROF} SELECT a.site_id AS a_id, b.site_id AS b_id, a.n AS a_n, b.n AS b_n, b.n - a.n AS diff_n FROM pr a JOIN pr b ON CAST(b.site_id AS BIGINT) = CAST(a.site_id AS BIGINT) + 1""", "points sites")(
    lambda s, d: S.compare(materialize(profile(s, d), "profile"), I.sites(s, d).select(F.col("site_id").alias("a_id"), (F.col("site_id").cast("long") + 1).cast("string").alias("b_id")), "site_id", ["n"]))

# ------------------------------------------------------------------ buildings
LOT = "CAST(1 + {k} % 6 AS VARCHAR) || lpad(CAST({k} % 97 AS VARCHAR), 5, '0') || lpad(CAST({k} % 13 AS VARCHAR), 4, '0')"


def lot(k):
    t = lambda e: e.cast("string")
    return codes.bbl(t(F.col(k) % 6 + 1), t(F.col(k) % 97), t(F.col(k) % 13))


def violations(s, d):
    li = I.table(s, d, "lineitem")
    cls = F.when(F.col("l_suppkey") % 4 == 0, "C").when(F.col("l_returnflag") == "N", "B").when(F.col("l_returnflag") == "R", "I").otherwise(F.col("l_returnflag"))
    return li.select(F.when(F.col("l_suppkey") % 11 != 0, lot("l_partkey")).alias("bbl"), cls.alias("class"), F.when(F.col("l_linestatus") == "O", "Open").otherwise("Close").alias("status"))


query("agg54_open_by_class", f"""WITH v AS (SELECT {LOT.format(k='l_partkey')} AS bbl, CASE WHEN l_suppkey % 4 = 0 THEN 'C' WHEN l_returnflag = 'N' THEN 'B' WHEN l_returnflag = 'R' THEN 'I' ELSE l_returnflag END AS c FROM lineitem WHERE l_linestatus = 'O' AND l_suppkey % 11 <> 0)
SELECT bbl, count(*) AS open_total, count(*) FILTER (c = 'A') AS open_class_a, count(*) FILTER (c = 'B') AS open_class_b, count(*) FILTER (c = 'C') AS open_class_c, count(*) FILTER (c = 'I') AS open_class_i FROM v GROUP BY 1""")(
    lambda s, d: B.open_by_class(violations(s, d)))
PERM = f"""SELECT {LOT.format(k='o_custkey')} AS bbl, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS a, CASE WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') END AS b,
  CASE WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS c, CASE WHEN o_orderkey % 8 < 4 THEN strftime(o_orderdate + INTERVAL 9 DAY, '%Y-%m-%d') END AS d, o_orderkey FROM orders"""


def permits(s, d):
    o = I.table(s, d, "orders")
    k, day = F.col("o_orderkey"), lambda n: F.date_format(F.date_add(F.col("o_orderdate").cast("date"), n), "yyyy-MM-dd")
    return o.select("o_orderkey", lot("o_custkey").alias("bbl"), F.when(k % 4 == 0, day(0)).alias("filing_date"), F.when(k % 4 == 1, day(1)).alias("issuance_date"),
                    F.when(k % 4 == 2, day(0)).alias("pre_filing_date"), F.when(k % 8 < 4, day(9)).alias("latest_action_date"))


query("prj09_effective_date", f"SELECT o_orderkey, coalesce(a, b, c, d) AS dt FROM ({PERM})")(
    lambda s, d: permits(s, d).select("o_orderkey", B.effective_date("filing_date", "issuance_date", "pre_filing_date", "latest_action_date").alias("dt")))
query("agg55_recent_filings", f"SELECT bbl, count(*) AS permits_5y, max(coalesce(a, b, c, d)) AS last_permit_date FROM ({PERM}) WHERE coalesce(a, b, c, d) >= '1996-06-30' GROUP BY 1")(lambda s, d: B.recent_filings(permits(s, d), "2001-06-30"))
TYPES = ["HeadOfficer", "Agent", "IndividualOwner", "CorporateOwner", "SiteManager"]
CONT = f"""SELECT o_custkey AS registrationid, {I.sql_pick('o_orderkey', TYPES)} AS type, CASE WHEN o_orderkey % 3 = 0 THEN ' Holding ' || CAST(o_custkey % 7 AS VARCHAR) || ' llc' WHEN o_orderkey % 3 = 1 THEN '  ' END AS corp,
  CASE WHEN o_orderkey % 11 <> 0 THEN 'Ann' END AS fn, CASE WHEN o_orderkey % 11 <> 0 THEN 'Lee' || CAST(o_custkey % 5 AS VARCHAR) END AS ln, CAST(o_custkey % 9 AS VARCHAR) AS hn, CASE WHEN o_orderkey % 2 = 0 THEN 'Main St' END AS sn FROM orders"""


def contacts(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return I.table(s, d, "orders").select(
        c.alias("registrationid"), I.pick(k, TYPES).alias("type"), F.when(k % 3 == 0, F.concat(F.lit(" Holding "), (c % 7).cast("string"), F.lit(" llc"))).when(k % 3 == 1, "  ").alias("corporationname"),
        F.when(k % 11 != 0, "Ann").alias("firstname"), F.when(k % 11 != 0, F.concat(F.lit("Lee"), (c % 5).cast("string"))).alias("lastname"), (c % 9).cast("string").alias("housenumber"),
        F.when(k % 2 == 0, "Main St").alias("streetname"), F.lit("10001").alias("zip"))


PICK = f"""
WITH asked AS (SELECT * FROM ({CONT}) WHERE list_contains(['HeadOfficer', 'IndividualOwner', 'CorporateOwner'], type)),
named AS (SELECT registrationid, trim(coalesce(corp, '')) AS company, trim(concat_ws(' ', coalesce(fn, ''), coalesce(ln, ''))) AS person, concat(hn, ' ', coalesce(sn, ''), ' 10001') AS place FROM asked),
tidy AS (SELECT registrationid, upper(CASE WHEN company <> '' THEN company ELSE person END) AS owner_name, upper(place) AS place FROM named)
SELECT registrationid, min(owner_name) AS owner_name, min(owner_name) || '|' || arg_min(place, (owner_name, place)) AS owner_key FROM tidy WHERE owner_name <> '' GROUP BY registrationid"""
query("win05_pick_contact", PICK)(lambda s, d: B.pick_contact(contacts(s, d)))


def registrations(s, d):
    return I.table(s, d, "customer").select(F.col("c_custkey").alias("registrationid"), (F.col("c_custkey") % 1201).alias("buildingid"), (F.col("c_custkey") % 6 + 1).cast("string").alias("boroid"), lot("c_custkey").alias("bbl"))


query("agg56_owner_portfolio", f"""WITH p AS ({PICK}), rg AS (SELECT c_custkey AS registrationid, c_custkey % 1201 AS buildingid, {LOT.format(k='c_custkey')} AS bbl FROM customer WHERE c_custkey % 6 + 1 <= 5),
j AS (SELECT * FROM rg JOIN p USING (registrationid)), sz AS (SELECT owner_key, count(DISTINCT buildingid) AS n FROM j GROUP BY 1)
SELECT bbl, min(j.owner_key) AS owner_key, arg_min(owner_name, j.owner_key) AS owner_name, max(n) AS portfolio_buildings FROM j JOIN sz ON sz.owner_key = j.owner_key GROUP BY 1""")(
    lambda s, d: B.owner_portfolio(registrations(s, d), contacts(s, d)))
query("src04_composed_keys", f"SELECT c_custkey, {LOT.format(k='c_custkey')} AS bbl, '36' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || lpad(CAST(c_custkey % 9999 AS VARCHAR), 6, '0') || lpad(CAST(c_custkey % 7 AS VARCHAR), 4, '0') AS geoid15, '36' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || lpad(CAST(c_custkey % 9999 AS VARCHAR), 6, '0') || '0' AS geoid12 FROM customer")(
    lambda s, d: lake.with_geoid(I.table(s, d, "customer").select(
        "c_custkey", lot("c_custkey").alias("bbl"), F.lit("36").alias("state"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("county"),
        F.lpad((F.col("c_custkey") % 9999).cast("string"), 6, "0").alias("tract"), F.lpad((F.col("c_custkey") % 7).cast("string"), 4, "0").alias("block"))).select("c_custkey", "bbl", "geoid15", "geoid12"))

# ------------------------------------------------------------------ cordon counts
LABELS = ["SUBWAY", "Autos, taxis & vans", "BUS (local)", "Suburban RAIL", "Ferry", "Bicycles", "Tramway", "TOTAL", "  subway lines", "Busway"]
VAL = "CAST(l_extendedprice AS BIGINT)"


def mode_rows(s, d):
    li = I.table(s, d, "lineitem")
    v = F.format_string("%,d", F.floor("l_extendedprice").cast("long"))
    v = F.when(F.col("l_partkey") % 10 == 3, "-").otherwise(v)
    return li.select(F.year("l_shipdate").alias("year"), I.pick(F.col("l_suppkey"), LABELS).alias("label"), F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit(""), v, F.lit("1"))).otherwise(F.array(v, F.lit("7"))).alias("cells"))


MODES = "CASE CAST(l_suppkey % 10 AS INT) WHEN 0 THEN 'subway' WHEN 8 THEN 'subway' WHEN 1 THEN 'auto' WHEN 2 THEN 'bus' WHEN 3 THEN 'rail' WHEN 4 THEN 'ferry' WHEN 5 THEN 'bike' WHEN 6 THEN 'tram' END"
ENTER = "CASE WHEN l_partkey % 10 = 3 THEN 0 ELSE CAST(floor(l_extendedprice) AS BIGINT) END"
query("prj17_mode_bucket", f"SELECT {I.sql_pick('l_suppkey', LABELS)} AS label, {MODES} AS mode, count(*) AS n FROM lineitem GROUP BY 1, 2")(
    lambda s, d: mode_rows(s, d).groupBy("label", codes.mode_bucket(F.col("label")).alias("mode")).agg(F.count(F.lit(1)).alias("n")))
query("prj18_first_count", f"SELECT CAST(year(l_shipdate) AS INT) AS year, {ENTER} AS entering, count(*) AS n FROM lineitem GROUP BY 1, 2")(
    lambda s, d: mode_rows(s, d).groupBy("year", codes.first_count(F.col("cells")).alias("entering")).agg(F.count(F.lit(1)).alias("n")))
CORD = f"SELECT CAST(year(l_shipdate) AS INT) AS year, {MODES} AS mode, CAST(sum({ENTER}) AS BIGINT) AS entering FROM lineitem WHERE {MODES} IS NOT NULL GROUP BY 1, 2"
query("agg59_cordon_series", CORD)(lambda s, d: B.cordon_series(mode_rows(s, d)))
MODE_NAMES = ["subway", "auto", "bus", "rail", "ferry", "bike", "tram"]
query("agg59_cordon_wide", "SELECT year, " + ", ".join(f"CAST(sum(CASE WHEN mode = '{m}' THEN entering ELSE 0 END) AS BIGINT) AS {m}" for m in MODE_NAMES) + f", CAST(sum(entering) AS BIGINT) AS total FROM ({CORD}) GROUP BY 1")(
    lambda s, d: B.cordon_wide(B.cordon_series(mode_rows(s, d)), MODE_NAMES))
