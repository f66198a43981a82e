"""Dense places: what meets stays bounded, and results equal plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SMALL
from kerbline.functions import planar
from kerbline.functions.overlap import disc, overlap_area
from kerbline.operators import bunching, observatory, spatial
from kerbline.plans import proximity


@pytest.fixture
def met(monkeypatch):
    """Rows that go through the named functions, counted."""
    seen = {}

    def watch(module, name, result=False):
        f = getattr(module, name)

        def counted(*a, **k):
            out = f(*a, **k)
            seen[name] = seen.get(name, 0) + (out if result else a[0]).count()
            return out

        monkeypatch.setattr(module, name, counted)
        return seen

    return watch


def _points(n, seed, side=100.0):
    rng = random.Random(seed)
    return [(i, rng.random() * side, rng.random() * side) for i in range(n)]


def test_nearest_among_dense_sites(spark, met):
    sites, pts = _points(600, 1), [*_points(80, 2), (999, 4000.0, 50.0)]
    seen = met(spatial, "point_pairs_within", result=True)
    got = spatial.nearest(spark.createDataFrame(pts, "point_id long, x double, y double"), spark.createDataFrame(sites, "site_id long, sx double, sy double"), "point_id", "x", "y", 1000.0)
    for r in got.collect():
        assert (round(r.dist_ft, 9), r.site_id) == min((round(math.hypot(r.x - x, r.y - y), 9), i) for i, x, y in sites)
    assert seen["point_pairs_within"] < 80 * 600 / 4


def test_k_nearest_among_dense_items(spark, met):
    items, queries = [*_points(900, 3), *[(10_000 + i, 500.0, 500.0) for i in range(40)]], [*_points(60, 4), (998, 505.0, 500.0), (999, 9000.0, 0.0)]
    seen = met(spatial, "point_pairs_within", result=True)
    q = spark.createDataFrame([*queries, (None, 50.0, 50.0)], "q long, qx double, qy double")
    got = spatial.k_nearest_within(q, spark.createDataFrame(items, "i long, x double, y double"), 150.0, 5, "q", "i").collect()
    for k, qx, qy in [*queries, (None, 50.0, 50.0)]:
        near = sorted((round(math.hypot(qx - x, qy - y), 9), i) for i, x, y in items)
        want = [(d, i) for d, i in near if d <= 150.0][:5]
        assert sorted((round(r.dist_ft, 9), r.i) for r in got if r.q == k) == want
    assert seen["point_pairs_within"] < 60 * 900 / 4


def test_pairs_of_points_by_smaller_cells(spark):
    a, b = _points(150, 5), _points(150, 6)
    left, right = spark.createDataFrame(a, "i long, x0 double, y0 double"), spark.createDataFrame(b, "k long, x double, y double")
    want = {(i, k) for i, x, y in a for k, u, v in b if math.hypot(x - u, y - v) <= 9.0}
    for split in (1, 2, 3):
        found = proximity.point_pairs_within(left, right, "x0", "y0", "x", "y", 9.0, split=split)
        assert {(r.i, r.k) for r in found.collect()} == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan  # small by the planner's sizes, large once spread over cells


def _squares(spark, rows):
    c = spark.createDataFrame(rows, "b string, x double, y double, w double, pop long")
    return c.select("b", "pop", F.array(planar.rectangle(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("w"))).alias("rings"))


def test_walkshed_equals_all_pairs(spark, met):
    rng = random.Random(8)
    rows = [(f"b{i}", rng.random() * 3000, rng.random() * 3000, rng.choice([40.0, 90.0, 300.0, 1500.0] if i % 20 == 0 else [40.0, 90.0]), rng.choice([None, 1, 7, 20])) for i in range(900)]
    polys, r = _squares(spark, rows + rows[:50]), 1000.0
    sites = spark.createDataFrame([("m", 1500.0, 1500.0), ("c", 0.0, 0.0), ("off", 9000.0, 0.0)], "site_id string, sx double, sy double")
    area = F.array_max(F.transform("rings", planar.ring_signed_area))
    pairs = sites.crossJoin(polys).withColumn("a", overlap_area(F.col("rings"), disc(F.col("sx"), F.col("sy"), F.lit(r))))
    want = {x.site_id: x.v for x in pairs.groupBy("site_id").agg(F.sum(F.col("pop") * F.col("a") / F.abs(area)).alias("v")).collect()}
    seen = met(spatial, "_disc_shares")
    got = {x.site_id: x.pop_walkshed for x in spatial.walkshed(sites, polys, r, "site_id", "b", ["pop"]).collect()}
    assert all(math.isclose(got[s], want[s], rel_tol=1e-6, abs_tol=1e-6) for s in ("m", "c", "off")), (got, want)
    assert seen["_disc_shares"] < 400  # some 450 squares lie in or at the discs; those well inside are summed by cell


def test_outlines_of_many_polygons_are_cut_once(spark, met):
    """30 blocks, strips and streets in each of a few places: geometry sees each place once, sums count every row."""
    blocks = _squares(spark, [(f"{k}-{i}", k * 100.0, 0.0, 80.0, 1) for k in range(4) for i in range(30)]).withColumnRenamed("b", "block_id")
    strips = _squares(spark, [(f"{k}-{i}", k * 100.0 + 60.0, 10.0, 40.0, 1) for k in range(4) for i in range(30)]).withColumnRenamed("b", "poly_id")
    seen = met(spatial, "_spread")
    got = spatial.block_provision(blocks, strips, "block_id", "poly_id").collect()
    assert len(got) == 120 and {r.sidewalk_area_sqft for r in got} == {30 * 20.0 * 40.0}
    streets = spark.createDataFrame([(f"{k}-{i}", k * 100.0, 0.0, k * 100.0 + 80.0, 0.0, "20") for k in range(4) for i in range(30)], "street_id string, x0 double, y0 double, x1 double, y1 double, width_text string")
    got = spatial.coverage_class(streets.unionByName(streets.where("street_id = '0-0'")), strips, "street_id", "poly_id").collect()
    area = {r.street_id: r.sidewalk_area_sqft for r in got}
    assert len(got) == 121 and area["0-0"] == 2 * area["0-1"] and {r.coverage_class for r in got} == {"one_side"}
    found = spatial.overlap_with_discs(spark.createDataFrame([("s", 100.0, 20.0)], "site_id string, sx double, sy double"), blocks, 60.0, "site_id", "block_id").collect()
    assert len(found) == 60 and {r.block_id.split("-")[0] for r in found} == {"0", "1"} and len({r.overlap_sqft for r in found}) == 2
    assert seen["_spread"] < 60


def test_discs_meet_outlines_by_number_and_tell_pairs_last(spark, monkeypatch):
    rng = random.Random(21)
    rows = [(f"b{i}", rng.randrange(30) * 100.0, rng.randrange(30) * 100.0, rng.choice([40.0, 90.0, 90.0, 90.0, 700.0]), 1) for i in range(500)]
    polys = _squares(spark, [*rows, *rows[:40], (None, 0.0, 0.0, 40.0, 1), ("none", None, 0.0, 40.0, 1)])
    sites = spark.createDataFrame([("m", 1500.0, 1500.0), ("m", 1500.0, 1500.0), ("c", 0.0, 0.0), ("off", 90_000.0, 0.0), ("null", None, 0.0)], "site_id string, sx double, sy double")
    known = polys.where("rings[0][0].x is not null")
    pairs = sites.where("sx is not null").crossJoin(known).withColumn("a", F.round(overlap_area(F.col("rings"), disc(F.col("sx"), F.col("sy"), F.lit(1000.0))), 2))
    want = sorted((x.site_id, str(x.b), x.a) for x in pairs.where("a > 0").collect())
    spread = []
    monkeypatch.setattr(spatial, "_spread", lambda df, *cols, f=spatial._spread: spread.append(df) or f(df, *cols))
    found = spatial.overlap_with_discs(sites, polys, 1000.0, "site_id", "b", digits=2)
    got = sorted((x.site_id, str(x.b), x.overlap_sqft) for x in found.collect())
    assert [x[:2] for x in got] == [x[:2] for x in want] and all(math.isclose(g[2], w[2], abs_tol=0.011) for g, w in zip(got, want)) and len(want) > 300
    # what is dealt to tasks holds the rings of outlines at the rim only, and no row for outlines outside
    held = [r.rings for r in spread[0].select("rings").collect()]
    assert sum(r is not None for r in held) < len(held) / 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("round(overlap_sqft")  # rounded before pairs are told


def test_segments_of_one_line_meet_points_once(spark):
    segs = spark.createDataFrame([(i, 0.0, 0.0, 400.0, 0.0) for i in range(30)] + [(30, 5000.0, 0.0, 5400.0, 0.0), (31, None, 0.0, 1.0, 0.0)], "street_id long, x0 double, y0 double, x1 double, y1 double")
    pts = spark.createDataFrame([(float(x), 50.0) for x in range(0, 400, 4)] + [(10.0, 150.0)], "x double, y double")
    found = spatial.near_segment_count(segs, pts, 100.0, "street_id")
    assert {(r.street_id, r.n_points) for r in found.collect()} == {*((i, 100) for i in range(30)), (30, 0), (31, 0)}
    assert "Broadcast" not in spatial.near_segment_count(segs, pts, 100.0, "street_id").select("n_points")._jdf.queryExecution().optimizedPlan().toString()


def test_lines_to_match_are_not_sent_to_all_tasks(spark):
    lines = spark.createDataFrame([(i, 0.0, 0.0, 100.0, 0.0, float(i)) for i in range(1, 40)], "street_id long, x0 double, y0 double, x1 double, y1 double, published double")
    points = spark.createDataFrame([(1, 50.0, 4.0), (2, 50.0, 4.0), (3, 900.0, 0.0)], "id long, x double, y double")
    found = spatial.match_nearest_line(points, lines, 25.0, "id")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.street_id, r.published) for r in found.collect()} == {(1, 1, 1.0), (2, 1, 1.0)}


def test_bunching_among_crowded_vehicles(spark, met):
    rng = random.Random(11)
    rows = [(f"{i:03d}", "r", i % 2, 40.6 + rng.randint(0, 300) * 1e-5, -74.0 + rng.randint(0, 3) * 1e-4) for i in range(260)]
    rows += [("none", "r", 0, None, -74.0), (None, "r", 0, 40.6, -74.0)]
    v = spark.createDataFrame(rows, "vehicle_id string, route_id string, direction_id int, lat double, lon double")
    headway = spark.createDataFrame([("r", 0, 300.0), ("r", 1, None)], "route_id string, direction_id int, sched_median_headway_s double")
    every = sorted((r.gap_m, r.vehicle_id_a, r.vehicle_id_b) for r in bunching.candidate_pairs(v, headway).collect())
    used, want = set(), set()
    for _, a, b in every:
        if not {a, b} & used:
            used |= {a, b}
            want.add((a, b))
    seen = met(bunching, "greedy_pairs")
    got = [(r.vehicle_id_a, r.vehicle_id_b) for r in bunching.bunching_pairs(v, headway).collect()]
    assert set(got) == want and len(got) == len(want)
    assert seen["greedy_pairs"] < len(every) / 4


def test_delay_looks_distinct_seconds_up(spark):
    """Many trips at the same seconds: as many schedule points meet as there are seconds."""
    keys = "route_id string, direction_id int"
    points = spark.createDataFrame([("r", 0, f"t{i}", 10_000, 600.0) for i in range(50)] + [("r", 0, "two", 10_000, 600.0), ("r", 0, "two", 10_000, 2600.0)], f"{keys}, trip_id string, ts long, offset_ft double")
    sched = spark.createDataFrame([("r", 0, t, o) for t, o in ((9_400, 500.0), (10_900, 500.0), (10_060, 2500.0)) for _ in range(50)], f"{keys}, ts long, offset_ft double")
    stops = spark.createDataFrame([("r", 0, "a", 500.0), ("r", 0, "b", 2500.0)], f"{keys}, stop_id string, stop_offset_ft double")
    got = observatory.delay_vs_schedule(points, sched, stops)
    assert {(r.trip_id, r.offset_ft, r.nearest_stop, r.delay_min) for r in got.collect()} == {*((f"t{i}", 600.0, "a", 10) for i in range(50)), ("two", 600.0, "a", -1), ("two", 2600.0, "b", -1)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") >= 5  # distinct points, distinct schedule, per place, per trip, stops


def test_changed_days_tell_their_signature(spark):
    got = entry.queries()["src17_changed_days"](spark, SMALL)
    assert got.columns == ["day", "n_files", "max_mtime"] and all(r.day % 3 and r.n_files > 0 for r in got.collect())
