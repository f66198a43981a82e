"""The split window, rank and matching steps against plain sequential definitions."""

import html
import html.entities
import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerbline.functions import clock, codes, planar, register_functions
from kerbline.functions.overlap import disc, fan_areas, overlap_area
from kerbline.operators import bunching, places, quality, scores, spatial, supply, trajectory
from kerbline.operators.thinning import thin
from kerbline.sources import lake
from kerbline.plans.ranks import exact_percentiles, with_rank_columns
from kerbline.plans.series import with_neighbour, with_running


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(7)
    rows = []
    for k in ["a", "b", None]:
        ts = sorted(rng.sample(range(0, 40_000), 120))
        rows += [(k, t, i, rng.choice([None, rng.randint(0, 50)])) for i, t in enumerate(ts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [1, 600, 3600, 10**6])
def test_neighbour_equals_lag_and_lead(spark, series, width):
    df = spark.createDataFrame(series, "k string, t long, i int, v int")
    got = with_neighbour(df, ["k"], ["t"], F.floor(F.col("t") / width), prev={"p": "i"}, next={"n": "i"}).collect()
    assert len(got) == len(series)
    for r in got:
        assert r.p == (r.i - 1 if r.i > 0 else None)
        assert r.n == (r.i + 1 if r.i < 119 else None)


@pytest.mark.parametrize("how", ["sum", "max", "last"])
@pytest.mark.parametrize("width", [600, 7200])
def test_running_equals_loop(spark, series, how, width):
    df = spark.createDataFrame(series, "k string, t long, i int, v int")
    got = {(r.k, r.t): r.o for r in with_running(df, ["k"], ["t"], F.floor(F.col("t") / width), "v", "o", how).collect()}
    for k in {r[0] for r in series}:
        acc = None
        for _, t, _, v in sorted((r for r in series if r[0] == k), key=lambda r: r[1]):
            if v is not None:
                acc = v if acc is None or how == "last" else (acc + v if how == "sum" else max(acc, v))
            assert got[(k, t)] == acc


def test_ranks_and_percentiles(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 3000), "v": np.round(rng.exponential(5, 3000), 1)})
    pdf.loc[pdf.k == 0, "v"] = np.where(rng.random((pdf.k == 0).sum()) < 0.5, 2.0, pdf.v[pdf.k == 0])  # one hot value
    df = spark.createDataFrame(pdf)
    ranked = with_rank_columns(df, "v", {"r": F.col("below") + (F.col("n") + 1) / 2}, ["k"]).toPandas()
    want = ranked.groupby("k").v.rank()
    assert np.allclose(ranked.r, want)
    p = exact_percentiles(df, ["k"], "v", {"m": 0.5, "q": 0.9}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert math.isclose(p.m[k], np.percentile(g.v, 50)) and math.isclose(p.q[k], np.percentile(g.v, 90))


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_results_do_not_depend_on_partition_count(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(500).select((F.col("id") % 7).alias("k"), (F.col("id") * 37 % 101).cast("double").alias("v"))
        got = exact_percentiles(df, ["k"], "v", {"m": 0.5}).orderBy("k").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    pdf = pd.DataFrame({"id": range(500)})
    want = (pdf.id * 37 % 101).groupby(pdf.id % 7).median()
    assert [r.m for r in got] == list(want)


def test_monotonic_filter_equals_loop(spark):
    rng = random.Random(5)
    rows = [("t", i * 400, float(rng.randint(0, 3000) + i * 60)) for i in range(80)]
    got = {r.ts: r.keep for r in trajectory.monotonic(spark.createDataFrame(rows, "trip_id string, ts long, offset_ft double")).collect()}
    run = rows[0][2]
    for i, (_, ts, off) in enumerate(rows):
        keep = i == 0 or off >= run - 500
        assert got[ts] == keep
        if keep:
            run = max(run, off)


def test_resample_and_crossing_by_hand(spark):
    pts = spark.createDataFrame([("x", 5, 0.0), ("x", 65, 60.0), ("x", 125, 60.0), ("x", 185, 180.0), ("one", 30, 1.0)], "trip_id string, ts long, offset_mono double")
    g = trajectory.resample(pts, 30)
    assert {r.ts: r.offset_ft for r in g.collect()} == {30: 25.0, 60: 55.0, 90: 60.0, 120: 60.0, 150: 110.0, 180: 170.0}
    stops = spark.createDataFrame([("r", 0, "s0", 25.0), ("r", 0, "s1", 60.0), ("r", 0, "s2", 140.0), ("r", 0, "far", 900.0)], "route_id string, direction_id int, stop_id string, stop_offset_ft double")
    t = g.withColumns({"route_id": F.lit("r"), "direction_id": F.lit(0)})
    got = {r.stop_id: r.arr_ts for r in trajectory.crossings(t, stops, ["route_id", "direction_id"], 50.0).collect()}
    assert got == {"s1": 90, "s2": 165}  # the first sample itself never counts


@pytest.mark.parametrize("gap", [1, 60, 700, 21_600])
def test_thinning_equals_loop(spark, gap):
    rng = random.Random(gap)
    rows = [(k, t) for k in "ab" for t in sorted(rng.sample(range(0, 200_000), 300))]
    got = {(r.k, r.t) for r in thin(spark.createDataFrame(rows, "k string, t long"), "k", "t", gap).collect()}
    want = set()
    for k in "ab":
        last = None
        ts = [t for kk, t in rows if kk == k]
        for t in ts:
            if last is None or t - last >= gap:
                want.add((k, t))
                last = t
        want.add((k, ts[-1]))
    assert got == want


def test_greedy_pairs_equal_loop(spark):
    rng = random.Random(2)
    pairs = [(a, b, round(rng.random() * 100, 3)) for a in range(25) for b in range(a + 1, 25) if rng.random() < 0.4]
    df = spark.createDataFrame([(f"{a:02d}", f"{b:02d}", g) for a, b, g in pairs], "vehicle_id_a string, vehicle_id_b string, gap_m double")
    got = {(r.vehicle_id_a, r.vehicle_id_b) for r in bunching.greedy_pairs(df).collect()}
    used, want = set(), set()
    for g, a, b in sorted((g, f"{a:02d}", f"{b:02d}") for a, b, g in pairs):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    assert got == want


def test_candidate_pairs_at_any_latitude(spark):
    rng = random.Random(5)
    rows = []
    for lat in (0.0, 40.7, 61.0, 75.0, -85.0, 89.999, -89.995):
        for lon in (-73.9, 179.9999, 0.0):
            reach = min(180.0, 0.012 / math.cos(math.radians(lat)))
            spot = [(lat + rng.uniform(-0.006, 0.006), lon + rng.uniform(-reach, reach)) for _ in range(12)]
            rows += [(f"v{len(rows) + i:03d}", "1", 0, max(-90.0, min(90.0, y)), (x + 180) % 360 - 180) for i, (y, x) in enumerate(spot)]

    def metres(a, b):
        y0, x0, y1, x1 = map(math.radians, (a[3], a[4], b[3], b[4]))
        return 2 * 6_371_000 * math.asin(min(1.0, math.sqrt(math.sin((y1 - y0) / 2) ** 2 + math.cos(y0) * math.cos(y1) * math.sin((x1 - x0) / 2) ** 2)))

    df = spark.createDataFrame(rows, "vehicle_id string, route_id string, direction_id int, lat double, lon double")
    headway = spark.createDataFrame([("1", 0, 3600.0)], "route_id string, direction_id int, sched_median_headway_s double")
    got = [(r.vehicle_id_a, r.vehicle_id_b) for r in bunching.candidate_pairs(df, headway).collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and metres(a, b) < bunching.CAP_M}
    assert len(got) == len(set(got)) and set(got) == want
    wide = [(a, b) for a in rows for b in rows if (a[0], b[0]) in want and 2 * bunching.CAP_M / bunching.DEG_M * 2 < abs(a[4] - b[4])]
    assert len(wide) > 10


def test_overlap_closed_forms(spark):
    box = lambda x0, y0, x1, y1: F.array(planar.rectangle(*[F.lit(float(v)) for v in (x0, y0, x1, y1)]))
    d = lambda r: disc(F.lit(0.0), F.lit(0.0), F.lit(float(r)))
    whole = 16 * 100.0**2 * math.sin(2 * math.pi / 32)  # 32-gon in a circle of radius 100
    hole = F.array(planar.rectangle(*[F.lit(float(v)) for v in (-200, -200, 200, 200)]), planar.rectangle(*[F.lit(float(v)) for v in (-10, -10, 10, 10)]))
    # an L shape (concave): the unit square of side 40 without its upper right quarter
    ell = F.array(F.array(*[planar.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (40, 0), (40, 20), (20, 20), (20, 40), (0, 40), (0, 0))]))
    r = spark.range(1).select(
        overlap_area(box(-10, -10, 30, 10), d(100)).alias("inside"), overlap_area(box(-500, -500, 500, 500), d(100)).alias("around"),
        overlap_area(box(0, -500, 500, 500), d(100)).alias("half"), overlap_area(box(200, 200, 300, 300), d(100)).alias("apart"),
        overlap_area(hole, d(100)).alias("hole"), overlap_area(ell, d(100)).alias("ell"), overlap_area(F.lit(None).cast("array<array<struct<x:double,y:double>>>"), d(1)).alias("none")).first()
    assert math.isclose(r.inside, 800) and math.isclose(r.around, whole) and math.isclose(r.half, whole / 2) and r.apart == 0
    assert math.isclose(r.hole, whole - 400) and math.isclose(r.ell, 1200) and r.none is None


def test_overlap_tiles_add_up():
    """Squares that tile a disc share exactly the disc's area."""
    angles = 2 * np.pi * np.arange(32) / 32
    region = np.stack([3.3 + 100 * np.cos(angles), -1.7 + 100 * np.sin(angles)], axis=1)
    p, q, owner = [], [], []
    tiles = [(x, y) for x in range(-120, 120, 30) for y in range(-120, 120, 30)]
    for i, (x, y) in enumerate(tiles):
        c = [(x, y), (x + 30, y), (x + 30, y + 30), (x, y + 30)]
        p += c
        q += c[1:] + c[:1]
        owner += [i] * 4
    areas = fan_areas(np.array(p, float), np.array(q, float), np.array(owner), np.repeat(region[None], len(tiles), axis=0))
    assert math.isclose(areas.sum(), 16 * 1e4 * math.sin(2 * math.pi / 32))


def test_walkshed_keeps_totals(spark):
    """Tiling squares inside a large disc: everything is apportioned once."""
    tiles = [(f"{x}-{y}", x * 50.0, y * 50.0) for x in range(4) for y in range(4)]
    polys = spark.createDataFrame(tiles, "b string, x double, y double").select("b", F.lit(3.0).alias("pop"), F.array(planar.rectangle(F.col("x"), F.col("y"), F.col("x") + 50, F.col("y") + 50)).alias("rings"))
    pts = spark.createDataFrame([("s", 100.0, 100.0), ("off", 9000.0, 9000.0)], "site_id string, sx double, sy double")
    got = {r.site_id: r.pop_walkshed for r in spatial.walkshed(pts, polys, 1000.0, "site_id", "b", ["pop"]).collect()}
    assert math.isclose(got["s"], 48.0) and got["off"] == 0.0


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(-74.0, 40.5), (-73.95, 40.75), (-72.0, 41.0)], "lon double, lat double").withColumn("f", planar.to_feet(F.col("lon"), F.col("lat")))
    for r in df.withColumn("b", planar.to_lonlat(F.col("f.x"), F.col("f.y"))).collect():
        assert abs(r.b.lon - r.lon) < 1e-10 and abs(r.b.lat - r.lat) < 1e-10
    origin = spark.range(1).select(planar.to_feet(F.lit(planar.LCC_LON0), F.lit(planar.LCC_PHI0)).alias("f")).first().f
    assert abs(origin.x - 300_000 / planar.US_FOOT_M) < 1e-6 and abs(origin.y) < 1e-6


def test_radius_count_with_a_hot_spot(spark):
    rng = random.Random(1)
    pts = [(rng.uniform(0, 5000), rng.uniform(0, 5000)) for _ in range(400)] + [(2500.0, 2500.0)] * 200
    sites = [(str(i), rng.uniform(0, 5000), rng.uniform(0, 5000)) for i in range(40)]
    got = {r.site_id: r.n for r in spatial.radius_count(spark.createDataFrame(sites, "site_id string, sx double, sy double"), spark.createDataFrame(pts, "x double, y double"), 900.0).collect()}
    assert got == {s: sum(math.hypot(x - sx, y - sy) <= 900 for x, y in pts) for s, sx, sy in sites}


def test_radius_count_sends_no_spread_sites_to_all_tasks(spark, tmp_path):
    rng = random.Random(3)
    pts = [(rng.gauss(2500, 300), rng.uniform(0, 5000)) for _ in range(3000)] + [(float(x), float(y)) for x in range(2400, 2600, 4) for y in range(2400, 2600, 4)] + [(None, 1.0)]
    sites = [(str(i), rng.uniform(0, 5000), rng.uniform(0, 5000)) for i in range(40)] + [("edge", 2400.0 - 900, 2400.0), ("off", None, 1.0)]
    spark.createDataFrame(sites, "site_id string, sx double, sy double").write.parquet(f"{tmp_path}/sites")
    spark.createDataFrame(pts, "x double, y double").write.parquet(f"{tmp_path}/points")
    df = spatial.radius_count(spark.read.parquet(f"{tmp_path}/sites"), spark.read.parquet(f"{tmp_path}/points"), 900.0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin [cx" in line]  # the table of sites is small, spread over cells it isn't
    got = {r.site_id: r.n for r in df.collect()}
    assert got == {s: 0 if sx is None else sum(math.hypot(x - sx, y - sy) <= 900 for x, y in pts if x is not None) for s, sx, sy in sites}


def test_trailing_mean_and_fill(spark):
    ev = spark.createDataFrame([(0, 10.0), (301, 20.0), (3600, 60.0)], "t long, v double")
    got = {r.bin_local: (r.trailing_mean, r.n_trailing) for r in quality.trailing_mean(ev, "t", "v").collect()}
    assert got[0] == (10.0, 1) and got[600] == (15.0, 2) and got[3600] == (40.0, 2) and got[3900] == (40.0, 2) and got[4200] == (60.0, 1)
    f = quality.ffill(spark.createDataFrame([(0, None), (300, 4), (600, None)], "bin_local long, v int"), "v")
    assert {r.bin_local: (r.v, r.v_stale) for r in f.collect()} == {0: (None, 1), 300: (4, 0), 600: (4, 1)}


def test_minmax_constant_is_fifty(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0), (3, None)], "i int, v double")
    assert [r.o for r in scores.minmax(df, "v", "o").orderBy("i").collect()] == [50.0, 50.0, None]


def test_advance_distance(spark):
    r = spark.range(1).select(*[trajectory.advance_ft(F.lit(10.0), F.lit(float(t))).alias(f"t{t}") for t in (0, 30, 40, 85, 500)]).first()
    assert (r.t0, r.t30, r.t40, r.t85, r.t500) == (0.0, 300.0, 400.0, 625.0, 625.0)


def test_clock_and_text(spark):
    assert [r.s for r in spark.createDataFrame([("25:00:01",), (" 7:05:09 ",), ("7:05",), ("",), (None,)], "t string").select(clock.gtfs_seconds(F.col("t")).alias("s")).collect()] == [90001, 25509, None, None, None]
    w = spark.createDataFrame([(43201,), (-43200,), (43200,), (-86000,)], "d long").select(clock.wrap_half_day(F.col("d")).alias("w")).collect()
    assert [r.w for r in w] == [-43199, 43200, 43200, 400]
    raw = ["a &amp; b", "&#x41;&#66;", "x&nbsp;y", None, "&lt;i&gt;"]
    got = [r.c for r in spark.createDataFrame([(t,) for t in raw], "t string").select(codes.clean_text(F.col("t")).alias("c")).collect()]
    assert got == [html.unescape(t or "") for t in raw]
    assert places.parse_bbox("1,2,3") is None and places.parse_bbox("1,2,3,x") is None and places.parse_bbox("1,2,3,4") == (1, 2, 3, 4)


def test_schedule_clock_names_its_text_once(spark):
    """A filter on the seconds is pushed to where the text is made, and makes it anew for every time it is named."""
    texts = ["25:00:01", " 7:05:09 ", "7:05", "1:2:3:4", "a:00:00", "99999999999:00:00", "00:00:00", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "raw string").select(clock.gtfs_seconds(F.concat("raw", F.lit(""))).alias("s"))
    assert [r.s for r in df.collect()] == [90001, 25509, None, None, None, None, 0, None, None]
    assert dict(df.dtypes) == {"s": "int"}
    assert df._jdf.queryExecution().analyzed().toString().count("concat(raw") == 1


def test_scheduled_series_keeps_trips_with_two_points(spark):
    st = spark.createDataFrame([("a", "x", 100), ("a", "y", 200), ("b", "x", 100), ("b", "y", 900), ("c", "x", 100), ("c", "z", 200)], "trip_id string, stop_id string, sched_arr_sec int")
    trips = spark.createDataFrame([(t, "r", 0, "s", "p") for t in "abc"], "trip_id string, route_id string, direction_id int, service_id string, shape_id string")
    offsets = spark.createDataFrame([("p", "x", 1.0), ("p", "y", 2.0)], "shape_id string, stop_id string, stop_offset_ft double")
    got = supply.scheduled_series(trips, st, offsets, spark.createDataFrame([("s",)], "service_id string"), 50, 300).collect()
    assert sorted(tuple(r) for r in got) == [("a", "r", 0, 100, 1.0), ("a", "r", 0, 200, 2.0)]


def test_scheduled_cells_of_many_service_sets(spark):
    """More sets of services than one number has bits, seconds shared by services, unreadable times, places without names."""
    gen = random.Random(4)
    services = [(f"day{d:03}", f"s{k}") for d in range(80) for k in range(8) if d >> k & 1 or k == 7]
    trips = [(f"t{i}", gen.choice(["r", None]), i % 2, f"s{gen.randrange(8)}") for i in range(120)]
    st = [(t[0], gen.choice("xy"), gen.choice([None, gen.randrange(20, 60) * 300 + 86_400 * (i % 5 == 0)])) for i, t in enumerate(trips * 3)]
    got = supply.scheduled_headway_cells(
        spark.createDataFrame(st, "trip_id string, stop_id string, sched_arr_sec int"), spark.createDataFrame(trips, "trip_id string, route_id string, direction_id int, service_id string"),
        spark.createDataFrame(services, "day string, service_id string"))
    of, want = {t[0]: t for t in trips}, {}
    for day in {d for d, _ in services}:
        runs, secs = {s for d, s in services if d == day}, {}
        for t, stop, sec in st:
            if sec is not None and of[t][3] in runs:
                secs.setdefault((day, of[t][1], of[t][2], stop), set()).add(sec)
        for place, s in secs.items():
            s = sorted(s)
            for a, b in zip(s, s[1:]):
                if b - a <= 7200:
                    want.setdefault((*place, b // 3600 % 24), []).append(b - a)
    assert got.dtypes[-3:] == [("local_hour", "int"), ("sched_median_headway_s", "double"), ("sched_n", "bigint")]
    rows = got.collect()
    assert {tuple(r)[:5]: (r[5], r[6]) for r in rows} == {k: (statistics.median(v), len(v)) for k, v in want.items()} and len(rows) == len(want) > 1000
    plan = supply.scheduled_headway_cells(
        spark.createDataFrame(st, "trip_id string, stop_id string, sched_arr_sec int"), spark.createDataFrame(trips, "trip_id string, route_id string, direction_id int, service_id string"),
        spark.createDataFrame(services, "day string, service_id string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" not in plan and "isnotnull(sched_arr_sec" not in plan.split("Aggregate")[-1]


def test_sql_functions(spark):
    assert "gtfs_seconds" in register_functions(spark)
    r = spark.sql("SELECT gtfs_seconds('24:10:00') a, route_norm('bx12-SBS') b, bbl('1','23','4') c, wrap_half_day(50000) d, round(haversine_m(0, 0, 0, 1)) e").first()
    assert (r.a, r.b, r.c, r.d, r.e) == (87000, "BX12", "1000230004", -36400, 111195.0)


def test_nearest_sets_missing_coordinates_aside(spark):
    nan = float("nan")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, nan, 1.0), (4, 5000.0, 5000.0), (5, 1.0, None)], "point_id long, x double, y double")
    sites = spark.createDataFrame([("a", 3.0, 4.0), ("b", -3.0, -4.0), ("z", None, 0.0), ("y", nan, nan), ("c", 90000.0, 5000.0)], "site_id string, sx double, sy double")
    got = {r.point_id: (r.site_id, r.dist_ft) for r in spatial.nearest(points, sites, "point_id", "x", "y", 1.0).collect()}
    assert got[1] == ("a", 5.0) and got[4][0] == "a"
    assert got[2] == got[3] == got[5] == (None, None)
    assert {r.site_id for r in spatial.nearest(points, sites.where("site_id = 'z'"), "point_id", "x", "y").collect()} == {None}


def test_nearest_published_line_and_agreement(spark):
    lines = [(1, 0.0, 0.0, 100.0, 0.0, None), (2, 0.0, 4.0, 100.0, 4.0, 10.0), (3, 0.0, -4.0, 100.0, -4.0, 12.0), (4, 500.0, 0.0, 500.0, 900.0, 30.0)]
    lines = spark.createDataFrame(lines, "street_id long, x0 double, y0 double, x1 double, y1 double, published double")
    points = [("tie", 50.0, 0.0, 5.0)] + [(f"spot{i}", 490.0, 450.0, float(i)) for i in range(40)] + [("far", 300.0, 300.0, 1.0), ("end", 103.0, 8.0, 9.0), ("none", None, 1.0, 2.0)]
    points = spark.createDataFrame(points, "id string, x double, y double, w double")
    found = spatial.match_nearest_line(points, lines, 25.0, "id")
    got = {r.id: (r.street_id, r.dist_ft, r.published) for r in found.collect()}
    assert len(got) == 42 and got["tie"] == (2, 4.0, 10.0) and got["end"] == (2, 5.0, 10.0) and got["spot7"] == (4, 10.0, 30.0)
    (row,) = scores.width_agreement(found, "w", "published", "dist_ft").collect()
    w, p = zip(*[(r.w, r.published) for r in found.collect()])
    assert row.n_matched == 42 and row.median_dist_ft == 10.0 and row.median_published_ft == 30.0 and abs(row.pearson - statistics.correlation(w, p)) < 1e-9
    assert abs(row.spearman - statistics.correlation(w, p, method="ranked")) < 1e-9
    few = scores.width_agreement(found.where("published < 20"), "w", "published", "dist_ft").first()
    assert (few.n_matched, few.pearson, few.spearman, few.median_measured_ft) == (2, None, None, 7.0)
    none = scores.width_agreement(found.where("false"), "w", "published", "dist_ft").first()
    assert none.n_matched == 0 and none.median_dist_ft is None


def test_stop_base_by_feed(spark):
    times = spark.createDataFrame([("a", "t1", "s"), ("a", "t1", "s"), ("a", "t2", "s"), ("b", "t1", "s"), ("b", "t9", "s")], "feed string, trip_id string, stop_id string")
    trips = spark.createDataFrame([("a", "t1", "R2", 0), ("a", "t2", "R1", 1), ("b", "t1", "R7", 0)], "feed string, trip_id string, route_id string, direction_id int")
    got = {r.feed: (r.stop_id, r.n_routes, r.routes, r.any_flag) for r in supply.stop_base(times, trips, F.col("direction_id") == 1).collect()}
    assert got == {"a": ("s", 2, "R1, R2", True), "b": ("s", 1, "R7", False)}


def test_profiles_keep_locations_far_from_filled_cells(spark):
    points = spark.createDataFrame([("own", 5.0, 5.0), ("near", 25.0, 5.0), ("far", 500.0, 500.0), ("nowhere", None, 1.0)], "site string, x double, y double")
    grid = spark.createDataFrame([(0, 0, 7, True), (0, 1, 9, False)], "cx long, cy long, n long, flood boolean")
    found = scores.profiles(points, grid, "site", 10.0)
    assert found.columns == ["site", "cx", "cy", "ring", "n", "flood"]
    empty = (None,) * 5
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == {"own": (0, 0, 0, 7, True), "near": (0, 0, 2, 7, True), "far": empty, "nowhere": empty}
    pairs = spark.createDataFrame([("own", "far"), ("far", "near"), ("near", "own")], "a_id string, b_id string")
    got = {(r.a_id, r.b_id): (r.a_n, r.b_n, r.diff_n) for r in scores.compare(found, pairs, "site", ["n"]).collect()}
    assert got == {("own", "far"): (7, None, None), ("far", "near"): (None, 7, None), ("near", "own"): (7, 7, 0)}


def test_running_values_shuffle_the_rows_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(2000).select((F.col("id") % 7).alias("k"), F.col("id").alias("t"), (F.col("id") * 31 % 97).alias("v"))
        out = with_running(df, ["k"], ["t"], F.floor(F.col("t") / 100), "v", "run")
        plan = out._jdf.queryExecution().executedPlan().toString()
        # the rows (in both branches, run once), the chunk totals by key, and the totals for the join
        assert plan.count("Exchange hashpartitioning") <= 4
        rows = sorted((r.k, r.t, r.v, r.run) for r in out.collect())
        total = {}
        for k, _, v, run in rows:
            total[k] = total.get(k, 0) + v
            assert run == total[k]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shared_folder_is_asked_for_on_a_cluster():
    from kerbline.session import shared_dir

    class Conf:
        def __init__(self, **kw):
            self.kw = {k.replace("_", "."): v for k, v in kw.items()}

        def get(self, key, default=None):
            return self.kw.get(key, default)

    class Session:
        def __init__(self, **kw):
            self.conf = Conf(**kw)

    assert shared_dir(Session(spark_master="yarn", spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(ValueError):
        shared_dir(Session(spark_master="yarn"))
    with pytest.raises(ValueError):
        shared_dir(Session(spark_master="local-cluster[2,1,1024]"))


def test_line_location_against_all_segments(spark):
    """A winding shape that crosses itself, one of two vertices and one of a single one; points on it, far off, without coordinates."""
    rnd = random.Random(4)
    path, x, y = [], 0.0, 0.0
    for i in range(400):
        path.append(("w", i, x, y))
        x, y = x + 60 + 80 * math.cos(i / 9) + rnd.uniform(-30, 30), y + 80 * math.sin(i / 7)
    shapes = path + [("v", 0, 0.0, 0.0), ("v", 1, 5000.0, 0.0), ("single", 0, 1.0, 1.0), ("same", 0, 2.0, 2.0), ("same", 1, 2.0, 2.0)]
    pts = [(i, "w", p[2] + rnd.gauss(0, 60), p[3] + rnd.gauss(0, 60)) for i, p in enumerate(path)]
    pts += [(1000 + i, ("w", "v", "same")[i % 3], rnd.uniform(-9e4, 9e4), rnd.uniform(-9e4, 9e4)) for i in range(180)]
    pts += [(5000, "w", None, 1.0), (5001, "single", 0.0, 0.0), (5002, "none", 0.0, 0.0), (5003, None, 0.0, 0.0), (5004, "v", 300.0, 600.0), (5005, "v", 0.0, -300.0)]
    lines = spatial.shape_lines(spark.createDataFrame(shapes, "shape_id string, seq long, x_ft double, y_ft double"))
    got = spatial.line_locate(spark.createDataFrame(pts, "id long, shape_id string, x_ft double, y_ft double"), lines)
    by_shape = {}
    for s, _, x, y in shapes:
        by_shape.setdefault(s, []).append((x, y))

    def by_hand(s, x, y):
        best, run = None, 0.0
        for (ax, ay), (bx, by) in zip(by_shape[s], by_shape[s][1:]):
            n = math.hypot(bx - ax, by - ay)
            u = min(1.0, max(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n**2)) if n else 0.0
            best = min(filter(None, (best, (math.hypot(x - ax - u * (bx - ax), y - ay - u * (by - ay)), run + u * n))))
            run += n
        return best

    rows = {r.id: r for r in got.collect()}
    assert set(rows) == {i for i, s, _, _ in pts if s in ("w", "v", "same")}
    assert rows[5000].offset_ft is None and rows[5000].perp_ft is None
    for i, s, x, y in pts:
        if i in rows and x is not None:
            perp, off = by_hand(s, x, y)
            assert abs(rows[i].perp_ft - perp) < 1e-6 and abs(rows[i].offset_ft - off) < 1e-5, (i, s)
    segs = spatial.segment_index(got.select("shape_id", (F.floor(F.col("x_ft") / 300)).alias("cx"), F.floor(F.col("y_ft") / 300).alias("cy")).where("cx is not null").distinct(), lines, 300.0)
    near = segs.where("shape_id = 'w' and cx between 0 and 80 and abs(cy) < 5").agg(F.avg(F.size("segs"))).first()[0]
    assert 1 <= near < 40  # of 399


def test_entities_against_the_standard_library(spark):
    rnd = random.Random(8)
    words = ["&", "&amp", ";", "amp;", "#", "&#", "&#x", "&#0", "&#X", "41", "e9", "128", "159", "129", "1114112", "99999999999", "xD800", "&not", "it;", "in;", "&notin", "&NotEqualTilde;", "&lt", "&LT;", "&eacute", "&bne;", " ", "<", "x", "é", "\n",
             "&#13", "&#11", "&#xfffe;", "&#x1F600;", "&#65533;", "&Aacute", "&CounterClockwiseContourIntegral;", "&nosuch;", "&#xFDD0;", "&#00000000000065;", "&#127"]
    raw = ["".join(rnd.choice(words) for _ in range(rnd.randint(1, 9))) for _ in range(3000)] + ["&" + k for k in html.entities.html5] + [f"&#{i};" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(raw)), "i long, t string")
    got = {r.i: r.c for r in df.select("i", codes.clean_text(F.col("t")).alias("c")).collect()}
    wrong = [(t, got[i], html.unescape(t)) for i, t in enumerate(raw) if got[i] != html.unescape(t)]
    assert not wrong, wrong[:5]


def test_days_change_with_their_files(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = spark.range(60).selectExpr("id", "concat('2024-01-0', id % 5 + 1) AS date")
    rows.where("id % 5 < 4").repartition(3).write.partitionBy("date").parquet(path)
    state = spark.createDataFrame(lake.day_signatures(lake.day_files(spark, path)).toPandas())
    assert lake.changed_days(lake.day_files(spark, path), state).collect() == []
    rows.where("id % 5 = 1").coalesce(1).write.mode("append").partitionBy("date").parquet(path)
    rows.where("id % 5 = 2").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    rows.where("id % 5 = 4").write.mode("append").partitionBy("date").parquet(path)
    assert {str(r.day) for r in lake.changed_days(lake.day_files(spark, path), state).collect()} == {"2024-01-02", "2024-01-03", "2024-01-05"}


def test_rows_are_counted_while_written(spark, tmp_path):
    full, none = str(tmp_path / "full"), str(tmp_path / "none")
    made = {"full": (True, lake.write_counted(spark.range(1000).repartition(7), full)), "none": (True, lake.write_counted(spark.range(0), none))}
    assert made == {"full": (True, 1000), "none": (True, 0)}
    spark.range(3).write.mode("append").parquet(full)
    counts = lake.row_counts(spark, {"full": full, "none": none, "unknown": full}, made)
    assert {tuple(r) for r in counts.collect()} == {("full", True, 1000, 1003), ("none", True, 0, 0), ("unknown", False, None, 1003)}
    crs = lake.crs_counts({"a": spark.createDataFrame([("x",), ("x",)], "geometry_crs string"), "b": spark.createDataFrame([("x",), ("y",)], "geometry_crs string")})
    empty = spark.createDataFrame([], "name string, rows long, matched long"), spark.createDataFrame([], "name string, sampled long, invalid long")
    got = {(r.check, r.name): r.status for r in lake.doctor(counts, crs, *empty).collect()}
    assert got == {("ROWCOUNTS", "full"): "FAIL", ("ROWCOUNTS", "none"): "PASS", ("ROWCOUNTS", "unknown"): "INFO", ("VIEWS", "full"): "PASS", ("VIEWS", "none"): "FAIL",
                   ("VIEWS", "unknown"): "PASS", ("CRS", "a"): "PASS", ("CRS", "b"): "FAIL"}


def test_dealt_bounds_a_task_whatever_the_size(spark, monkeypatch):
    from kerbline.plans import spread

    monkeypatch.setattr(spread, "TASK_ROWS", 100)
    df = spark.range(4000).selectExpr("cast(id % 1000 as string) AS k", "id")
    got = spread.dealt(df, "k")
    assert got.rdd.getNumPartitions() == 40
    sizes = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("k")).collect()
    assert max(r.n for r in sizes) < 300 and sum(r.k for r in sizes) == 1000
    assert spread.dealt(df.limit(50), "k").count() == 50 and spread.dealt(df.limit(0), "k").count() == 0


def test_predecessors_are_dealt_by_rows_not_by_session(spark, monkeypatch):
    """The tasks of the votes grow in number with the trips; the result is that of a plain loop."""
    from kerbline.operators import supply as S
    from kerbline.plans import spread

    gen, rows, by_trip = random.Random(4), [], {}
    for t in range(300):
        by_trip[f"t{t}"] = [f"s{gen.randrange(6)}" for _ in range(gen.randrange(1, 6))]
        rows += [(f"t{t}", s, 600 * i) for i, s in enumerate(by_trip[f"t{t}"])]
    st = spark.createDataFrame(rows, "trip_id string, stop_id string, stop_seq long")
    trips = spark.createDataFrame([(t, f"r{int(t[1:]) % 3}") for t in by_trip], "trip_id string, route_id string")
    votes = {}
    for t, stops in by_trip.items():
        for i, s in enumerate(stops):
            pred = stops[i - 1] if i else stops[1] if len(stops) > 1 else None
            if pred is not None:
                tally = votes.setdefault((f"r{int(t[1:]) % 3}", s), {})
                tally[(i > 0, pred)] = tally.get((i > 0, pred), 0) + 1
    want = set()
    for key, tally in votes.items():
        (inner, pred), n = min(tally.items(), key=lambda x: (not x[0][0], -x[1], x[0][1]))
        want.add((*key, pred, inner, n))
    monkeypatch.setattr(spread, "TASK_ROWS", 50)
    got = S.canonical_predecessor(st, trips)
    assert {(r.route_id, r.stop_id, r.pred, r.inner, r.n) for r in got.collect()} == want
    assert "hashpartitioning(route_id" in got._jdf.queryExecution().executedPlan().toString() and got.rdd.getNumPartitions() == 48


def test_versions_join_stop_times_and_trips_once(spark, monkeypatch):
    from kerbline.operators import gtfsdiff

    t = spark.createDataFrame([(f"t{i}", "r", i % 2, "wk", "s") for i in range(40)], "trip_id string, route_id string, direction_id int, service_id string, shape_id string")
    days = ", ".join(f"{d} string" for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"))
    same = {"trips": t, "routes": spark.createDataFrame([("r", "M1")], "route_id string, route_short_name string"),
            "stops": spark.createDataFrame([("x", "X", 40.0, -74.0)], "stop_id string, stop_name string, lat double, lon double"),
            "calendar": spark.createDataFrame([("wk", *"1111100")], f"service_id string, {days}"),
            "calendar_dates": spark.createDataFrame([], "service_id string, date string, exception_type string")}
    st = lambda gap: spark.createDataFrame([(f"t{i}", "x", 1, 30_000 + gap * i) for i in range(40)], "trip_id string, stop_id string, stop_sequence long, sched_sec int")
    joined, of_trips = [], supply.of_trips
    monkeypatch.setattr(supply, "of_trips", lambda *a: joined.append(1) or of_trips(*a))
    a, b = gtfsdiff.prepared({**same, "stop_times": st(60)}), gtfsdiff.prepared({**same, "stop_times": st(120)})
    both = gtfsdiff.gtfs_diff(a, b, "f", "1", "2").unionByName(gtfsdiff.gtfs_diff(b, a, "f", "2", "3"))
    got = {(r.from_ts, r.change_type, r.magnitude) for r in both.collect()}
    assert {(f, c, m) for f, c, m in got if c == "headway_delta"} == {("1", "headway_delta", 100.0), ("2", "headway_delta", -50.0)}
    assert ("1", "service_span_change", 39.0) in got and len(joined) == 2
