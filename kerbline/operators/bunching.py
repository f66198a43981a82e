"""Live bunching: vehicles of one route and direction too close to each other."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.functions.planar import haversine_m
from kerbline.plans.series import null_safe_join
from kerbline.session import materialize

# Spacing rules.
PAIR_FRAC = 0.25
NOMINAL_MPS = 4.5
CAP_M = 500.0
DEFAULT_HEADWAY_S = 600.0
DEG_M = 111_194.9  # metres per degree of latitude on the sphere used here


SIZE_LAT = CAP_M / DEG_M


def _columns(band: Column, size: float = SIZE_LAT) -> Column:
    """Columns around the globe in a band of latitude: each as wide as the cap is at the latitude farthest from the equator
    in this band and the two beside it."""
    far = F.least(F.greatest(F.abs(band - 1), F.abs(band + 2)) * size, F.lit(90.0))
    half = F.asin(F.least(F.lit(1.0), math.sin(math.radians(size) / 2) / F.cos(F.radians(far))))
    return F.floor(math.pi / half * (1 - 1e-6))


def _column(lon: Column, band: Column, size: float = SIZE_LAT) -> Column:
    n = _columns(band, size)
    return F.pmod(F.floor(F.pmod(lon, F.lit(360.0)) * n / 360), n)


def _located(positions: DataFrame, headway: DataFrame, size: float = SIZE_LAT) -> DataFrame:
    """Positions with the expected headway and the grid cell (cx, cy)."""
    hw = headway.select("route_id", "direction_id", "sched_median_headway_s")
    v = null_safe_join(positions.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()), hw, ["route_id", "direction_id"])
    v = v.withColumn("headway", F.coalesce("sched_median_headway_s", F.lit(DEFAULT_HEADWAY_S)))
    v = v.withColumn("cy", F.floor(F.col("lat") / size))
    return v.withColumn("cx", _column(F.col("lon"), F.col("cy"), size))


def _around(v: DataFrame, lon: str, size: float = SIZE_LAT) -> DataFrame:
    """Each row in its own cell and in those beside it: columns are as wide as the band needs that is met, and close up around the globe."""
    v = v.withColumn("cy", F.explode(F.array(*[F.col("cy") + i for i in (-1, 0, 1)])))
    beside = F.array_distinct(F.array(*[F.pmod(_column(F.col(lon), F.col("cy"), size) + i, _columns(F.col("cy"), size)) for i in (-1, 0, 1)]))
    return v.withColumn("cx", F.explode(beside))


def _close(pairs: DataFrame) -> DataFrame:
    """Pairs (lat_a, lon_a, lat_b, lon_b, headway) with their gap, as far as it is below the limit."""
    gap = haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    pairs = pairs.withColumns({"gap_m": gap, "expected_m": F.col("headway") * NOMINAL_MPS})
    return pairs.where(F.col("gap_m") < F.least(PAIR_FRAC * F.col("expected_m"), F.lit(CAP_M)))


def candidate_pairs(positions: DataFrame, headway: DataFrame, cap: float = CAP_M) -> DataFrame:
    """Pairs closer than min(25 % of the expected spacing, 500 m), from neighbouring grid cells only.

    The cap bounds the search radius, so a pair's vehicles lie in adjacent 500 m cells;
    a route's vehicles are never all paired with each other.  A smaller ``cap`` leaves the pairs below it.
    """
    size = cap / DEG_M
    v = _located(positions, headway, size)
    keep = ["vehicle_id", "lat", "lon"]
    a = v.select("route_id", "direction_id", "headway", "cx", "cy", *[F.col(c).alias(f"{c}_a") for c in keep])
    b = _around(v.select("route_id", "direction_id", "cy", *[F.col(c).alias(f"{c}_b") for c in keep]), "lon_b", size)
    b = b.withColumnsRenamed({"route_id": "r_b", "direction_id": "d_b", "cx": "cx_b", "cy": "cy_b"})
    same = F.col("route_id").eqNullSafe(F.col("r_b")) & F.col("direction_id").eqNullSafe(F.col("d_b")) & (F.col("cx") == F.col("cx_b")) & (F.col("cy") == F.col("cy_b"))
    j = a.join(b, same & (F.col("vehicle_id_a") < F.col("vehicle_id_b"))).drop("r_b", "d_b", "cx_b", "cy_b")
    return _close(j).where(F.col("gap_m") < cap).drop("cx", "cy")


def _reached(lat: Column, lon: Column, tile: float) -> Column:
    """The tiles (cx, cy) of ``tile`` degrees, its own among them, in which a vehicle can be within the cap of a position."""
    near = CAP_M / DEG_M * (1 + 1e-6)

    def across(band):
        far = F.least(F.greatest(F.abs(band - 1), F.abs(band + 2)) * tile, F.lit(90.0))
        reach = F.degrees(2 * F.asin(F.least(F.lit(1.0), math.sin(math.radians(near) / 2) / F.cos(F.radians(far))))) * (1 + 1e-6)
        n, x = _columns(band, tile), F.pmod(lon, F.lit(360.0))
        columns = F.sequence(F.floor((x - reach) * n / 360), F.floor((x + reach) * n / 360))
        return F.transform(F.array_distinct(F.transform(columns, lambda i: F.pmod(i, n))), lambda i: F.struct(i.alias("cx"), band.alias("cy")))

    return F.flatten(F.transform(F.sequence(F.floor((lat - near) / tile), F.floor((lat + near) / tile)), across))


def met_by_window(positions: DataFrame, headway: DataFrame, window: Column, wide: int = 8) -> DataFrame:
    """What a tile of ``wide`` x ``wide`` cells and a rim of one cap around it hold of one route's direction in one window, a row each: as one
    aggregation, which a stream can run where it can't join itself.  A position stands in four rows at most, however many others are near it, and in
    one if it isn't near the edge of its tile: what is shuffled, kept as state and written hardly exceeds the positions themselves."""
    tile = wide * SIZE_LAT
    v = _located(positions, headway, tile).withColumnsRenamed({"cx": "home_x", "cy": "home_y"})
    v = v.withColumn("t", F.explode(_reached(F.col("lat"), F.col("lon"), tile))).select("*", "t.cx", "t.cy")
    v = v.withColumn("home", (F.col("cx") == F.col("home_x")) & (F.col("cy") == F.col("home_y")))
    met = v.groupBy(window.alias("window"), "route_id", "direction_id", "cx", "cy").agg(F.collect_list(F.struct("vehicle_id", "lat", "lon", "headway", "home")).alias("m"))
    return met.where(F.exists("m", lambda a: a.home) & (F.size("m") > 1)).select("window", "route_id", "direction_id", "m")


def pairs_of_met(met: DataFrame) -> DataFrame:
    """:func:`candidate_pairs` of the rows of :func:`met_by_window`, one after the other: no row holds more than its vehicles.

    A row's vehicles are dealt to bands a cap high, and those of a band meet the ones in it and in the two beside it.
    """
    keys = ["window", "route_id", "direction_id"]
    band = lambda x: F.floor(x.lat / SIZE_LAT)
    ends = [f(F.transform("m", band)) for f in (F.array_min, F.array_max)]
    bands = met.select(*keys, F.transform(F.sequence(*ends), lambda k: F.filter("m", lambda x: band(x) == k)).alias("r"))
    beside = lambda i: F.flatten(F.slice("r", F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)))
    met = bands.select(*keys, F.explode(F.transform("r", lambda x, i: F.struct(F.filter(x, lambda v: v.home).alias("home"), beside(i).alias("near")))).alias("s"))
    a = met.select(*keys, F.col("s.near").alias("m"), F.explode("s.home").alias("a"))
    side = lambda s: [F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in ("vehicle_id", "lat", "lon")]
    both = a.select(*keys, F.col("a.headway").alias("headway"), *side("a"), F.explode("m").alias("b"))
    both = both.select(*keys, "headway", "vehicle_id_a", "lat_a", "lon_a", *side("b"))
    # a cap on the way north or south is told without the sphere
    north = F.abs(F.col("lat_b") - F.col("lat_a")) * DEG_M <= F.lit(CAP_M * (1 + 1e-6))
    return _close(both.where((F.col("vehicle_id_a") < F.col("vehicle_id_b")) & north))


def _rank() -> Column:
    return F.struct("gap_m", "vehicle_id_a", "vehicle_id_b")


def greedy_pairs(candidates: DataFrame) -> DataFrame:
    """Tightest pairs first, each vehicle in one pair at most.

    A pair that is the tightest one at both of its vehicles is always taken by the
    sequential rule, whatever happens elsewhere.  Taking all such pairs at once and
    dropping their vehicles' other pairs, round after round, gives the same result.
    Only the open pairs go into the next round; each round's tables are written.
    """
    left, taken = materialize(candidates, "pairs"), None
    while not left.isEmpty():
        ends = left.select(F.explode(F.array("vehicle_id_a", "vehicle_id_b")).alias("v"), _rank().alias("rk"))
        best = ends.groupBy("v").agg(F.min("rk").alias("best"))
        w = left.withColumn("rk", _rank())
        w = w.join(best.withColumnsRenamed({"v": "vehicle_id_a", "best": "best_a"}), "vehicle_id_a")
        w = w.join(best.withColumnsRenamed({"v": "vehicle_id_b", "best": "best_b"}), "vehicle_id_b")
        won = materialize(w.where((F.col("rk") == F.col("best_a")) & (F.col("rk") == F.col("best_b"))).select(*left.columns), "pairs")
        used = won.select(F.explode(F.array("vehicle_id_a", "vehicle_id_b")).alias("u"))
        rest = left.join(used, F.col("vehicle_id_a") == F.col("u"), "left_anti").join(used, F.col("vehicle_id_b") == F.col("u"), "left_anti")
        left = materialize(rest, "pairs")
        taken = won if taken is None else taken.unionByName(won)
    return candidates.limit(0) if taken is None else taken


def _at_one_spot(positions: DataFrame, headway: DataFrame) -> DataFrame:
    """The pairs that the sequential rule takes among vehicles at one and the same spot: gaps are 0, so they pair up in order of id."""
    w = W.partitionBy("route_id", "direction_id", "lat", "lon").orderBy("vehicle_id")
    v = _located(positions.where(F.col("vehicle_id").isNotNull()), headway).withColumns({"vehicle_id_b": F.lead("vehicle_id").over(w), "i": F.row_number().over(w)})
    v = v.where((F.col("i") % 2 == 1) & F.col("vehicle_id_b").isNotNull())
    place = [F.col(c).alias(f"{c}_{s}") for s in "ab" for c in ("lat", "lon")]
    return _close(v.select("route_id", "direction_id", "headway", F.col("vehicle_id").alias("vehicle_id_a"), "vehicle_id_b", *place))


def tightest_pairs(positions: DataFrame, headway: DataFrame, most: int = 16, least_m: float = 0.25) -> DataFrame:
    """:func:`greedy_pairs` of all :func:`candidate_pairs`, which need not all be listed where vehicles stand dense.

    Pairs below a small cap come before all wider ones, so they are settled first: among those left no two are that close any more, and
    the cap is widened.  The first cap is such that no cell holds more than ``most`` vehicles; vehicles at one spot are paired before.
    """
    v = materialize(positions.select("vehicle_id", "route_id", "direction_id", "lat", "lon").where("lat is not null and lon is not null"), "positions")
    headway = materialize(headway, "headway")

    def fullest(rows, cap):
        n = _located(rows, headway, cap / DEG_M).groupBy("route_id", "direction_id", "cy", "cx").agg(F.count(F.lit(1)).alias("n"))
        return n.agg(F.max("n")).first()[0] or 0

    crowded = fullest(v, CAP_M) > most
    if not crowded or not v.where("vehicle_id is not null").groupBy("vehicle_id").count().where("count > 1").isEmpty():
        return greedy_pairs(candidate_pairs(v, headway))

    def without(rows, pairs):
        used = pairs.select(F.explode(F.array("vehicle_id_a", "vehicle_id_b")).alias("u"))
        return materialize(rows.join(used, F.col("vehicle_id") == F.col("u"), "left_anti"), "positions")

    taken = materialize(_at_one_spot(v, headway), "pairs")
    v, cap = without(v, taken), CAP_M
    while cap > least_m and (n := fullest(v, cap)) > most:
        cap = max(least_m, cap / max(2.0, (n / most) ** 0.5))
    while True:
        won = greedy_pairs(candidate_pairs(v, headway, min(cap, CAP_M)))
        taken = taken.unionByName(won.select(*taken.columns))
        if cap >= CAP_M:
            return taken
        v, cap = without(v, won), 4 * cap
        if v.isEmpty():
            return taken


def bunching_pairs(positions: DataFrame, headway: DataFrame) -> DataFrame:
    """Pairs with mid-point, gap and severity."""
    p = tightest_pairs(positions, headway)
    ratio = F.col("gap_m") / F.col("expected_m")
    return p.select(
        "route_id", "direction_id", "vehicle_id_a", "vehicle_id_b", "gap_m",
        F.round((F.col("lat_a") + F.col("lat_b")) / 2, 6).alias("lat"), F.round((F.col("lon_a") + F.col("lon_b")) / 2, 6).alias("lon"),
        F.when(ratio < 0.08, "high").when(ratio < 0.16, "medium").otherwise("low").alias("severity"),
    )


def hotspots(pairs: DataFrame, n: int = 200) -> DataFrame:
    return pairs.orderBy("gap_m", "vehicle_id_a", "vehicle_id_b").limit(n)
