"""Distance, containment and overlap between layers, all as bucketed equi joins.

Feet throughout.  ``rings`` is an array of closed rings, outer first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.functions import planar as P
from kerbline.functions.overlap import disc, overlap_area, stadium
from kerbline.operators.observatory import shape_length
from kerbline.plans.proximity import box_join, cells_of_box, open_radius, point_pairs_within
from kerbline.plans.ranks import exact_percentiles
from kerbline.session import materialize

RADIUS_400M_FT = 1312.336
FT_PER_MILE = 5280.0
SQFT_PER_SQMI = 27_878_400.0
ONROUTE_FT, TERMINAL_FT = 100.0, 500.0
LINE = BOX = ["x0", "y0", "x1", "y1"]


# ------------------------------------------------------------------ cells
def cell_id(x: Column, y: Column, size: float) -> Column:
    """Square grid cell packed into one long (32 bits per axis)."""
    cx, cy = F.floor(x / size).cast("long"), F.floor(y / size).cast("long")
    return F.shiftleft(cx, 32).bitwiseOR(cy.bitwiseAND(F.lit(0xFFFFFFFF)))


def with_cell(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return df.withColumns({"cx": F.floor(F.col(x) / size).cast("long"), "cy": F.floor(F.col(y) / size).cast("long")})


def neighbour_map(cells: DataFrame, size: float, r: float) -> DataFrame:
    """Existing cells whose centres are at most ``r`` apart, by offsets: no pair outside the disc is ever formed."""
    k = int(math.floor(r / size))
    steps = [(i, j, math.hypot(i, j) * size) for i in range(-k, k + 1) for j in range(-k, k + 1) if math.hypot(i, j) * size <= r]
    offs = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit(d).alias("dist_ft")) for i, j, d in steps])
    e = cells.select("cx", "cy", F.explode(offs).alias("o")).select(
        "cx", "cy", (F.col("cx") + F.col("o.dx")).alias("nx"), (F.col("cy") + F.col("o.dy")).alias("ny"), "o.dist_ft")
    return e.join(cells.select(F.col("cx").alias("nx"), F.col("cy").alias("ny")), ["nx", "ny"], "left_semi")


def roll_up(layer: DataFrame, nbr: DataFrame, aggs: list[Column]) -> DataFrame:
    """Aggregate a cell layer over each cell's neighbourhood; the layer has one row per cell."""
    lay = layer.withColumnsRenamed({"cx": "nx", "cy": "ny"})
    return nbr.join(lay, ["nx", "ny"]).groupBy("cx", "cy").agg(*aggs)


def bin_layer(df: DataFrame, x: str, y: str, size: float, aggs: list[Column]) -> DataFrame:
    return with_cell(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, y, size).groupBy("cx", "cy").agg(*aggs)


# ------------------------------------------------------------------ containment
def assign_area(points: DataFrame, polys: DataFrame, x: str, y: str, take: list[str], size: float = 2000.0, how: str = "left") -> DataFrame:
    """Points with the attributes of the polygon that contains them.

    Polygons are spread over the cells of their bounding box, points sit in one cell.
    """
    box = polys.select(*take, "rings", P.bbox(F.flatten("rings")).alias("__b"))
    cells = box.select(*take, "rings", F.explode(cells_of_box(F.col("__b.x0"), F.col("__b.y0"), F.col("__b.x1"), F.col("__b.y1"), size)).alias("__c"))
    cells = cells.select(*take, "rings", F.col("__c.cx").alias("__cx"), F.col("__c.cy").alias("__cy"))
    p = points.withColumns({"__px": F.floor(F.col(x) / size).cast("long"), "__py": F.floor(F.col(y) / size).cast("long")})
    cond = (F.col("__px") == F.col("__cx")) & (F.col("__py") == F.col("__cy")) & P.contains(F.col("rings"), F.col(x), F.col(y))
    return p.join(cells, cond, how).select(*points.columns, *take)


def explode_parts(df: DataFrame, parts: str = "parts") -> DataFrame:
    """Multipolygon (array of polygons) to one row per part, so boxes become selective."""
    return df.select("*", F.posexplode(parts).alias("part", "rings")).drop(parts)


def hazard_flags(cells: DataFrame, hazards: DataFrame, x: str, y: str, kinds: list[str]) -> DataFrame:
    """Whether a cell centre lies in any part of each hazard kind."""
    hit = assign_area(cells, explode_parts(hazards), x, y, ["kind"], how="left")
    return hit.groupBy(*cells.columns).agg(*[F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False)).alias(f"in_{k}") for k in kinds])


# ------------------------------------------------------------------ distance
def radius_count(sites: DataFrame, pts: DataFrame, r: float, name: str = "n", key: str = "site_id", split: int = 4, most: int = 16) -> DataFrame:
    """Number of points within ``r`` of each site, zeros kept.

    Points are first counted per exact position and per small cell (r / split).  A small
    cell wholly inside the circle adds its count at once; only cells cut by the
    circle are looked into.  A dense spot is thus one row for most sites.  Cells are cut up once more, into patches of about ``most`` positions
    where points commonly lie: a patch, too, counts at once or not at all unless the circle cuts the box that its positions fill.
    """
    s, part = r / split, 1024
    at = pts.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    at = at.withColumns({"cx": F.floor(F.col("x") / s).cast("long"), "cy": F.floor(F.col("y") / s).cast("long")})
    at = materialize(at, "positions")
    per_cell = at.groupBy("cx", "cy").agg(F.sum("w").alias("w"), F.count(F.lit(1)).cast("double").alias("n"))
    held = per_cell.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0
    patch = s / max(1.0, (held / most) ** 0.5)
    of = ["cx", "cy", F.floor(F.col("x") / patch).alias("px"), F.floor(F.col("y") / patch).alias("py")]
    turn = F.row_number().over(W.partitionBy(*of).orderBy("x", "y"))
    ends = [f(c).alias(f"{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))]
    patches = at.withColumn("part", F.floor((turn - 1) / part)).groupBy(*of, "part").agg(F.sum("w").alias("w"), *ends, F.collect_list(F.struct("x", "y", "w")).alias("m"))
    box = [c for i in "xy" for c in (f"{i}0", f"{i}1")]
    whole = per_cell.select("cx", "cy", "w", *[F.lit(None).cast("double").alias(c) for c in box], F.lit(None).cast(patches.schema["m"].dataType).alias("m"), F.lit(True).alias("inside"))
    held_in = whole.unionByName(patches.select("cx", "cy", "w", *box, "m", F.lit(False).alias("inside")))

    k = split + 1
    near = F.sequence(F.lit(-k), F.lit(k))
    st = _spread(sites.select(key, "sx", "sy"), key).withColumns({"c0": F.floor(F.col("sx") / s).cast("long"), "c1": F.floor(F.col("sy") / s).cast("long")})
    e = st.withColumn("cx", F.explode(F.transform(near, lambda i: F.col("c0") + i))).withColumn("cy", F.explode(F.transform(near, lambda i: F.col("c1") + i)))
    lo_x, lo_y = F.col("cx") * s - F.col("sx"), F.col("cy") * s - F.col("sy")
    hi_x, hi_y = lo_x + s, lo_y + s
    far = F.hypot(F.greatest(F.abs(lo_x), F.abs(hi_x)), F.greatest(F.abs(lo_y), F.abs(hi_y)))
    zero = F.lit(0.0)
    close = F.hypot(F.greatest(lo_x, -hi_x, zero), F.greatest(lo_y, -hi_y, zero))
    e = e.withColumn("inside", far <= r).where(close <= r).drop("c0", "c1")
    # the planner doesn't see how many cells a site is spread over, and would send them all to the driver
    j = e.join(held_in.hint("merge"), ["cx", "cy", "inside"])
    # squares tell all but what lies at the rim itself
    sure, may = r * r * (1 - 1e-9), r * r * (1 + 1e-9)
    square = lambda dx, dy: dx * dx + dy * dy
    nearest = square(*[F.greatest(F.col(f"{c}0") - F.col(f"s{c}"), F.col(f"s{c}") - F.col(f"{c}1"), zero) for c in "xy"])
    farthest = square(*[F.greatest(F.abs(F.col(f"{c}0") - F.col(f"s{c}")), F.abs(F.col(f"{c}1") - F.col(f"s{c}"))) for c in "xy"])
    j = j.where(F.col("inside") | (nearest <= may)).withColumn("inside", F.col("inside") | (farthest <= sure))
    all_of_it = F.array(F.struct(F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), "w"))
    j = j.select(key, "sx", "sy", "inside", F.explode(F.when(F.col("inside"), all_of_it).otherwise(F.col("m"))).alias("p"))
    dx, dy = F.col("p.x") - F.col("sx"), F.col("p.y") - F.col("sy")
    within = (square(dx, dy) <= sure) | ((square(dx, dy) <= may) & (F.hypot(dx, dy) <= r))
    n = j.where(F.col("inside") | within).groupBy(key).agg(F.sum("p.w").alias(name))
    return sites.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def near_segment_count(segs: DataFrame, pts: DataFrame, d: float, key: str, size: float = 400.0) -> DataFrame:
    """Points within ``d`` of each segment, zeros kept.

    Points are counted per position, and a line that several segments share meets them once.
    """
    at = pts.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")).withColumns({"cx": F.floor(F.col("x") / size).cast("long"), "cy": F.floor(F.col("y") / size).cast("long")})
    g = segs.select(*LINE).distinct()
    box = cells_of_box(F.least("x0", "x1") - d, F.least("y0", "y1") - d, F.greatest("x0", "x1") + d, F.greatest("y0", "y1") + d, size)
    e = g.select("*", F.explode(box).alias("c")).select(*g.columns, "c.cx", "c.cy")
    dist = P.segment_distance(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    w = e.hint("merge").join(at, ["cx", "cy"]).where(dist <= d).groupBy(*LINE).agg(F.sum("w").alias("w"))
    n = segs.select(key, *LINE).join(w, LINE).groupBy(key).agg(F.sum("w").alias("n_points"))
    return segs.join(n, key, "left").withColumn("n_points", F.coalesce("n_points", F.lit(0)))


def nearest(points: DataFrame, sites: DataFrame, key: str, x: str, y: str, start: float = 1000.0) -> DataFrame:
    """Nearest site of each point; equal distances go to the smaller site id.

    The search ring doubles from ``start``, or from less where sites lie dense: points whose nearest site lies within the
    ring are final, the rest go on, whatever the number of sites.  Sites without finite coordinates are nobody's nearest; points without, and all points
    if there is no site, come back with a null site and distance.
    """
    def finite(c):
        v = F.col(c).cast("double")
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))

    one = materialize(sites.where(finite("sx") & finite("sy")).groupBy("sx", "sy").agg(F.min("site_id").alias("site_id")), "sites")
    kind = dict(sites.dtypes)["site_id"]
    none = {"site_id": F.lit(None).cast(kind), "dist_ft": F.lit(None).cast("double")}
    placed = F.coalesce(finite(x) & finite(y), F.lit(False))
    if one.isEmpty():
        return points.withColumns(none)
    left, done, r = points.where(placed), points.where(~placed).withColumns(none), open_radius(one, "sx", "sy", start)
    while True:
        pairs = point_pairs_within(left.select(key, x, y).distinct(), one, x, y, "sx", "sy", r, dist="dist_ft")
        best = pairs.groupBy(key, x, y).agg(F.min(F.struct("dist_ft", "site_id")).alias("b")).select(key, x, y, "b.site_id", "b.dist_ft")
        tried = materialize(left.join(best, [key, x, y], "left").select(*points.columns, "site_id", "dist_ft"), "nearest")
        done = done.unionByName(tried.where("dist_ft is not null"))
        left = tried.where("dist_ft is null").select(*points.columns)
        if left.isEmpty():
            return done
        r *= 2


def k_nearest_within(queries: DataFrame, items: DataFrame, r: float, k: int, key: str, item: str) -> DataFrame:
    """The k nearest items of each query point within ``r``, with their rank.

    Of many items at one spot only the first k can be among anyone's k nearest, so
    the rest of such a spot is left out before any pair is formed.  The search ring doubles up to ``r``, from less where items lie
    dense: queries with k items within the ring are final, the rest go on.
    """
    spot = F.row_number().over(W.partitionBy("x", "y").orderBy(item))
    items = materialize(items.withColumn("__spot", spot).where(F.col("__spot") <= k).drop("__spot"), "items")
    rk = F.row_number().over(W.partitionBy(key).orderBy("dist_ft", item))
    ring, left, done = open_radius(items, "x", "y", r, 4 * k), queries, None
    while True:
        pairs = point_pairs_within(left, items, "qx", "qy", "x", "y", min(ring, r), dist="dist_ft")
        best = pairs.withColumn("rk", rk).where(F.col("rk") <= k)
        if ring >= r:
            return best if done is None else done.unionByName(best)
        best = materialize(best, "k-nearest")
        full = best.where(F.col("rk") == k).select(F.col(key).alias("__full"))
        final = best.join(full, F.col(key).eqNullSafe(F.col("__full")), "left_semi")
        done = final if done is None else done.unionByName(final)
        left = materialize(left.join(full, F.col(key).eqNullSafe(F.col("__full")), "left_anti"), "left")
        if left.isEmpty():
            return done
        ring *= 2


# ------------------------------------------------------------------ overlap
def _spread(pairs: DataFrame, *cols: str) -> DataFrame:
    """Spread candidate pairs over all tasks before the costly geometry, so a dense cell's pairs are shared out."""
    return pairs.repartition(F.xxhash64(*cols))


def overlap_with_discs(points: DataFrame, polys: DataFrame, r: float, key: str, poly: str, segments: int = 32, digits: int | None = None) -> DataFrame:
    """Shared area of each point's disc with each polygon whose box meets it, rounded to ``digits`` if they are given.

    Polygons of one outline meet a disc once, under a number; outlines whose box lies inside the disc or outside of it are told without their rings.
    Pairs of ids are told only in the end: what is done for a pair is to write it.
    """
    outlines = polys.select("rings").distinct().select(F.monotonically_increasing_id().alias("__outline"), "rings", P.bbox(F.flatten("rings")).alias("__b"), P.polygon_area(F.col("rings")).alias("poly_area"))
    outlines = materialize(outlines, "outlines")
    x, y, rr = F.col("sx"), F.col("sy"), F.lit(float(r))
    j = box_join(points, outlines, (x - rr, y - rr, x + rr, y + rr), tuple(F.col(f"__b.{c}") for c in BOX), max(2 * r, 500.0))
    square = lambda dx, dy: dx * dx + dy * dy
    close = square(*[F.greatest(F.col(f"__b.{a}0") - F.col(f"s{a}"), F.col(f"s{a}") - F.col(f"__b.{a}1"), F.lit(0.0)) for a in "xy"])
    far = square(*[F.greatest(F.abs(F.col(f"__b.{a}0") - F.col(f"s{a}")), F.abs(F.col(f"__b.{a}1") - F.col(f"s{a}"))) for a in "xy"])
    j = j.where(close <= r * r * (1 + 1e-9)).withColumn("__whole", far <= (r * math.cos(math.pi / segments)) ** 2 * (1 - 1e-9))
    j = j.withColumn("rings", F.when(~F.col("__whole"), F.col("rings"))).drop("__b").withColumnRenamed("poly_area", "__area")
    j = _disc_shares(_spread(j, key, "__outline"), r, segments, whole=F.col("__whole"), area=F.col("__area")).drop("rings", "__whole", "__area")
    if digits is not None:
        j = j.withColumn("overlap_sqft", F.round("overlap_sqft", digits))
    numbered = outlines.select(F.col("__outline").alias("__of"), F.col("rings").alias("__rings"), F.xxhash64("rings").alias("__hash"))
    own = polys.withColumn("__own", F.xxhash64("rings")).join(numbered, (F.col("__own") == F.col("__hash")) & (F.col("rings") == F.col("__rings"))).drop("__own", "__hash", "__rings")
    return j.join(own, F.col("__outline") == F.col("__of")).drop("__outline", "__of")


def _members(shapes: DataFrame, rows: DataFrame, shape: str, of: str) -> DataFrame:
    """Rows beside what is known of their shape, found by its hash and itself: ``shape`` on the left, ``of`` on the right."""
    s = shapes.withColumn("__hash", F.xxhash64(shape)).withColumnRenamed(shape, "__shape")
    m = rows.withColumn("__of", F.xxhash64(of))
    return s.join(m.hint("merge"), (F.col("__hash") == F.col("__of")) & (F.col("__shape") == F.col(of))).drop("__hash", "__of", "__shape")


def _disc_shares(j: DataFrame, r: float, segments: int = 32, whole: Column | None = None, area: Column | None = None) -> DataFrame:
    """Pairs (sx, sy, rings) that share area, with ``poly_area`` and ``overlap_sqft``.

    A polygon wholly inside the disc needs no clipping; the batch function only sees the cut ones.  ``whole``: known to be inside, rings
    not needed; ``area``: that of the polygons, if known.
    """
    reach = F.array_max(F.transform(F.get("rings", 0), lambda p: F.hypot(p.x - F.col("sx"), p.y - F.col("sy"))))
    inside = reach <= r * math.cos(math.pi / segments)
    inside = inside if whole is None else whole | inside
    j = j.withColumns({"poly_area": P.polygon_area(F.col("rings")) if area is None else area, "__inside": inside})
    cut = overlap_area(F.when(~F.col("__inside"), F.col("rings")), F.when(~F.col("__inside"), disc(F.col("sx"), F.col("sy"), F.lit(float(r)), segments)))
    j = j.withColumn("overlap_sqft", F.coalesce(F.when(F.col("__inside"), F.col("poly_area")), cut)).where(F.col("overlap_sqft") > 1e-9)
    return j.drop("__inside")


def walkshed(points: DataFrame, polys: DataFrame, r: float, key: str, poly: str, values: list[str]) -> DataFrame:
    """Polygon values apportioned to discs by area share and summed per point.

    Polygons are summed per outline and per small cell (r / 8), with the box that a cell's polygons fill.  A cell whose box lies
    inside the disc adds its sums at once; only polygons of cells at the rim are looked at, and those wider than
    two cells, each in a cell of its own size.
    """
    size, segments = r / 8, 32
    sums = lambda by: [F.sum(F.col(v) * by).alias(v) for v in values]
    p = polys.groupBy("rings").agg(*[F.sum(F.col(v).cast("double")).alias(v) for v in values], F.count(F.lit(1)).alias("__n"))
    p = p.withColumns({"__b": P.bbox(F.flatten("rings")), "poly_area": P.polygon_area(F.col("rings"))}).where("poly_area > 1e-9")
    width = F.greatest(F.col("__b.x1") - F.col("__b.x0"), F.col("__b.y1") - F.col("__b.y0"))
    middle = [F.floor((F.col(f"__b.{a}0") + F.col(f"__b.{a}1")) / (2 * size)).cast("long") for a in "xy"]
    p = materialize(p.withColumns({"__wide": width > 2 * size, "cx": middle[0], "cy": middle[1]}), "outlines")

    sites = points.select(key, "sx", "sy")
    small = p.where("not __wide")
    ends = [F.min("__b.x0").alias("x0"), F.min("__b.y0").alias("y0"), F.max("__b.x1").alias("x1"), F.max("__b.y1").alias("y1")]
    cells = small.groupBy("cx", "cy").agg(*sums(F.lit(1.0)), F.sum(F.col("poly_area") * F.col("__n")).alias("overlap_sqft"), *ends)
    # a polygon that meets the disc is at most two cells wide, so its middle lies within r and one cell on either axis
    k = 10
    c0, c1 = F.floor(F.col("sx") / size).cast("long"), F.floor(F.col("sy") / size).cast("long")
    around = F.sequence(F.lit(-k), F.lit(k))
    e = sites.withColumn("cx", F.explode(F.transform(around, lambda i: c0 + i))).withColumn("cy", F.explode(F.transform(around, lambda i: c1 + i)))
    gap = [F.greatest(F.col(c) * size - F.col(s), F.col(s) - (F.col(c) + 1) * size, F.lit(0.0)) for c, s in (("cx", "sx"), ("cy", "sy"))]
    e = e.where(F.hypot(*gap) <= r + 1.5 * size)
    e = e.join(cells.hint("merge"), ["cx", "cy"])
    far = F.hypot(*[F.greatest(F.abs(F.col(f"{a}0") - F.col(f"s{a}")), F.abs(F.col(f"{a}1") - F.col(f"s{a}"))) for a in "xy"])
    close = F.hypot(*[F.greatest(F.col(f"{a}0") - F.col(f"s{a}"), F.col(f"s{a}") - F.col(f"{a}1"), F.lit(0.0)) for a in "xy"])
    inside = F.coalesce(far <= r * math.cos(math.pi / segments), F.lit(False))
    whole = e.where(inside).select(key, *values, "overlap_sqft")
    rim = e.where(~inside & (close <= r)).select(key, "sx", "sy", "cx", "cy").join(small.hint("merge"), ["cx", "cy"]).drop("cx", "cy")

    x, y = F.col("sx"), F.col("sy")
    wide = box_join(sites, p.where("__wide").drop("cx", "cy"), (x - r, y - r, x + r, y + r), tuple(F.col(f"__b.{c}") for c in BOX), 2 * r)
    cut = rim.unionByName(wide.select(*rim.columns)).drop("__wide", "poly_area")
    meets = (F.col("__b.x0") <= x + r) & (F.col("__b.x1") >= x - r) & (F.col("__b.y0") <= y + r) & (F.col("__b.y1") >= y - r)
    o = _disc_shares(_spread(cut.where(meets).drop("__b"), key, "rings"), r, segments)
    share = F.col("overlap_sqft") / F.col("poly_area")
    o = o.select(key, *[(F.col(v) * share).alias(v) for v in values], (F.col("overlap_sqft") * F.col("__n")).alias("overlap_sqft"))
    s = whole.unionByName(o).groupBy(key).agg(*[F.sum(v).alias(f"{v}_walkshed") for v in values], F.sum("overlap_sqft").alias("overlap_sqft"))
    return points.select(key).join(s, key, "left").fillna(0.0)


def block_provision(blocks: DataFrame, polys: DataFrame, key: str, poly: str) -> DataFrame:
    """Layer area inside each convex block, per foot of frontage and per head.

    Blocks of one outline and polygons of one outline meet once.
    """
    outlines = blocks.select(F.get("rings", 0).alias("outline")).distinct().withColumn("__b", P.bbox(F.col("outline")))
    layer = polys.groupBy(F.col("rings").alias("prings")).agg(F.count(F.lit(1)).alias("__n")).withColumn("__p", P.bbox(F.get("prings", 0)))
    box = lambda n: tuple(F.col(f"{n}.{c}") for c in BOX)
    j = box_join(outlines, layer, box("__b"), box("__p"), 1000.0)
    j = _spread(j.select("outline", "prings", "__n"), "outline", "prings")
    a = j.select("outline", (overlap_area("prings", "outline") * F.col("__n")).alias("a")).groupBy("outline").agg(F.sum("a").alias("a"))
    a = _members(a, blocks.select(key, F.get("rings", 0).alias("__own")), "outline", "__own").groupBy(key).agg(F.sum("a").alias("sidewalk_area_sqft"))
    out = blocks.join(a, key, "left").withColumns({
        "sidewalk_area_sqft": F.coalesce("sidewalk_area_sqft", F.lit(0.0)), "block_area_sqft": P.polygon_area(F.col("rings")), "perimeter_ft": P.polygon_perimeter(F.col("rings"))})
    return out.withColumns({
        "coverage_ratio_ft": F.col("sidewalk_area_sqft") / F.nullif(F.col("perimeter_ft"), F.lit(0.0)),
        "sqft_per_capita": F.when(F.col("pop") > 0, F.col("sidewalk_area_sqft") / F.col("pop"))}).drop("rings")


def side_of_segment(rings: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Sign of the side on which the polygon's nearest point lies; 0 when it crosses the line."""
    es = P.edges(F.get(rings, 0))
    crosses = F.exists(es, lambda e: (P.cross_sign(e.x0, e.y0, x0, y0, x1, y1) * P.cross_sign(e.x1, e.y1, x0, y0, x1, y1) < 0)
                       & (P.cross_sign(x0, y0, e.x0, e.y0, e.x1, e.y1) * P.cross_sign(x1, y1, e.x0, e.y0, e.x1, e.y1) < 0))
    vertex = F.transform(F.get(rings, 0), lambda p: F.struct(P.segment_distance(p.x, p.y, x0, y0, x1, y1).alias("d"), P.cross_sign(p.x, p.y, x0, y0, x1, y1).alias("s")))

    def from_end(ex, ey):
        def one(e):
            u = P.segment_position(ex, ey, e.x0, e.y0, e.x1, e.y1)
            nx, ny = e.x0 + u * (e.x1 - e.x0), e.y0 + u * (e.y1 - e.y0)
            return F.struct(F.hypot(ex - nx, ey - ny).alias("d"), P.cross_sign(nx, ny, x0, y0, x1, y1).alias("s"))

        return F.transform(es, one)

    best = F.array_min(F.concat(vertex, from_end(x0, y0), from_end(x1, y1)))
    # a polygon wholly on one side has its nearest point there; only the others need distances
    cross = F.transform(F.get(rings, 0), lambda p: P.cross_sign(p.x, p.y, x0, y0, x1, y1))
    return F.when(F.array_min(cross) > 0, 1).when(F.array_max(cross) < 0, -1).when(crosses, 0).otherwise(F.signum(best.getField("s")).cast("int"))


def coverage_class(segs: DataFrame, polys: DataFrame, key: str, poly: str, reach: float = 25.0, default_width: float = 30.0) -> DataFrame:
    """Layer area within reach of each street and the sides it lies on.

    Streets of one line and width and polygons of one outline meet once.
    """
    w = F.coalesce(F.nullif(F.col("width_text").try_cast("double"), F.lit(0.0)), F.lit(default_width))
    s = segs.withColumn("__r", w / 2 + reach)
    p = polys.groupBy("rings").agg(F.count(F.lit(1)).alias("__n")).withColumn("__p", P.bbox(F.get("rings", 0)))
    lb = (F.least("x0", "x1") - F.col("__r"), F.least("y0", "y1") - F.col("__r"), F.greatest("x0", "x1") + F.col("__r"), F.greatest("y0", "y1") + F.col("__r"))
    line = [*LINE, "__r"]
    j = box_join(s.select(*line).distinct(), p, lb, tuple(F.col(f"__p.{c}") for c in BOX), 500.0)
    xy = [F.col(c) for c in LINE]
    j = _spread(j.select(*line, "rings", "__n"), *line, "rings")
    # wholly within reach: no clipping needed (half circles are drawn with 16 segments)
    far = F.array_max(F.transform(F.get("rings", 0), lambda p: P.segment_distance(p.x, p.y, *xy)))
    j = j.withColumn("__inside", far <= F.col("__r") * math.cos(math.pi / 32))
    cut = overlap_area(F.when(~F.col("__inside"), F.col("rings")), stadium(*xy, F.col("__r")))
    j = j.withColumn("a", F.coalesce(F.when(F.col("__inside"), P.polygon_area(F.col("rings"))), cut)).where(F.col("a") > 1e-9)
    j = j.withColumn("side", side_of_segment(F.col("rings"), *xy))
    per = j.groupBy(*line).agg(F.sum(F.col("a") * F.col("__n")).alias("a"), F.max("side").alias("most"), F.min("side").alias("least"))
    g = s.select(key, *line).join(per, line).groupBy(key).agg(
        F.sum("a").alias("sidewalk_area_sqft"), (F.max("most") > 0).cast("int").alias("has_left"), (F.min("least") < 0).cast("int").alias("has_right"))
    out = segs.join(g, key, "left").fillna({"sidewalk_area_sqft": 0.0, "has_left": 0, "has_right": 0})
    return out.withColumns({"seg_len_ft": F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), "coverage_class": class_of_sides(F.col("has_left"), F.col("has_right"))})


def class_of_sides(left: Column, right: Column) -> Column:
    return F.when((left == 1) & (right == 1), "both_sides").when((left == 1) | (right == 1), "one_side").otherwise("none")


# ------------------------------------------------------------------ measures, lines
def geom_measures(df: DataFrame, key: str) -> DataFrame:
    c, b = P.ring_centroid(F.get("rings", 0)), P.bbox(F.flatten("rings"))
    return df.select(key, P.polygon_area(F.col("rings")).alias("area_sqft"), P.polygon_perimeter(F.col("rings")).alias("perimeter_ft"), c.alias("c"), b.alias("b")).select(
        key, "area_sqft", "perimeter_ft", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("b.x0").alias("min_x"), F.col("b.y0").alias("min_y"),
        F.col("b.x1").alias("max_x"), F.col("b.y1").alias("max_y"))


def strip_width(rings: Column) -> Column:
    """Width of a long thin polygon: twice its area over its perimeter."""
    return 2 * P.polygon_area(rings) / F.nullif(P.polygon_perimeter(rings), F.lit(0.0))


def measured_widths(polys: DataFrame, key: str, lo: float = 2.0, hi: float = 120.0) -> DataFrame:
    """Middle and width of each strip polygon whose width is plausible, to be held against published widths."""
    c = P.ring_centroid(F.get("rings", 0))
    w = polys.select(key, c.alias("c"), strip_width(F.col("rings")).alias("width_ft")).where(F.col("width_ft").between(lo, hi))
    return w.select(key, F.col("c.x").alias("x"), F.col("c.y").alias("y"), "width_ft")


def segment_width(pairs: DataFrame, key: str, lo: float = 2.0, hi: float = 120.0) -> DataFrame:
    """Median, smallest and 90th-percentile width of the polygons matched to each segment (a handful each)."""
    w = pairs.withColumn("w", strip_width(F.col("rings"))).where(F.col("w").between(lo, hi))
    return w.groupBy(key).agg(F.median("w").alias("width_median_ft"), F.min("w").alias("width_min_ft"), F.percentile("w", 0.9).alias("width_p90_ft"), F.count(F.lit(1)).alias("n_polys"))


def width_summary(segs: DataFrame, area: str, value: str) -> DataFrame:
    """Width distribution per area and over all."""
    probs = {"p10": 0.1, "median": 0.5, "p90": 0.9}
    per = exact_percentiles(segs, [area], value, probs)
    return per.unionByName(exact_percentiles(segs, [], value, probs).withColumn(area, F.lit("Citywide")))


def valid_share(df: DataFrame, fraction: float, key: str, seed: int = 42) -> DataFrame:
    """Share of sampled polygons whose rings are closed, have four points and an area.

    The sample is by a hash of the key, so it is the same however the rows are laid out.
    """
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    ok = F.forall("rings", lambda r: (F.size(r) >= 4) & (r[0] == F.element_at(r, -1)) & (F.abs(P.ring_signed_area(r)) > 0))
    return df.where(draw < int(fraction * 2**32)).agg(F.count(F.lit(1)).alias("sampled"), F.count_if(~ok).alias("invalid"))


def shape_lines(points: DataFrame) -> DataFrame:
    """One polyline per shape with the cumulative offset at each vertex; a shape has at most some thousand vertices."""
    c = shape_length(points)
    line = F.sort_array(F.collect_list(F.struct("seq", F.col("x_ft").alias("x"), F.col("y_ft").alias("y"), "cum_ft")))
    return c.groupBy("shape_id").agg(line.alias("line"), F.max("cum_ft").alias("shape_len_ft"), F.count(F.lit(1)).alias("n_points"))


def segment_index(cells: DataFrame, lines: DataFrame, size: float) -> DataFrame:
    """Per (shape_id, cx, cy) the segments of the shape that can be nearest to some point of that cell.

    Distances to a segment differ by at most half a diagonal between the centre of a cell and any of its points, so a segment
    more than a whole diagonal farther from the centre than the nearest one is nobody's nearest there.  No point
    is too far away for this: every cell gets at least one segment.
    """
    n = F.size("line")
    pairs = F.zip_with(F.slice("line", F.lit(1), n - 1), F.slice("line", F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    mx, my = (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size

    def from_centre(e):
        return F.struct(*[e[v][c].alias(f"{v}_{c}") for v in "ab" for c in ("x", "y", "cum_ft")], P.segment_distance(mx, my, e.a.x, e.a.y, e.b.x, e.b.y).alias("d"))

    at = cells.join(lines.where("n_points >= 2"), "shape_id").withColumn("segs", F.transform(pairs, from_centre)).drop("line")
    at = at.withColumn("far", F.array_min(F.transform("segs", lambda e: e.d)) + size * math.sqrt(2) * (1 + 1e-9) + 1e-6)
    near = F.transform(F.filter("segs", lambda e: e.d <= F.col("far")), lambda e: e.dropFields("d"))
    return at.select("shape_id", "cx", "cy", "shape_len_ft", near.alias("segs"))


def line_locate(points: DataFrame, lines: DataFrame, size: float = 300.0) -> DataFrame:
    """Offset along and distance from the point's own shape; of equally near places the first along the shape.

    Only the cells in which points lie meet whole shapes; a point meets the few segments kept for its cell
    (``segment_index``).  The join is by shape and cell, so the points of a busy shape are spread over its cells.  Points of shapes
    with fewer than two vertices are left out, points without coordinates have neither offset nor distance.
    """
    x, y = F.col("x_ft"), F.col("y_ft")
    placed = points.withColumns({"__cx": F.floor(x / size), "__cy": F.floor(y / size)})
    cells = placed.select("shape_id", F.col("__cx").alias("cx"), F.col("__cy").alias("cy")).distinct()
    index = segment_index(cells, lines, size).withColumnsRenamed({"shape_id": "__shape", "cx": "__ix", "cy": "__iy", "segs": "__segs"})

    def with_fraction(e):
        return F.struct(e.alias("e"), P.segment_position(x, y, e.a_x, e.a_y, e.b_x, e.b_y).alias("u"))

    def place(f):
        px, py = f.e.a_x + f.u * (f.e.b_x - f.e.a_x), f.e.a_y + f.u * (f.e.b_y - f.e.a_y)
        return F.struct(F.hypot(x - px, y - py).alias("perp"), (f.e.a_cum_ft + f.u * (f.e.b_cum_ft - f.e.a_cum_ft)).alias("off"))

    own = (F.col("shape_id") == F.col("__shape")) & F.col("__cx").eqNullSafe(F.col("__ix")) & F.col("__cy").eqNullSafe(F.col("__iy"))
    j = placed.join(index, own).withColumn("__m", F.array_min(F.transform(F.transform("__segs", with_fraction), place)))
    return j.select(*points.columns, "shape_len_ft", F.col("__m.off").alias("offset_ft"), F.col("__m.perp").alias("perp_ft"))


def route_adherence(projected: DataFrame) -> DataFrame:
    """On-route share and distance percentiles per route and day, ends of the shape left out."""
    p = projected.where((F.col("offset_ft") >= TERMINAL_FT) & (F.col("offset_ft") <= F.col("shape_len_ft") - TERMINAL_FT)).withColumn("day", F.floor(F.col("ts") / 86400))
    g = p.groupBy("route_id", "day").agg(F.count(F.lit(1)).alias("n_pings"), F.count_if(F.col("perp_ft") <= ONROUTE_FT).alias("n_on_route"), F.countDistinct("trip_id").alias("n_trips"))
    q = exact_percentiles(p, ["route_id", "day"], "perp_ft", {"median_perp_ft": 0.5, "p90_perp_ft": 0.9}).drop("n")
    return g.join(q, ["route_id", "day"]).withColumn("adherence_pct", 100.0 * F.col("n_on_route") / F.col("n_pings"))


def match_nearest_line(points: DataFrame, lines: DataFrame, d: float, key: str, size: float = 200.0) -> DataFrame:
    """Nearest line with a published value within ``d`` of each point; equal distances go to the smaller street_id.

    Lines without a value are no candidates, nor are those that run where one of a smaller street_id runs.  Points meet the lines once per position, however many stand on it; points without
    coordinates, or with no line that near, are left out.
    """
    s = float(size)
    box = cells_of_box(F.least("x0", "x1") - d, F.least("y0", "y1") - d, F.greatest("x0", "x1") + d, F.greatest("y0", "y1") + d, s)
    one = lines.where("published is not null").groupBy(*LINE).agg(F.min(F.struct("street_id", "published")).alias("l")).select("l.*", *LINE)
    e = one.select("street_id", "published", "x0", "y0", "x1", "y1", F.explode(box).alias("c"))
    e = e.select("street_id", "published", "x0", "y0", "x1", "y1", "c.cx", "c.cy")
    at = points.where("x is not null and y is not null").select("x", "y").distinct()
    at = at.withColumns({"cx": F.floor(F.col("x") / s).cast("long"), "cy": F.floor(F.col("y") / s).cast("long")})
    dist = P.segment_distance(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    j = at.join(e.hint("merge"), ["cx", "cy"]).withColumn("dist_ft", dist).where(F.col("dist_ft") <= d)
    best = j.groupBy("x", "y").agg(F.min(F.struct("dist_ft", "street_id", "published")).alias("b"))
    return points.join(best.hint("merge"), ["x", "y"]).select(*points.columns, "b.dist_ft", "b.street_id", "b.published")


# ------------------------------------------------------------------ street network
def network_nodes(segs: DataFrame, key: str) -> DataFrame:
    """Street ends snapped to the foot, with degree and kind."""
    ends = segs.select(key, F.explode(F.array(F.struct(F.round("x0").alias("nx"), F.round("y0").alias("ny")), F.struct(F.round("x1").alias("nx"), F.round("y1").alias("ny")))).alias("e"))
    n = ends.groupBy("e.nx", "e.ny").agg(F.count(F.lit(1)).alias("degree"), F.countDistinct(key).alias("n_segments"))
    return n.withColumn("kind", F.when(F.col("degree") >= 3, "intersection (>=3)").when(F.col("degree") == 2, "midblock pseudo-node").otherwise("dead end"))


def ramps_at_intersections(nodes: DataFrame, ramps: DataFrame, r: float = 50.0, max_slope: float = 8.33, sentinel: float = 100.0) -> DataFrame:
    """Ramps within ``r`` feet of each intersection, and how many are too steep; unmeasured slopes do not count as steep."""
    ix = nodes.where("degree >= 3").select("nx", "ny", "degree")
    pairs = point_pairs_within(ix, ramps.select(F.col("x").alias("rx"), F.col("y").alias("ry"), "slope"), "nx", "ny", "rx", "ry", r)
    steep = (F.col("slope") > max_slope) & (F.col("slope") < sentinel)
    g = pairs.groupBy("nx", "ny").agg(F.count(F.lit(1)).alias("n_ramps"), F.count_if(steep).alias("n_ramps_steep"))
    return ix.join(g, ["nx", "ny"], "left").fillna(0, ["n_ramps", "n_ramps_steep"]).withColumn("has_ramp", (F.col("n_ramps") > 0).cast("int"))


def ramp_coverage(inter: DataFrame, area: str) -> DataFrame:
    """Ramp coverage per area with a citywide row, which is there even when nothing is."""
    sums = {"n_with_ramp": "has_ramp", "total_ramps": "n_ramps", "steep_ramps": "n_ramps_steep"}
    per = inter.where(F.col(area).isNotNull()).groupBy(area).agg(F.count(F.lit(1)).alias("n_intersections"), *[F.sum(c).alias(n) for n, c in sums.items()])
    city = per.agg(F.coalesce(F.sum("n_intersections"), F.lit(0)).alias("n_intersections"), *[F.sum(n).alias(n) for n in sums]).withColumn(area, F.lit("Citywide"))
    return per.unionByName(city).withColumns({
        "ramp_coverage_pct": F.round(100 * F.col("n_with_ramp") / F.nullif(F.col("n_intersections"), F.lit(0)), 1),
        "steep_ramp_pct": F.round(100 * F.col("steep_ramps") / F.nullif(F.col("total_ramps"), F.lit(0)), 1)})


def edge_miles(segs: DataFrame, areas: DataFrame) -> DataFrame:
    """Sidewalk edge miles (length x sides) and centre-line miles per area, by segment centre."""
    s = segs.withColumns({"mx": (F.col("x0") + F.col("x1")) / 2, "my": (F.col("y0") + F.col("y1")) / 2})
    j = assign_area(s, areas, "mx", "my", ["area"], how="inner")
    return j.groupBy("area").agg((F.sum(F.col("seg_len_ft") * (F.col("has_left") + F.col("has_right"))) / FT_PER_MILE).alias("edge_mi"), (F.sum("seg_len_ft") / FT_PER_MILE).alias("centerline_mi"))


def coverage_summary(segs: DataFrame, area: str) -> DataFrame:
    """Class counts per area in columns, with a citywide row and percentages."""
    n = lambda c: F.count_if(F.col("coverage_class") == c).alias(c)
    g = segs.rollup(area).agg(n("none"), n("one_side"), n("both_sides"), F.count(F.lit(1)).alias("total"))
    return g.select(F.coalesce(area, F.lit("Citywide")).alias(area), "none", "one_side", "both_sides", "total",
                    F.round(100 * F.col("both_sides") / F.col("total"), 1).alias("pct_both"), F.round(100 * F.col("none") / F.col("total"), 1).alias("pct_none"))
