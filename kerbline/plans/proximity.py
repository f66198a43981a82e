"""Distance and range joins as equi joins on grid buckets.

Both sides are dealt to tasks by cell.  The planner's sizes don't see how many cells a row is spread over, so the joins say
that neither side is to be sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def cell(x: Column, y: Column, size: float) -> Column:
    """Grid cell of a point as a struct of two integers."""
    return F.struct(
        F.floor(x / F.lit(float(size))).cast("long").alias("cx"),
        F.floor(y / F.lit(float(size))).cast("long").alias("cy"),
    )


def cells_of_box(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """All grid cells touched by a box, as an array of structs."""
    s = F.lit(float(size))
    xs = F.sequence(F.floor(x0 / s).cast("long"), F.floor(x1 / s).cast("long"))
    ys = F.sequence(F.floor(y0 / s).cast("long"), F.floor(y1 / s).cast("long"))
    return F.flatten(
        F.transform(xs, lambda i: F.transform(ys, lambda j: F.struct(i.alias("cx"), j.alias("cy"))))
    )


def box_join(
    left: DataFrame, right: DataFrame, left_box: Sequence[Column], right_box: Sequence[Column],
    size: float, extra: Sequence[str] = (), how: str = "inner",
) -> DataFrame:
    """Pairs whose boxes overlap, each pair once.

    Both sides are spread over the cells they touch; a pair is kept only in the
    first cell the two boxes share, so no distinct is needed afterwards.
    """
    lb = [c.alias(n) for c, n in zip(left_box, ("__lx0", "__ly0", "__lx1", "__ly1"))]
    rb = [c.alias(n) for c, n in zip(right_box, ("__rx0", "__ry0", "__rx1", "__ry1"))]
    le = left.select("*", *lb)
    le = le.select("*", F.explode(cells_of_box(*[F.col(n) for n in ("__lx0", "__ly0", "__lx1", "__ly1")], size)).alias("__cell"))
    re = right.select("*", *rb)
    re = re.select("*", F.explode(cells_of_box(*[F.col(n) for n in ("__rx0", "__ry0", "__rx1", "__ry1")], size)).alias("__cell"))
    out = le.join(re.hint("merge"), ["__cell", *extra], how)
    s = F.lit(float(size))
    overlap = (
        (F.col("__lx0") <= F.col("__rx1")) & (F.col("__rx0") <= F.col("__lx1"))
        & (F.col("__ly0") <= F.col("__ry1")) & (F.col("__ry0") <= F.col("__ly1"))
    )
    first = (F.col("__cell.cx") == F.floor(F.greatest("__lx0", "__rx0") / s)) & (
        F.col("__cell.cy") == F.floor(F.greatest("__ly0", "__ry0") / s)
    )
    return out.where(overlap & first).drop(
        "__cell", "__lx0", "__ly0", "__lx1", "__ly1", "__rx0", "__ry0", "__rx1", "__ry1"
    )


def point_pairs_within(
    left: DataFrame, right: DataFrame, lx: str, ly: str, rx: str, ry: str, r: float,
    extra: Sequence[str] = (), dist: str = "dist", split: int = 1,
) -> DataFrame:
    """Pairs of points at most ``r`` apart: right points sit in one cell of ``r / split``, left ones look at the cells around.

    ``split``: 1 looks at 3 x 3 cells; 2 at 5 x 5 smaller ones, for few left points that each meet many.
    """
    steps = range(-split, split + 1)
    around = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in steps for j in steps])
    s = F.lit(float(r) / split)
    le = left.select("*", F.explode(around).alias("__o")).select(
        *left.columns,
        (F.floor(F.col(lx) / s) + F.col("__o.dx")).cast("long").alias("__cx"),
        (F.floor(F.col(ly) / s) + F.col("__o.dy")).cast("long").alias("__cy"),
    )
    re = right.select(
        "*", F.floor(F.col(rx) / s).cast("long").alias("__cx"), F.floor(F.col(ry) / s).cast("long").alias("__cy")
    )
    out = le.join(re.hint("merge"), ["__cx", "__cy", *extra]).drop("__cx", "__cy")
    dx, dy = F.col(lx) - F.col(rx), F.col(ly) - F.col(ry)
    near = out.where(dx * dx + dy * dy <= float(r) ** 2 * (1 + 1e-9))  # hypot is exact and costly
    return near.withColumn(dist, F.hypot(dx, dy)).where(F.col(dist) <= F.lit(float(r)))


def open_radius(points: DataFrame, x: str, y: str, r: float, most: int = 16) -> float:
    """A search radius up to ``r`` such that no cell of that size holds more than ``most`` of the points.

    A search that starts there and doubles meets a bounded number of points at a time, however dense they lie.
    """
    least = r / 2**20
    while r > least:
        s = F.lit(float(r))
        held = points.groupBy(F.floor(F.col(x) / s).alias("cx"), F.floor(F.col(y) / s).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
        n = held.agg(F.max("n")).first()[0] or 0
        if n <= most:
            break
        r /= max(2.0, (n / most) ** 0.5)
    return r


def interval_bins(start: Column, end: Column, width: float) -> Column:
    """Bins of ``width`` touched by the closed interval [start, end]."""
    w = F.lit(float(width))
    return F.sequence(F.floor(start / w).cast("long"), F.floor(end / w).cast("long"))
