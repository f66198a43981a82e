"""Percentiles, composite indices, equity tables and profiles over cells, stops and blocks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.spatial import SQFT_PER_SQMI
from kerbline.plans.ranks import exact_percentiles, rank_many, with_rank_columns
from kerbline.plans.series import with_running
from kerbline.plans.spine import safe_ratio
from kerbline.session import materialize


def _avg_rank_pct() -> Column:
    """Percentile rank with average ties, in percent."""
    return 100.0 * (F.col("below") + (F.col("n") + 1) / 2) / F.col("total")


def pctile_cume(df: DataFrame, key: str, columns: Sequence[str], only_defined: bool = False) -> DataFrame:
    """100 x cumulative distribution of each column over all rows.

    NULLs sort last and count, so they get 100; with ``only_defined`` they are left out and stay NULL.
    """
    ranked = rank_many(df, key, columns, F.struct((F.col("below") + F.col("n")).alias("upto"), F.col("total").alias("t")))
    rows = df.agg(F.count(F.lit(1)).alias("__rows"))
    j = df.select(key).join(ranked, key, "left").crossJoin(F.broadcast(rows))  # one row
    out = []
    for c in columns:
        upto = F.col(c).getField("upto")
        out.append((100.0 * upto / F.col(c).getField("t") if only_defined else F.coalesce(100.0 * upto / F.col("__rows"), F.lit(100.0))).alias(f"{c}_pctile"))
    return j.select(key, *out)


def pctile_avg(df: DataFrame, col: str, out: str, invert: bool = False) -> DataFrame:
    p = _avg_rank_pct()
    return with_rank_columns(df, col, {out: 100.0 - p if invert else p})


def minmax(df: DataFrame, col: str, out: str, invert: bool = False) -> DataFrame:
    """0-100 by smallest and largest value; a constant column maps to 50."""
    span = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    z = (F.col(col) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)) * 100.0
    z = F.when(F.col(col).isNotNull(), F.coalesce(100.0 - z if invert else z, F.lit(50.0)))
    return df.crossJoin(F.broadcast(span)).withColumn(out, z).drop("__lo", "__hi")  # one row


def good_percentile(percentile: Column, lower_is_better: bool) -> Column:
    return 100.0 - percentile if lower_is_better else percentile


def composite_index(df: DataFrame, key: str, spec: Mapping[str, tuple[str, bool]], weights: Mapping[str, float]) -> DataFrame:
    """Percentile subscores, their weighted and plain mean, overall rank and percentile.

    ``spec``: subscore -> (input column, lower is better).
    """
    src = materialize(df.select(key, *[F.col(c).cast("double").alias(name) for name, (c, _) in spec.items()]), "index-inputs")
    ranked = rank_many(src, key, list(spec), _avg_rank_pct())
    sub = ranked.select(key, *[F.round(100.0 - F.col(n) if inv else F.col(n), 2).alias(n) for n, (_, inv) in spec.items()])
    total = sum((F.col(n) * F.lit(w) for n, w in weights.items()), F.lit(0.0))
    plain = sum((F.col(n) for n in spec), F.lit(0.0)) / len(spec)
    sub = sub.withColumns({"score": F.round(total, 2), "score_equal_weight": F.round(plain, 2)})
    rank = {"score_rank": F.col("total") - F.col("below") - F.col("n") + 1, "score_pctile": F.round(_avg_rank_pct(), 1)}
    return with_rank_columns(materialize(sub, "subscores"), "score", rank)


def index_league(df: DataFrame, score: str, key: str, n: int = 50) -> DataFrame:
    best = df.orderBy(F.desc_nulls_last(score), key).limit(n).withColumn("side", F.lit("best"))
    return best.unionByName(df.orderBy(F.asc_nulls_last(score), F.desc(key)).limit(n).withColumn("side", F.lit("worst")))


def index_summary(df: DataFrame, area: str, score: str, flags: Sequence[str]) -> DataFrame:
    """Mean and median score per area and the share of rows where each amenity is present."""
    g = df.groupBy(area).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(score).alias("score_mean"),
                             *[(F.avg(F.when(F.col(c) > 0, 1.0).otherwise(0.0)) * 100).alias(f"pct_{c}") for c in flags])
    return g.join(exact_percentiles(df, [area], score, {"score_median": 0.5}).drop("n"), area, "left")


def amenity_share(df: DataFrame, flag: str, column: str) -> DataFrame:
    return df.groupBy(flag).agg((100 * F.avg(F.when(F.col(column) > 0, 1.0).otherwise(0.0))).alias("share_pct"), F.count(F.lit(1)).alias("n"))


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson and Spearman coefficients over rows where both are known; null where a side is constant."""
    def corr(x, y):
        return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))

    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    avg_rank = F.col("below") + (F.col("n") + 1) / 2
    ra = with_rank_columns(with_rank_columns(d, "a", {"ra": avg_rank}), "b", {"rb": avg_rank})
    return ra.agg(corr("a", "b").alias("pearson"), corr("ra", "rb").alias("spearman"), F.count(F.lit(1)).alias("n"))


def width_agreement(matched: DataFrame, measured: str, published: str, dist: str, least: int = 30) -> DataFrame:
    """How well measured values agree with those published for the line matched: pairs, coefficients and medians, in one row.

    With fewer than ``least`` pairs the coefficients are null.
    """
    both = matched.where(F.col(measured).isNotNull() & F.col(published).isNotNull()).select(measured, published, dist)
    both = materialize(both, "agreement")
    out = correlation(both, measured, published).select(
        F.col("n").alias("n_matched"), *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("pearson", "spearman")])
    for name, c in (("median_dist_ft", dist), ("median_measured_ft", measured), ("median_published_ft", published)):
        # one row meets one row
        out = out.crossJoin(exact_percentiles(both, [], c, {name: 0.5}).select(name))
    return out


def condition_index(areas: DataFrame, counts: Sequence[str], length: str, extra: Sequence[str] = ()) -> DataFrame:
    """Densities per mile, z-scores over areas and their null-skipping mean; areas are a short table."""
    dens = {f"{c}_per_mi": safe_ratio(F.col(c), F.col(length)) for c in counts}
    d = areas.withColumns(dens)
    names = [*dens, *extra]
    stats = d.agg(*[f(c).alias(f"__{t}_{c}") for c in names for t, f in (("m", F.avg), ("s", F.stddev_samp))])
    j = d.crossJoin(F.broadcast(stats))  # one row
    z = [(F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0)) for c in names]
    known = sum((x.isNotNull().cast("int") for x in z), F.lit(0))
    total = sum((F.coalesce(x, F.lit(0.0)) for x in z), F.lit(0.0))
    return j.withColumn("condition_z", total / F.nullif(known, F.lit(0))).select(*areas.columns, *dens, "condition_z")


# ------------------------------------------------------------------ equity
def quintile_equity(blocks: DataFrame, k: int = 5) -> DataFrame:
    """Provision by income quantile of populated blocks; edges are exact, right closed."""
    b = blocks.where(F.col("income").isNotNull() & (F.col("pop") > 0))
    cuts = exact_percentiles(b, [], "income", {f"__e{i}": i / k for i in range(1, k)}).drop("n")
    j = b.crossJoin(F.broadcast(cuts))  # one row
    q = F.lit(1) + sum(((F.col("income") > F.col(f"__e{i}")).cast("int") for i in range(1, k)), F.lit(0))
    return j.groupBy(q.alias("income_q")).agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum("pop").alias("population"), F.min("income").alias("income_low"), F.max("income").alias("income_high"),
        (F.sum(F.coalesce("coverage_ratio_ft", F.lit(0.0)) * F.col("pop")) / F.sum("pop")).alias("mean_coverage_ratio_ft"),
        (F.sum("sidewalk_area_sqft") / F.sum("pop")).alias("sqft_per_capita"),
        (100 * F.avg(F.when(F.col("sidewalk_area_sqft") == 0, 1.0).otherwise(0.0))).alias("pct_zero_blocks"))


def area_provision(blocks: DataFrame, area: str) -> DataFrame:
    """Blocks rolled up to areas."""
    g = blocks.where(F.col(area).isNotNull()).groupBy(area).agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum("sidewalk_area_sqft").alias("sidewalk_area_sqft"), F.sum("perimeter_ft").alias("frontage_ft"), F.sum("pop").alias("total_pop"))
    m = exact_percentiles(blocks.where(F.col(area).isNotNull()), [area], "income", {"med_income": 0.5}).drop("n")
    return g.join(m, area, "left").withColumns({"coverage_ratio_ft": safe_ratio(F.col("sidewalk_area_sqft"), F.col("frontage_ft")), "sqft_per_capita": safe_ratio(F.col("sidewalk_area_sqft"), F.col("total_pop"))})


def provision_gaps(blocks: DataFrame, min_pop: int = 50) -> DataFrame:
    """Populated blocks without any provision."""
    return blocks.where((F.col("pop") >= min_pop) & (F.col("sidewalk_area_sqft") == 0))


def weighted_bucket(df: DataFrame, value: str, weight: str, key: str, k: int = 10, prefix: int = 12) -> DataFrame:
    """Bucket 1..k by cumulative weight in order of (value, key).

    The weight below a value comes from value positions; ties run in key order inside
    key-prefix chunks, so even a value shared by very many rows is split.
    """
    d = df.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    d = with_rank_columns(d, value, {"__below": F.col("below"), "__total": F.col("total")}, weight=weight)
    d = with_running(d, [value], [key], F.substring(key, 1, prefix), weight, "__run")
    share = (F.col("__below") + F.col("__run")) / F.col("__total") * k
    return d.withColumn("bucket", (F.floor(F.least(share, F.lit(k - 0.0001))) + 1).cast("int")).drop("__below", "__total", "__run")


def weighted_deciles(df: DataFrame, value: str, weight: str, key: str, measure: str, flag: str) -> DataFrame:
    """Weighted income deciles with weighted access."""
    b = weighted_bucket(df, value, weight, key)
    w = F.col(weight)
    return b.groupBy(F.col("bucket").alias("income_decile")).agg(
        F.min(value).alias("income_low"), F.max(value).alias("income_high"), F.sum(w).cast("long").alias("population"), F.count(F.lit(1)).alias("n_blocks"),
        (F.sum(F.col(measure) * w) / F.sum(w)).alias("mean_jobs_reachable"), (F.sum(F.col(flag).cast("double") * w) / F.sum(w)).alias("frequent_access_share"))


def density(df: DataFrame, area: str, pop: str, sqft: str) -> DataFrame:
    """People per square mile of each area: ratio of sums."""
    g = df.where(F.col(sqft) > 0).groupBy(area).agg(F.sum(pop).alias("pop"), (F.sum(sqft) / SQFT_PER_SQMI).alias("land_sqmi"))
    return g.withColumn("pop_density_sqmi", safe_ratio(F.col("pop"), F.col("land_sqmi")))


def top_flows(od: DataFrame, n: int = 100, hour: int | None = None) -> DataFrame:
    """Largest origin-destination flows, within one hour or all day; trips inside one place are left out."""
    o = od if hour is None else od.where(F.col("hour_of_day") == hour)
    g = o.where(F.col("origin") != F.col("destination")).groupBy("origin", "destination").agg(F.round(F.sum("riders"), 1).alias("est_avg_riders"))
    return g.orderBy(F.desc("est_avg_riders"), "origin", "destination").limit(n)


def exposure_gradient(segs: DataFrame, rank: str, count: str) -> DataFrame:
    return segs.groupBy(rank).agg(F.count(F.lit(1)).alias("n_segments"), F.sum(count).alias("total"), F.avg(count).alias("mean_per_segment"))


def worst_segments(segs: DataFrame, count: str, key: str, n: int = 50) -> DataFrame:
    return segs.orderBy(F.desc(count), key).limit(n)


def reachable_sum(cover: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs in the cells each origin reaches, and their share of all jobs.

    ``cover``: ox, oy, nx, ny.  ``jobs``: one row per cell (nx, ny, jobs).
    """
    total = jobs.agg(F.sum("jobs").alias("__all"))
    g = cover.join(jobs, ["nx", "ny"], "left").groupBy("ox", "oy").agg(F.coalesce(F.sum("jobs"), F.lit(0)).alias("jobs_reachable"), F.count(F.lit(1)).alias("n_cells"))
    return g.crossJoin(F.broadcast(total)).select("ox", "oy", "jobs_reachable", "n_cells", safe_ratio(F.col("jobs_reachable"), F.col("__all")).alias("jobs_reachable_pct"))  # one row


def inherit_parent(blocks: DataFrame, grid: DataFrame, acs: DataFrame) -> DataFrame:
    """Blocks take the metric of their parent cell and the income of their block group (negative = unknown)."""
    a = acs.select("bg_geoid", F.when(F.col("med_income") >= 0, F.col("med_income")).alias("med_income"))
    return blocks.withColumn("bg_geoid", F.substring("geoid", 1, 12)).join(grid, ["px", "py"], "left").join(a, "bg_geoid", "left")


# ------------------------------------------------------------------ wide cells and profiles
def assemble_cells(cells: DataFrame, base: DataFrame, quality: DataFrame, flood: DataFrame) -> DataFrame:
    """Stage tables side by side with zero fill and rates where they are defined."""
    on = ["cx", "cy"]
    j = cells.join(base, on).join(quality, on, "left").join(flood, on, "left")
    counts = [c for c in quality.columns if c not in on]
    flags = [c for c in flood.columns if c not in on]
    return j.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts} | {c: F.coalesce(c, F.lit(False)) for c in flags}).withColumn(
        "rodent_fail_rate", F.when(F.col("insp") > 0, F.col("fail") / F.col("insp")))


def profiles(points: DataFrame, grid: DataFrame, key: str, size: float, rings: int = 4) -> DataFrame:
    """Grid row of each location: its own cell, else the nearest filled cell of the closest ring.

    A location without coordinates, or without a filled cell within ``rings``, stays with null cell, ring and values.
    """
    offs = [(i, j, max(abs(i), abs(j))) for i in range(-rings, rings + 1) for j in range(-rings, rings + 1)]
    around = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit(k).alias("ring")) for i, j, k in sorted(offs, key=lambda o: o[2])])
    p = points.withColumns({"c0": F.floor(F.col("x") / size).cast("long"), "c1": F.floor(F.col("y") / size).cast("long")})
    own = p.join(grid, (F.col("c0") == F.col("cx")) & (F.col("c1") == F.col("cy")))
    vals = [c for c in grid.columns if c not in ("cx", "cy")]
    exact = own.select(key, "cx", "cy", F.lit(0).alias("ring"), *vals)
    rest = p.join(exact.select(key), key, "left_anti").select(key, "x", "y", "c0", "c1", F.explode(around).alias("o")).where(F.col("o.ring") > 0)
    rest = rest.select(key, "x", "y", (F.col("c0") + F.col("o.dx")).alias("cx"), (F.col("c1") + F.col("o.dy")).alias("cy"), "o.ring").join(grid.withColumn("__filled", F.lit(True)), ["cx", "cy"], "left")
    d2 = F.hypot((F.col("cx") + 0.5) * size - F.col("x"), (F.col("cy") + 0.5) * size - F.col("y"))
    best = rest.groupBy(key).agg(F.min_by(F.struct("cx", "cy", "ring", *vals), F.when(F.col("__filled"), F.struct("ring", d2.alias("d"), "cx", "cy"))).alias("b")).select(key, "b.*")
    return exact.unionByName(best)


def compare(profile: DataFrame, pairs: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Two locations side by side with the difference of each column."""
    a = profile.select(F.col(key).alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = profile.select(F.col(key).alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in columns])
    j = pairs.join(a, "a_id").join(b, "b_id")
    return j.withColumns({f"diff_{c}": F.col(f"b_{c}") - F.col(f"a_{c}") for c in columns})
