"""From vehicle positions to trajectories, stop crossings and along-route speeds.

Input ``pings``: trip_id, route_id, direction_id, vehicle_id, stop_id, ts (epoch s), offset_ft, event_id.
All series steps run inside (key, hour) chunks; see ``plans.series``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.functions.planar import MPS_TO_MPH, haversine_m
from kerbline.plans.ranks import exact_percentiles
from kerbline.plans.proximity import interval_bins
from kerbline.plans.series import null_safe_join, with_neighbour, with_running
from kerbline.session import materialize

# Thresholds of the derivation.
RESAMPLE_S = 30
MONO_BACKTRACK_FT = 500.0
SEG_BIN_FT = 2640.0
SPEED_MIN_FPS = 1.0
SPEED_MAX_FPS = 90.0
SPEED_DEFAULT_FPS = 12.0
SPEED_MPH_CAP = 80.0
OFF_SHAPE_FT = 200.0
STALE_S = 40.0
DECAY_S = 45.0

CHUNK_S = 3600


def hour_chunk(ts: str = "ts") -> Column:
    return F.floor(F.col(ts) / CHUNK_S)


def dedupe_pings(pings: DataFrame) -> DataFrame:
    """One row per (trip, second): the one with the smallest event id, as a mergeable aggregate."""
    rest = [c for c in pings.columns if c not in ("trip_id", "ts")]
    best = pings.groupBy("trip_id", "ts").agg(F.min_by(F.struct(*rest), "event_id").alias("r"))
    return best.select("trip_id", "ts", "r.*")


def monotonic(pings: DataFrame, tolerance: float = MONO_BACKTRACK_FT) -> DataFrame:
    """Flag points more than ``tolerance`` behind the furthest earlier point.

    A dropped point lies behind the running maximum, so it can never raise it: the
    maximum over all earlier points is the maximum over the kept ones.
    ``offset_mono`` is the running maximum including the point itself.
    """
    w = with_running(pings, ["trip_id"], ["ts"], hour_chunk(), "offset_ft", "before_max", how="max", inclusive=False)
    keep = F.col("before_max").isNull() | (F.col("offset_ft") >= F.col("before_max") - F.lit(tolerance))
    return w.withColumns({"keep": keep, "offset_mono": F.greatest("offset_ft", F.coalesce("before_max", "offset_ft"))})


def resample(kept: DataFrame, step: int = RESAMPLE_S, keys: tuple[str, ...] = ("trip_id",)) -> DataFrame:
    """Linear interpolation on a regular time grid; trips with fewer than two points vanish.

    Every pair of neighbouring points produces its own grid points, so a trip is
    never gathered in one place.
    """
    carry = [c for c in ("route_id", "direction_id", "shape_id") if c in kept.columns]
    p = kept.select(*keys, *carry, "ts", F.col("offset_mono").alias("o"))
    p = with_neighbour(p, list(keys), ["ts"], hour_chunk(), prev={"t_prev": "ts"}, next={"t1": "ts", "o1": "o"})
    first = F.ceil(F.col("ts") / step) * step
    stop = (F.ceil(F.col("t1") / step) - 1) * step
    inner = F.when(F.col("t1").isNotNull() & (first <= stop), F.sequence(first, stop, F.lit(step).cast("long")))
    last = F.when(F.col("t1").isNull() & F.col("t_prev").isNotNull() & (F.col("ts") % step == 0), F.array(F.col("ts")))
    g = p.select(*keys, *carry, "ts", "o", "t1", "o1", F.explode(F.coalesce(inner, last)).alias("g"))
    at = F.col("o") + F.coalesce((F.col("o1") - F.col("o")) * (F.col("g") - F.col("ts")) / (F.col("t1") - F.col("ts")), F.lit(0.0))
    return g.select(*keys, *carry, F.col("g").alias("ts"), at.alias("offset_ft"))


def crossings(traj: DataFrame, stop_offsets: DataFrame, on: list[str], width: float = 1000.0) -> DataFrame:
    """Interpolated time at which each trip first reaches each stop offset.

    The bracketing search is an equi join on offset bins: each trajectory step
    (o0, o1] meets only the stops in the bins it touches.
    """
    seg = with_neighbour(traj, ["trip_id"], ["ts"], hour_chunk(), {"t0": "ts", "o0": "offset_ft"})
    seg = seg.where(F.col("o0") < F.col("offset_ft")).select(
        "trip_id", *[c for c in ("route_id", "direction_id") if c in traj.columns], *[c for c in on if c not in ("route_id", "direction_id")],
        "t0", "o0", F.col("ts").alias("t1"), F.col("offset_ft").alias("o1"),
    )
    seg = seg.withColumn("b", F.explode(interval_bins(F.col("o0"), F.col("o1"), width)))
    s = stop_offsets.withColumn("b", F.floor(F.col("stop_offset_ft") / width).cast("long"))
    hit = seg.join(s, [*on, "b"]).where((F.col("o0") < F.col("stop_offset_ft")) & (F.col("stop_offset_ft") <= F.col("o1")))
    frac = (F.col("stop_offset_ft") - F.col("o0")) / (F.col("o1") - F.col("o0"))
    keep = ["trip_id", *[c for c in ("route_id", "direction_id") if c in seg.columns], "stop_id"]
    when = F.floor(F.col("t0") + frac * (F.col("t1") - F.col("t0")))
    return hit.groupBy(*keep).agg(F.min(when).cast("long").alias("arr_ts"))


def first_seen_arrivals(pings: DataFrame, primary: DataFrame) -> DataFrame:
    """Earliest report per (trip, stop) for trips without a primary result."""
    rest = pings.where(F.col("trip_id").isNotNull() & F.col("stop_id").isNotNull()).join(primary.select("trip_id").distinct(), "trip_id", "left_anti")
    return rest.groupBy("trip_id", "stop_id").agg(
        F.min("route_id").alias("route_id"), F.min("direction_id").alias("direction_id"), F.min("ts").alias("arr_ts")
    ).withColumn("method", F.lit("first_seen"))


def along_shape_speed(traj: DataFrame, lo: float = SPEED_MIN_FPS, hi: float = SPEED_MAX_FPS) -> DataFrame:
    """Feet per second between consecutive samples, inside the sane band."""
    p = with_neighbour(traj, ["trip_id"], ["ts"], hour_chunk(), {"t0": "ts", "o0": "offset_ft"})
    fps = (F.col("offset_ft") - F.col("o0")) / F.nullif(F.col("ts") - F.col("t0"), F.lit(0))
    return p.withColumn("speed_fps", fps).where(F.col("speed_fps").between(lo, hi)).drop("t0", "o0")


def speed_table(speeds: DataFrame, bin_ft: float = SEG_BIN_FT) -> DataFrame:
    """Median speed per route x direction x half-mile bin, per route, and overall, tagged by ``level``.

    Speeds are real numbers, so the medians come from value positions: no group,
    not even the citywide one, is gathered in one task.
    """
    s = speeds.where(F.col("direction_id").isNotNull()).withColumn("seg_bin", F.floor(F.col("offset_ft") / bin_ft).cast("int"))
    seg = exact_percentiles(s, ["route_id", "direction_id", "seg_bin"], "speed_fps", {"median_fps": 0.5}, bins=16).withColumn("level", F.lit("segment"))
    route = exact_percentiles(s, ["route_id"], "speed_fps", {"median_fps": 0.5}).withColumn("level", F.lit("route"))
    city = exact_percentiles(s, [], "speed_fps", {"median_fps": 0.5}).withColumn("level", F.lit("city"))
    return seg.unionByName(route, allowMissingColumns=True).unionByName(city, allowMissingColumns=True)


def segment_speed_from_pings(pings: DataFrame) -> DataFrame:
    """Straight-line speeds between consecutive reports of a trip, per stop pair, date and hour."""
    p = pings.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    p = with_neighbour(p, ["feed", "trip_id"], ["ts", "event_id"], hour_chunk(), {"plat": "lat", "plon": "lon", "pts": "ts", "from_stop": "stop_id"})
    dist = haversine_m(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"))
    p = p.where(F.col("pts").isNotNull()).withColumns({"dist_m": dist, "dt_s": F.col("ts") - F.col("pts")})
    p = p.where(F.col("dt_s").between(1, 900) & (F.col("dist_m") > 0)).withColumn("mph", F.col("dist_m") / F.col("dt_s") * MPS_TO_MPH)
    at = F.timestamp_seconds("ts")
    return p.where(F.col("mph") < SPEED_MPH_CAP).groupBy(
        "feed", "route_id", "direction_id", "from_stop", F.col("stop_id").alias("to_stop"),
        F.date_format(at, "yyyy-MM-dd").alias("date"), F.hour(at).alias("hour"),
    ).agg(
        F.count(F.lit(1)).alias("n_segments"), F.median("mph").alias("median_mph"), F.avg("mph").alias("mean_mph"),
        F.sum("dist_m").alias("total_dist_m"), F.sum("dt_s").alias("total_time_s"),
    )


# ------------------------------------------------------------------ live motion
def latest_two(pings: DataFrame, within_s: int = 120) -> DataFrame:
    """Latest and previous report of each vehicle among those seen in the last N seconds of the feed.

    One scan: every task keeps the two newest reports of each vehicle (a limit inside the window's groups), so two rows per vehicle
    and task are shuffled; the horizon comes from those.
    """
    payload = ["trip_id", "route_id", "direction_id", "stop_id", "ts", "event_id", "lat", "lon", "x_ft", "y_ft", "offset_ft"]
    newest = W.partitionBy("vehicle_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    two = pings.where("ts is not null").select("vehicle_id", *payload).withColumn("__n", F.row_number().over(newest)).where("__n <= 2")
    nth = lambda n: F.max_by(F.struct(*payload), F.when(F.col("__n") == n, 1))
    both = materialize(two.groupBy("vehicle_id").agg(nth(1).alias("l"), nth(2).alias("p")), "newest")
    horizon = both.agg(F.max("l.ts").alias("__now"))
    near = both.crossJoin(F.broadcast(horizon)).where(F.col("l.ts") >= F.col("__now") - within_s)  # one row
    before = {"prev_ts": "ts", "prev_lat": "lat", "prev_lon": "lon", "prev_x": "x_ft", "prev_y": "y_ft", "prev_offset_ft": "offset_ft"}
    return near.select("vehicle_id", "l.*", *[F.col(f"p.{c}").alias(name) for name, c in before.items()])


def motion_guards(rows: DataFrame, perp: str = "perp_ft") -> DataFrame:
    """Off-shape and backward-jump flags; a point is kept on its shape only without either."""
    off = F.coalesce(F.col(perp) > OFF_SHAPE_FT, F.lit(False))
    back = ~off & F.coalesce(F.col("offset_ft") < F.col("prev_offset_ft") - MONO_BACKTRACK_FT, F.lit(False))
    return rows.withColumns({"off_shape": off, "non_monotonic": back, "keep_shape": F.col("offset_ft").isNotNull() & ~off & ~back})


def speed_estimate(vehicles: DataFrame, seg: DataFrame, route: DataFrame, lo: float = SPEED_MIN_FPS, hi: float = SPEED_MAX_FPS) -> DataFrame:
    """Observed speed, else the segment's, else the route's, else the default; with its basis."""
    dt = F.col("ts") - F.col("prev_ts")
    obs = F.hypot(F.col("x_ft") - F.col("prev_x"), F.col("y_ft") - F.col("prev_y")) / F.nullif(dt, F.lit(0))
    ok = (dt > 0) & (dt < 900) & obs.between(lo, hi)
    v = vehicles.withColumns({"obs_fps": F.when(ok, obs), "seg_bin": F.when(F.col("keep_shape"), F.floor(F.col("offset_ft") / SEG_BIN_FT).cast("int"))})
    v = null_safe_join(v, seg.select("route_id", "direction_id", "seg_bin", F.col("median_fps").alias("seg_fps")), ["route_id", "direction_id", "seg_bin"])
    v = v.join(route.select("route_id", F.col("median_fps").alias("route_fps")), "route_id", "left")
    basis = F.when(F.col("obs_fps").isNotNull(), "observed").when(F.col("seg_fps").isNotNull(), "segment").when(F.col("route_fps").isNotNull(), "route").otherwise("default")
    return v.select("vehicle_id", "route_id", F.coalesce("obs_fps", "seg_fps", "route_fps", F.lit(SPEED_DEFAULT_FPS)).alias("speed_est_fps"), basis.alias("speed_basis"))


def advance_ft(fps: Column, dt: Column) -> Column:
    """Distance since a report: speed held for 40 s, then falling linearly to zero over 45 s."""
    v = F.least(F.lit(SPEED_MAX_FPS), F.greatest(F.lit(0.0), F.coalesce(fps, F.lit(0.0))))
    held = F.least(F.greatest(dt, F.lit(0.0)), F.lit(STALE_S))
    ease = F.least(F.greatest(dt - STALE_S, F.lit(0.0)), F.lit(DECAY_S))
    return v * (held + ease - ease * ease / (2 * DECAY_S))


def prediction_error(pings: DataFrame, speed: str = "speed_fps") -> DataFrame:
    """Predicted minus observed next offset per route: median and 90th percentile of the size."""
    p = with_neighbour(pings, ["trip_id"], ["ts"], hour_chunk(), next={"t1": "ts", "o1": "offset_ft"}).where(F.col("t1").isNotNull())
    err = F.abs(F.col("offset_ft") + advance_ft(F.col(speed), (F.col("t1") - F.col("ts")).cast("double")) - F.col("o1"))
    p = p.select("route_id", err.alias("err_ft"))
    return exact_percentiles(p, ["route_id"], "err_ft", {"median_err_ft": 0.5, "p90_err_ft": 0.9})
