"""Differences between two schedule versions, as one table of change records.

Both versions go through the same aggregates; every comparison is a join on the
aggregate keys, never on raw stop times.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.functions.clock import hhmm
from kerbline.functions.planar import haversine_m
from kerbline.operators import supply as S
from kerbline.session import materialize

# Thresholds of a reportable change.
HEADWAY_FLAG_PCT = 10.0
SPAN_FLAG_MIN = 5.0
RELOCATE_M = 25.0

# Order of the text log.
CHANGE_ORDER = ["route_added", "route_removed", "headway_delta", "service_span_change", "trip_count_delta",
                "stop_added", "stop_removed", "stop_relocated", "shape_change"]


def set_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys only in ``b`` ('added') and only in ``a`` ('removed')."""
    added = b.join(a.select(key), key, "left_anti").withColumn("side", F.lit("added"))
    removed = a.join(b.select(key), key, "left_anti").withColumn("side", F.lit("removed"))
    return added.unionByName(removed)


def _route_list(v):
    return v["routes"].select("route_id", F.col("route_short_name").alias("route_name")).groupBy("route_id").agg(F.min("route_name").alias("route_name"))


def diff_routes(a: dict, b: dict) -> DataFrame:
    return set_diff(_route_list(a), _route_list(b), "route_id")


def diff_stops(a: dict, b: dict) -> DataFrame:
    return set_diff(a["stops"].select("stop_id", "stop_name"), b["stops"].select("stop_id", "stop_name"), "stop_id")


def _trip_counts(v):
    return _route_list(v).join(v["trips"].groupBy("route_id").agg(F.count(F.lit(1)).alias("n")), "route_id", "left").select(
        "route_id", "route_name", F.coalesce("n", F.lit(0)).alias("n"))


def diff_trip_counts(a: dict, b: dict) -> DataFrame:
    ca = _trip_counts(a).select("route_id", F.col("n").alias("from_trips"))
    cb = _trip_counts(b).select("route_id", "route_name", F.col("n").alias("to_trips"))
    pct = F.when(F.col("from_trips") > 0, F.round((F.col("to_trips") - F.col("from_trips")) / F.col("from_trips") * 100, 1))
    return ca.join(cb, "route_id").where("from_trips <> to_trips").withColumns(
        {"pct": pct, "magnitude": (F.col("to_trips") - F.col("from_trips")).cast("double")})


def _with_period(v):
    return S.trip_periods(v["trips"], v["calendar"], v["calendar_dates"])


def _visits(v):
    return v["visits"] if "visits" in v else S.visits(v["stop_times"], _with_period(v))


def prepared(v: dict) -> dict:
    """The version with its visits written, so that its stop times are joined with its trips once, however many comparisons follow."""
    return v if "visits" in v else {**v, "visits": materialize(_visits(v), "visits")}


def diff_headways(a: dict, b: dict, flag_pct: float = HEADWAY_FLAG_PCT) -> DataFrame:
    ha = S.headways_of_visits(_visits(a)).withColumnRenamed("headway_min", "from_headway_min")
    hb = S.headways_of_visits(_visits(b)).withColumnRenamed("headway_min", "to_headway_min")
    raw = (F.col("to_headway_min") - F.col("from_headway_min")) / F.col("from_headway_min") * 100
    j = ha.join(hb, ["route_id", "service_period", "tod_window", "direction_id"]).where((F.col("from_headway_min") > 0) & (F.abs(raw) > flag_pct))
    return j.join(_route_list(b), "route_id", "left").withColumns(
        {"pct": F.round(raw, 1), "magnitude": F.round(raw, 1), "route_name": F.coalesce("route_name", "route_id")})


def diff_spans(a: dict, b: dict, flag_min: float = SPAN_FLAG_MIN) -> DataFrame:
    sa = S.spans_of_visits(_visits(a)).withColumnsRenamed({"first_sec": "a0", "last_sec": "a1"})
    sb = S.spans_of_visits(_visits(b)).withColumnsRenamed({"first_sec": "b0", "last_sec": "b1"})
    d0, d1 = (F.col("b0") - F.col("a0")) / 60.0, (F.col("b1") - F.col("a1")) / 60.0
    j = sa.join(sb, ["route_id", "service_period"]).where((F.abs(d0) > flag_min) | (F.abs(d1) > flag_min))
    return j.join(_route_list(b), "route_id", "left").select(
        "route_id", F.coalesce("route_name", "route_id").alias("route_name"), "service_period",
        hhmm(F.col("a0")).alias("from_first"), hhmm(F.col("b0")).alias("to_first"),
        hhmm(F.col("a1")).alias("from_last"), hhmm(F.col("b1")).alias("to_last"),
        F.round(d0, 1).alias("d_first_min"), F.round(d1, 1).alias("d_last_min"),
        F.round(F.greatest(F.abs(d0), F.abs(d1)), 1).alias("magnitude"),
    )


def diff_stop_moves(a: dict, b: dict, metres: float = RELOCATE_M) -> DataFrame:
    sa = a["stops"].select("stop_id", F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    j = sa.join(b["stops"], "stop_id")
    d = haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat"), F.col("lon"))
    return j.withColumn("d", d).where(F.col("d") > metres).select("stop_id", "stop_name", F.round("d", 1).alias("meters"), F.round("d", 1).alias("magnitude"))


def diff_shapes(a: dict, b: dict) -> DataFrame:
    ta = a["trips"].select("trip_id", F.col("shape_id").alias("shape_a"), F.col("route_id").alias("route_a"))
    j = ta.join(b["trips"].select("trip_id", "shape_id", "route_id"), "trip_id").where("not (shape_id <=> shape_a)")
    g = j.groupBy(F.coalesce("route_id", "route_a").alias("route_id")).agg(F.count(F.lit(1)).alias("trips_with_new_shape"))
    return g.join(_route_list(b), "route_id", "left").withColumns(
        {"route_name": F.coalesce("route_name", "route_id"), "magnitude": F.col("trips_with_new_shape").cast("double")})


def _json_value(c: Column, kind: str) -> Column:
    if kind == "s":
        text = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\\\\\"), '"', r'\\\\"'), F.lit('"'))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null"))


def _record(df: DataFrame, change_type, detail: dict[str, str]) -> DataFrame:
    """Uniform change record; ``detail`` maps field -> 's' (text), 'i' (whole) or 'd' (double)."""
    names = sorted(detail)
    pieces = []
    for i, n in enumerate(names):
        pieces += [F.lit(("" if i == 0 else ", ") + f'"{n}": '), _json_value(F.col(n), detail[n])]
    kv = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("string") for n in names]))
    route = F.col("route_id") if "route_id" in df.columns else F.lit(None).cast("string")
    magnitude = F.col("magnitude") if "magnitude" in df.columns else F.lit(None).cast("double")
    kind = change_type if isinstance(change_type, Column) else F.lit(change_type)
    return df.select(kind.alias("change_type"), route.alias("route_id"), kv.alias("detail"),
                     F.concat(F.lit("{"), *pieces, F.lit("}")).alias("detail_json"), magnitude.alias("magnitude"))


def gtfs_diff(a: dict, b: dict, feed: str, from_ts: str, to_ts: str) -> DataFrame:
    """All change records between two versions of a feed."""
    a, b = prepared(a), prepared(b)
    headway = diff_headways(a, b).withColumn("direction", F.col("direction_id"))
    parts = [
        _record(diff_routes(a, b), F.concat(F.lit("route_"), F.col("side")), {"route_name": "s"}),
        _record(diff_trip_counts(a, b), "trip_count_delta", {"route_name": "s", "from_trips": "i", "to_trips": "i", "pct": "d"}),
        _record(headway, "headway_delta", {"route_name": "s", "service_period": "s", "tod_window": "s", "direction": "i",
                                           "from_headway_min": "d", "to_headway_min": "d", "pct": "d"}),
        _record(diff_spans(a, b), "service_span_change", {"route_name": "s", "service_period": "s", "from_first": "s", "to_first": "s",
                                                          "from_last": "s", "to_last": "s", "d_first_min": "d", "d_last_min": "d"}),
        _record(diff_stops(a, b), F.concat(F.lit("stop_"), F.col("side")), {"stop_id": "s", "stop_name": "s"}),
        _record(diff_stop_moves(a, b), "stop_relocated", {"stop_id": "s", "stop_name": "s", "meters": "d"}),
        _record(diff_shapes(a, b), "shape_change", {"route_name": "s", "trips_with_new_shape": "i"}),
    ]
    out = reduce(lambda x, y: x.unionByName(y), parts)
    return out.select(F.lit(feed).alias("feed"), F.lit(from_ts).alias("from_ts"), F.lit(to_ts).alias("to_ts"), *out.columns)


def diff_summary(deltas: DataFrame) -> DataFrame:
    """Counts by type with the position each type takes in the text log."""
    order = F.array_position(F.array(*[F.lit(c) for c in CHANGE_ORDER]), F.col("change_type"))
    return deltas.groupBy("feed", "from_ts", "to_ts", "change_type").agg(F.count(F.lit(1)).alias("n")).withColumn("log_order", order.cast("int"))


def pending_pairs(index: DataFrame, done: DataFrame) -> DataFrame:
    """Consecutive snapshots of each feed that have no diff yet; the index has one row per snapshot."""
    pairs = index.select("feed", F.lag("ts").over(W.partitionBy("feed").orderBy("ts")).alias("from_ts"), F.col("ts").alias("to_ts"))
    return pairs.where(F.col("from_ts").isNotNull()).join(done, ["feed", "from_ts", "to_ts"], "left_anti")
