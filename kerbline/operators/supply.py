"""Scheduled service: weekday trips, headways, stop service, active services, route lists.

Schedule tables are text typed as published; ``typed_stop_times`` casts them once.
Arrival clocks are whole seconds of a service day, so any per-key table of
distinct seconds is bounded by the length of the day, whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.functions import clock
from kerbline.functions.codes import borough_from_route, route_norm
from kerbline.plans.series import with_neighbour
from kerbline.plans.spread import dealt

MAX_HEADWAY_S = 7_200
SEQ_CHUNK = 600
WORD = 62  # service sets told by the bits of one number
TRIP_STOPS = 8  # stop times of a trip, roughly: for the number of tasks only

WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def by_feed(keys: list[str], *tables: DataFrame) -> list[str]:
    """``keys``, with ``feed`` before them where all tables tell feeds apart: ids repeat between feeds."""
    return ["feed", *keys] if all("feed" in t.columns for t in tables) else list(keys)


def of_trips(st: DataFrame, trips: DataFrame, *cols: str) -> DataFrame:
    """Stop times with ``cols`` of their trip."""
    keys = by_feed(["trip_id"], st, trips)
    return st.join(trips.select(*keys, *[c for c in cols if c not in keys]), keys)


def typed_stop_times(st: DataFrame) -> DataFrame:
    return st.select(
        *by_feed(["trip_id", "stop_id"], st), F.col("stop_sequence").try_cast("long").alias("stop_seq"),
        clock.gtfs_seconds(F.col("arrival_time")).alias("sched_arr_sec"),
        clock.gtfs_seconds(F.col("departure_time")).alias("sched_dep_sec"),
    )


def least_row(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the least by its other columns, so repeats leave the same row on every run."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*[c if c in keys else F.col(f"__r.{c}") for c in df.columns])


def gtfs_index(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Typed projections of the text tables that later stages share."""
    out = {
        "trip_meta": least_row(raw["trips"].select(
            "feed", "trip_id", "route_id", F.col("direction_id").try_cast("int").alias("direction_id"), "service_id", "shape_id"
        ), ["feed", "trip_id"]),
        "stop_times": typed_stop_times(raw["stop_times"]),
        "routes": least_row(raw["routes"], ["feed", "route_id"]),
        "calendar": raw["calendar"],
        "calendar_dates": raw["calendar_dates"],
    }
    if "shape_points" in raw:
        out["shape_points"] = raw["shape_points"].where(F.col("x_ft").isNotNull() & F.col("y_ft").isNotNull())
    return out


# ------------------------------------------------------------------ weekday service, three rules
def named_weekday(include: str = "%weekday%", exclude: str = "%SDon%") -> Column:
    """Rule 1, for one service: named as weekday, no school-day variant."""
    s = F.col("service_id")
    return s.ilike(include) & ~s.ilike(exclude)


def weekday_services(trips: DataFrame, include: str = "%weekday%", exclude: str = "%SDon%") -> DataFrame:
    """Rule 1: every service named as weekday, without the school-day variants."""
    return trips.where(named_weekday(include, exclude)).select("feed", "service_id").distinct()


def representative_service(trips: DataFrame, include: str = "%Weekday%") -> DataFrame:
    """Rule 2: the busiest weekday service of each (feed, route); ties by service id."""
    n = trips.where(F.col("service_id").ilike(include)).groupBy("feed", "route_id", "service_id").agg(F.count(F.lit(1)).alias("n_trips"))
    best = n.groupBy("feed", "route_id").agg(F.min_by(F.struct("service_id", "n_trips"), F.struct(-F.col("n_trips"), "service_id")).alias("b"))
    return best.select("feed", "route_id", "b.service_id", "b.n_trips")


def active_services(calendar: DataFrame, dates: DataFrame, days: DataFrame) -> DataFrame:
    """Rule 3, for all days at once: (weekday flags in range or added) minus removed.

    ``days`` holds one row per calendar day, so the calendar fans out at most 7/7 per day.
    """
    d = days.select("day", F.date_format("day", "yyyyMMdd").alias("ymd"), F.weekday("day").alias("wd"))
    flags = calendar.select(
        "service_id", "start_date", "end_date", F.posexplode(F.array(*[F.col(c) for c in WEEKDAYS])).alias("wd", "on")
    ).where("on = '1'")
    base = flags.join(d, "wd").where((F.col("start_date") <= F.col("ymd")) & (F.col("end_date") >= F.col("ymd")))
    ex = dates.join(d, dates["date"] == d["ymd"])
    added = ex.where("exception_type = '1'").select("day", "service_id")
    removed = ex.where("exception_type = '2'").select("day", "service_id")
    return base.select("day", "service_id").union(added).distinct().join(removed, ["day", "service_id"], "left_anti")


def classify_service(calendar: DataFrame, dates: DataFrame) -> DataFrame:
    """weekday / saturday / sunday / other from the flags, else from most added dates."""
    flag = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0))
    wk = sum((flag(c) for c in WEEKDAYS[:5]), F.lit(0))
    sat, sun = flag("saturday") != 0, flag("sunday") != 0
    kind = F.when(wk >= 3, "weekday").when(sat & ~sun, "saturday").when(sun & ~sat, "sunday").otherwise("other")
    primary = calendar.select("service_id", kind.alias("k"))
    day = F.try_to_date("date", "yyyyMMdd")
    wd = F.weekday(day)
    bucket = F.when(wd == 5, "saturday").when(wd == 6, "sunday").otherwise("weekday")
    votes = (
        dates.where((F.coalesce(F.trim("exception_type"), F.lit("1")) == "1") & day.isNotNull())
        .groupBy("service_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        .groupBy("service_id").agg(F.min_by("bucket", F.struct(-F.col("n"), "bucket")).alias("v"))
    )
    j = primary.join(votes, "service_id", "full_outer")
    undecided = F.col("k").isNull() | (F.col("k") == "other")
    return j.select("service_id", F.when(undecided, F.coalesce("v", "k")).otherwise(F.col("k")).alias("period"))


# ------------------------------------------------------------------ weekday trips and what follows
def weekday_trips(trips: DataFrame, routes: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Weekday trips with route name, first departure second and its start hour (floored).

    The name of its service tells whether a trip is a weekday's; a join with the few services would send all trips to a few tasks.
    """
    first = (
        stop_times.where(F.col("departure_time").isNotNull() & (F.col("departure_time") != ""))
        .groupBy(*by_feed(["trip_id"], stop_times)).agg(F.min(clock.gtfs_seconds(F.col("departure_time"))).alias("start_sec"))
    )
    r = routes.select("feed", "route_id", F.col("route_short_name").alias("route"))
    t = trips.where(named_weekday()).join(r, ["feed", "route_id"]).join(first, by_feed(["trip_id"], first))
    return t.select(
        "feed", "trip_id", "route_id", "route", route_norm(F.col("route")).alias("route_norm"), "direction_id", "start_sec",
        F.pmod(F.floor(F.col("start_sec") / 3600), F.lit(24)).cast("int").alias("start_hour"),
    )


def trips_per_hour(wk: DataFrame) -> DataFrame:
    return wk.groupBy("route", borough_from_route(F.col("route")).alias("borough"), "direction_id", F.col("start_hour").alias("hour")).agg(
        F.count(F.lit(1)).alias("trips")
    )


def system_trips_per_hour(wk: DataFrame) -> DataFrame:
    return wk.groupBy(F.col("start_hour").alias("hour")).agg(F.count(F.lit(1)).alias("trips"))


def scheduled_headway(wk: DataFrame) -> DataFrame:
    h = F.col("start_hour")
    g = wk.groupBy("route", "direction_id", clock.period_of(h).alias("period")).agg(
        F.max(clock.period_minutes(h)).alias("span_min"), F.count(F.lit(1)).alias("trips")
    )
    return g.withColumn("headway_min", F.round(F.col("span_min") / F.col("trips"), 1))


def stop_service(stop_times: DataFrame, wk: DataFrame, stops: DataFrame) -> DataFrame:
    """Weekday arrivals and routes per stop (per feed and stop where the stop times tell feeds apart)."""
    keys = by_feed(["stop_id"], stop_times)
    per = of_trips(stop_times, wk, "route").groupBy(*keys, "route").agg(F.count(F.lit(1)).alias("n"))
    g = per.groupBy(*keys).agg(F.sum("n").alias("weekday_arrivals"), F.count(F.lit(1)).alias("n_routes"))
    named = by_feed(["stop_id"], stop_times, stops)
    return g.join(stops.select(*named, "stop_name"), named, "left")


def stop_base(stop_times: DataFrame, trips: DataFrame, flag: Column) -> DataFrame:
    """Per stop (and feed): its distinct routes, their sorted names joined, and whether ``flag`` holds for any trip that calls there.

    Visits are reduced to (stop, route) first; a stop's list is as long as the routes that call there.
    """
    keys = by_feed(["stop_id"], stop_times, trips)
    calls = stop_times.select(*keys, "trip_id").join(trips.select(*by_feed(["trip_id"], stop_times, trips), "route_id", flag.alias("__flag")), by_feed(["trip_id"], stop_times, trips))
    per = calls.groupBy(*keys, "route_id").agg(F.bool_or("__flag").alias("__flag"))
    return per.groupBy(*keys).agg(
        F.count("route_id").alias("n_routes"), F.array_join(F.sort_array(F.collect_list("route_id")), ", ").alias("routes"), F.bool_or("__flag").alias("any_flag"))


def demand_vs_supply(wk: DataFrame, demand: DataFrame, min_trips: int = 20) -> DataFrame:
    s = wk.groupBy("route_norm", borough_from_route(F.col("route")).alias("borough")).agg(
        F.min("route").alias("gtfs_route"), F.count(F.lit(1)).alias("weekday_trips")
    )
    j = s.where(F.col("weekday_trips") >= min_trips).join(demand, "route_norm")
    return j.withColumn("boardings_per_trip", F.round(F.col("avg_weekday_boardings") / F.col("weekday_trips"), 1))


def crowding_league(ds: DataFrame, n: int = 20, min_boardings: float = 500.0) -> DataFrame:
    most = ds.orderBy(F.desc("boardings_per_trip"), "route_norm").limit(n).withColumn("side", F.lit("most"))
    least = ds.where(F.col("avg_weekday_boardings") > min_boardings).orderBy("boardings_per_trip", F.desc("route_norm")).limit(n)
    return most.unionByName(least.withColumn("side", F.lit("least")))


def stop_windows(stop_times: DataFrame, trips: DataFrame, chosen: DataFrame) -> DataFrame:
    """Distinct trips per stop in hour windows, on the representative weekday service.

    A trip is first folded to one row per stop with its window flags, so the
    distinct count becomes a plain sum.
    """
    t = trips.join(chosen.select("feed", "route_id", "service_id"), ["feed", "route_id", "service_id"])
    hr = F.pmod(F.floor(clock.gtfs_seconds(F.col("departure_time")) / 3600), F.lit(24))
    spans = {"trips_am": (7, 9), "trips_midday": (10, 15), "trips_eve": (19, 21), "trips_daytime": (5, 21)}
    keys = by_feed(["stop_id"], stop_times)
    ev = of_trips(stop_times, t).groupBy(*keys, "trip_id").agg(
        *[F.max(F.when(hr.between(a, b), 1).otherwise(0)).alias(c) for c, (a, b) in spans.items()]
    )
    g = ev.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in spans])
    per_hour = {"tph_am": ("trips_am", 3), "tph_midday": ("trips_midday", 6), "tph_eve": ("trips_eve", 3)}
    return g.withColumns({k: F.round(F.col(c) / n, 2) for k, (c, n) in per_hour.items()})


def with_match_flag(a: DataFrame, b: DataFrame, key: str, flag: str) -> DataFrame:
    """TRUE where the key occurs in ``b``."""
    keys = b.select(key).distinct().withColumn("__hit", F.lit(True))
    return a.join(keys, key, "left").withColumn(flag, F.coalesce("__hit", F.lit(False))).drop("__hit")


def frequent_stops(stop_times: DataFrame, min_trips: int = 8, lo: str = "07:00:00", hi: str = "09:00:00") -> DataFrame:
    """Stops with many departures in the window; trips named as weekend are left out."""
    name = F.lower("trip_id")
    weekend = name.contains("saturday") | name.contains("sunday") | name.contains("weekend")
    w = stop_times.where((F.col("departure_time") >= lo) & (F.col("departure_time") < hi) & ~weekend)
    return w.groupBy(*by_feed(["stop_id"], w)).agg(F.count(F.lit(1)).alias("am_trips")).where(F.col("am_trips") >= min_trips)


# ------------------------------------------------------------------ schedule gaps
def _gaps(seconds: DataFrame, keys: list[str], sec: str, arrivals: Column) -> DataFrame:
    """Positive gaps between consecutive arrivals: distinct seconds per key, at most two days of them."""
    distinct = seconds.groupBy(*keys, sec).agg(arrivals.alias("__n"))
    before = F.lag(sec).over(W.partitionBy(*keys).orderBy(sec))
    return distinct.withColumn("gap", F.col(sec) - before)


def scheduled_headway_cells(st: DataFrame, trips: DataFrame, services: DataFrame) -> DataFrame:
    """Median scheduled gap per day x route x direction x stop x hour for that day's services.

    Days that run the same set of services have the same schedule, so cells are made per service set and copied to days.  An arrival
    carries the sets it belongs to as bits of a number, a row per ``WORD`` sets.  A stop's seconds are dealt, sorted and put together
    once; each set takes its own from there, and no row per set and arrival is sorted.
    """
    sets = services.groupBy("day").agg(F.array_sort(F.collect_set("service_id")).alias("members"))
    nr = F.row_number().over(W.orderBy("members")) - 1  # a row per set: at most one per day of the calendar
    numbered = sets.select("members").distinct().withColumn("nr", nr).select(
        "members", F.floor(F.col("nr") / WORD).alias("block"), F.expr(f"shiftleft(1L, nr % {WORD})").alias("bit"))
    masks = numbered.select(F.explode("members").alias("service_id"), "block", "bit").groupBy("service_id", "block").agg(F.bit_or("bit").alias("mask"))
    place = ["route_id", "direction_id", "stop_id"]
    t = trips.join(masks, "service_id")
    once = of_trips(st, t, "route_id", "direction_id", "block", "mask")
    # arrivals without a second go later: a filter here would be pushed to the scan, with the text that the seconds are read from
    arrivals = F.sort_array(F.collect_set(F.struct("sched_arr_sec", "mask"))).alias("arrivals")
    per_place = once.select(*place, "block", "sched_arr_sec", "mask").groupBy(*place, "block").agg(arrivals, F.bit_or("mask").alias("masks"))
    bits = F.filter(F.array(*[F.lit(1 << i) for i in range(WORD)]), lambda b: F.col("masks").bitwiseAND(b) != 0)
    per_set = per_place.select(*place, "block", "arrivals", F.explode(bits).alias("bit"))
    own = F.filter("arrivals", lambda a: (a.mask.bitwiseAND(F.col("bit")) != 0) & a.sched_arr_sec.isNotNull())
    per_set = per_set.select(*place, "block", "bit", F.array_distinct(F.transform(own, lambda a: a.sched_arr_sec)).alias("secs")).where(F.size("secs") > 1)
    later = F.slice("secs", F.lit(2), F.size("secs") - 1)
    hour = lambda s: F.pmod(F.floor(s / 3600), F.lit(24)).cast("int")
    gaps = F.zip_with(later, F.slice("secs", F.lit(1), F.size("secs") - 1), lambda b, a: F.struct(hour(b).alias("hour"), (b - a).alias("gap")))
    per_set = per_set.select(*place, "block", "bit", F.filter(gaps, lambda g: g.gap <= MAX_HEADWAY_S).alias("gaps"))
    of_hour = lambda h: F.array_sort(F.transform(F.filter("gaps", lambda g: g.hour == h), lambda g: g.gap))
    cells = F.transform(F.array_distinct("gaps.hour"), lambda h: F.struct(h.alias("local_hour"), of_hour(h).alias("of")))
    cells = per_set.select(*place, "block", "bit", F.inline(cells))
    n = F.size("of")
    middle = (F.get("of", F.floor((n - 1) / 2).cast("int")) + F.get("of", F.floor(n / 2).cast("int"))) / F.lit(2.0)
    cells = cells.select(*place, "block", "bit", "local_hour", middle.alias("sched_median_headway_s"), n.cast("long").alias("sched_n"))
    days = sets.join(numbered, "members").select("day", "block", "bit")
    return days.join(cells, ["block", "bit"]).select("day", *place, "local_hour", "sched_median_headway_s", "sched_n")


def trip_periods(trips: DataFrame, calendar: DataFrame, dates: DataFrame) -> DataFrame:
    """Trips with the period class of their service."""
    c = classify_service(calendar, dates)
    return trips.join(c, "service_id", "left").withColumn("service_period", F.coalesce("period", F.lit("other"))).drop("period")


def trunk_stop(st: DataFrame, trips: DataFrame) -> DataFrame:
    """The stop most visited by a route's trips; ties by stop id."""
    v = of_trips(st, trips, "route_id").groupBy("route_id", "stop_id").agg(F.count(F.lit(1)).alias("visits"))
    return argmax(v, ["route_id"], [-F.col("visits"), F.col("stop_id")], ["stop_id", "visits"])


def argmax(df: DataFrame, keys: list[str], order: list[Column], take: list[str]) -> DataFrame:
    """The first row of each group by ``order``, as a mergeable aggregate (no per-group sort)."""
    best = F.min_by(F.struct(*take), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("__b")).select(*keys, *[F.col(f"__b.{c}").alias(c) for c in take])


def visits(st: DataFrame, trips: DataFrame) -> DataFrame:
    """Arrivals n per route x period x direction x stop x second: one pass over the stop times, from which trunks, headways and spans follow."""
    keys = ["route_id", "service_period", "direction_id"]
    return of_trips(st, trips, *keys).groupBy(*keys, "stop_id", "sched_sec").agg(F.count(F.lit(1)).alias("n"))


def trunk_headways(st: DataFrame, trips: DataFrame, min_arrivals: int = 3) -> DataFrame:
    """Median gap in minutes at the trunk stop per route x period x window x direction."""
    return headways_of_visits(visits(st, trips), min_arrivals)


def headways_of_visits(v: DataFrame, min_arrivals: int = 3) -> DataFrame:
    """:func:`trunk_headways` of :func:`visits`."""
    calls = v.groupBy("route_id", "stop_id").agg(F.sum("n").alias("visits"))
    trunk = argmax(calls, ["route_id"], [-F.col("visits"), F.col("stop_id")], ["stop_id", "visits"]).select("route_id", "stop_id")
    a = v.join(trunk, ["route_id", "stop_id"])
    a = a.withColumn("tod_window", clock.tod_window(F.col("sched_sec"))).where(F.col("tod_window").isNotNull())
    keys = ["route_id", "service_period", "tod_window", "direction_id"]
    g = _gaps(a, keys, "sched_sec", F.sum("n")).groupBy(*keys).agg(
        F.sum("__n").alias("n_arrivals"), F.count("gap").alias("n_gaps"), F.median("gap").alias("m")
    )
    g = g.where((F.col("n_arrivals") >= min_arrivals) & (F.col("n_gaps") >= min_arrivals - 1))
    return g.select(*keys, F.round(F.col("m") / 60, 2).alias("headway_min"))


def service_spans(st: DataFrame, trips: DataFrame) -> DataFrame:
    return spans_of_visits(of_trips(st, trips, "route_id", "service_period"))


def spans_of_visits(v: DataFrame) -> DataFrame:
    return v.groupBy("route_id", "service_period").agg(F.min("sched_sec").alias("first_sec"), F.max("sched_sec").alias("last_sec"))


# ------------------------------------------------------------------ route lists and stops
def owned_routes(routes: DataFrame, trips: DataFrame) -> DataFrame:
    """A route belongs to the first feed (by name) that lists and operates it."""
    operated = routes.join(trips.select("feed", "route_id").distinct(), ["feed", "route_id"], "left_semi")
    return argmax(operated, ["route_id"], [F.col("feed")], ["feed", "route_short_name"])


def shape_sizes(points: DataFrame) -> DataFrame:
    return points.groupBy("shape_id").agg(F.count(F.lit(1)).alias("n_points"))


def canonical_shape(trips: DataFrame, points: DataFrame, by: str = "points") -> DataFrame:
    """One shape per (route, direction): most detailed (``points``) or most used (``trips``)."""
    per = trips.where(F.col("shape_id").isNotNull()).groupBy("route_id", "direction_id", "shape_id").agg(
        F.count(F.lit(1)).alias("n_trips"), F.min("trip_id").alias("rep_trip")
    )
    per = per.join(shape_sizes(points), "shape_id", "left").withColumn("n_points", F.coalesce("n_points", F.lit(0)))
    size = F.col("n_points") if by == "points" else F.col("n_trips")
    return argmax(per, ["route_id", "direction_id"], [-size, F.col("shape_id")], ["shape_id", "rep_trip", "n_trips", "n_points"])


def route_stops(trips: DataFrame, points: DataFrame, st: DataFrame, stops: DataFrame) -> DataFrame:
    """Stops of the representative trip of each direction's longest shape."""
    rep = canonical_shape(trips, points).select("route_id", F.col("rep_trip").alias("trip_id"))
    s = st.join(rep, "trip_id").select("route_id", "stop_id").distinct()
    return s.join(stops.select("stop_id", "stop_name", "lat", "lon"), "stop_id").where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def station_catalog(stops: DataFrame, trips: DataFrame, st: DataFrame) -> DataFrame:
    """Parent stations with the sorted routes whose representative trips serve them."""
    rep = trips.where(F.col("shape_id").isNotNull()).groupBy("shape_id").agg(F.min("trip_id").alias("trip_id"), F.min("route_id").alias("route_id"))
    parent = stops.select("stop_id", F.coalesce("parent_station", "stop_id").alias("station_id"))
    served = st.join(rep, "trip_id").join(parent, "stop_id").select("station_id", "route_id").distinct()
    lists = served.groupBy("station_id").agg(F.array_join(F.array_sort(F.collect_set("route_id")), ",").alias("routes"), F.count(F.lit(1)).alias("n_routes"))
    return lists.join(stops.select(F.col("stop_id").alias("station_id"), "stop_name", "lat", "lon"), "station_id")


def canonical_predecessor(st: DataFrame, trips: DataFrame) -> DataFrame:
    """Most common previous stop per (route, stop); a terminal takes its next stop."""
    keys = by_feed(["trip_id"], st, trips)
    s = of_trips(st, trips, "route_id").select(*keys, "route_id", "stop_id", "stop_seq")
    chunk = F.floor(F.col("stop_seq") / SEQ_CHUNK)
    s = with_neighbour(s, keys, ["stop_seq"], chunk, {"prev_stop": "stop_id"}, {"next_stop": "stop_id"})
    inner = F.col("prev_stop").isNotNull()
    calls = s.where(inner | F.col("next_stop").isNotNull()).select("route_id", "stop_id", inner.alias("inner"), F.coalesce("prev_stop", "next_stop").alias("pred"))
    # votes and the best of them both stay where their stop is dealt to
    votes = dealt(calls, "route_id", "stop_id", rows=TRIP_STOPS * trips.count()).groupBy("route_id", "stop_id", "inner", "pred").agg(F.count(F.lit(1)).alias("n"))
    return argmax(votes, ["route_id", "stop_id"], [~F.col("inner"), -F.col("n"), F.col("pred")], ["pred", "inner", "n"])


# ------------------------------------------------------------------ trips in time
def trip_spans(st: DataFrame) -> DataFrame:
    return st.groupBy(*by_feed(["trip_id"], st)).agg(F.min("sched_arr_sec").alias("first_sec"), F.max("sched_arr_sec").alias("last_sec"))


def active_in_bin(spans: DataFrame, step: int = clock.BIN_S, keys: tuple[str, ...] = ()) -> DataFrame:
    """Trips under way at each bin start of the clock day; owl trips wrap past midnight.

    Each span is exploded to the bins it covers (at most 24 h worth), counted before
    any shuffle of whole rows.
    """
    lo, hi = F.ceil(F.col("first_sec") / step), F.floor(F.col("last_sec") / step)
    bins = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    per_day = clock.DAY_S // step
    wrapped = F.array_distinct(F.transform(bins, lambda b: F.pmod(b, F.lit(per_day)) * step))
    e = spans.select(*keys, F.explode(wrapped).alias("bin_sec"))
    return e.groupBy(*keys, "bin_sec").agg(F.count(F.lit(1)).alias("scheduled_active"))


def scheduled_series(trips: DataFrame, st: DataFrame, offsets: DataFrame, services: DataFrame, lo: int, hi: int) -> DataFrame:
    """Scheduled trips of the day's services placed on stop offsets inside [lo, hi] seconds, two points at least."""
    t = trips.join(services.select("service_id").distinct(), "service_id", "left_semi").select("trip_id", "route_id", "direction_id", "shape_id")
    pts = st.where(F.col("sched_arr_sec").between(lo, hi)).join(t, "trip_id").join(offsets, ["shape_id", "stop_id"])
    n = F.count(F.lit(1)).over(W.partitionBy("trip_id"))
    return pts.withColumn("n", n).where("n >= 2").select("trip_id", "route_id", "direction_id", "sched_arr_sec", "stop_offset_ft")


