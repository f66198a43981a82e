"""Streams over several micro-batches against plain Python: order, late rows, silent keys, timers."""

import math
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerbline.operators import bunching
from kerbline.operators import quality as Q
from kerbline.streaming import live

T0 = 1_704_067_200
PING = "vehicle_id string, route_id string, direction_id int, stop_id string, ts long, event_id long, lat double, lon double"


def landed(spark, path, schema, batches):
    """Each batch as one file, read one file a micro-batch."""
    df = None
    for rows in batches:
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(str(path))
    return live.read_stream(spark, str(path), df.schema, files=1)


def reports(n=400, vehicles=6, seed=3):
    gen = random.Random(seed)
    rows = []
    for i in range(n):
        v = gen.randrange(vehicles)
        rows.append((f"v{v}", None if v == 5 and i % 4 == 0 else f"r{v % 2}", None if v == 4 else v % 2, f"s{gen.randrange(4)}" if i % 9 else "", T0 + i * 40 + gen.randrange(30), i, 40.0 + gen.random() / 100, -74.0))
    return rows


def headways_by_hand(rows):
    last, told = {}, []
    for v, r, d, s, ts, e, *_ in sorted(rows, key=lambda x: (x[4], x[5])):
        if r is None or not s:
            continue
        before = last.get(v)
        if before != s:
            told.append((r, d, s, v, ts, e))
        last[v] = s
    seen, out = {}, set()
    for r, d, s, v, ts, e in told:
        out.add((r, d, s, v, ts, e, ts - seen[(r, d, s)] if (r, d, s) in seen else None))
        seen[(r, d, s)] = ts
    return out


def test_headways_in_any_order_within_the_watermark(spark, tmp_path):
    rows = reports()
    gen = random.Random(1)
    mixed = sorted(rows, key=lambda r: r[4] + gen.randrange(1200))  # up to 20 minutes out of order
    batches = [mixed[i : i + 80] for i in range(0, len(mixed), 80)]
    # a report far behind the watermark, in a batch of its own after the others
    batches.append([("v0", "r0", 0, "s9", T0 + 5, 9000, 40.0, -74.0), ("v1", "r1", 1, "end", T0 + 40 * 400 + 7200, 9001, 40.0, -74.0)])
    stream = live.stream_headways(landed(spark, tmp_path / "in", PING, batches), late="30 minutes")
    got = {tuple(r) for r in live.run_to_table(stream, "headways", chained=True).collect()}
    closes = T0 + 40 * 400 + 7200 - 1800
    assert got == {r for r in headways_by_hand(rows) if r[4] < closes}


def test_silent_vehicles_and_stops_are_forgotten(spark, tmp_path):
    row = lambda v, s, at, e: (v, "r", 0, s, T0 + at, e, 40.0, -74.0)
    batches = [[row("a", "x", 0, 1), row("b", "y", 5, 2)], [row("b", "y", 5000, 3), row("b", "z", 5001, 4)], [row("b", "z", 9000, 5)]]
    batches += [[row("a", "x", 9100, 6), row("b", "z", 9200, 7), row("c", "x", 9150, 9)], [row("b", "z", 20_000, 8)]]
    stream = live.stream_headways(landed(spark, tmp_path / "in", PING, batches), late="1 minute", ttl=3600)
    got = {(r.event_id, r.headway_s) for r in live.run_to_table(stream, "headways", chained=True).collect()}
    # after more than an hour a vehicle's stop is a passage again, and a stop's next passage has no headway
    assert got == {(1, None), (2, None), (3, None), (4, None), (5, None), (6, None), (9, 50)}


def test_headways_of_reports_at_the_watermark(spark, tmp_path):
    row = lambda v, s, at, e: (v, "r", 0, s, T0 + at, e, 40.0, -74.0)
    # the watermark comes to stand at 940 and at 1940, each the second of a report that waits, of one that came with it and of one before it
    batches = [[row("a", "x", 100, 1), row("a", "y", 940, 2), row("b", "y", 1000, 3)], [row("c", "y", 1940, 4), row("d", "y", 2000, 5)], [row("a", "x", 2300, 6), row("b", "z", 3000, 7)], [row("b", "z", 4000, 8)]]
    stream = live.stream_headways(landed(spark, tmp_path / "in", PING, batches), late="1 minute")
    got = {(r.event_id, r.headway_s) for r in live.run_to_table(stream, "headways", chained=True).collect()}
    assert got == {(1, None), (2, None), (3, 60), (4, 940), (5, 60), (6, 2200), (7, None)}


def test_headways_of_vehicles_and_stops_that_share_a_bucket(spark, tmp_path):
    gen = random.Random(9)
    rows = [(*r[:2], gen.choice([0, 1, None]), f"s{gen.randrange(12)}", *r[4:]) for r in reports(600, vehicles=60, seed=9)]
    rows += [(None, "r9", 0, f"s{i % 3}", T0 + i * 30, 10_000 + i, 40.0, -74.0) for i in range(40)] + rows[:50]
    rows.sort(key=lambda r: r[4])
    batches = [rows[i : i + 200] for i in range(0, len(rows), 200)] + [[("v0", "r0", 0, "end", T0 + 40 * 600 + 7200, 90_000, 40.0, -74.0)]]
    stream = live.stream_headways(landed(spark, tmp_path / "in", PING, batches), late="10 minutes", buckets=3)
    got = sorted(map(repr, (tuple(r) for r in live.run_to_table(stream, "headways", chained=True).collect())))
    seen, last, expected = {}, {}, []
    for v, r, d, s, ts, e, *_ in sorted(rows, key=lambda x: (x[4], x[5])):
        if r is not None and s and last.get(v) != s:
            expected.append((r, d, s, v, ts, e, ts - seen[(r, d, s)] if (r, d, s) in seen else None))
            seen[(r, d, s)] = ts
        if r is not None and s:
            last[v] = s
    assert got == sorted(map(repr, expected))

    spark.conf.set(*live.STORE)
    try:
        q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(live.STORE[0])
    q.awaitTermination()
    # buckets, not vehicles or stops, have rows of state
    assert max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]) < 40


def test_two_newest_with_late_repeated_and_silent(spark, tmp_path):
    rows = reports()
    gen = random.Random(2)
    mixed = sorted(rows, key=lambda r: r[4] + gen.randrange(1500)) + rows[-5:]
    batches = [mixed[i : i + 50] for i in range(0, len(mixed), 50)]
    stream = live.stream_latest(landed(spark, tmp_path / "in", PING, batches))
    got = {r.vehicle_id: (r.ts, r.event_id, r.stop_id, r.prev_ts, r.prev_event_id, r.prev_lat) for r in live.run_changes(stream, "latest", "vehicle_id", "ts", fold=3).collect()}
    want = {}
    for v in {r[0] for r in rows}:
        a, b = sorted((r for r in rows if r[0] == v), key=lambda r: (r[4], r[5]))[: -3 : -1]
        want[v] = (a[4], a[5], a[3], b[4], b[5], b[6])
    assert got == want
    row = lambda v, at, e: (v, "r", 0, "s", T0 + at, e, 40.0, None)
    silent = landed(spark, tmp_path / "silent", PING, [[row("a", 0, 1), row("b", 0, 2)], [row("b", 50_000, 3)], [row("b", 50_100, 4)]])
    out = live.run_changes(live.stream_latest(silent, late="1 minute", ttl=3600), "silent", "vehicle_id", "ts").collect()
    assert [(r.vehicle_id, r.event_id, r.prev_event_id, r.lon) for r in out] == [("b", 4, 3, None)]


def test_two_newest_of_vehicles_that_share_a_bucket(spark, tmp_path):
    """One state row for all vehicles: each still has its own reports and its own silence, also the one without a name."""
    row = lambda v, at, e: (v, "r", 0, "s", T0 + at, e, None if e == 2 else 40.0, -74.0)
    batches = [[row("a", 0, 1), row("b", 10, 2), row(None, 20, 3)], [row("b", 30_000, 4), row("b", 30_000, 4), row(None, 29_990, 5), row("c", 30_010, 6)], [row("c", 30_020, 7), row("b", 30_005, 8)]]
    stream = live.stream_latest(landed(spark, tmp_path / "in", PING, batches), late="1 minute", ttl=3600, buckets=1)
    log = live.run_changes(stream, "shared", "vehicle_id", "ts")
    assert {tuple(r)[:1] + (r.event_id, r.prev_event_id, r.prev_lat) for r in log.collect()} == {("b", 8, 4, 40.0), (None, 5, 3, 40.0), ("c", 7, 6, 40.0)}
    calls = []

    class State:
        exists, hasTimedOut, get = False, False, ()

        def getCurrentWatermarkMs(self):
            return 0

        def update(self, value):
            calls.append(value)

        def setTimeoutTimestamp(self, at):
            calls.append(at)

    many = pd.DataFrame([(f"v{i % 500}", T0 + i, i, "s", 40.0, -74.0) for i in range(5000)], columns=live.KNOWN)
    told = pd.concat(live._two_newest(60)((0,), iter([many]), State()))
    assert len(told) == 500 and set(told["event_id"] - told["prev_event_id"]) == {500} and len(calls[0][0]) == 1000 and calls[1] == (T0 + 4500 + 60) * 1000


@pytest.mark.parametrize("seed", [1, 2])
def test_stale_feeds_against_the_batch_form(spark, tmp_path, seed):
    gen = random.Random(seed)
    polls = []
    for feed in "abc":
        at, head = T0, T0
        for i in range(200):
            at += gen.choice([30, 30, 30, 400 if feed == "b" else 30])
            if gen.random() < 0.12:
                head = at
            polls.append((feed, at, head if i % 17 else None))
            if feed == "c" and i == 50:
                break  # a feed that is not polled any more
    polls.sort(key=lambda p: p[1])
    schema = "feed string, poll_ts long, header_ts long"
    stream = live.stream_stale(landed(spark, tmp_path / "in", schema, [polls[i : i + 60] for i in range(0, len(polls), 60)]))
    got = sorted(tuple(r) for r in live.run_to_table(stream, "stale").collect())
    assert got == sorted(tuple(r) for r in Q.stale_changes(spark.createDataFrame(polls, schema)).collect())
    assert any(r[4] for r in got) and any(not r[4] for r in got) and any(r[0] == "c" and r[4] for r in got)


def test_stale_feeds_by_the_clock(spark, tmp_path):
    """A live service: the header stands still longer than the clock allows, with no poll since."""
    schema = "feed string, poll_ts long, header_ts long"
    old = [("a", T0, T0), ("a", T0 + 60, T0)]
    stream = live.stream_stale(landed(spark, tmp_path / "in", schema, [old, [("b", T0 + 90, T0)]]), live=True)
    query = stream.writeStream.format("memory").queryName("stale_live").outputMode("append").start()
    try:
        for _ in range(60):
            got = {(r.feed, r.at, r.stale) for r in spark.table("stale_live").collect()}
            if len(got) == 2:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert got == {("a", T0 + 300, True), ("b", T0 + 390, True)}


def test_pairs_per_window_equal_pairs_of_each_window(spark, tmp_path):
    gen = random.Random(5)
    rows = [(f"v{gen.randrange(30):02}", "r" if i % 5 else None, i % 2, "s", T0 + i * 3, i, 40.0 + gen.random() / 300 if i % 40 else None, (180.0 if i % 3 else -180.0) + gen.random() / 300 * (-1 if i % 3 else 1)) for i in range(900)]
    headway = spark.createDataFrame([("r", 0, 900.0)], "route_id string, direction_id int, sched_median_headway_s double")
    rows.append(("end", "r", 0, "s", T0 + 10_000, 99_999, 40.0, 0.0))
    stream = live.stream_bunching(landed(spark, tmp_path / "in", PING, [rows[i : i + 250] for i in range(0, len(rows), 250)]), headway)
    got = {(r.bin_local, r.vehicle_id_a, r.vehicle_id_b, round(r.gap_m, 6)) for r in live.run_to_table(stream, "pairs").collect()}
    newest = {}
    for r in rows:
        if r[6] is not None:
            newest[(r[4] // 300 * 300, r[0])] = r
    want = set()
    for at in {k[0] for k in newest}:
        one = spark.createDataFrame([r for (b, _), r in newest.items() if b == at], PING)
        want |= {(at - 14_400, r.vehicle_id_a, r.vehicle_id_b, round(r.gap_m, 6)) for r in bunching.candidate_pairs(one, headway).collect()}
    assert got == want and len(want) > 100


def test_table_of_bunching_grows_with_reports_not_with_pairs(spark, tmp_path):
    rows = [(f"v{i:03}", "r", 0, "s", T0 + i % 250, i, 40.001 + i * 1e-7, -74.0) for i in range(200)] + [("end", "r", 0, "s", T0 + 10_000, 999, 40.0, -74.0)]
    headway = spark.createDataFrame([("r", 0, 900.0)], "route_id string, direction_id int, sched_median_headway_s double")
    table = live.run_to_table(live.stream_bunching(landed(spark, tmp_path / "in", PING, [rows]), headway, listed=False), "met")
    told = live.listed_pairs(table).collect()
    assert len({(r.vehicle_id_a, r.vehicle_id_b) for r in told}) == len(told) == 200 * 199 // 2
    assert sum(len(r.m) for r in table.collect()) <= 9 * 200


def gap_m(a, b):
    (la, oa), (lb, ob) = ((math.radians(x) for x in p) for p in (a, b))
    return 2 * 6_371_000 * math.asin(math.sqrt(math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - oa) / 2) ** 2))


@pytest.mark.parametrize("place", ["city", "date line", "pole", "equator"])
def test_tiles_meet_all_pairs_with_few_copies(spark, place):
    gen = random.Random(11)
    lat, lon = {"city": (40.7, -73.9), "date line": (-52.0, 180.0), "pole": (89.97, 0.0), "equator": (0.0, 0.0)}[place]
    wide = 0.05 / math.cos(math.radians(lat)) if place != "pole" else 180.0
    at = {}
    for i in range(600):
        o = lon + gen.uniform(-wide, wide)
        at[f"v{i:03}"] = (min(90.0, lat + gen.uniform(-0.05, 0.05)), o - 360 if o > 180 else o)
    df = spark.createDataFrame([(v, "r", None, *p) for v, p in at.items()] + [("x", "r", None, None, 1.0)], "vehicle_id string, route_id string, direction_id int, lat double, lon double")
    headway = spark.createDataFrame([("r", None, 900.0)], "route_id string, direction_id int, sched_median_headway_s double")
    met = bunching.met_by_window(df, headway, F.lit(1)).cache()
    got = {(r.vehicle_id_a, r.vehicle_id_b): round(r.gap_m, 4) for r in bunching.pairs_of_met(met).collect()}
    want = {(a, b): round(g, 4) for a in at for b in at if a < b and (g := gap_m(at[a], at[b])) < 500}
    assert got == want and len(want) > 200
    if place != "pole":
        assert sum(len(r.m) for r in met.collect()) <= 2.5 * len(at)
