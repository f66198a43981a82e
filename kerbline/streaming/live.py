"""The realtime jobs as Structured Streaming: archive, de-duplication, windows, keyed state.

The same column logic serves batch and stream.  Watermarks bound state; a window is
written once it can no longer change, so results equal the batch job on all windows
the watermark has closed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kerbline.functions import clock
from kerbline.operators.bunching import PAIR_FRAC, met_by_window, pairs_of_met
from kerbline.session import scratch_path

#: Chained keyed state needs column families, which only this state store has.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 100) -> DataFrame:
    """Landed snapshot files as a stream, at most ``files`` of them a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_to_table(stream: DataFrame, label: str, partition_by: tuple[str, ...] = (), mode: str = "append", chained: bool = False) -> DataFrame:
    """Process everything that has landed, write it exactly once, read the table back.

    ``chained``: the stream has several keyed states one after the other.
    """
    spark = stream.sparkSession
    out, check = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    w = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", check)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w = w.trigger(availableNow=True)
    if chained:
        before = spark.conf.get(STORE[0])
        spark.conf.set(*STORE)
    try:
        q = w.start()  # a query keeps the settings it was started with
    finally:
        if chained:
            spark.conf.set(STORE[0], before)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stream_archive(pings: DataFrame) -> DataFrame:
    """Rows with the date and hour they are archived under."""
    at = F.timestamp_seconds("poll_ts")
    return pings.withColumns({"date": F.date_format(at, "yyyy-MM-dd"), "hour": F.date_format(at, "HH")})


def with_event_time(df: DataFrame, ts: str, late: str) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_seconds(ts)).withWatermark("event_time", late)


def stream_dedupe(pings: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row per (trip, second) among those arriving within the watermark."""
    return with_event_time(pings, "ts", late).dropDuplicatesWithinWatermark(["trip_id", "ts"]).drop("event_time")


def stream_vehicles(pings: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Reports and vehicles per 5-minute window: distinct by de-duplication first, so the count is exact."""
    one = with_event_time(pings, "ts", late).select("event_time", "vehicle_id").dropDuplicates(["vehicle_id", "event_time"])
    g = one.groupBy(F.window("event_time", "5 minutes").alias("w"), "vehicle_id").agg(F.count(F.lit(1)).alias("n"))
    g = g.groupBy(F.window(F.window_time("w"), "5 minutes").alias("win")).agg(F.count(F.lit(1)).alias("vehicles"), F.sum("n").alias("reports"))
    return g.select((F.unix_timestamp("win.start") - clock.LOCAL_OFFSET_S).alias("bin_local"), "vehicles", "reports")


def stream_alerts(alerts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Distinct alerts per 5-minute window: first reduced per (window, alert), then counted."""
    a = with_event_time(alerts, "poll_ts", late)
    per = a.groupBy(F.window("event_time", "5 minutes").alias("w"), "alert_id").agg(F.min(F.coalesce("effect", F.lit(8))).alias("e"))
    g = per.groupBy(F.window(F.window_time("w"), "5 minutes").alias("win")).agg(F.count(F.lit(1)).alias("alerts_total"))
    return g.select((F.unix_timestamp("win.start") - clock.LOCAL_OFFSET_S).alias("bin_local"), "alerts_total")


def stream_trailing(arrivals: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Mean headway deviation over the trailing hour, every five minutes, as sliding windows."""
    a = with_event_time(arrivals, "arr_ts", late)
    g = a.groupBy(F.window("event_time", "60 minutes", "5 minutes").alias("w")).agg(F.avg("dev").alias("mean_dev"), F.count(F.lit(1)).alias("n"))
    return g.select((F.unix_timestamp("w.end") - clock.LOCAL_OFFSET_S).alias("bin_local"), "mean_dev", "n")


def stream_bunching(pings: DataFrame, headway: DataFrame, late: str = "10 minutes", listed: bool = True) -> DataFrame:
    """Pairs of vehicles too close to each other, per 5-minute window: the newest position of each vehicle in the window, and of
    those the pairs that :func:`~kerbline.operators.bunching.candidate_pairs` finds.

    State is one position per (window, vehicle) until the window closes; then the vehicles in and around a cell meet as one group of
    (window, cell), which is given out in the same micro-batch.  ``headway`` is a static table.  Pairs grow with the square of the vehicles
    in a cell: with ``listed=False`` the stream tells the groups, whose table grows with the reports, and :func:`listed_pairs` tells the
    pairs where it is read.
    """
    p = with_event_time(pings.where("lat is not null and lon is not null"), "ts", late)
    newest = F.max_by(F.struct("route_id", "direction_id", "lat", "lon"), F.struct("ts", "event_id")).alias("b")
    closed = p.groupBy(F.window("event_time", "5 minutes").alias("w"), "vehicle_id").agg(newest).select(F.window_time("w").alias("closes"), "vehicle_id", "b.*")
    met = met_by_window(closed, headway, F.window("closes", "5 minutes"))
    return listed_pairs(met) if listed else met


def listed_pairs(met: DataFrame) -> DataFrame:
    """The pairs of the groups that ``stream_bunching(..., listed=False)`` tells, from the stream or from its table."""
    start = (F.unix_timestamp("window.start") - clock.LOCAL_OFFSET_S).alias("bin_local")
    return pairs_of_met(met).select(start, "route_id", "direction_id", "vehicle_id_a", "vehicle_id_b", "gap_m", "expected_m")


def stream_short_headways(arrivals: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Arrivals per 5-minute window that come less than a quarter of the scheduled headway after the one before."""
    a = with_event_time(arrivals, "arr_ts", late)
    short = F.coalesce(F.col("headway_s") < PAIR_FRAC * F.col("sched_median_headway_s"), F.lit(False))
    g = a.groupBy(F.window("event_time", "5 minutes").alias("w")).agg(F.count_if(short).alias("active_bunching_pairs"), F.count(F.lit(1)).alias("arrivals"))
    return g.select((F.unix_timestamp("w.start") - clock.LOCAL_OFFSET_S).alias("bin_local"), "active_bunching_pairs", "arrivals")


REPORT = "ts long, event_id long, stop_id string, lat double, lon double"
NEWEST_SCHEMA = f"vehicle_id string, {REPORT}, " + REPORT.replace(", ", ", prev_").replace("ts ", "prev_ts ", 1)
NEWEST_COLUMNS = [c.split()[0] for c in NEWEST_SCHEMA.split(", ")]


REPORT_COLUMNS = [c.split()[0] for c in REPORT.split(", ")]
KNOWN = ["vehicle_id", *REPORT_COLUMNS]


def _two_newest(ttl: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """The two newest reports of a bucket's vehicles, told again only when they change; after ``ttl`` seconds of silence a row of nulls."""
        passed = state.getCurrentWatermarkMs()
        known = _reports(dict(zip(KNOWN, state.get, strict=True)) if state.exists else {c: [] for c in KNOWN})
        heard = [] if state.hasTimedOut else [pdf.sort_values(["ts", "event_id"]).groupby("vehicle_id", sort=False, dropna=False).tail(2)[KNOWN] for pdf in batches]
        rows = pd.concat([known, *map(_reports, heard)], ignore_index=True)
        rows["fresh"] = np.arange(len(rows)) >= len(known)
        rows["v"] = pd.factorize(rows["vehicle_id"], use_na_sentinel=False)[0]
        spoke = np.bincount(rows["v"], weights=rows["fresh"]) > 0
        # a report known before stands before its repetitions
        rows = rows.drop_duplicates(["v", "ts", "event_id"]).sort_values(["v", "ts", "event_id"])
        v = rows["v"].to_numpy()
        last = np.append(v[1:] != v[:-1], True)
        second = ~last & np.append(last[1:], False)
        silent = ~spoke[v[last]] & ((rows["ts"].to_numpy()[last] + ttl) * 1000 < passed)
        changed = np.bincount(v, weights=rows["fresh"] & (last | second), minlength=len(spoke))[v[last]] > 0
        both = rows[last].reset_index(drop=True)
        before = rows[second].set_index("v").reindex(v[last]).reset_index(drop=True)
        told = pd.concat([both[KNOWN], before[REPORT_COLUMNS].add_prefix("prev_")], axis=1)
        gone = told[silent].reset_index(drop=True)
        gone[NEWEST_COLUMNS[1:]] = None
        kept = rows[(last | second) & ~np.isin(v, v[last][silent])]
        if kept.empty:
            state.remove()
        else:
            state.update(tuple([None if pd.isna(x) else x for x in kept[c].tolist()] for c in KNOWN))
            state.setTimeoutTimestamp(max(int(both["ts"][~silent].min()) + ttl, passed // 1000 + 1) * 1000)
        for out in (told[changed], gone):
            if len(out):
                yield _typed(out)

    return run


KINDS = {"long": "Int64", "double": "Float64", "string": "object"}


def _reports(columns) -> pd.DataFrame:
    """Reports as a frame of these types, whatever of them is there; missing values are null."""
    kinds = {"vehicle_id": "object", **{c.split()[0]: KINDS[c.split()[1]] for c in REPORT.split(", ")}}
    return pd.DataFrame({c: pd.Series(columns[c], dtype=None if len(columns[c]) else k).astype(k) for c, k in kinds.items()}).reset_index(drop=True)


def _typed(rows: pd.DataFrame) -> pd.DataFrame:
    kinds = {c.split()[0]: KINDS[c.split()[1]] for c in NEWEST_SCHEMA.split(", ")}
    return rows.reset_index(drop=True).astype(kinds)


def stream_latest(pings: DataFrame, late: str = "1 hour", ttl: int = 30 * clock.DAY_S, buckets: int = 1024) -> DataFrame:
    """The newest and the previous report of each vehicle, in update mode: only vehicles whose reports changed come out.

    State is two reports per vehicle, dropped (and told as a row of nulls) after ``ttl`` seconds of silence.  A report told twice counts once.
    Vehicles are dealt to ``buckets``, each one state row, as a call of Python per bucket costs far less than one per vehicle; some
    hundreds of vehicles a bucket are about right, thousands do no harm.
    """
    p = with_event_time(pings.where("ts is not null"), "ts", late).select("vehicle_id", "ts", "event_id", "stop_id", "lat", "lon", "event_time")
    state = ", ".join(f"{c.split()[0]} array<{c.split()[1]}>" for c in ["vehicle_id string", *REPORT.split(", ")])
    p = p.withColumn("bucket", F.pmod(F.xxhash64("vehicle_id"), F.lit(buckets)))
    return p.groupBy("bucket").applyInPandasWithState(_two_newest(ttl), NEWEST_SCHEMA, state, "update", GroupStateTimeout.EventTimeTimeout)


def newest_of(changes: DataFrame, key: str, gone: str) -> DataFrame:
    """The table that a log of changes stands for: each key's row of the highest version, without those whose ``gone`` is null."""
    rows = F.struct(*[c for c in changes.columns if c not in (key, "version")])
    return changes.groupBy(key).agg(F.max_by(rows, "version").alias("r")).select(key, "r.*").where(F.col(gone).isNotNull())


def run_changes(stream: DataFrame, label: str, key: str, gone: str, fold: int = 50) -> DataFrame:
    """Run an update-mode stream into a log of changed rows, and read the table that it stands for.

    A micro-batch writes its changes under its own number, so a batch that is run again replaces itself.  Every ``fold`` batches the log is
    written anew as one row per key; older parts stay for readers that are at work and hold nothing that counts any more.
    """
    spark = stream.sparkSession
    out, check = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    schema = T.StructType([*stream.schema.fields, T.StructField("version", T.LongType())])

    def log(upto: int) -> DataFrame:
        """The last whole table before batch ``upto`` and the changes after it."""
        base = upto // fold * fold
        parts = [spark.read.schema(schema).parquet(f"{out}/table-{base}")] if base else []
        parts += [spark.read.schema(schema).parquet(f"{out}/changes-{i}") for i in range(base, upto)]
        table = parts[0]
        for part in parts[1:]:
            table = table.unionByName(part)
        return table

    done = [0]

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/changes-{number}")
        done[0] = number + 1
        if done[0] % fold == 0:
            base = done[0] - fold
            whole = [f"{out}/table-{base}"] if base else []
            rows = spark.read.schema(schema).parquet(*whole, *[f"{out}/changes-{i}" for i in range(base, done[0])])
            newest_of(rows, key, gone).withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/table-{done[0]}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", check).foreachBatch(append).trigger(availableNow=True).start()
    q.awaitTermination()
    return newest_of(log(done[0]), key, gone) if done[0] else spark.createDataFrame([], stream.schema)


STALE_SCHEMA = "feed string, header_ts long, since long, at long, stale boolean"


def _stale(max_age: int, event_time: bool):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """A row when a feed's header has stood still for ``max_age`` seconds, and one when it moves again."""
        header, since, seen, stale = state.get if state.exists else (None, None, None, False)
        out = []
        if state.hasTimedOut:
            if since is not None and not stale:
                out.append((key[0], header, since, since + max_age, True))
                stale = True
            state.update((header, since, seen, stale))
        else:
            polls = pd.concat(list(batches), ignore_index=True)[["poll_ts", "header_ts"]].sort_values(["poll_ts", "header_ts"], na_position="first")
            for at, head in polls.itertuples(index=False):
                # a poll that was not after the last one known changes nothing, nor does one without header
                if pd.isna(head) or seen is not None and at <= seen:
                    continue
                at, head, seen = int(at), int(head), int(at)
                if since is not None and not stale and at - since > max_age:
                    out.append((key[0], header, since, since + max_age, True))
                    stale = True
                if head != header:
                    if stale:
                        out.append((key[0], head, at, at, False))
                    header, since, stale = head, at, False
            state.update((header, since, seen, stale))
            if since is not None and not stale:
                if event_time:
                    state.setTimeoutTimestamp(max((since + max_age) * 1000, state.getCurrentWatermarkMs() + 1))
                else:
                    state.setTimeoutDuration(max(1, (since + max_age) * 1000 - state.getCurrentProcessingTimeMs()))
        if out:
            yield pd.DataFrame(out, columns=["feed", "header_ts", "since", "at", "stale"])

    return run


def stream_stale(polls: DataFrame, max_age: int = 300, late: str = "10 minutes", live: bool = False) -> DataFrame:
    """Feeds whose header stands still: (feed, header_ts, since, at, stale), one row when it has not moved for ``max_age`` seconds
    and one when it moves again.  Input one row per (feed, poll): poll_ts, header_ts.

    Polls of a feed tell by themselves; a timer tells of feeds that are not polled any more.  ``live``: the timer is the clock of the cluster, for a
    running service; else it is the watermark of all feeds' polls, and a replay gives the same rows as
    :func:`~kerbline.operators.quality.stale_changes`.
    """
    clock_ = GroupStateTimeout.ProcessingTimeTimeout if live else GroupStateTimeout.EventTimeTimeout
    p = polls.where("poll_ts is not null").select("feed", "poll_ts", "header_ts")
    p = p if live else with_event_time(p, "poll_ts", late)
    return p.groupBy("feed").applyInPandasWithState(_stale(max_age, not live), STALE_SCHEMA, "header long, since long, seen long, stale boolean", "append", clock_)


PASSAGE_SCHEMA = "vehicle_id string, route_id string, direction_id int, stop_id string, ts long, event_id long"


def _passages(ttl: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Rows where the vehicle's stop changes; the state is its last stop and the report that named it."""
        if state.hasTimedOut:
            state.remove()
            return
        last, seen, event = state.get if state.exists else (None, -(2**62), -(2**62))
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"])
        # a report before the last one known comes too late to tell a passage
        pdf = pdf[(pdf["ts"] > seen) | ((pdf["ts"] == seen) & (pdf["event_id"] > event))]
        if pdf.empty:
            return
        stops = pdf["stop_id"].tolist()
        out = pdf[[a != b for a, b in zip(stops, [last, *stops[:-1]])]]
        newest = int(pdf["ts"].iloc[-1])
        state.update((stops[-1], newest, int(pdf["event_id"].iloc[-1])))
        state.setTimeoutTimestamp(max(newest + ttl, state.getCurrentWatermarkMs() // 1000 + 1) * 1000)
        yield pd.DataFrame({
            "vehicle_id": pd.Series([key[0]] * len(out), dtype=object), "route_id": out["route_id"].astype(object).to_numpy(), "direction_id": out["direction_id"].to_numpy(),
            "stop_id": out["stop_id"].astype(object).to_numpy(), "ts": out["ts"].to_numpy(), "event_id": out["event_id"].to_numpy()})

    return run


def stream_passages(pings: DataFrame, late: str = "1 hour", ttl: int = 30 * clock.DAY_S) -> DataFrame:
    """Stop passages as reports arrive: one small state row per vehicle, dropped when it is silent for ``ttl`` seconds.

    Reports that come after a later one of their vehicle are left out, so no passage is told twice or taken back.
    """
    p = with_event_time(pings, "ts", late).select("vehicle_id", "route_id", "direction_id", "stop_id", "ts", "event_id", "event_time")
    return p.groupBy("vehicle_id").applyInPandasWithState(
        _passages(ttl), PASSAGE_SCHEMA, "stop string, seen long, event long", "append", GroupStateTimeout.EventTimeTimeout)


class _InOrder(StatefulProcessor):
    """Keeps a bucket's rows until the watermark has passed them, then hands them on in the order of (ts, event_id) within each key, with what was
    remembered of the key.  What is remembered goes after ``ttl`` seconds of silence.

    Rows and memories are kept as Arrow batches, one state value for each batch of rows: values of Python per row or key would cost far more than the
    work itself.  A bucket has one timer, at its first waiting row or its oldest memory.
    """

    KEY: list[str]
    ROW = MEMORY = ""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.memory = handle.getValueState("memory", "rows binary")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if len(pdf):
                self.waiting.appendValue((_packed(pdf, self.ROW),))
                least = int(pdf["ts"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self.call(_after(first))
        return iter([])

    def call(self, at: int) -> None:
        """Have the timer run at ``at``, or earlier if it is set so."""
        due = self.timer.get()[0] if self.timer.exists() else None
        if due is None or at < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs()
        rows = _unpacked([r[0] for r in self.waiting.get()], self.ROW)
        memory = _unpacked([self.memory.get()[0]] if self.memory.exists() else [], self.MEMORY)
        late = rows["ts"].to_numpy(dtype="int64") * 1000 >= passed
        rest, due = rows[late], rows[~late]
        if len(due):
            self.waiting.clear()
            if len(rest):
                self.waiting.put([(_packed(rest[i : i + BATCH], self.ROW),) for i in range(0, len(rest), BATCH)])
            out, memory = self.step(*self.in_order(memory, due))
            if len(out):
                yield out
        memory = memory[_after(memory["ts"].to_numpy(dtype="int64") + self.ttl) > passed]
        if len(memory):
            self.memory.update((_packed(memory, self.MEMORY),))
        else:
            self.memory.clear()
        for ts in ([int(rest["ts"].min())] if len(rest) else []) + ([int(memory["ts"].min()) + self.ttl] if len(memory) else []):
            self.call(_after(ts))

    def in_order(self, memory: pd.DataFrame, due: pd.DataFrame) -> tuple[pd.DataFrame, pd.Series, np.ndarray]:
        """Memories and rows due by key, a key's memory first; which are rows, and which stand behind another of their key."""
        due = due.sort_values(["ts", "event_id"], kind="stable")
        both = pd.concat([memory, due], ignore_index=True)
        k = both.groupby(self.KEY, sort=False, dropna=False).ngroup().to_numpy()
        order = np.argsort(k, kind="stable")
        return both.iloc[order].reset_index(drop=True), order >= len(memory), np.append(False, k[order][1:] == k[order][:-1])

    def close(self) -> None:
        pass


#: Rows of one state value.
BATCH = 10_000
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _packed(rows: pd.DataFrame, kinds: str) -> bytes:
    """Columns as an Arrow batch: whole numbers that pandas holds as floats become whole again, missing ones null."""
    schema = pa.schema([(c, ARROW[k]) for c, k in (x.split() for x in kinds.split(", "))])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_batch(pa.RecordBatch.from_pandas(rows[schema.names], schema=schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(parts: list[bytes], kinds: str) -> pd.DataFrame:
    schema = pa.schema([(c, ARROW[k]) for c, k in (x.split() for x in kinds.split(", "))])
    read = [pa.ipc.open_stream(x).read_all() for x in parts]
    table = pa.concat_tables(read) if read else schema.empty_table()
    return table.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get)


def _after(ts):
    """The timer of a second.  Watermarks stand at whole seconds where the lateness allowed does, and Spark may never call a timer that the watermark
    has stood on exactly."""
    return ts * 1000 + 1


class _Passages(_InOrder):
    """Vehicle to passage: its rows where the stop changes.  Remembered: the last report's time and stop.

    A row waits until the watermark is later than its second, so one at the watermark itself is told a batch later, when Spark takes that very
    moment as late already; the next state's event time is a millisecond after the second.
    """

    KEY = ["vehicle_id"]
    ROW = "vehicle_id string, ts long, event_id long, stop_id string, route_id string, direction_id int"
    MEMORY = "vehicle_id string, ts long, stop_id string"
    OUT = "vehicle_id string, route_id string, direction_id int, stop_id string, ts long, event_id long, event_time timestamp"

    def step(self, both, row, behind):
        ts, stop = both["ts"].to_numpy(dtype="int64"), both["stop_id"].to_numpy()
        same = behind & (np.append(False, stop[1:] == stop[:-1])) & (np.append(0, np.diff(ts)) <= self.ttl)
        out = both.loc[row & ~same, ["vehicle_id", "route_id", "direction_id", "stop_id", "ts", "event_id"]].reset_index(drop=True)
        out["event_time"] = pd.to_datetime(_after(out["ts"].to_numpy(dtype="int64")), unit="ms", utc=True)
        return out.astype({"direction_id": "Int32"}), both.loc[np.append(~behind[1:], True), ["vehicle_id", "ts", "stop_id"]]


class _Headways(_InOrder):
    """Stop to the passage before: seconds since then.  Remembered: the time of the last passage."""

    KEY = ["route_id", "direction_id", "stop_id"]
    ROW = "ts long, event_id long, vehicle_id string, route_id string, direction_id int, stop_id string"
    MEMORY = "route_id string, direction_id int, stop_id string, ts long"
    OUT = "route_id string, direction_id int, stop_id string, vehicle_id string, ts long, event_id long, headway_s long"

    def step(self, both, row, behind):
        gap = np.append(0, np.diff(both["ts"].to_numpy(dtype="int64")))
        both["headway_s"] = pd.array(gap, dtype="Int64")
        both.loc[~behind | (gap > self.ttl), "headway_s"] = pd.NA
        out = both.loc[row, ["route_id", "direction_id", "stop_id", "vehicle_id", "ts", "event_id", "headway_s"]].reset_index(drop=True)
        return out.astype({"direction_id": "Int32", "headway_s": "Int64"}), both.loc[np.append(~behind[1:], True), [*self.KEY, "ts"]]


def stream_headways(pings: DataFrame, late: str = "1 hour", ttl: int = 30 * clock.DAY_S, buckets: int = 256) -> DataFrame:
    """Headways as reports arrive: vehicles tell passages, and passages of a stop (route, direction, stop) tell the seconds since the one before.

    Two chained keyed states.  Rows wait until the watermark has passed them, so reports may come in any order within ``late`` and the
    result equals the batch job; later ones are left out.  A vehicle or a stop that is silent for ``ttl`` seconds is forgotten: its next
    passage has no headway.  Vehicles and stops are dealt to ``buckets``, as a call of Python per bucket costs far less than one per vehicle; a bucket's
    rows that wait are held by one task at a time, some hundred thousand do no harm.  Needs :data:`STORE` (``run_to_table(..., chained=True)``).
    """
    p = pings.where("stop_id is not null and stop_id <> '' and route_id is not null and ts is not null")
    p = with_event_time(p, "ts", late).select("vehicle_id", "route_id", "direction_id", "stop_id", "ts", "event_id", "event_time")

    def dealt(rows, keys):
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).groupBy("bucket")

    told = dealt(p, _Passages.KEY).transformWithStateInPandas(_Passages(ttl), _Passages.OUT, "append", "eventtime", eventTimeColumnName="event_time")
    return dealt(told, _Headways.KEY).transformWithStateInPandas(_Headways(ttl), _Headways.OUT, "append", "eventtime")
