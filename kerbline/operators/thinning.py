"""Thin a time series to a minimum gap: keep the first point, then the next one at least ``gap`` later.

The rule is sequential, but its state is a single number: the seconds still
blocked.  Each chunk of the clock is therefore summarised by what leaves it for
every point it could start at; the summaries are made in parallel, chained per
series (one row per chunk), and every chunk then keeps its points knowing its own
entry state.  No series has to fit one task, whatever its length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_S = 21_600


def _exits(ts: np.ndarray, end: int, gap: int) -> np.ndarray:
    """Seconds still blocked at the chunk's end when the first kept point is the i-th one."""
    out = np.maximum(0, ts + gap - end)
    following = np.searchsorted(ts, ts + gap, side="left")
    for i in range(len(ts) - 1, -1, -1):
        if following[i] < len(ts):
            out[i] = out[following[i]]
    return out


def _kept(ts: np.ndarray, free: int, gap: int) -> list[int]:
    kept, i = [], int(np.searchsorted(ts, free, side="left"))
    while i < len(ts):
        kept.append(int(ts[i]))
        i = int(np.searchsorted(ts, ts[i] + gap, side="left"))
    return kept


@F.pandas_udf(T.ArrayType(T.LongType()))
def _chunk_exits(ts: pd.Series, chunk: pd.Series, gap: pd.Series) -> pd.Series:
    """Exit states of each chunk, for the points a series can enter it at (fewer than ``gap`` seconds blocked)."""
    out = []
    for t, c, g in zip(ts, chunk, gap):
        t = np.asarray(t)
        m = int(np.searchsorted(t, c * CHUNK_S + g)) + 1
        out.append(_exits(t, (c + 1) * CHUNK_S, g)[:m])
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _chain(chunks: pd.Series, ts: pd.Series, exits: pd.Series) -> pd.Series:
    """First free second of every chunk of a series, in chunk order."""
    out = []
    for cs, tss, exs in zip(chunks, ts, exits):
        free, row = None, []
        for c, t, e in zip(cs, tss, exs):
            start = int(c) * CHUNK_S
            free = start if free is None else max(free, start)
            row.append(free)
            i = int(np.searchsorted(t, free, side="left"))
            if i < len(e):
                free = start + CHUNK_S + int(e[i])
        out.append(row)
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _keep(ts: pd.Series, free: pd.Series, gap: pd.Series) -> pd.Series:
    return pd.Series([_kept(np.asarray(t), int(f), int(g)) for t, f, g in zip(ts, free, gap)], dtype=object)


def thin(series: DataFrame, key: str, ts: str, gap: int = 60) -> DataFrame:
    """Rows kept by the rule, plus the last row of each series; ``gap`` must not exceed the chunk."""
    if not 0 < gap <= CHUNK_S:
        raise ValueError(f"gap must be between 1 and {CHUNK_S} seconds")
    s = series.select(F.col(key).alias("k"), F.floor(F.col(ts) / CHUNK_S).cast("long").alias("c"), F.col(ts).cast("long").alias("t"))
    # at most one entry per second of the chunk
    chunks = s.groupBy("k", "c").agg(F.sort_array(F.collect_set("t")).alias("ts"))
    g = F.lit(gap).cast("long")
    tables = chunks.withColumn("exits", _chunk_exits("ts", "c", g)).select("k", "c", F.slice("ts", F.lit(1), F.size("exits")).alias("ts"), "exits")
    # per chunk of the series at most ``gap`` + 1 entry points
    line = tables.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("c", "ts", "exits"))).alias("l"))
    free = line.select("k", F.col("l.c").alias("cs"), _chain("l.c", "l.ts", "l.exits").alias("free"))
    entries = free.select("k", F.explode(F.arrays_zip("cs", "free")).alias("z")).select("k", F.col("z.cs").alias("c"), "z.free")
    kept = chunks.join(entries, ["k", "c"]).select("k", F.explode(_keep("ts", "free", g)).alias("t"))
    marks = kept.unionByName(s.groupBy("k").agg(F.max("t").alias("t"))).distinct()
    marks = marks.withColumnsRenamed({"k": "__k", "t": "__t"})
    return series.join(marks, (F.col(key) == F.col("__k")) & (F.col(ts) == F.col("__t")), "left_semi")
