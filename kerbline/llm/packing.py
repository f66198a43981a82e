"""Packing of documents into sequences: length patterns fitted by non-negative least squares.

Only the histogram of piece lengths (one count per length, at most ``size`` numbers) is planned:

1. Patterns of one to three lengths that fill a sequence, on a grid of ``size`` / GRID lengths.
2. Repeat counts that fit the histogram by non-negative least squares, rounded down.
3. What the patterns leave is packed by best fit: the longest lengths first, each into the fullest sequence
   with room, whole runs of equal sequences at a time.

The plan is a list of runs (lengths of a sequence, how often).  Pieces find their place in it by their rank among
pieces of their length; ranks come from counts per length and salt, so the commonest length spreads over tasks.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections import Counter
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.tokens import token_ids
from kerbline.llm.words import as_bytes, chunks
from kerbline.session import materialize, small_batches

GRID, SALTS = 128, 64
#: Bytes of text that are cut into pieces at a time, one text at least.
CHUNK = 1 << 20
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """The non-negative x of least |a x - b|, by active sets (Lawson and Hanson)."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    gram, target = a.T @ a, a.T @ b
    slack = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds or 3 * a.shape[0]):
        gain = target - gram @ x
        gain[active] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= slack:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(gram[np.ix_(at, at)], target[at], rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = (x[at][low] / np.maximum(x[at][low] - z[low], 1e-300)).min()
            x[at] += step * (z - x[at])
            active[at[(x[at] <= 1e-12) & low]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def patterns(cells: int, present: list[int]) -> list[tuple[int, ...]]:
    """One to three of the cells ``present``, longest first, that together fill ``cells`` exactly."""
    have = set(present)
    out = [(cells,)] if cells in have else []
    for i in present:
        for j in present:
            if j <= i < cells:
                if i + j == cells:
                    out.append((i, j))
                elif i + j < cells and (k := cells - i - j) <= j and k in have:
                    out.append((i, j, k))
    return out


class _Stock:
    """How many pieces of every length are left."""

    def __init__(self, histogram: dict[int, int]):
        self.left = {x: n for x, n in histogram.items() if n}
        self.lengths = sorted(self.left)

    def most(self, room: int, over: int) -> int | None:
        """The longest length of at most ``room`` and more than ``over`` that is left."""
        i = bisect.bisect_right(self.lengths, room) - 1
        return self.lengths[i] if i >= 0 and self.lengths[i] > over else None

    def take(self, lengths: tuple[int, ...], most: int) -> int:
        """Takes as many sets of ``lengths`` as there are, up to ``most``."""
        need = Counter(lengths)
        n = min([most, *(self.left[x] // k for x, k in need.items())])
        for x, k in need.items():
            self.left[x] -= n * k
            if not self.left[x]:
                del self.left[x]
                self.lengths.pop(bisect.bisect_left(self.lengths, x))
        return n


def _of_shape(shape: tuple[int, ...], stock: _Stock, cell: int, size: int) -> tuple[int, ...] | None:
    """Lengths that are left for a pattern: the longest of its cells, for its last the longest that still fits."""
    lengths: list[int] = []
    for c in shape[:-1]:
        n = Counter(lengths)
        top = c * cell
        while (x := stock.most(top, (c - 1) * cell)) is not None and stock.left[x] <= n[x]:
            top = x - 1
        if x is None:
            return None
        lengths.append(x)
    n, room = Counter(lengths), size - sum(lengths)
    while (x := stock.most(room, (shape[-1] - 1) * cell)) is not None and stock.left[x] <= n[x]:
        room = x - 1
    return None if x is None else (*lengths, x)


def plan(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths of a sequence in order, repeats) that hold every piece of the histogram once."""
    cell = max(1, size // GRID)
    cells = size // cell
    up = lambda length: -(-length // cell)
    cell_counts: Counter = Counter()
    for length, n in histogram.items():
        cell_counts[up(length)] += n
    present = sorted(cell_counts)
    shapes = patterns(cells, present)
    runs: list[tuple[tuple[int, ...], int]] = []
    stock = _Stock(histogram)
    if shapes:
        row = {c: i for i, c in enumerate(present)}
        matrix = np.zeros((len(present), len(shapes)))
        for j, shape in enumerate(shapes):
            for c in shape:
                matrix[row[c], j] += 1
        # short pieces are easy to place later, so their misfit weighs less
        weight = np.array([0.1 + c / cells for c in present])
        want = np.array([cell_counts[c] for c in present], float)
        scale = want.max()
        repeats = np.floor(nnls(matrix * weight[:, None], want / scale * weight) * scale + 1e-6).astype(np.int64)
        for shape, n in sorted(zip(shapes, repeats.tolist(), strict=True), key=lambda s: (-s[0][0], s[0])):
            while n > 0 and (lengths := _of_shape(shape, stock, cell, size)):
                some = stock.take(lengths, n)
                runs.append((lengths, some))
                n -= some
    return _best_fit(stock.left, size, runs)


def _best_fit(left: dict[int, int], size: int, runs: list[tuple[tuple[int, ...], int]]) -> list[tuple[tuple[int, ...], int]]:
    """Places the pieces of ``left`` into the room of ``runs`` and into new sequences."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for lengths, n in runs:
        by_room.setdefault(size - sum(lengths), []).append((lengths, n))
    rooms = sorted(by_room)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                lengths, k = by_room[room].pop()
                some = min(n, k)
                if k > some:
                    by_room[room].append((lengths, k - some))
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(i)
            else:
                per = max(1, size // length)
                lengths, room = (), size
                some = min(n, -(-n // per))
            lengths, room, n = (*lengths, length), room - length, n - some
            if room not in by_room:
                bisect.insort(rooms, room)
            by_room.setdefault(room, []).append((lengths, some))
    return [run for room in sorted(by_room) for run in by_room[room]]


def _pieces(path: str, size: int):
    def run(batches):
        for batch in batches:
            data, offsets = as_bytes(batch.column(1))
            for lo, hi in chunks(offsets, CHUNK):
                out = []
                for doc_id, ids in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), token_ids(data, offsets[lo : hi + 1], path), strict=True):
                    for piece, start in enumerate(range(0, len(ids), size)):
                        part = ids[start : start + size]
                        out.append((doc_id, piece, start, len(part), zlib.crc32(part)))
                columns = zip(*out, strict=True)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _placed(table):
    """Sequence and offset of every (length, rank)."""

    def run(batches):
        begin, times, base, offset = table.value
        for batch in batches:
            key = batch.column("length").to_numpy() * (1 << 48) + batch.column("rank").to_numpy()
            at = np.searchsorted(begin, key, "right") - 1
            inside = key - begin[at]
            # the k-th piece of a run of sequences that hold ``times`` of its length side by side
            sequence = base[at] + inside // times[at]
            place = offset[at] + (inside % times[at]) * (begin[at] >> 48)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(place)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def _lookup(runs: list[tuple[tuple[int, ...], int]]):
    """The plan as arrays sorted by (length, first rank)."""
    used: Counter = Counter()
    rows, base = [], 0
    for lengths, n in runs:
        offset = 0
        for length, group in itertools.groupby(sorted(lengths, reverse=True)):
            times = len(list(group))
            rows.append((length * (1 << 48) + used[length], times, base, offset))
            used[length] += n * times
            offset += times * length
        base += n
    rows.sort()
    begin, times, base_, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
    return begin, times, base_, offset


def pack(docs: DataFrame, tokenizer: str, size: int = 2048) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text by the tokenizer file, then id 0; longer ones are cut into pieces of
    ``size``.  Null and empty texts are the one id 0.  Every row of ``docs`` is a document, also where a doc_id comes again;
    a null doc_id stays null.  Sequences hold ``size`` ids at most and have no gaps.  An empty table gives an empty result.  Columns
    other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    with small_batches(spark):
        pieces = materialize(plain.mapInArrow(_pieces(tokenizer, size), PIECE), "pieces")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).alias("salt")
    salted = pieces.select("*", salt)
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(_lookup(plan(histogram, size)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    counts = counts.select(F.col("length").alias("l"), F.col("salt").alias("s"), before.alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("n", F.row_number().over(order) - 1)
    ranked = ranked.join(counts, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s")))
    ranked = ranked.select(*pieces.columns, (F.col("before") + F.col("n")).alias("rank"))
    return ranked.mapInArrow(_placed(table), f"{PIECE}, sequence_id long, offset long")
