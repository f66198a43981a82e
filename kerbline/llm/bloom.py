"""Bloom filters, built by tasks and merged chunk by chunk, or dealt over tasks by ranges of hashes.

A filter never denies a key that it was given.  One that goes to all tasks is sized by :func:`bits_for` up to ``MOST_BITS``; with more
keys than that suits it lets more through, which costs work later and no result.  The once-seen and twice-seen filters
of :func:`repeated` cover one range of hashes each: their number grows with the keys, their size doesn't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.words import U, mix
from kerbline.session import materialize

CHUNK_BITS = 1 << 20
#: Bits a key, and the most of a filter that goes to all tasks: 128 MB.
PER_KEY, MOST_BITS = 16, 1 << 30
#: Keys of a range, and keys that a task holds before it hands them on: rows and groups of a few MB at most.
RANGE, HELD = 1 << 18, 1 << 16
PACKED = "hashes binary, again binary, n long"
PART = "chunk int, bits binary"
_BIT = (1 << np.arange(8)).astype(np.uint8)


def places(key: np.ndarray, bits: int) -> np.ndarray:
    """The two bits of every 64-bit key."""
    key = mix(key)
    mask = U(bits - 1)
    return np.concatenate([key & mask, (key >> U(32)) & mask]).astype(np.int64)


def set_bits(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, at >> 3, _BIT[at & 7])


def has(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = places(key, 8 * len(bitmap))
    hit = (bitmap[at >> 3] & _BIT[at & 7]) != 0
    return hit[: len(key)] & hit[len(key) :]


def _packed(bitmap: np.ndarray) -> Iterator[tuple]:
    """The chunks of a bitmap that have bits: as places where they are few, else as they are."""
    size = CHUNK_BITS // 8
    for chunk in range(0, len(bitmap), size):
        part = bitmap[chunk : chunk + size]
        n = int(np.bitwise_count(part).sum())
        if n:
            few = 4 * n < len(part)
            data = np.flatnonzero(np.unpackbits(part, bitorder="little")).astype("<u4").tobytes() if few else part.tobytes()
            yield chunk // size, (b"p" if few else b"b") + data


def _unpacked(data: bytes, size: int) -> np.ndarray:
    if data[:1] == b"b":
        return np.frombuffer(data, np.uint8, offset=1)
    out = np.zeros(size, np.uint8)
    set_bits(out, np.frombuffer(data, "<u4", offset=1).astype(np.int64))
    return out


def _batch(chunk: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([data], pa.binary())], names=["chunk", "bits"])


def _build(keys: Callable[[pa.RecordBatch], np.ndarray], bits: int):
    def run(batches):
        bitmap = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            set_bits(bitmap, places(np.unique(keys(batch)), bits))
        for part in _packed(bitmap):
            yield _batch(*part)

    return run


def _merge(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, chunk = np.zeros(size, np.uint8), 0
        for batch in batches:
            for chunk, data in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):  # noqa: B007
                bitmap |= _unpacked(data, size)
        yield _batch(chunk, b"b" + bitmap.tobytes())

    return run


def bitmap_of(df: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """The filter of all keys that ``keys`` finds in the batches of ``df``, on the driver: ``bits`` / 8 bytes whatever
    the table.  ``bits`` is a power of two, 2^20 or more."""
    size = CHUNK_BITS // 8
    parts = df.mapInArrow(_build(keys, bits), PART).groupBy("chunk").applyInArrow(_merge(size), PART)
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in parts.collect():
        bitmap[row["chunk"] * size : (row["chunk"] + 1) * size] = _unpacked(bytes(row["bits"]), size)
    return bitmap


def bits_for(n: int, most: int = MOST_BITS) -> int:
    """A power of two that gives ``n`` keys ``PER_KEY`` bits each, within 2^20 and ``most``."""
    return min(most, max(CHUNK_BITS, 1 << (max(1, PER_KEY * n) - 1).bit_length()))


def _words(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def _gathered(keys: Callable[[pa.RecordBatch], np.ndarray], held: int):
    """The distinct keys of about ``held`` at a time, and those among them that came more than once."""

    def pack(parts: list[np.ndarray]) -> pa.RecordBatch:
        key, count = np.unique(np.concatenate(parts), return_counts=True)
        data = [[key.astype("<u8").tobytes()], [key[count > 1].astype("<u8").tobytes()]]
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.binary()) for x in data), pa.array([len(key)], pa.int64())], names=["hashes", "again", "n"])

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            found = keys(batch)
            for at in range(0, len(found), held):
                parts.append(found[at : at + held])
                n += len(parts[-1])
                if n >= held:
                    yield pack(parts)
                    parts, n = [], 0
        if n:
            yield pack(parts)

    return run


def _dealt(ranges: int):
    """Packed keys by range; those seen more than once come a second time."""

    def run(batches):
        for batch in batches:
            for hashes, again in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = np.concatenate([_words(hashes), _words(again)])
                part = ((key >> U(32)) * U(ranges) >> U(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                parts, first = np.unique(part[order], return_index=True)
                out = [x.tobytes() for x in np.split(key[order], first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(out, pa.binary())], names=["part", "hashes"])

    return run


def _seen_twice(bits: int):
    def run(table: pa.Table) -> pa.Table:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        rows = [_words(x) for x in table["hashes"].to_pylist()]
        for row in rows:
            key, count = np.unique(row, return_counts=True)
            set_bits(twice, places(key[(count > 1) | has(once, key)], bits))
            set_bits(once, places(key, bits))
        hit = [np.unique(row[has(twice, row)]) for row in rows]
        found = np.unique(np.concatenate(hit)) if hit else np.zeros(0, np.uint64)
        return pa.table({"hashes": pa.array([found.astype("<u8").tobytes()], pa.binary()), "n": pa.array([len(found)], pa.int64())})

    return run


def repeated(df: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], label: str) -> np.ndarray:
    """A filter of the keys that ``keys`` finds twice or more in the batches of ``df`` (and a few others), on the driver.

    ``df`` is read once: its keys, 8 bytes each, are written and counted.  Ranges of about ``RANGE`` keys then have a once-seen
    and a twice-seen filter each, in the task that gets the range.  A key that is everywhere comes once from every ``HELD`` keys of a task.
    Only the keys that the twice-seen filters know make the filter that is returned.
    """
    packed = materialize(df.mapInArrow(_gathered(keys, HELD), PACKED), label)
    n = packed.agg(F.sum(F.col("n") + F.length("again") / 8)).first()[0] or 0
    ranges = max(1, -(-int(n) // RANGE))
    dealt = packed.select("hashes", "again").mapInArrow(_dealt(ranges), "part int, hashes binary")
    found = materialize(dealt.groupBy("part").applyInArrow(_seen_twice(bits_for(RANGE)), "hashes binary, n long"), label)
    many = found.agg(F.sum("n")).first()[0] or 0
    return bitmap_of(found.select("hashes"), packed_keys, bits_for(int(many)))


def packed_keys(batch: pa.RecordBatch) -> np.ndarray:
    return _words(b"".join(batch.column(0).to_pylist()))


def longs(batch: pa.RecordBatch) -> np.ndarray:
    """Keys of a first column of whole numbers, or of arrays of them."""
    column = batch.column(0)
    if pa.types.is_list(column.type):
        column = column.flatten()
    return column.drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
