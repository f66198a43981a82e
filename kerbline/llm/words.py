"""Vectorised word and shingle hashes over Arrow batches.

Texts are taken as UTF-8 bytes.  A word is a run of bytes that are no delimiter; delimiters are ASCII,
so no multi-byte character is ever cut.  Hashes are 64-bit: a random value per byte, weighted by odd
powers over the positions in the word, then mixed.  All work is numpy over chunks of about a megabyte,
so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U = np.uint64

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: ASCII white space, punctuation and control characters: what separates bare words.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(i).isalnum() for i in range(128)]

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BYTE[range(0x41, 0x5B)] = _BYTE[range(0x61, 0x7B)]  # A-Z count as a-z
_STEP = U(0x9E3779B97F4A7C15)
_ORDER = _RANDOM.integers(1, 2**63, 16, dtype=np.uint64) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(4096)


def _of_length(n: int) -> np.ndarray:
    return _POWERS if n <= len(_POWERS) else powers(n)


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes, one row at least."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end
        row = end


class Words:
    """The words of the rows of one chunk: ``first[i] : first[i + 1]`` are those of row i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, delimiter: np.ndarray = WHITE, stem: int = 0):
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        n = len(data)
        gap = delimiter[data]
        edge = np.ones(n + 1, bool)
        edge[1:n] = gap[: n - 1]
        edge[offsets] = True
        starts = np.flatnonzero(~gap & edge[:n])
        self.first = np.searchsorted(starts, offsets)
        self.hash = np.zeros(0, np.uint64)
        self.stem = self.hash
        if len(starts):
            at = np.zeros(n, np.int64)
            at[starts[0]] = starts[0]
            at[starts[1:]] = np.diff(starts)
            at = np.arange(n) - np.cumsum(at)
            at[: starts[0]] = 0
            value = _BYTE[data] * _of_length(int(at.max()) + 1)[at]
            value[gap] = 0
            self.hash = mix(np.add.reduceat(value, starts))
            if stem:
                value[at >= stem] = 0
                self.stem = mix(np.add.reduceat(value, starts) + U(stem))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words (repeats included) and the offsets of the rows; a row of fewer words
        has its whole sequence as one, a row without words has none."""
        n, words = len(self.hash), np.diff(self.first)
        count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
        offsets = np.concatenate([[0], np.cumsum(count)])
        total = np.zeros(n, np.uint64)
        row = np.repeat(np.arange(len(words)), words)
        for j in range(min(k, n)):
            part = self.hash[j:] * _ORDER[j]
            same = row[j:] == row[: n - j]
            part[~same] = 0
            total[: n - j] += part
        inside = np.arange(n) - np.repeat(self.first[:-1], words) < np.repeat(count, words)
        return mix(total[inside]), offsets


def spans(data: np.ndarray, offsets: np.ndarray, delimiter: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every word in the rows of one chunk, and ``first`` as in :class:`Words`; places are those in ``data``."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    inside = np.zeros(hi - lo + 2, bool)
    inside[1:-1] = ~delimiter[data[lo:hi]]
    inside = inside.view(np.int8)
    starts, ends = (np.flatnonzero(np.diff(inside) == x) for x in (1, -1))
    # a word that runs over a row's end is one word in each of the rows
    cut = offsets[1:-1] - lo
    cut = np.unique(cut[(inside[cut] & inside[cut + 1]).astype(bool)])
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts + lo, ends - starts, np.searchsorted(starts, offsets - lo)
