"""How the sources of a language differ in their words: count-level bitmaps.

A source's smoothed share of a term depends only on the term's count there.  So terms are kept as bitsets per (source, count): 64 terms a
word, terms of like frequency side by side.  For two sources, AND and popcount of two of their bitsets give the number of terms that have one count here and the
other there; times the difference of the two shares, and summed, that is the divergence.  Terms that a source lacks are the complement of all its bitsets.

Terms are numbered inside slabs (language, power of two of the frequency, part), so no numbering passes one task.  A slab's bitsets
meet in tasks of one pair of source blocks each, which give one sum per pair of sources.  All numbers are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.words import as_bytes, chunks, spans
from kerbline.session import materialize

#: Terms of a slab's part and sources of a block, on average at most.
SLAB, BLOCK = 4096, 32
CHUNK_BYTES = 1 << 25
COUNTED = "lang string, source string, term string, n long, docs long"

#: ASCII but for letters: what separates terms.
NOT_LETTER = np.zeros(256, bool)
NOT_LETTER[:128] = [not chr(i).isalpha() for i in range(128)]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the rows of one chunk, one after the other, and the row of each."""
    start, length, first = spans(data, offsets, NOT_LETTER)
    part = data[offsets[0] : offsets[-1]]
    letters = _LOWER[part[~NOT_LETTER[part]]]
    ends = np.concatenate([[0], np.cumsum(length)])
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)])
    return terms, np.repeat(np.arange(len(first) - 1), np.diff(first))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per (lang, source, term); every (lang, source) also with the empty term and none."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
        pairs = pa.Table.from_batches([batch.select([0, 1])]).group_by(["lang", "source"], use_threads=False).aggregate([])
        place = {tuple(p.values()): i for i, p in enumerate(pairs.to_pylist())}
        group = np.fromiter((place[tuple(p.values())] for p in names.to_pylist()), np.int64, batch.num_rows)
        none = pa.array([0] * len(pairs), pa.int64())
        yield _rows(pairs, np.arange(len(pairs)), pa.array([""] * len(pairs)), none, none)
        data, offsets = as_bytes(batch.column(2))
        for lo, hi in chunks(offsets, CHUNK_BYTES):
            terms, row = _terms(data, offsets[lo : hi + 1])
            if not len(terms):
                continue
            coded = terms.dictionary_encode()
            size = len(coded.dictionary)
            # one number per (row, term): its distinct values are what a document counts for
            seen, n = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
            key = group[lo + seen // size] * size + seen % size
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            begin = np.flatnonzero(np.diff(key, prepend=-1))
            docs = np.diff(np.append(begin, len(key)))
            each = key[begin]
            words = coded.dictionary.cast(pa.large_string()).take(pa.array(each % size)).cast(pa.string())
            yield _rows(pairs, each // size, words, pa.array(np.add.reduceat(n, begin)), pa.array(docs))


def _rows(pairs: pa.Table, group: np.ndarray, term: pa.Array, n: pa.Array, docs: pa.Array) -> pa.RecordBatch:
    at = pa.array(group)
    lang, source = (pairs[c].combine_chunks().take(at) for c in ("lang", "source"))
    return pa.RecordBatch.from_arrays([lang, source, term, n.cast(pa.int64()), docs.cast(pa.int64())], names=["lang", "source", "term", "n", "docs"])


def share(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), exactly: three digits at a time, so that nothing overflows."""
    of = lambda c: F.col(c) if isinstance(c, str) else c
    over = of(total) + 5 * of(terms)
    rest, out = of(n) + 5, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, over)
        rest = (rest * 1000) % over
    # a share of one: the remainders above hold only what is below it
    return 1 + out


def _sums(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Over the terms of a slab: the sum of differences for every source of one block and every one of the other.

    ``side`` is 0 or 1 for the two blocks.  Rows without chunk are the sources themselves: ``p`` is their share of a term
    that they lack, ``bits`` the number of terms of the slab.
    """
    side, p, chunk, bits = (table[c].to_numpy() for c in ("side", "p", "chunk", "bits"))
    lists = chunk < 0
    size = int(bits[lists][0])
    source = table["source"].combine_chunks().dictionary_encode()
    names, code = source.dictionary, source.indices.to_numpy()
    sides = []
    for s in (0, 1):
        own = np.flatnonzero(lists & (side == s))
        place = np.zeros(len(names), np.int64)
        place[code[own]] = np.arange(len(own))
        at = np.flatnonzero(~lists & (side == s))
        at = at[np.argsort(chunk[at], kind="stable")]
        sides.append((code[own], p[own], place[code[at]], p[at], chunk[at], bits[at].view(np.uint64)))
    if not all(len(x[0]) for x in sides):
        return pa.table({"lang": pa.array([], pa.string()), "source": pa.array([], pa.string()), "item": pa.array([], pa.string()), "value": pa.array([], pa.int64())})
    total = np.zeros((len(sides[0][0]), len(sides[1][0])), np.int64)
    for c in range(-(-size // 64)):
        mask = np.uint64((1 << min(64, size - 64 * c)) - 1)
        of, share_, words, begin = zip(*(_levels(x, c, mask) for x in sides), strict=True)
        both = np.bitwise_count(words[0][:, None] & words[1][None, :]).astype(np.int64)
        both *= np.abs(share_[0][:, None] - share_[1][None, :])
        total += np.add.reduceat(np.add.reduceat(both, begin[0], 0), begin[1], 1)
    i, j = (x.ravel() for x in np.indices(total.shape))
    return pa.table({
        "lang": pa.array([group[0].as_py()] * len(i), pa.string()),
        "source": names.take(pa.array(sides[0][0][i])).cast(pa.string()), "item": names.take(pa.array(sides[1][0][j])).cast(pa.string()), "value": pa.array(total.ravel()),
    })


def _levels(part: tuple[np.ndarray, ...], c: int, mask: np.uint64) -> tuple[np.ndarray, ...]:
    """Source, share and bitset of every count level in one chunk, sorted by source, none left out; level zero is the complement of the others."""
    sources, none, of, p, chunk, bits = part
    lo, hi = np.searchsorted(chunk, [c, c + 1])
    of, p, bits = of[lo:hi], p[lo:hi], bits[lo:hi]
    found = np.zeros(len(sources), np.uint64)
    np.bitwise_or.at(found, of, bits)
    of, p, bits = np.concatenate([np.arange(len(sources)), of]), np.concatenate([none, p]), np.concatenate([mask & ~found, bits])
    order = np.argsort(of, kind="stable")
    of = of[order]
    return of, p[order], bits[order], np.flatnonzero(np.diff(of, prepend=-1))


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from its others, and the terms it stands out by.

    ``docs`` has text, lang and source; null is the empty text in each, and other columns are not read.  Terms are runs of letters (A-Z in
    lower case; all beyond ASCII counts as letters).  A language keeps the terms found in ``min_docs`` of its rows or more.  With V of them and N
    occurrences, a count of n has the share 1 + floor(10^9 (n + 5) / (N + 5 V)).  Part ``pair``: for every other source of the language, the sum over kept terms
    of the absolute differences of the shares (0 without kept terms).  Part ``term``: the ``top`` kept terms of the source whose share
    exceeds the language's, by the difference.  Ranks go by value, then by item.  Rows are documents, whatever their doc_id.  A language of one source has
    no pairs.  An empty table gives an empty result.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    plain = docs.select(text("lang").alias("lang"), text("source").alias("source"), F.col("text").cast("binary").alias("text"))
    parts = plain.mapInArrow(_counted, COUNTED)
    counts = materialize(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")

    kept = counts.where("n > 0").groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = kept.select("lang", "term", "of_lang", F.floor(F.log2("of_lang")).cast("int").alias("band"))
    kept = materialize(kept, "kept")
    bands = kept.groupBy("lang", "band").agg(F.count(F.lit(1)).alias("size"), F.sum("of_lang").alias("n"))
    langs = bands.groupBy("lang").agg(F.sum("size").alias("terms"), F.sum("n").alias("total"))
    pieces = bands.select("lang", "band", F.ceil(F.col("size") / SLAB).cast("int").alias("pieces"))
    numbered = kept.join(pieces, ["lang", "band"]).withColumn("piece", F.pmod(F.xxhash64("term"), "pieces").cast("int"))
    slab = ["lang", "band", "piece"]
    numbered = numbered.withColumn("id", F.row_number().over(Window.partitionBy(*slab).orderBy(F.col("of_lang").desc(), "term")) - 1)
    numbered = materialize(numbered.select(*slab, "term", "of_lang", "id"), "numbered")

    cells = counts.where("n > 0").select("lang", "source", "term", "n").join(numbered, ["lang", "term"])
    cells = materialize(cells, "cells")
    groups = counts.select("lang", "source").distinct().join(langs, "lang", "left")
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = groups.join(sums, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("n_group", F.lit(0)).alias("n_group"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("total", F.lit(0)).alias("total")
    )
    of_lang = Window.partitionBy("lang")
    groups = groups.withColumn("blocks", F.ceil(F.count(F.lit(1)).over(of_lang) / BLOCK).cast("int"))
    groups = materialize(groups.withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int")), "groups")

    # bitsets per (group, count) of 64 terms each
    chunk = F.call_function("div", F.col("id"), F.lit(64)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") % 64).cast("int"))
    levels = cells.groupBy(*slab, "source", chunk.alias("chunk"), "n").agg(F.bit_or(bit).alias("bits"))
    levels = levels.join(groups, ["lang", "source"]).select(*slab, "source", "blocks", "block", "chunk", "bits", share("n", "n_group", "terms").alias("p"))
    slabs = numbered.groupBy(*slab).agg(F.count(F.lit(1)).alias("bits"))
    lists = slabs.join(groups, "lang").select(*slab, "source", "blocks", "block", F.lit(-1).alias("chunk"), "bits", share(F.lit(0), "n_group", "terms").alias("p"))
    rows = levels.unionByName(lists)
    # block i meets every block j >= i: as side 0 of (i, j) and as side 1 of (j', i)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = rows.where("block <= other").select(*slab, F.col("block").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), "source", "chunk", "bits", "p")
    right = rows.where("other <= block").select(*slab, F.col("other").alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "source", "chunk", "bits", "p")
    met = left.unionByName(right).groupBy(*slab, "i", "j").applyInArrow(_sums, "lang string, source string, item string, value long")
    met = met.where("source <> item").select("lang", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b"), "value", (F.col("source") < F.col("item")).alias("up"))
    # inside a block a pair is met from both of its sides; across blocks once
    met = met.groupBy("lang", "a", "b").agg(F.sum(F.when(F.col("up"), F.col("value"))).alias("up"), F.sum(F.when(~F.col("up"), F.col("value"))).alias("down"))
    met = met.select("lang", "a", "b", F.coalesce("up", "down").alias("value"))
    both = met.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(met.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(both, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    p = cells.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), share("n", "n_group", "terms").alias("p"), share("of_lang", "total", "terms").alias("q"))
    above = p.where("p > q").select("lang", "source", "item", (F.col("p") - F.col("q")).alias("value"))
    above = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(above.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
