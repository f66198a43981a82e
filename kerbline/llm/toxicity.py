"""Toxicity score: a factorization machine over hashed terms.

Terms are bare words and the first letters of words, hashed into 2^18 buckets.  From a bounded, evenly drawn sample of the
labelled rows the buckets that tell the classes apart are chosen, and a machine of degree two learns a weight and a short vector
for each: a text's log-odds are the sum of its weights and of the inner products of all pairs of its vectors.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kerbline.llm.lines import by_place, named, placed_fields
from kerbline.llm.words import NOT_ALNUM, U, Words, as_bytes, chunks

BUCKET_BITS, TERMS, FACTORS, STEM = 18, 8192, 8, 4
#: At most about so many labelled rows are learned from.
SAMPLE = 24_000
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of every row's words and stems, and the offsets of the rows."""
    words = Words(data, offsets, NOT_ALNUM, STEM)
    n = np.diff(words.first)
    row = np.repeat(np.arange(len(n)), n)
    bucket = np.concatenate([words.hash, words.stem]) >> U(64 - BUCKET_BITS)
    key = np.unique((np.concatenate([row, row]) << BUCKET_BITS) + bucket.astype(np.int64))
    row = key >> BUCKET_BITS
    return (key & ((1 << BUCKET_BITS) - 1)).astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))])


def choose(bucket: np.ndarray, row: np.ndarray, label: np.ndarray, most: int = TERMS) -> np.ndarray:
    """The buckets that differ most between the classes (chi-square of presence), at most ``most``; -1 elsewhere."""
    size = 1 << BUCKET_BITS
    seen = np.bincount(bucket, minlength=size).astype(float)
    bad = np.bincount(bucket, weights=label[row], minlength=size)
    n, p = len(label), label.mean()
    gap = bad - seen * p
    chi = gap**2 / np.maximum(seen * p * (1 - p) * (1 - seen / n), 1e-9)
    chi[(seen < 5) | (seen >= n)] = 0
    best = np.argsort(-chi, kind="stable")[:most]
    best = best[chi[best] > 4]
    column = np.full(size, -1, np.int32)
    column[best] = np.arange(len(best))
    return column


def raw_score(model: dict, column: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Log-odds of every row from its chosen columns."""
    out = np.full(rows, model["bias"])
    out += np.bincount(row, weights=model["weight"][column], minlength=rows)
    vector = model["vector"]
    for f in range(vector.shape[1]):
        v = vector[column, f]
        out += 0.5 * (np.bincount(row, weights=v, minlength=rows) ** 2 - np.bincount(row, weights=v * v, minlength=rows))
    return out


def fit(bucket: np.ndarray, row: np.ndarray, label: np.ndarray, epochs: int = 12, batch: int = 256, seed: int = 5) -> dict:
    """A model from (bucket, row) pairs sorted by row and the label of every row; Adam on the log loss, seeded."""
    label = label.astype(float)
    rows = len(label)
    if not rows or label.min() == label.max():
        # nothing to tell apart: the smoothed share of label 1
        p = (label.sum() + 0.5) / (rows + 1)
        return {"column": np.full(1 << BUCKET_BITS, -1, np.int32), "bias": float(np.log(p / (1 - p))), "weight": np.zeros(0), "vector": np.zeros((0, FACTORS))}
    column = choose(bucket, row, label)
    at = column[bucket]
    row, at = row[at >= 0], at[at >= 0]
    gen = np.random.Generator(np.random.PCG64(seed))
    m = int(column.max()) + 1
    first = np.searchsorted(row, np.arange(rows + 1))
    p = label.mean()
    params = {"weight": np.zeros(m), "vector": gen.normal(0, 0.02, (m, FACTORS)), "bias": np.array(np.log(p / (1 - p)))}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    step = 0
    for epoch in range(epochs):
        rate = 0.02 / (1 + epoch / 4)
        order = gen.permutation(rows)
        for lo in range(0, rows, batch):
            some = order[lo : lo + batch]
            sizes = first[some + 1] - first[some]
            inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            col = at[np.repeat(first[some], sizes) + inside]
            r = np.repeat(np.arange(len(some)), sizes)
            vec = params["vector"][col]
            total = np.stack([np.bincount(r, weights=vec[:, f], minlength=len(some)) for f in range(FACTORS)], 1)
            square = np.bincount(r, weights=(vec**2).sum(1), minlength=len(some))
            z = params["bias"] + np.bincount(r, weights=params["weight"][col], minlength=len(some)) + 0.5 * ((total**2).sum(1) - square)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[some]) / len(some)
            grad = {"bias": error.sum(), "weight": np.bincount(col, weights=error[r], minlength=m) + 1e-5 * params["weight"]}
            pull = error[r, None] * (total[r] - vec)
            grad["vector"] = np.stack([np.bincount(col, weights=pull[:, f], minlength=m) for f in range(FACTORS)], 1) + 1e-4 * params["vector"]
            step += 1
            for k, g in grad.items():
                a, b = moment[k]
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                params[k] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return {"column": column, "bias": float(params["bias"]), "weight": params["weight"], "vector": params["vector"]}


def _features(batches):
    for batch in batches:
        data, offsets = as_bytes(batch.column(2))
        for lo, hi in chunks(offsets):
            bucket, first = terms(data, offsets[lo : hi + 1])
            values = pa.ListArray.from_arrays(first.astype(np.int32), pa.array(bucket))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), values], names=["doc_id", "label", "buckets"])


def _train(table: pa.Table) -> pa.Table:
    """The bounded sample of labelled rows to a model."""
    lists = table["buckets"].combine_chunks()
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    # rows come in any order; the model doesn't depend on it
    label = table["label"].to_numpy()
    start = np.concatenate([[0], np.cumsum(n)])
    flat = lists.flatten().to_numpy()
    order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
    sizes = n[order]
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    bucket = flat[np.repeat(start[:-1][order], sizes) + inside]
    model = fit(bucket, np.repeat(np.arange(len(order)), sizes), label[order])
    return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from the labelled rows (doc_id, text) and (doc_id, toxic); rows with a null in doc_id or toxic teach nothing.

    Of more than ``sample`` labelled rows, those with the least hashes of doc_id are taken, by a threshold that gives about ``sample``.
    They go to one task, which is bounded by ``sample``.
    """
    labels = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    labels = labels.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = labels.count()
    if n > sample:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * sample / n))
    if not n:
        return fit(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = texts.join(F.broadcast(labels), "doc_id").select("doc_id", "label", "text")
    rows = rows.mapInArrow(_features, "doc_id long, label int, buckets array<int>")
    model = rows.groupBy(F.lit(0).alias("all")).applyInArrow(_train, "model binary").select("model").first()
    if model is None:
        return fit(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
    return pickle.loads(bytes(model["model"]))


def _scored(model):
    def run(batches):
        m = model.value
        for batch in batches:
            data, offsets = as_bytes(batch.column(batch.num_columns - 1))
            scores = []
            for lo, hi in chunks(offsets):
                bucket, first = terms(data, offsets[lo : hi + 1])
                column, row = m["column"][bucket], np.repeat(np.arange(hi - lo), np.diff(first))
                z = raw_score(m, column[column >= 0], row[column >= 0], hi - lo)
                scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            columns = [*batch.columns[:-1], pa.array(np.concatenate(scores) if scores else np.zeros(0))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "__score"])

    return run


def with_score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with column __score, 0 to 1; null and empty texts get the score of no terms.  Column names that begin
    with two underscores are taken."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*placed_fields(docs), StructField("__score", DoubleType())])
    rows = docs.select(*by_place(docs), F.col("text").cast("binary").alias("__text"))
    return rows.mapInArrow(_scored(known), schema).toDF(*docs.columns, "__score")


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from learning: crc32 of doc_id as text, mod 5, is 0; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted; learned from the labels of rows that aren't held out.

    Rows of one doc_id are scored one by one; an empty table gives an empty result; without labels all scores are 0.5.
    """
    model = learn(docs, labels.where(~held_out(F.col("doc_id"))))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    score = F.col("__score")
    return with_score(plain, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; all columns as they are."""
    model = learn(docs, labels)
    return with_score(docs, model).where(F.col("__score") < threshold).select(*map(named, docs.columns))
