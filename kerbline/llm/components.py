"""Connected components of a table of links, in alternating rounds over written tables.

Each task first joins its links by union-find into a forest; then large-star and small-star rounds
(every node points its larger, then its smaller neighbours to its least neighbour) run until no link
changes.  No neighbourhood is ever collected: a round is a minimum per node and a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.session import materialize

LINK = "a long, b long"


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links that is not the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    least = np.array([root(x) for x in range(len(nodes))], np.int64)
    other = least != np.arange(len(nodes))
    return nodes[other], nodes[least[other]]


def _forest(batches):
    """Links of a partition as a forest, bounded piece by bounded piece."""
    for batch in batches:
        if batch.num_rows:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            node, least = union_find(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(least, pa.int64())], names=["a", "b"])


def connected(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``links`` (two long columns); component is the least node reachable.

    Links with a null end and links of a node to itself join nothing and are left out.
    """
    a, b = links.columns[:2]
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = materialize(edges.mapInArrow(_forest, LINK).distinct(), label)
    while True:
        # large star: the larger neighbours of a node go to its least neighbour (or to itself, if less)
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # small star: the smaller neighbours of a node and the node itself go to its least neighbour
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = materialize(small, label)
        more = new.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("m"))
        roots = new.select(F.col("b").alias("a")).distinct()
        open_ = more.where("n > 1").limit(1).count() or new.join(roots, "a", "left_semi").limit(1).count()
        edges = new
        if not open_:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
