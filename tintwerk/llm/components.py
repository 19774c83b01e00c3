"""Connected components by alternating large and small stars, each round two group-bys and joins on narrow rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintwerk.llm._work import discard, written

ONE_TASK = 1 << 20  # edges (16 bytes each) that one task joins at once


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node reachable from each) of the edges a, b: roots hook to smaller roots, then everybody to its root's root."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[p], label[q]), np.maximum(label[p], label[q])
        apart = low < high
        if not apart.any():
            return nodes, nodes[label]
        np.minimum.at(label, high[apart], low[apart])
        while (further := label[label]).tobytes() != label.tobytes():
            label = further


def connected_components(edges: DataFrame, most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """``node, component`` (the smallest node reachable) for each node of the edges ``a, b`` (longs).

    Up to ``one_task`` edges, counted first, are joined in one task, as rounds over so small tables would be nothing but overhead. Beyond that
    no group is collected: hot nodes are met by a partial minimum, written as a table, and a join whose hot side Spark can split
    (a join straight on an aggregate couldn't be). Each round is written to the shared folder, and the loop ends when a round changes nothing.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if edges.count() <= one_task:
        return _in_one_task(edges)
    last = None
    for _ in range(most_rounds):
        # Large star: each node's larger neighbours go to the smallest of its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.where("b > a").join(first, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        large = written(large, "stars")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        before, edges = edges, written(small, "edges")
        discard(before, large, least, first)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components not found in {most_rounds} rounds")
    # Every edge is now a star's: from a node to the least of its component.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(np.array(r.column(0), np.int64), np.array(r.column(1), np.int64)) for r in batches]
        a, b = (np.concatenate([np.zeros(0, np.int64), *(e[k] for e in ends)]) for k in (0, 1))
        nodes, component = joined(a, b)
        for i in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(component[i : i + (1 << 16)])], ["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")
