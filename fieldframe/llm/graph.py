"""Connected components by alternating stars, and union-find for one task's block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldframe.session import materialize


#: Most links that one task contracts.
EDGES_PER_TASK = 1 << 20


class Forest:
    """Union-find over positions 0..n-1; ``label`` holds each position's root after ``settle``."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def root(self, x: int) -> int:
        label = self.label
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return int(x)

    def union(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.label[max(a, b)] = min(a, b)
        return True

    def settle(self) -> np.ndarray:
        while not np.array_equal(up := self.label[self.label], self.label):
            self.label = up
        return self.label


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node that each reaches) of the links u-v."""
    nodes, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = place[:len(u)], place[len(u):]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, high, low)
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contracted(batches):
    held = [b for b in batches if b.num_rows]
    if held:
        u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
        nodes, roots = spanning(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["u", "v"])


def components(links: DataFrame, per_task: int = EDGES_PER_TASK) -> DataFrame:
    """Smallest node reachable by links (long columns u, v), for every node of a link: (node, root).

    Links are dealt to tasks of at most ``per_task`` of them, each of which contracts its own to
    stars. With several tasks the stars are then merged in rounds of large and small stars, each
    written to the shared folder; a star is split over tasks, as its centre's least neighbour is an
    aggregate and the join back to the leaves is one that Spark may split. No links give no rows;
    loops and repeated links change nothing.
    """
    links = materialize(links.select("u", "v").where("u <> v"), "links")
    tasks = -(-links.count() // per_task)
    if tasks < 2:
        return materialize(links.coalesce(1).mapInArrow(_contracted, "u long, v long"), "stars").select(F.col("u").alias("node"), F.col("v").alias("root"))
    edges = materialize(links.repartition(tasks).mapInArrow(_contracted, "u long, v long").where("u <> v").distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v") % 999_983)).first()
        if state == seen or not state[0]:
            break
        seen = state
        edges = materialize(_small_star(materialize(_large_star(edges), "stars")), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
