"""Nearest neighbours by shifted Hilbert curves.

Every ordering projects the vectors at random to a few dimensions, shifts them and numbers the grid
cells along a Hilbert curve. Spark range-partitions each ordering by key; a query meets the blocks of
rows whose ranks lie in its window, in every ordering, and what the blocks return is merged and
ranked by the exact distance.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.llm.batches import common_width, doubles, runs
from fieldframe.session import materialize

ORDERINGS = 8
DIMENSIONS = 8
BITS = 7
WINDOW = 0.2  # share of all rows that a query meets in each ordering
BLOCK = 4096
QUERIES = 4096  # queries that meet a block in one task
SEED = 20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of grid cells (rows, dimensions) along the Hilbert curve; at most 63 bits in all."""
    axes = cells.astype(np.int64).T.copy()
    n = len(axes)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            on = (axes[i] & level) > 0
            swap = np.where(on, 0, (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(on, low, swap)
            axes[i] ^= swap
        level >>= 1
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    turn = np.zeros_like(axes[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where(axes[n - 1] & level, level - 1, 0)
        level >>= 1
    axes ^= turn
    key = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | axes[i] >> bit & 1
    return key


def directions(width: int, dimensions: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(projection, shift in 0..1/2) of each ordering, from a fixed seed."""
    draw = np.random.default_rng(SEED)
    return [(np.linalg.qr(draw.standard_normal((width, width)))[0][:, :dimensions], draw.random(dimensions) / 2) for _ in range(ORDERINGS)]


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, window: float = WINDOW) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of vectors (vec_id, embedding) whose id ``every`` divides.

    score is the Euclidean distance in double precision; ties go to the smaller vec_id. A query
    does not meet rows of its own vec_id. Vectors that are null, all zero, of another length than
    most, or hold null or non-finite components take no part, nor do rows without vec_id. Rows that
    repeat a vec_id count once, with the nearest of their vectors. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    width = common_width(rows, "embedding")
    dimensions = min(DIMENSIONS, max(width, 1))
    lines = directions(max(width, 1), dimensions)

    def ranges(batches):
        low, high, n = np.full((ORDERINGS, dimensions), np.inf), np.full((ORDERINGS, dimensions), -np.inf), 0
        for batch in batches:
            matrix, _ = doubles(batch.column("embedding"), width)
            n += len(matrix)
            for o, (to, _) in enumerate(lines if len(matrix) else []):
                low[o], high[o] = np.minimum(low[o], (matrix @ to).min(axis=0)), np.maximum(high[o], (matrix @ to).max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(low.ravel()), pa.array(high.ravel()), pa.array(np.arange(low.size)), pa.array([n] * low.size)], ["low", "high", "at", "n"])

    # one row per ordering and dimension
    spans = rows.select("embedding").mapInArrow(ranges, "low double, high double, at long, n long").groupBy("at").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("at").collect()
    total = spans[0]["n"] if spans else 0
    low = np.array([r["low"] for r in spans]).reshape(-1, dimensions)
    size = np.maximum(np.array([r["high"] for r in spans]).reshape(-1, dimensions) - low, 1e-300)

    def keyed(batches):
        for batch in batches:
            matrix, at = doubles(batch.column("embedding"), width)
            if not len(at):
                continue
            ids, whole = batch.column("vec_id").take(pa.array(at)), pa.array([x.tobytes() for x in matrix], pa.binary())
            for o, (to, shift) in enumerate(lines):
                place = (matrix @ to - low[o]) / (2 * size[o]) + shift
                cells = np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), o, np.int32)), pa.array(hilbert_keys(cells, BITS)), ids, whole], ["o", "key", "vec_id", "v"])

    def numbered(batches):
        seen: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            orders = batch.column("o").to_pylist()
            place = []
            for o in orders:
                place.append(seen.get(o, 0))
                seen[o] = place[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(orders), pa.int32()), pa.array(place, pa.int64())], [*batch.schema.names, "part", "place"])

    form = "o int, key long, vec_id long, v binary"
    parts = max(ORDERINGS, min(4096, ORDERINGS * (total // 100_000 + 1)))
    sorted_rows = rows.mapInArrow(keyed, form).repartitionByRange(parts, "o", "key", "vec_id").sortWithinPartitions("o", "key", "vec_id")
    ranked = materialize(sorted_rows.mapInArrow(numbered, form + ", part int, place long"), "curves")
    # one row per ordering and part
    counts = ranked.groupBy("o", "part").agg(F.count(F.lit(1)).alias("n")).orderBy("o", "part").collect()
    before, base = {}, {}
    for r in counts:
        before[r["o"], r["part"]] = base.get(r["o"], 0)
        base[r["o"]] = base.get(r["o"], 0) + r["n"]
    offset = F.create_map(*[F.lit(x) for (o, part), n in before.items() for x in (o * 10_000 + part, n)]) if before else F.create_map(F.lit(0), F.lit(0))
    placed = ranked.withColumn("rank", F.col("place") + offset[F.col("o") * 10_000 + F.col("part")])
    half = math.ceil(window * total / 2)
    groups = max(1, math.ceil(total / every * min(1.0, window) / QUERIES))
    asks = placed.where(F.col("vec_id") % every == 0).select(
        "o", F.explode(F.sequence(F.floor(F.greatest(F.col("rank") - half, F.lit(0)) / BLOCK), F.floor(F.least(F.col("rank") + half, F.lit(max(total - 1, 0))) / BLOCK))).alias("block"),
        F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("g"), F.lit(True).alias("ask"), "vec_id", "v")
    there = placed.select("o", F.floor(F.col("rank") / BLOCK).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(False).alias("ask"), "vec_id", "v")
    met = asks.union(there).select(F.xxhash64("o", "block", "g").alias("task"), "ask", "vec_id", "v")

    def closest(batches):
        for part in runs(batches, "task"):
            ask, ids = part.column("ask").to_numpy(), part.column("vec_id").to_numpy()
            matrix = np.frombuffer(b"".join(part.column("v").to_pylist())).reshape(len(ids), -1)
            points, point_ids, asked = matrix[~ask], ids[~ask], ids[ask]
            if not len(points) or not len(asked):
                continue
            norms = (points ** 2).sum(axis=1)
            out: list[tuple[int, int, float]] = []
            for query, vector in zip(asked.tolist(), matrix[ask]):
                about = norms - 2 * (points @ vector) + vector @ vector
                about[point_ids == query] = np.inf
                cut = np.partition(about, min(k, len(about)) - 1)[min(k, len(about)) - 1]
                # rounding of the quick distances must not decide: what lies just behind the cut is measured too
                near = np.flatnonzero((about <= cut + 1e-9 * (abs(cut) + norms.max())) & np.isfinite(about))
                exact = np.sqrt(((points[near] - vector) ** 2).sum(axis=1))
                best = np.lexsort((point_ids[near], exact))[:k]
                out += [(query, i, d) for i, d in zip(point_ids[near][best].tolist(), exact[best].tolist())]
            if out:
                q, i, d = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], ["query_id", "vec_id", "score"])

    found = met.repartition("task").sortWithinPartitions("task").mapInArrow(closest, "query_id long, vec_id long, score double")
    single = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
