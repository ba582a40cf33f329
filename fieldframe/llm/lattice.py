"""Near-copies of vectors by lattice hashing.

Several tables project unit vectors at random to eight dimensions and decode them to points of the
E8 lattice; a vector is filed under its nearest points. Vectors that share a cell and a label are
compared by exact cosine. A task has the cells of a label in one table, or a part of them, so that a
vector need not go there for each of its cells. A pair that shares several cells counts in the one with
the smallest code only; a large cell is dealt out in pairs of chunks, and tasks return sums and spanning links, so no
step writes all pairs. Equal vectors are one member with their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldframe.llm.batches import common_width, doubles, whole_runs
from fieldframe.llm.graph import components, spanning
from fieldframe.llm.words import STEPS, mix
from fieldframe.session import materialize

TABLES = 10
PROBES = 3
SCALE = 0.16  # length of the lattice's unit in the projected space of unit vectors
CHUNK = 1024
TASK_ROWS = 75_000  # about the most vectors of a task
COSINES = 1 << 20  # entries of the products made at once
PAIRS = 1 << 16  # linked pairs whose codes are compared at once
SEED = 10


def _coset(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and the next point of D8 (integers of even sum) to each row."""
    near = np.rint(x)
    off = x - near
    order = np.argsort(-np.abs(off), axis=1)
    rows = np.arange(len(x))
    step = np.where(off >= 0, 1.0, -1.0)
    odd = near.sum(axis=1) % 2 != 0
    first, second = near.copy(), near.copy()
    worst, next_worst = order[:, 0], order[:, 1]
    first[rows[odd], worst[odd]] += step[rows[odd], worst[odd]]
    second[rows[odd], next_worst[odd]] += step[rows[odd], next_worst[odd]]
    even = ~odd
    for place in (worst, next_worst):
        second[rows[even], place[even]] += step[rows[even], place[even]]
    return first, second


def e8_points(x: np.ndarray, probes: int) -> np.ndarray:
    """Doubled coordinates of the ``probes`` (at most four) E8 points found around each row, nearest first.

    The first is the nearest point of the lattice, D8 and its shift by one half together.
    """
    whole, shifted = _coset(x), _coset(x - 0.5)
    points = np.stack([whole[0], whole[1], shifted[0] + 0.5, shifted[1] + 0.5], axis=1)
    order = np.argsort(((points - x[:, None]) ** 2).sum(axis=2), axis=1, kind="stable")[:, :probes]
    return np.rint(2 * np.take_along_axis(points, order[:, :, None], axis=1)).astype(np.int64)


def cell_codes(unit: np.ndarray, labels: np.ndarray, projections: list[np.ndarray]) -> np.ndarray:
    """Codes of a vector's cells in all tables (rows, TABLES * PROBES); the label is part of a code."""
    out = []
    for t, to in enumerate(projections):
        points = e8_points(unit @ to / SCALE, PROBES)
        code = mix(labels.astype(np.int64).view(np.uint64) * STEPS[0] + np.uint64(t + 1))[:, None]
        for d in range(points.shape[2]):
            code = mix(code * STEPS[1] + points[:, :, d].view(np.uint64))
        out.append(code)
    return np.concatenate(out, axis=1)


def unit_vectors(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def close_pairs(unit: np.ndarray, rows: np.ndarray, sizes: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of unit vectors with cosine >= ``least`` inside each of the consecutive groups of ``sizes`` rows; groups of equal size at once.

    Of each pair the numbers in ``unit``, which ``rows`` holds by group, and the place in ``rows`` where its group begins.
    """
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 1]):
        first = starts[sizes == size]
        upper = np.triu(np.ones((size, size), bool), 1)
        for some in np.array_split(first, -(-len(first) * size * size // COSINES)):
            group = rows[some[:, None] + np.arange(size)]
            x = unit[group]
            cosines = x @ x.transpose(0, 2, 1)
            # rounding of the product must not decide: what lies at the threshold is measured one by one
            for g, i, j in zip(*np.nonzero((np.abs(cosines - least) < 1e-12) & upper)):
                cosines[g, i, j] = float(np.dot(x[g, i], x[g, j]))
            g, i, j = np.nonzero((cosines >= least) & upper)
            yield group[g, i], group[g, j], some[g]


def met_before(codes: np.ndarray, a: np.ndarray, b: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Whether the rows a and b of ``codes`` (sorted in each row) have one in common that is below ``code``, for each pair."""
    met = np.zeros(len(a), bool)
    for start in range(0, len(a), PAIRS):
        left = np.arange(start, min(start + PAIRS, len(a)))
        for kth in codes.T:
            left = left[kth[a[left]] < code[left]]
            same = (codes[b[left]] == kth[a[left]][:, None]).any(axis=1)
            met[left[same]] = True
            left = left[~same]
    return met


def _dealt(files: DataFrame, in_large: DataFrame | None) -> DataFrame:
    """Rows (task, cls, copies, own, first, alone, codes, embedding) of the tasks that compare cells; ``own`` has a row's cells in its task.

    A vector comes once to the cells of its label in a table, as long as a task holds them. The cells
    ``in_large`` (code, cls, many) are dealt out in pairs of chunks.
    """
    most = files.groupBy("label").agg(F.count(F.lit(1)).alias("many")).agg(F.max("many")).first()[0] or 0
    parts = 1 if most <= TASK_ROWS else -(-PROBES * most // TASK_ROWS)
    own = F.array(*(F.slice("codes", PROBES * t + 1, PROBES) for t in range(TABLES)))
    if in_large is not None:
        files = files.join(in_large.groupBy("cls").agg(F.collect_set("code").alias("large")), "cls", "left")
        usual = F.when(F.col("large").isNull(), F.col("own")).otherwise(F.array_except("own", "large"))
    else:
        usual = F.col("own")
    cells = files.select("*", F.posexplode(own).alias("table", "own")).withColumn("own", usual)
    if parts > 1:
        cells = cells.withColumn("part", F.explode(F.array_distinct(F.transform("own", lambda c: F.pmod(c, F.lit(parts))))))
        cells = cells.withColumn("own", F.filter("own", lambda c: F.pmod(c, F.lit(parts)) == F.col("part")))
    else:
        cells = cells.withColumn("part", F.lit(0))
    columns = ["task", "cls", "copies", "own", "first", "alone", "codes", "embedding"]
    out = cells.where(F.size("own") > 0).withColumns({"task": F.xxhash64("label", "table", "part"), "first": F.lit(True), "alone": F.lit(True)}).select(columns)
    if in_large is None:
        return out
    chunks = F.ceil(F.col("many") / CHUNK)
    chunk = F.pmod(F.xxhash64("cls"), chunks)
    # a chunk meets itself and every other one: in task (a, b), a <= b
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda c: F.struct(F.least(c, chunk).alias("a"), F.greatest(c, chunk).alias("b")))
    dealt = in_large.select("cls", F.array("code").alias("own"), "code", chunk.alias("chunk"), F.explode(pairs).alias("pair")).withColumns({
        "task": F.xxhash64("code", "pair.a", "pair.b"), "first": F.col("chunk") == F.col("pair.a"), "alone": F.col("pair.a") == F.col("pair.b")})
    return out.union(dealt.join(files, "cls").select(columns))


def near_copies(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Linked are rows of equal, non-null label with cosine >= ``least`` in double precision. Vectors
    that are null, all zero, of another length than most, or hold null or non-finite components, and
    rows without vec_id, link with nothing and are kept. Rows that repeat a vec_id count as rows of
    their own. Other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    able = rows.where("vec_id is not null and label is not null")
    width = common_width(able, "embedding")
    draw = np.random.default_rng(SEED)
    projections = [np.linalg.qr(draw.standard_normal((max(width, 8), max(width, 8))))[0][:width, :8] * np.sqrt(max(width, 8) / 64) for _ in range(TABLES)]
    same = able.groupBy("label", "embedding").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    same = materialize(same.withColumn("cls", F.xxhash64("label", "embedding")), "vectors")

    def filed(batches):
        for batch in batches:
            matrix, at = doubles(batch.column("embedding"), width)
            if len(at):
                picked = pa.array(at)
                codes = cell_codes(unit_vectors(matrix), batch.column("label").to_numpy()[at], projections).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * codes.shape[1], codes.ravel())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(picked) for c in ("label", "cls", "copies")), lists, batch.column("embedding").take(picked)],
                                                 ["label", "cls", "copies", "codes", "embedding"])

    kind = same.schema["embedding"].dataType.simpleString()
    files = materialize(same.mapInArrow(filed, f"label long, cls long, copies long, codes array<long>, embedding {kind}"), "cells")
    filed_under = files.select("cls", F.explode(F.array_distinct("codes")).alias("code"))
    large = materialize(filed_under.groupBy("code").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > CHUNK), "large")
    met = _dealt(files, None if large.isEmpty() else filed_under.join(large, "code")).repartition("task").sortWithinPartitions("task")

    def compared(batches):
        for part in whole_runs(batches, "task"):
            unit = unit_vectors(doubles(part.column("embedding"), width)[0])
            ids, copies, first, alone, task = (part.column(c).to_numpy() for c in ("cls", "copies", "first", "alone", "task"))
            codes = np.sort(part.column("codes").combine_chunks().flatten().to_numpy().reshape(len(ids), -1), axis=1)
            own = part.column("own").combine_chunks()
            code, row = own.flatten().to_numpy(), np.repeat(np.arange(len(ids)), np.diff(own.offsets.to_numpy()))
            order = np.lexsort((code, task[row]))
            code, row = code[order], row[order]
            begins = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (task[row[1:]] != task[row[:-1]]))))
            u = v = np.zeros(0, np.int64)
            for a, b, at in close_pairs(unit, row, np.diff(begins, append=len(row)), least):
                counts = alone[a] | (first[a] != first[b])
                a, b, at = a[counts], b[counts], at[counts]
                counts = ~met_before(codes, a, b, code[at])
                u, v = np.concatenate((u, a[counts])), np.concatenate((v, b[counts]))
            if len(u):
                rows, to = spanning(u, v)
                links = np.zeros(len(ids), np.int64)
                np.add.at(links, u, copies[v])
                np.add.at(links, v, copies[u])
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(links[rows]), pa.array(ids[to])], ["cls", "links", "to"])

    found = materialize(met.mapInArrow(compared, "cls long, links long, to long"), "near")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cls").alias("u"), F.col("to").alias("v"))).withColumnRenamed("node", "cls")
    known = files.select("cls", "copies").join(links, "cls", "left").join(roots, "cls", "left").select(
        "cls", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root"))
    known = materialize(known.join(same.select("cls", "least_id"), "cls"), "known")
    named = known.join(known.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("cls", "n_links", "component_id")
    linked = able.select("vec_id", F.xxhash64("label", "embedding").alias("cls")).join(named, "cls", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    apart = rows.where("vec_id is null or label is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(apart).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
