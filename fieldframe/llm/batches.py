"""Small helpers over Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table for each run of equal keys in sorted batches; a run may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        changed = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            piece = batch.slice(a, b - a)
            if held and held[0].column(key)[0] != piece.column(key)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys in batches in ascending order of a key without nulls: the runs that end in a batch together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if held and (last or held[0].column(key)[0].as_py() != keys[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def longs(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def common_width(df: DataFrame, vector: str) -> int:
    """The most frequent length of a list column's values, the smaller of two; 0 without any."""
    counts = df.groupBy(F.size(vector).alias("width")).agg(F.count(F.lit(1)).alias("n")).where("width > 0")
    top = counts.orderBy(F.desc("n"), "width").first()
    return top["width"] if top else 0


def doubles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a list column: (matrix of the rows that count, their row numbers).

    A vector counts if it has ``width`` components, none null, all finite and one not zero.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.flatnonzero(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False) == width) if width else np.zeros(0, np.int64)
    if not len(rows):
        return np.zeros((0, width)), rows
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
    matrix = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), width)
    good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
    return matrix[good], rows[good]


def trim() -> None:
    """Give memory that earlier tasks of this worker left free back to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)
