"""Token ids in files: ids ranked by frequency, in one to four bytes each, with separate control bytes.

A file table holds blocks in ascending doc_id order: documents' ids and lengths, and for all their
ids in one stream control bytes (two bits per id, four ids a byte) and data bytes. The rank table is written beside it. Both are Parquet
under the shared folder, and reading needs nothing else.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.llm.tokens import encoder, forget
from fieldframe.session import checkpoint_root

BLOCK_IDS = 1 << 19
#: For every control byte the number of bytes of its four ids, where each starts, and their sum.
WIDTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], np.uint8)
STARTS = np.concatenate((np.zeros((256, 1), np.int64), np.cumsum(WIDTHS, axis=1, dtype=np.int64)[:, :3]), axis=1)
TOTALS = WIDTHS.sum(axis=1, dtype=np.int64)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[:len(ranks)] = more
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    used = np.arange(4, dtype=np.uint8)[None, :] <= more[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Ranks from control and data bytes, by looking each control byte up in the tables."""
    control = np.frombuffer(control, np.uint8)
    base = np.cumsum(TOTALS[control]) - TOTALS[control]
    # ids that only fill the last control byte point behind the data; they are cut off
    at = (base[:, None] + STARTS[control]).ravel()[:n]
    width = WIDTHS[control].ravel()[:n]
    raw = np.frombuffer(data, np.uint8)
    ranks = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(width > k)
        ranks[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int = 0) -> None:
    """Encode every row of docs (doc_id, text) and write it under ``path``, rows by doc_id, null first.

    A null or empty text is its end id alone; rows that repeat a doc_id stay apart, by their ids. Ids
    are counted while encoding, and become ranks in their blocks.
    """
    spark = docs.sparkSession

    def encoded(batches):
        """Ids of every row; a task's last row holds its counts of ids instead."""
        own, total = encoder(vocabulary), np.zeros(0, np.int64)
        kind = "<u2" if own.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows = [own.raw(t.as_py()) + end for t in batch.column("text")]
            lengths = np.array([len(r) // 4 for r in rows], np.int64)
            ids = np.frombuffer(b"".join(rows), "<u4")
            found = np.bincount(ids)
            total = np.pad(total, (0, max(0, len(found) - len(total))))
            total[:len(found)] += found
            raw, cuts = ids.astype(kind).tobytes(), np.concatenate(([0], np.cumsum(lengths))) * np.dtype(kind).itemsize
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths), pa.array([raw[x:y] for x, y in zip(cuts, cuts[1:])], pa.binary()),
                                              pa.nulls(len(rows), pa.list_(pa.int64())), pa.nulls(len(rows), pa.list_(pa.int64()))], names)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                                              *(pa.array([x], pa.list_(pa.int64())) for x in (at, total[at]))], names)

    names = ["doc_id", "n", "ids", "kinds", "counts"]
    form = "doc_id long, n long, ids binary, kinds array<long>, counts array<long>"
    docs.select("doc_id", "text").mapInArrow(encoded, form).write.option("compression", "zstd").parquet(f"{path}/ids")
    ids = spark.read.schema(form).parquet(f"{path}/ids")
    small = encoder(vocabulary).tokenizer.get_vocab_size() <= 1 << 16
    forget()

    def joined(batch: pa.RecordBatch) -> np.ndarray:
        """Ids of all rows of a batch, one after another."""
        return np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<u2" if small else "<u4")

    counts = ids.where("kinds is not null").select(F.explode(F.arrays_zip("kinds", "counts")).alias("c")).groupBy(F.col("c.kinds").alias("id")).agg(F.sum("c.counts").alias("count"))
    # one row per id of the vocabulary at most
    order = [r["id"] for r in counts.orderBy(F.desc("count"), "id").select("id").collect()]
    spark.createDataFrame([(r, i) for r, i in enumerate(order)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(order, default=0) + 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    def blocks(batches):
        at, held, size = 0, [], 0
        for batch in batches:
            ends = np.cumsum(batch.column("n").to_numpy())
            first = 0
            while first < batch.num_rows:
                before = int(ends[first - 1]) if first else 0
                last = min(batch.num_rows, int(np.searchsorted(ends, before + BLOCK_IDS - size)) + 1)
                held.append(batch.slice(first, last - first))
                size += int(ends[last - 1]) - before
                first = last
                if size >= BLOCK_IDS:
                    yield block(held, at)
                    at, held, size = at + size, [], 0
        if held:
            yield block(held, at)

    def block(rows: list[pa.RecordBatch], at: int) -> pa.RecordBatch:
        """One block, ``at`` ids into its part: its documents' ids as one stream."""
        table = pa.Table.from_batches(rows)
        control, data = encode_ranks(shared.value[np.concatenate([joined(r) for r in rows])])
        lengths = table.column("n").to_pylist()
        return pa.RecordBatch.from_arrays([
            pa.array([table.column("part")[0].as_py()], pa.int32()), pa.array([at], pa.int64()), pa.array([sum(lengths)], pa.int64()),
            pa.array([table.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
            pa.array([control], pa.binary()), pa.array([data], pa.binary()),
        ], ["part", "at", "tokens", "docs", "lengths", "control", "data"])

    # rows that repeat a doc_id are dealt and ordered by their ids
    keys = ("doc_id", "n", "mark")
    rows = ids.where("n is not null").select("doc_id", "n", "ids", F.xxhash64("ids").alias("mark"))
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    form = "part int, at long, tokens long, docs array<long>, lengths array<long>, control binary, data binary"
    sorted_rows.select("part", "doc_id", "n", "ids").mapInArrow(blocks, form).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents of a file table, ids as an array on demand.

    start counts the ids of all documents before: those of the parts before (one row per part is
    read ahead), of the part's blocks before, and of the block's documents before.
    """
    files = spark.read.parquet(f"{path}/blocks")
    base, before = {}, 0
    for r in files.groupBy("part").agg(F.max(F.col("at") + F.col("tokens")).alias("all")).orderBy("part").collect():
        base[r["part"]], before = before, before + r["all"]
    order = [r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]  # one row per id of the vocabulary at most
    id_of = spark.sparkContext.broadcast(np.array(order, "<u4"))

    def decoded(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = id_of.value[decode_ranks(row["control"], row["data"], row["tokens"])]
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                raw = memoryview(ids.tobytes())
                columns = [pa.array(row["docs"], pa.int64()), pa.array(base[row["part"]] + row["at"] + starts, pa.int64()), pa.array(row["lengths"], pa.int64()),
                           pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64())]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(starts, ends)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    return files.select("part", "at", "tokens", "docs", "lengths", "control", "data").mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def tokens_round_trip(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write docs as a file table in the shared folder and return what its files say."""
    path = f"{checkpoint_root(docs.sparkSession)}/fieldframe/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, vocabulary, path, end_id)
    return read_tokens(docs.sparkSession, path)
