"""SHA-256 of large files in blocks: a task continues the hash where another stopped.

A whole file's hash is a chain, but none of its steps needs more than one block and 112 bytes of
state. Spark's text source splits a file at newlines and keeps all other bytes, wherever the file is.
"""

from __future__ import annotations

import _hashlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.session import checkpoint_root

STATE_BYTES = 112
MARK = b"\xef\xbb\xbf"  # the text source leaves this out at the start of a file
#: The text source unpacks files with these endings.
PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".xz")


class Sha256:
    """A hash whose state can travel; hashlib's cannot, so this calls the same library's functions."""

    def __init__(self, state: bytes | None = None):
        self.library = ctypes.CDLL(_hashlib.__file__)
        self.held = ctypes.create_string_buffer(state or bytes(STATE_BYTES), STATE_BYTES)
        if state is None:
            self.library.SHA256_Init(self.held)

    def update(self, data: bytes) -> None:
        self.library.SHA256_Update(self.held, ctypes.c_char_p(data), ctypes.c_size_t(len(data)))

    @property
    def state(self) -> bytes:
        return self.held.raw

    def hexdigest(self) -> str:
        last, out = ctypes.create_string_buffer(self.state, STATE_BYTES), ctypes.create_string_buffer(32)
        self.library.SHA256_Final(out, last)
        return out.raw.hex()


def file_key(path: Column) -> Column:
    return F.xxhash64(path)


def _pieces(batches):
    """Bytes of the lines of each split in turn; every line but a file's first comes with the newline before it."""
    split, number = None, 0
    for batch in batches:
        files, starts = batch.column("file").to_numpy(), batch.column("start").to_numpy()
        lines = batch.column("line").to_pylist()
        cuts = [k for k in range(len(lines)) if not k or files[k] != files[k - 1] or starts[k] != starts[k - 1]]
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(lines)]):
            here = (int(files[a]), int(starts[a]))
            number = number + 1 if here == split else 0
            data = b"\n".join(lines[a:b])
            rows.append((*here, number, data if not here[1] and not number else b"\n" + data))
            split = here
        if rows:
            file, start, numbers, data = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(file, pa.int64()), pa.array(start, pa.int64()), pa.array(numbers, pa.int64()), pa.array([len(x) for x in data], pa.int64()),
                                              pa.array(data, pa.binary())], ["file", "start", "number", "size", "data"])


def _continued(states: dict[int, bytes]):
    def of(batches):
        file, own = None, None
        for batch in batches:
            for key, data in zip(batch.column("file").to_pylist(), batch.column("data")):
                if key != file:
                    if own is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([own.state])], ["file", "state"])
                    file, own = key, Sha256(states[key])
                own.update(data.as_py())
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([own.state])], ["file", "state"])
    return of


def large_files(spark: SparkSession, root: str, pattern: str, lengths: dict[int, int], over: int, block: int) -> DataFrame:
    """(file, sha256) of the files of more than ``over`` bytes whose keys ``lengths`` holds, with their bytes.

    Their bytes are written once to the shared folder by block; then in each round a task hashes one
    block of a file. Only states pass through the driver.
    """
    path = f"{checkpoint_root(spark)}/fieldframe/blocks-{uuid.uuid4().hex}"
    text = spark.read.format("text").option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    found = text.where(F.col("_metadata.file_size") > over).select(
        file_key(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    wanted = found.where(F.col("file").isin(list(lengths)))
    pieces = wanted.mapInArrow(_pieces, "file long, start long, number long, size long, data binary")
    pieces.withColumn("block", F.floor(F.col("start") / block)).write.partitionBy("block").parquet(path)
    stored = spark.read.schema("file long, start long, number long, size long, data binary, block long").parquet(path)
    sizes = {r["file"]: r["size"] for r in stored.groupBy("file").agg(F.sum("size").alias("size")).collect()}
    states = {}
    for file, length in lengths.items():
        missing = length - sizes[file]
        if missing not in (0, 1, len(MARK), len(MARK) + 1):
            raise ValueError(f"{missing} bytes of a file of {length} were not read")
        own = Sha256()
        own.update(MARK if missing >= len(MARK) else b"")
        states[file] = own.state
    for number in range(-(-max(lengths.values()) // block)):
        going = sum(length > number * block for length in lengths.values())
        dealt = stored.where(F.col("block") == number).select("file", "start", "number", "data").repartition(4 * going, "file")
        done = dealt.sortWithinPartitions("file", "start", "number").mapInArrow(_continued(states), "file long, state binary").collect()
        states |= {r["file"]: bytes(r["state"]) for r in done}
    out = []
    for file, length in lengths.items():
        own = Sha256(states[file])
        if (length - sizes[file]) % len(MARK):
            own.update(b"\n")
        out.append((file, own.hexdigest()))
    return spark.createDataFrame(out, "file long, sha256 string")
