"""Table scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.errors import AnalysisException

from fieldframe.session import materialize

# Encodings tried for statistics tables, in order.
ENCODINGS = ("UTF-8", "GB18030", "ISO-8859-1")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Typed Parquet, or CSV with every column as text."""
    if path.endswith(".csv"):
        return read_csv(spark, path)
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """CSV as text; encodings outside Spark's list need the session setting that ``get_session`` makes."""
    df = spark.read.option("header", True).option("inferSchema", False).option("encoding", encoding).csv(path)
    return df.withColumnsRenamed({c: c.removeprefix("﻿") for c in df.columns})


def file_encodings(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """``(path, encoding)`` per file: the first encoding in which all its lines are valid; a byte order mark does not count.

    One pass over the raw bytes, split by line as Spark likes: a line is decoded by every encoding,
    an aggregate keeps per file which have never failed. The last encoding takes what is left.
    """
    raw = spark.read.text(path).select(F.col("value").cast("binary").alias("_line"), F.is_valid_utf8("value").alias("_utf8"),
                                       F.col("_metadata.file_path").alias("path"))
    valid = lambda e: F.col("_utf8") if e == "UTF-8" else ~F.decode("_line", e).contains("\ufffd")
    seen = raw.groupBy("path").agg(*[F.bool_and(valid(e)).alias(f"_ok{i}") for i, e in enumerate(encodings[:-1])])
    first = F.coalesce(*[F.when(F.col(f"_ok{i}"), F.lit(e)) for i, e in enumerate(encodings[:-1])], F.lit(encodings[-1]))
    return seen.select("path", first.alias("encoding"))


def read_csv_any(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """A group of CSV files as text, each in the first encoding that all its lines fit; columns by name, absent ones null.

    The vote of ``file_encodings`` is one row per file; files that agree are read together.
    """
    groups: dict[str, list[str]] = {}
    for row in file_encodings(spark, path, encodings).orderBy("path").collect():
        groups.setdefault(row["encoding"], []).append(row["path"])
    out = None
    for encoding in encodings:
        if encoding in groups:
            df = read_csv(spark, groups[encoding], encoding)
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return read_csv(spark, path, encodings[0]) if out is None else out


def first_table(spark: SparkSession, paths: Sequence[str], non_empty: bool = True) -> DataFrame | None:
    """First readable (and non-empty) table of an ordered list, else None."""
    for path in paths:
        try:
            df = read_table(spark, path)
        except AnalysisException:
            continue
        if not non_empty or not df.isEmpty():
            return df
    return None


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, columns: Sequence[str], kind: str = "string") -> DataFrame:
    """Fixed columns first (absent ones as nulls), all others after them."""
    have = set(df.columns)
    fixed = [F.col(c) if c in have else F.lit(None).cast(kind).alias(c) for c in columns]
    return df.select(*fixed, *[c for c in df.columns if c not in columns])


def write_panel(df: DataFrame, path: str, partition_by: Sequence[str] = (), csv_companion: bool = False) -> None:
    """Parquet sink; a CSV companion is written from the stored table, in as many files as tasks."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    if csv_companion:
        stored = df.sparkSession.read.parquet(path)
        stored.write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def total_order(df: DataFrame, keys: Sequence[str | Column]) -> list[Column]:
    """Sort columns that leave no ties but equal rows: the keys, nulls first, then every other column.

    A key may be a sort expression. Maps cannot be compared and are ordered by their JSON text.
    """
    named = {k for k in keys if isinstance(k, str)}
    given = [F.col(k).asc_nulls_first() if isinstance(k, str) else k for k in keys]
    rest = [(F.to_json(c) if "map<" in kind else F.col(f"`{c}`")).asc_nulls_first() for c, kind in df.dtypes if c not in named]
    return [*given, *rest]


def write_ordered(df: DataFrame, path: str, keys: Sequence[str | Column], rows_per_file: int = 1_000_000, form: str = "parquet") -> DataFrame:
    """Sorted sink whose files do not depend on how the rows came in; returns its manifest ``(file, rows)``.

    Rows are put in ``total_order`` by ranges, numbered by the counts of the ranges before, and dealt
    by number into files ``file=00000``, ``file=00001`` … of ``rows_per_file`` rows, so two runs on
    differently split input write the same rows in the same order into the same files. The manifest
    is written beside the files as ``path``.manifest. An empty table writes no files.
    """
    spark = df.sparkSession
    order = total_order(df, keys)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ordered").withColumn("_part", F.shiftright("_at", 33))
    # one row per range
    sizes = ranged.groupBy("_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", (before - F.col("_first")).alias("_shift"))
    number = F.col("_at") + F.col("_shift")
    files = (ranged.join(starts, "_part").withColumns({"_row": number, "_file": F.expr(f"(_at + _shift) div {rows_per_file}")})
             .drop("_at", "_part", "_shift"))
    label = F.lpad(F.col("_file").cast("string"), 5, "0")
    dealt = files.repartition("_file").sortWithinPartitions("_file", "_row").withColumn("file", label).drop("_file", "_row")
    writer = dealt.write.mode("overwrite").partitionBy("file").format(form)
    (writer.option("header", True) if form == "csv" else writer).save(path)
    manifest = files.groupBy(label.alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    manifest.coalesce(1).sortWithinPartitions("file").write.mode("overwrite").parquet(f"{path}.manifest")
    return spark.read.parquet(f"{path}.manifest")
