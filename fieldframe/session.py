"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "fieldframe", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session; only settings that change results or plans are fixed here."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.legacy.javaCharsets": "true",  # statistics tables come in GB18030 too
        "spark.sql.legacy.codingErrorAction": "true",  # bytes that an encoding does not know are marked, not an error
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a private one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    root = tempfile.mkdtemp(prefix="spark-fieldframe-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a reused intermediate once as Parquet in the shared folder and read it back.

    Unlike a cache the written table survives the loss of executors, and later
    branches read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/fieldframe/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the folder of a table that ``materialize`` wrote and that no plan reads any more; no other folder is touched."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if re.fullmatch(r".*/fieldframe/\w+-[0-9a-f]{32}", folder):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
