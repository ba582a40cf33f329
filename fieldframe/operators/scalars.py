"""Values of a one-row table on every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a table of at most one row as a scalar subquery.

    There is no join: the subquery runs once and its value is a constant of the scan. An
    empty table gives nulls; more than one row is a runtime error.
    """
    value = one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("_row")).scalar()
    return (
        df.withColumn("_row", value)
        .withColumns({c: F.col("_row").getField(c) for c in one_row.columns})
        .drop("_row")
    )
