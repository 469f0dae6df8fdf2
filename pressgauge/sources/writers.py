"""Sinks. All overwrite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """A result table with header. With `order` the rows are sorted into one file, so use it for
    top-n reports only."""
    rows = df.orderBy(*order).coalesce(1) if order else df
    # white space at the ends of a value is part of it
    whole = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.mode("overwrite").options(**whole).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
