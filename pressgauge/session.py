"""Session settings and the one way lineage is cut: a written table in the shared folder."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyarrow.fs import FileSystem, FileType, LocalFileSystem
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pressgauge")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # small local files as several splits
        .config("spark.sql.files.minPartitionNum", "8" if cores == "*" else str(cores))
        .config("spark.sql.files.openCostInBytes", "0")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Weeks and date bounds are defined in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


#: rows and bytes of an Arrow batch inside `small_batches`; a longer row comes alone
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands Python workers small Arrow batches.

    A worker holds a few batches at once, so its memory follows neither the rows of a task nor the
    lengths of texts. Limits that the session has set itself stay.
    """
    limits = {key: value for key, value in BATCH_LIMITS.items() if spark.conf.get(key, None) is None}
    for key, value in limits.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in limits:
            spark.conf.unset(key)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only where it is unset, and all tasks run in this process, a temporary folder is taken.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="pressgauge-"))
    return context.getCheckpointDir()


def staged_dir(spark: SparkSession) -> str:
    """Where this application stages its tables."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def remove_staged(spark: SparkSession) -> None:
    """Deletes all tables this application has staged. Frames that read them are void from here on."""
    folder = staged_dir(spark)
    is_uri = "://" in folder or folder.startswith("file:")
    files, place = FileSystem.from_uri(folder) if is_uri else (LocalFileSystem(), folder)
    if files.get_file_info(place).type != FileType.NotFound:
        files.delete_dir(place)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and go on from the written table.

    Used where a reduced table has several readers, so that the large input behind it is
    read once, and so that a lost executor costs a re-read of the table, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{staged_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Where a row of a written table stands: its file, by the hash of the path, and its number there.
LOCATOR = ["_file", "_row"]


def reads_one_table(df: DataFrame) -> bool:
    """Whether `df` is a table as its files have it, so that files and places of its rows are known."""
    return df._jdf.queryExecution().analyzed().metadataOutput().toString().count("_metadata") == 1


def with_locators(df: DataFrame, *columns: str) -> DataFrame:
    """`columns` of `df` and where each row stands in its files.

    Wide columns can so be left out until the rows that need them are known. A frame that does not
    read its files directly is written first, with the columns asked for only.
    """
    place = [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    if not reads_one_table(df):
        df = stage(df.select(*dict.fromkeys(columns)), "located")
    return df.select(*dict.fromkeys(columns), *place)


def observed(df: DataFrame, metrics: dict[str, Column]) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """`df`, and the metrics of its rows as a table of one row, to be asked for once `df` has been written.

    The pass that writes `df` gathers them. Write it without a shuffle behind `df`: tasks that write
    count once, however often they are tried. Metrics are numbers, truth values or strings.
    """
    seen = Observation()
    spark = df.sparkSession
    schema = df.agg(*[value.alias(name) for name, value in metrics.items()]).schema

    def row() -> DataFrame:
        found = seen.get
        return spark.createDataFrame([tuple(found[name] for name in metrics)], schema)

    return df.observe(seen, *[value.alias(name) for name, value in metrics.items()]), row


def input_fingerprint(df: DataFrame) -> str | None:
    """A digest of what `df` reads: its files with their lengths and times. None if it reads no files.

    Files are listed by Spark, not read; only one row reaches the driver.
    """
    files = df.inputFiles()
    if not files:
        return None
    listed = df.sparkSession.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    total = listed.agg(F.count("*").alias("n"), F.sum(mark).alias("mark")).first()
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    return hashlib.sha256(f"{total['n']} {total['mark']} {re.sub('#[0-9]+', '', plan)}".encode()).hexdigest()
