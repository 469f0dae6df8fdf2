"""What several operators share: table access, linking of pairs, prefix sums, ranges as text."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.session import shared_dir, stage

_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Gives the Python workers this package, once per application, by way of the shared folder."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    # beside the staged tables, as executors that start later fetch it too
    folder = f"{shared_dir(spark)}/code-{context.applicationId}"
    files, place = open_folder(folder)
    with files.open_output_stream(f"{place}/{root.name}.zip") as out:
        out.write(packed.getvalue())
    context.addPyFile(f"{folder}/{root.name}.zip")
    _shipped.add(context.applicationId)


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, given as URI or path, and the folder's path there; it is made if need be."""
    is_uri = "://" in folder or folder.startswith("file:")
    files, place = pafs.FileSystem.from_uri(folder) if is_uri else (pafs.LocalFileSystem(), folder)
    files.create_dir(place, recursive=True)
    return files, place


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def texts_of(batch: pa.RecordBatch, column: int) -> list[str]:
    """A string column as Python strings, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def over_batches(make):
    """A mapInArrow function of a per-batch function returning a RecordBatch (or None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := make(batch)) is not None:
                yield out

    return run


def star_components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of `edges(a, b)`; root is the smallest vertex of its component.

    Alternates large-star and small-star steps. Every round is written to the shared folder, so
    lineage stays short and a lost executor costs a re-read. Only a count and a checksum reach the
    driver. The number of rounds grows with the logarithm of the longest chain. Rows per vertex are
    reduced to a minimum before the shuffle; the joins are plain equi-joins that adaptive execution
    may split, so a hub with many links does not bind one task.
    """
    current = stage(edges.where("a <> b").select("a", "b").distinct(), "links")
    before = None
    while (mark := _checksum(current)) != before:
        before = mark
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.where("a <> b").distinct(), "links")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = stage(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "links")
    roots = current.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(roots)


def _checksum(df: DataFrame):
    return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
