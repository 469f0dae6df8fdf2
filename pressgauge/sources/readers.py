"""Article tables, stored tables, vectors, boundaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressgauge.config import RAW_COLUMNS

COUNT_COLUMNS = ("retweet_count", "reply_count", "like_count", "quote_count", "impression_count")

# Text that stands for a missing value in delimited files.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

RAW_SCHEMA = T.StructType(
    [T.StructField(c, T.LongType() if c in COUNT_COLUMNS else T.StringType()) for c in RAW_COLUMNS]
)


def nullify(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns(
        {name: F.when(~F.col(name).isin(*NULL_TOKENS), F.col(name)) for name in columns}
    )


def read_raw_csv(spark: SparkSession, path: str, limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Raw articles from CSV with quoted multi-line text; with `limit` the first rows in `order`, or any.

    Multi-line CSV cannot be split, one file is one task: land a large corpus as Parquet first
    (many files, `read_raw_csv` then `write_table`) and start from there.
    """
    as_text = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])
    rows = (
        spark.read.schema(as_text)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )
    rows = nullify(rows, RAW_COLUMNS)
    rows = rows.withColumns(
        {name: F.col(name).try_cast("double").cast("long") for name in COUNT_COLUMNS}
    )
    if limit is None:
        return rows
    return (rows.orderBy(*order) if order else rows).limit(limit)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def read_result_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )


def preview(
    spark: SparkSession, path: str, order: Sequence[str], columns: Sequence[str] | None = None, n: int = 5000
) -> DataFrame:
    """The first n rows in a stated order."""
    rows = read_table(spark, path).orderBy(*order).limit(n)
    return rows if columns is None else rows.select(*columns)


def check_vector_parity(lookup: DataFrame, vectors: DataFrame, key: str = "story_key") -> DataFrame:
    """Keys present on one side only, with the side they are missing from. Must be empty."""
    left, right = lookup.select(key), vectors.select(key)
    return (
        left.join(right, key, "left_anti")
        .withColumn("missing_from", F.lit("vectors"))
        .unionByName(right.join(left, key, "left_anti").withColumn("missing_from", F.lit("lookup")))
    )


def attach_vectors(lookup: DataFrame, vectors: DataFrame, key: str = "story_key") -> DataFrame:
    """Lookup rows with their vectors; fails if the two tables do not hold the same keys."""
    if not check_vector_parity(lookup, vectors, key).isEmpty():
        raise ValueError("lookup and vector table do not hold the same stories")
    return lookup.join(vectors.select(key, "embedding"), key)


GEOJSON_SCHEMA = (
    "features array<struct<properties: struct<LAD23NM: string, LAD22NM: string>, "
    "geometry: struct<type: string, coordinates: string>>>"
)


def read_boundaries(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features (name, geometry_type, coordinates as JSON text) of a GeoJSON file, or of a folder of such files.

    A file is one collection, read by one task; with `lines` each of its lines is one, and many tasks read it.
    """
    features = spark.read.schema(GEOJSON_SCHEMA).option("multiLine", not lines).json(path)
    return features.select(F.explode("features").alias("f")).select(
        F.coalesce(
            F.when(F.col("f.properties.LAD23NM") != "", F.col("f.properties.LAD23NM")),
            F.col("f.properties.LAD22NM"),
        ).alias("name"),
        F.col("f.geometry.type").alias("geometry_type"),
        F.col("f.geometry.coordinates").alias("coordinates"),
    )


RING = "array<array<double>>"


def outer_rings(boundaries: DataFrame) -> DataFrame:
    """One row per outer ring; shapes other than polygons give none."""
    polygon = F.from_json("coordinates", f"array<{RING}>")
    many = F.from_json("coordinates", f"array<array<{RING}>>")
    polygons = F.when(F.col("geometry_type") == "Polygon", F.array(polygon)).when(
        F.col("geometry_type") == "MultiPolygon", many
    )
    kept = F.filter(polygons, lambda p: F.size(p) > 0)
    return boundaries.select(
        *[c for c in boundaries.columns if c != "coordinates"],
        F.posexplode(F.transform(kept, lambda p: F.get(p, 0))).alias("ring_index", "ring"),
    )


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Guard for stages that make no sense on empty input; runs a one-row job."""
    if df.isEmpty():
        raise ValueError(message)
    return df
