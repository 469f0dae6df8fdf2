"""Articles to stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.config import Settings
from pressgauge.functions.hashing import stable_hash
from pressgauge.session import LOCATOR, stage, with_locators

# "First" row of a story: by date, then id.
ARRIVAL = ["date", "unique_article_id"]


def arrival() -> Column:
    return F.struct(*ARRIVAL)


def story_buckets(candidates: DataFrame) -> DataFrame:
    """Article rows per story, region and week."""
    return candidates.groupBy("story_key", "region", "week").agg(F.count("*").alias("article_rows"))


def primary_buckets(buckets: DataFrame, seed: int) -> DataFrame:
    """The region and week where a story has most rows; ties by hash."""
    return (
        buckets.groupBy("story_key")
        .agg(_primary(seed).alias("_first"))
        .select("story_key", "_first.region", "_first.week", "_first.article_rows")
    )


def _primary(seed: int) -> Column:
    rank = F.struct(
        F.negative("article_rows"),
        stable_hash(seed, F.col("story_key"), F.col("region"), F.col("week")),
        "region",
        "week",
    )
    return F.min_by(F.struct("region", "week", "article_rows"), rank)


def region_spread(buckets: DataFrame) -> DataFrame:
    """Distinct regions per story."""
    return buckets.groupBy("story_key").agg(F.count_distinct("region").cast("int").alias("region_spread"))


def with_region_spread(buckets: DataFrame) -> DataFrame:
    """`region_spread` on every (story, region, week) row.

    Regions are counted with partial aggregation and joined back, so no task holds a whole story.
    """
    spread = buckets.groupBy("story_key", "region").agg(F.count("*").alias("_weeks")).groupBy("story_key").agg(
        F.count("*").cast("int").alias("region_spread")
    )
    return buckets.join(spread, "story_key")


def story_flags(candidates: DataFrame) -> DataFrame:
    """Source of the first row of a story, and whether any of its rows hit a strong keyword."""
    return candidates.groupBy("story_key").agg(
        F.min_by("candidate_source", arrival()).alias("candidate_source"),
        F.bool_or("strong_keyword_hit").alias("strong_keyword_hit"),
    )


def _first_places(located: DataFrame) -> DataFrame:
    """Where the first row of every story stands. Reads no text."""
    first = F.min(F.struct(*ARRIVAL, *LOCATOR)).alias("_first")
    return located.groupBy("story_key").agg(first).select("story_key", *[F.col(f"_first.{c}").alias(c) for c in LOCATOR])


def _fetched(places: DataFrame, located: DataFrame, columns: list[str], how: str) -> DataFrame:
    """`columns` of the rows at `places`.

    The places are the hashed side of the join, so wide rows are exchanged once and never sorted.
    """
    rows = located.select(*LOCATOR, *columns)
    return places.hint("shuffle_hash").join(rows, LOCATOR, how).drop(*LOCATOR)


def first_rows(candidates: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of the first row of every story.

    The first row is found on narrow columns, with its place in the files as the last tie-breaker,
    and its wide columns are fetched from there.
    """
    located = with_locators(candidates, "story_key", *ARRIVAL, *columns)
    return _fetched(_first_places(located), located, [c for c in columns if c != "story_key"], "inner")


def story_meta(candidates: DataFrame, cfg: Settings) -> DataFrame:
    """One row per story: primary bucket, spread, flags, tier. Reads no text.

    Rows are first reduced per (story, region, week) with partial aggregation, so a story that is
    reprinted everywhere arrives as at most regions x weeks rows. The tier follows the first row,
    the strong flag any row.
    """
    head = F.struct(
        *ARRIVAL, "candidate_source", F.col("strong_keyword_hit").alias("first_strong")
    )
    buckets = candidates.groupBy("story_key", "region", "week").agg(
        F.count("*").alias("article_rows"),
        F.min(head).alias("_head"),
        F.bool_or("strong_keyword_hit").alias("_strong"),
    )
    return (
        buckets.groupBy("story_key")
        .agg(
            _primary(cfg.random_state).alias("_first"),
            # the set holds region names of one story: bounded by the number of regions
            F.size(F.collect_set("region")).alias("region_spread"),
            F.sum("article_rows").alias("article_rows"),
            F.min("_head").alias("_head"),
            F.bool_or("_strong").alias("strong_keyword_hit"),
        )
        .select(
            "story_key",
            "_first.region",
            "_first.week",
            "region_spread",
            "article_rows",
            "_head.candidate_source",
            "strong_keyword_hit",
            F.when(F.col("_head.first_strong"), "strong").otherwise("weak_url").alias("sampling_tier"),
        )
    )


def build_stories(candidates: DataFrame, selected: DataFrame, cfg: Settings) -> DataFrame:
    """Selected stories with the text of their first row and run mode: the table that is encoded.

    Texts come last: what is exchanged before is where each story's text stands.
    """
    located = with_locators(candidates, "story_key", *ARRIVAL, "text_for_embedding")
    places = selected.join(_first_places(located), "story_key", "left")
    return (
        _fetched(places, located, ["text_for_embedding"], "left")
        .withColumn("text_for_embedding", F.coalesce("text_for_embedding", F.lit("")))
        .withColumn("region_spread", F.coalesce("region_spread", F.lit(1)))
        .withColumn("run_mode", F.lit(cfg.run_mode))
    )


def number_stories(stories: DataFrame) -> DataFrame:
    """`embedding_row`: dense row number by story_key, for export beside a vector matrix.

    Only the keys are sorted: they are dealt into ranges, the written table fixes the ranges, rows
    are numbered within their range, and the ranges' sizes (one row each) give the offsets.
    """
    ranges = stories.select("story_key").repartitionByRange("story_key").withColumn("_part", F.spark_partition_id())
    ranges = stage(ranges, "story_ranges")
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")
    offsets = sizes.select("_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("story_key")) - 1
    numbered = (
        ranges.withColumn("_place", place)
        .join(F.broadcast(offsets), "_part")  # a row per range
        .select("story_key", (F.col("_before") + F.col("_place")).alias("embedding_row"))
    )
    return stories.join(numbered, "story_key")


def rebuild_lookup(old: DataFrame, candidates: DataFrame) -> DataFrame:
    """Lookup for an existing story table: its rows with the spread found in the candidates."""
    columns = ["story_key", "embedding_row", "text_for_embedding", "region", "week", "run_mode"]
    spread = region_spread(candidates)
    return (
        old.select(*columns)
        .withColumn("story_key", F.col("story_key").cast("string"))
        .join(spread, "story_key", "left")
        .withColumn("region_spread", F.coalesce("region_spread", F.lit(1)).cast("int"))
    )
