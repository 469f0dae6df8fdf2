"""Diagnostics of each stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.config import OTHER_TOPIC
from pressgauge.functions.vectors import is_sparse


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), column)


def describe_lengths(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample standard deviation, quartiles of an integer column, exact.

    Statistics come from the histogram of values, whose size is the number of distinct lengths.
    """
    histogram = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_rows"))
    rows, value = F.col("_rows"), F.col(column).cast("double")
    count, total = F.sum(rows), F.sum(rows * value)
    mean = histogram.agg(total / count).scalar()
    variance = F.sum(rows * (value - mean) * (value - mean)) / (count - 1)
    quartile = lambda q: F.percentile(column, F.lit(q), rows)
    return histogram.agg(
        count.alias("count"),
        (total / count).alias("mean"),
        F.when(count > 1, F.sqrt(variance)).alias("std"),
        F.min(value).alias("min"),
        quartile(0.25).alias("p25"),
        quartile(0.5).alias("p50"),
        quartile(0.75).alias("p75"),
        F.max(value).alias("max"),
    )


def candidate_profile(candidates: DataFrame) -> DataFrame:
    share = lambda name: F.avg(F.col(name).cast("int"))
    return candidates.agg(
        F.count("*").alias("candidate_rows"),
        share("strong_keyword_hit").alias("share_strong_keyword"),
        share("weak_keyword_hit").alias("share_weak_keyword"),
        share("url_section_hit").alias("share_url_section"),
        F.count_distinct("region").alias("unique_regions"),
        F.count_distinct("week").alias("unique_weeks"),
    )


def scoring_profile(scored: DataFrame, index: DataFrame, topics: Sequence[str]) -> DataFrame:
    topic, econ = F.col("assigned_topic"), F.col("is_econ")
    spans = index.agg(
        F.struct(F.count_distinct("region").alias("regions"), F.count_distinct("week").alias("weeks"))
    ).scalar()
    counted = scored.agg(
        F.count("*").alias("scored_articles"),
        F.count_if(econ).alias("economic_articles"),
        F.count_if(topic.isin(list(topics))).alias("boe_topic_articles"),
        F.count_if(topic == OTHER_TOPIC).alias("other_econ_articles"),
        F.avg(F.when(econ, (topic == OTHER_TOPIC).cast("int"))).alias("other_econ_share_among_econ_articles"),
    )
    return counted.withColumns(
        {"regions_in_index": spans["regions"], "weeks_in_index": spans["weeks"]}
    )


def vector_profile(stories: DataFrame) -> DataFrame:
    size = F.col("embedding.size") if is_sparse(stories.schema["embedding"].dataType) else F.size("embedding")
    return stories.agg(
        F.count("*").alias("story_lookup_rows"),
        F.count("embedding").alias("embedding_rows"),
        F.max(size).alias("embedding_dim"),
        F.array_join(F.sort_array(F.collect_set("run_mode")), ", ").alias("run_modes"),
    )


def story_score_summary(scores: DataFrame) -> DataFrame:
    topic = F.col("assigned_topic")
    return scores.agg(
        F.count("*").alias("embedded_story_keys"),
        F.count_if("is_econ").alias("economic_story_keys"),
        F.count_if(topic == OTHER_TOPIC).alias("other_econ_story_keys"),
        F.count_if(topic == "unassigned").alias("unassigned_story_keys"),
    )
