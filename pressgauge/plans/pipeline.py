"""The whole pipeline as stages between stored tables.

Every stage reads the table before it, so a stage whose table is complete can be skipped, and a
failed run goes on from the last complete table. Beside a complete table stands the fingerprint of
what it was made from: settings, input files and, for vectors, the encoder. A stage is skipped only
if all of these are as they were.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.config import NO_LEADER, Settings
from pressgauge.operators import (
    candidates as candidate_ops,
    cleaning,
    encoding,
    outputs,
    panel,
    profiles,
    sampling,
    scoring,
    stories,
)
from pressgauge.session import input_fingerprint, small_batches, stage, use_utc
from pressgauge.sources import readers, writers


def is_complete(spark: SparkSession, path: str, key: str | None = None) -> bool:
    """Whether a table was written to the end, and from what `key` names if one is given.

    The mark is a table of its own, written after the table.
    """
    try:
        marks = spark.read.schema("fingerprint string").parquet(f"{path}.done").collect()
    except AnalysisException:
        return False
    return bool(marks) and (key is None or marks[0]["fingerprint"] == key)


def mark_complete(spark: SparkSession, path: str, key: str | None = None) -> None:
    row = spark.createDataFrame([(key,)], "fingerprint string")
    writers.write_table(row.coalesce(1), f"{path}.done")


def is_current(spark: SparkSession, key: str | None, *paths: str) -> bool:
    """Whether all of the tables were made from what `key` names; never so for an unknown origin."""
    return key is not None and all(is_complete(spark, path, key) for path in paths)


def stored(spark: SparkSession, path: str, make: Callable[[], DataFrame], reuse: bool, key: str | None) -> DataFrame:
    if not (reuse and is_current(spark, key, path)):
        writers.remove(spark, f"{path}.done")  # the old mark must not stand beside a half-written table
        writers.write_table(make(), path)
        mark_complete(spark, path, key)
    return readers.read_table(spark, path)


def origin(raw: DataFrame, cfg: Settings) -> str | None:
    """Names the settings and the input files; None if the input comes from no files."""
    files = input_fingerprint(raw)
    written = json.dumps(asdict(cfg), sort_keys=True, default=str)
    return None if files is None else hashlib.sha256(f"{files} {written}".encode()).hexdigest()


def encoded_origin(key: str | None, encoder: encoding.Encoder) -> str | None:
    named = getattr(encoder, "fingerprint", None)
    return None if key is None or named is None else hashlib.sha256(f"{key} {named}".encode()).hexdigest()


def select_stories(candidates: DataFrame, cfg: Settings) -> DataFrame:
    """Sampled (or all) stories with text, ready to be encoded."""
    chosen = stage(sampling.sample_stories(stories.story_meta(candidates, cfg), cfg), "selected")
    return stories.build_stories(candidates, chosen, cfg)


def score_embedded(embedded: DataFrame, encoder: encoding.Encoder, cfg: Settings) -> DataFrame:
    refs = scoring.encode_references(embedded.sparkSession, encoder, cfg)
    return scoring.score_stories(embedded, refs, cfg)


def score_candidates(candidates: DataFrame, encoder: encoding.Encoder, cfg: Settings) -> DataFrame:
    """Stories of the candidates, encoded and scored, staged as articles and index both read them."""
    embedded = encoding.embed_stories(select_stories(candidates, cfg), encoder)
    with small_batches(candidates.sparkSession):
        return stage(score_embedded(embedded, encoder, cfg), "scores")


def candidate_buckets(candidates: DataFrame) -> DataFrame:
    """Summed duplicate weights per story, region and week of candidates that carry theirs."""
    return candidates.groupBy(*cleaning.GROUP).agg(F.sum("dup_weight").alias("dup_weight"))


def index_of(candidates: DataFrame, scores: DataFrame, cfg: Settings) -> DataFrame:
    return panel.build_index(scoring.weigh_buckets(candidate_buckets(candidates), scores), cfg)


def stage_losses(candidates: DataFrame, scores: DataFrame, scored: DataFrame) -> DataFrame:
    """Rows (stage, rows_in, rows_out, lost): candidate stories without a score, candidates not scored."""
    count = lambda name, before, after: before.agg(F.count("*").alias("rows_in")).select(
        F.lit(name).alias("stage"), "rows_in", after.agg(F.count("*")).scalar().alias("rows_out")
    )
    told = candidates.select("story_key").distinct()
    both = count("stories", told, scores).unionByName(count("articles", candidates, scored))
    return both.withColumn("lost", F.col("rows_in") - F.col("rows_out"))


def build_tables(
    spark: SparkSession,
    raw: DataFrame,
    encoder: encoding.Encoder,
    cfg: Settings,
    out_dir: str,
    reuse: bool = False,
) -> dict[str, DataFrame]:
    """Raw articles to the risk index; each table is stored under `out_dir`.

    Raw texts are scanned once, and cleaned texts once to find the candidates; counters are gathered
    on the way. `reuse` skips what the same settings, input files and encoder have made before.
    """
    use_utc(spark)
    at = lambda name: f"{out_dir}/{name}"

    key = origin(raw, cfg)
    encoded_key = encoded_origin(key, encoder)

    if not (reuse and is_current(spark, key, at("cleaned_articles"), at("cleaning_report"))):
        # one pass over the raw texts writes the articles and counts; the weights read them staged
        kept, counted = cleaning.clean_and_count(raw, cfg)
        articles = stored(spark, at("cleaned_articles"), lambda: cleaning.with_duplicate_weight(kept), False, key)
        writers.write_json(cleaning.cleaning_report(counted, raw.columns, articles, cfg), at("cleaning_report"))
        mark_complete(spark, at("cleaning_report"), key)
    articles = readers.read_table(spark, at("cleaned_articles"))

    if not (reuse and is_current(spark, key, at("candidate_articles"), at("candidate_summary"))):
        rows, summary = candidate_ops.filter_and_count(
            articles, cfg, lambda found: stored(spark, at("candidate_articles"), lambda: found, False, key)
        )
        writers.write_json(summary, at("candidate_summary"))
        mark_complete(spark, at("candidate_summary"), key)
    rows = readers.read_table(spark, at("candidate_articles"))
    readers.require_rows(rows, "no candidate articles")
    writers.write_csv(candidate_ops.candidate_review_sample(rows, cfg), at("candidate_review_sample"))

    lookup = stored(spark, at("story_lookup"), lambda: stories.number_stories(select_stories(rows, cfg)), reuse, key)
    with small_batches(spark):
        vectors = stored(
            spark,
            at("story_embeddings"),
            lambda: encoding.embed_stories(lookup, encoder).select("story_key", "embedding"),
            reuse,
            encoded_key,
        )
        scores = stored(
            spark,
            at("story_scores"),
            lambda: score_embedded(readers.attach_vectors(lookup, vectors), encoder, cfg),
            reuse,
            encoded_key,
        )
    readers.require_rows(scores.where("is_econ"), "no economic stories")

    # by week, as result tables ask for articles of single weeks; adaptive execution splits large weeks
    scored = scoring.score_articles(rows, scores, ["candidate_source"]).hint("rebalance", "week")
    writers.write_table(scored, at("scored_articles"), partition_by=["week"])
    with_source = readers.read_table(spark, at("scored_articles"))
    writers.write_csv(scoring.econ_review_sample(with_source, cfg), at("econ_review_sample"))
    scored = with_source.select(*scoring.SCORED_COLUMNS)
    index = stored(spark, at("regional_topic_index"), lambda: index_of(rows, scores, cfg), reuse, encoded_key)
    counters = {
        "candidate_profile": profiles.candidate_profile(rows),
        "vector_profile": profiles.vector_profile(readers.attach_vectors(lookup, vectors)),
        "story_score_summary": profiles.story_score_summary(scores),
        "scoring_profile": profiles.scoring_profile(scored, index, cfg.topic_names),
        "stage_losses": stage_losses(rows, scores, scored),
    }
    for name, counter in counters.items():
        writers.write_json(counter, at(name))
    return {
        "cleaned_articles": articles,
        "candidate_articles": rows,
        "story_lookup": lookup,
        "story_embeddings": vectors,
        "story_scores": scores,
        "scored_articles": scored,
        "regional_topic_index": index,
    }


def result_tables(
    index: DataFrame, scored: DataFrame, cfg: Settings, boundaries: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Every result table of a stored index and its stored scored articles.

    With `boundaries` (`readers.read_boundaries`), the values of each map per boundary as well.
    """
    topics = outputs.topic_index(index, cfg.topic_names)
    readers.require_rows(outputs.active(topics), "no active week in the index")
    scope = stage(outputs.report_scope(topics, cfg), "scope")
    leaders = outputs.region_leaders(topics, cfg, scope)
    reference = outputs.reference_map(topics, cfg, scope)
    month = outputs.month_map(topics, cfg, scope)
    labels = outputs.leader_labels(leaders)
    tables = {
        "hot_regions_topics": outputs.hot_pairs(topics, cfg, scope),
        "representative_snippets": outputs.representative_snippets(scored, outputs.latest_pairs(topics, cfg, scope), cfg),
        "topic_trend": outputs.topic_trend(topics, cfg, scope),
        "overall_region_trend": outputs.overall_region_trend(topics, cfg, scope),
        "reference_map": reference,
        "reference_map_legend": outputs.ranked_legend(reference, "risk_score", cfg),
        "month_map": month,
        "month_map_legend": outputs.ranked_legend(month, "risk_score", cfg, [F.desc("n_articles")]),
        "top_risk_map": outputs.top_risk_map(leaders),
        "top_risk_legend": outputs.top_risk_legend(leaders, cfg),
        "leader_labels": labels,
        "leader_legend": outputs.leader_legend(leaders),
    }
    if boundaries is not None:
        places = boundaries.select("name")
        for name in ("reference_map", "month_map", "top_risk_map"):
            tables[f"{name}_places"] = outputs.map_values(places, tables[name], "risk_score", 0.0)
        tables["leader_label_places"] = outputs.map_values(places, labels, "label", NO_LEADER)
    return tables


def write_results(
    index: DataFrame, scored: DataFrame, cfg: Settings, out_dir: str, boundaries: DataFrame | None = None
) -> None:
    for name, df in result_tables(index, scored, cfg, boundaries).items():
        writers.write_csv(df, f"{out_dir}/{name}")
