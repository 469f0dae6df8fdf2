"""Similarity gate, topic assignment, and the way back from stories to articles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.config import Settings
from pressgauge.functions import math, rules, vectors
from pressgauge.operators.encoding import Encoder, encode_texts, topic_table
from pressgauge.operators.sampling import sample_per_stratum
from pressgauge.operators.skew import hot_split_join

Vector = Sequence[float]

# --- fixed values: columns of the stored tables -------------------------------------------------
STORY_SCORE_COLUMNS = [
    "story_key",
    "candidate_source",
    "strong_keyword_hit",
    "region_spread",
    "econ_confidence",
    "is_econ",
    "top_topic",
    "top1_similarity",
    "topic_ambiguous",
    "assigned_topic",
]

SCORED_COLUMNS = [
    "unique_article_id",
    "story_key",
    "date",
    "week",
    "region",
    "resolved_url",
    "text_clean",
    "dup_weight",
    "effective_weight",
    "is_econ",
    "econ_confidence",
    "assigned_topic",
    "top_topic",
    "top1_similarity",
    "topic_ambiguous",
    "region_spread",
]

REVIEW_COLUMNS = [
    "review_group",
    "unique_article_id",
    "date",
    "week",
    "region",
    "candidate_source",
    "assigned_topic",
    "top_topic",
    "top1_similarity",
    "econ_confidence",
    "resolved_url",
    "text_clean",
]

# -----------------------------------------------------------------------------------------------

INHERITED = [c for c in STORY_SCORE_COLUMNS if c not in ("story_key", "candidate_source", "strong_keyword_hit")]


@dataclass(frozen=True)
class References:
    """Vectors of the configured anchors and topics; their number is fixed by the settings."""

    positive: Sequence[Vector]
    negative: Sequence[Vector]
    topics: Sequence[Vector]
    topic_names: Sequence[str]

    @property
    def all_vectors(self) -> list[Vector]:
        return [*self.positive, *self.negative, *self.topics]


def encode_references(spark: SparkSession, encoder: Encoder, cfg: Settings) -> References:
    profiles = [row.profile_text for row in topic_table(spark, cfg).collect()]
    texts = [*cfg.positive_anchors, *cfg.negative_anchors, *profiles]
    encoded = encode_texts(spark, texts, encoder)
    p, n = len(cfg.positive_anchors), len(cfg.negative_anchors)
    return References(encoded[:p], encoded[p : p + n], encoded[p + n :], cfg.topic_names)


def similarities(stories: DataFrame, refs: References) -> DataFrame:
    """Adds pos_max, neg_max and topic_scores, from one matrix product per batch."""
    p, n = len(refs.positive), len(refs.negative)
    product = vectors.sparse_dot_products if vectors.is_sparse(stories.schema["embedding"].dataType) else vectors.dot_products
    scored = stories.withColumn("_dots", product(F.col("embedding"), refs.all_vectors))
    return scored.withColumns(
        {
            "pos_max": F.array_max(F.slice("_dots", 1, p)),
            "neg_max": F.array_max(F.slice("_dots", p + 1, n)),
            "topic_scores": F.slice("_dots", p + n + 1, len(refs.topics)),
        }
    ).drop("_dots")


def best_topics(scored: DataFrame, topic_names: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(name) for name in topic_names])
    scores = F.col("topic_scores")
    return scored.withColumns(
        {
            "top1_similarity": F.array_max(scores),
            "top2_similarity": vectors.second_largest(scores),
            "top_topic": F.element_at(names, vectors.best_index(scores)),
        }
    )


def apply_rules(scored: DataFrame, cfg: Settings) -> DataFrame:
    gated = scored.withColumn(
        "is_econ", rules.passes_gate(F.col("pos_max"), F.col("neg_max"), F.col("strong_keyword_hit"), cfg)
    )
    return gated.withColumns(
        {
            "econ_confidence": F.col("pos_max"),
            "econ_margin": F.col("pos_max") - F.col("neg_max"),
            "topic_ambiguous": F.col("top1_similarity") - F.col("top2_similarity") < cfg.topic_ambiguous_margin,
            "assigned_topic": rules.assigned_topic(
                F.col("is_econ"), F.col("top_topic"), F.col("top1_similarity"), cfg
            ),
        }
    )


def score_stories(stories: DataFrame, refs: References, cfg: Settings) -> DataFrame:
    """Gate and topic of every story; `stories` carries its embedding, flags and spread."""
    flagged = stories.withColumn("strong_keyword_hit", F.coalesce("strong_keyword_hit", F.lit(False)))
    return apply_rules(best_topics(similarities(flagged, refs), refs.topic_names), cfg).select(*STORY_SCORE_COLUMNS)


def score_articles(candidates: DataFrame, scores: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Articles of the scored stories with the story's result and their effective weight.

    Gives SCORED_COLUMNS, as far as the candidates have them, and the `extra` columns of the
    candidates. Only those columns move. Hot stories are split off, the rest is shuffled; stories of
    one article, which are most, need no more than that one shuffle.
    """
    carried = [c for c in candidates.columns if c in SCORED_COLUMNS or c in extra]
    narrow = candidates.select(*carried)
    wanted = scores.select("story_key", *INHERITED)
    sizes = candidates.groupBy("story_key").agg(F.count("*").alias("_rows"))
    joined = hot_split_join(
        narrow, wanted.join(sizes, "story_key"), ["story_key"], "_rows", INHERITED, ["unique_article_id"], "inner"
    )
    scored = joined.withColumns(
        {
            "region_spread": F.coalesce("region_spread", F.lit(1)),
            "effective_weight": math.effective_weight(F.col("dup_weight"), F.col("region_spread")),
        }
    )
    return scored.select(*[c for c in SCORED_COLUMNS if c in scored.columns], *[c for c in extra if c not in SCORED_COLUMNS])


def weigh_buckets(buckets: DataFrame, scores: DataFrame) -> DataFrame:
    """The index input at story x region x week grain: far fewer rows than articles, no text.

    `buckets` holds the summed duplicate weights (`cleaning.bucket_weights`). A bucket's weight is
    the sum of its articles' effective weights, as all share one spread. Because rows are reduced
    before the join, a story reprinted everywhere is no hot key.
    """
    columns = ["story_key", "is_econ", "assigned_topic", "top1_similarity"]
    if "region_spread" in buckets.columns:
        joined = buckets.join(scores.select(*columns), "story_key")
    else:
        joined = buckets.join(scores.select(*columns, "region_spread"), "story_key")
    return joined.withColumn(
        "effective_weight", math.effective_weight(F.col("dup_weight"), F.col("region_spread"))
    )


def econ_review_sample(scored: DataFrame, cfg: Settings) -> DataFrame:
    """`scored` carries `candidate_source` beside the fixed columns."""
    grouped = scored.withColumn("review_group", rules.review_group(F.col("assigned_topic")))
    return sample_per_stratum(
        grouped.select(*REVIEW_COLUMNS),
        "review_group",
        "unique_article_id",
        cfg.review_sample_per_stratum,
        cfg.random_state,
    )
