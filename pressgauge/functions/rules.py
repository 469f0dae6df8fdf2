"""Decision rules on similarity scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressgauge.config import OTHER_TOPIC, UNASSIGNED, Settings


def passes_gate(positive: Column, negative: Column, strong: Column, cfg: Settings) -> Column:
    margin = positive - negative
    main = (positive >= cfg.econ_min_similarity) & (margin >= cfg.econ_margin_threshold)
    relaxed = (
        strong
        & (positive >= cfg.econ_strong_min_similarity)
        & (margin >= cfg.econ_strong_margin_threshold)
    )
    return (main | relaxed) & ~(negative > positive + F.lit(cfg.econ_negative_guard))


def assigned_topic(is_econ: Column, top_topic: Column, top1: Column, cfg: Settings) -> Column:
    return (
        F.when(~is_econ, UNASSIGNED)
        .when(top1 >= cfg.topic_min_similarity, top_topic)
        .otherwise(OTHER_TOPIC)
    )


def review_group(topic: Column) -> Column:
    return (
        F.when(topic == UNASSIGNED, "rejected_candidate")
        .when(topic == OTHER_TOPIC, "other_econ")
        .otherwise("boe_topic")
    )
