"""Dense week x region x topic panel and the risk index on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.config import OTHER_TOPIC, Settings
from pressgauge.functions import math
from pressgauge.session import stage

# Columns of the index.
INDEX_COLUMNS = [
    "week",
    "region",
    "topic",
    "n_articles",
    "total_econ_weight",
    "topic_share",
    "mean_similarity",
    "baseline_share",
    "surprise",
    "momentum",
    "persistence_weeks",
    "risk_score",
]


def econ_totals(scored: DataFrame) -> DataFrame:
    """Economic weight per week and region."""
    return (
        scored.where("is_econ")
        .groupBy("week", "region")
        .agg(F.sum("effective_weight").alias("total_econ_weight"))
    )


def topic_cells(scored: DataFrame) -> DataFrame:
    """Weight and weighted mean similarity of the topics that occur, per week and region."""
    weight = F.col("effective_weight")
    return (
        scored.where(F.col("is_econ") & (F.col("assigned_topic") != "unassigned"))
        .groupBy("week", "region", F.col("assigned_topic").alias("topic"))
        .agg(F.sum(weight).alias("n_articles"), F.sum(F.col("top1_similarity") * weight).alias("_similarity"))
        .withColumn("mean_similarity", math.safe_ratio(F.col("_similarity"), F.col("n_articles")))
        .drop("_similarity")
    )


def region_weeks(scored: DataFrame, topics: Sequence[str]) -> DataFrame:
    """One row per active week and region: the total, and two sums per topic side by side.

    This is the only shuffle of article-grain rows, and it moves partial sums.
    """
    weight, topic = F.col("effective_weight"), F.col("assigned_topic")
    sums = [F.sum(weight).alias("total_econ_weight")]
    for i, name in enumerate(topics):
        mine = topic == name
        sums.append(F.sum(F.when(mine, weight)).alias(f"_n{i}"))
        sums.append(F.sum(F.when(mine, F.col("top1_similarity") * weight)).alias(f"_s{i}"))
    return scored.where("is_econ").groupBy("week", "region").agg(*sums)


def spread_topics(wide: DataFrame, topics: Sequence[str]) -> DataFrame:
    """The dense panel: every topic for every active week and region, zero where it is absent."""
    cells = []
    for i, name in enumerate(topics):
        n = F.coalesce(F.col(f"_n{i}"), F.lit(0.0))
        cells.append(
            F.struct(
                F.lit(name).alias("topic"),
                n.alias("n_articles"),
                math.safe_ratio(F.coalesce(F.col(f"_s{i}"), F.lit(0.0)), n).alias("mean_similarity"),
            )
        )
    return wide.select("week", "region", "total_econ_weight", F.inline(F.array(*cells))).withColumn(
        "topic_share", math.safe_ratio(F.col("n_articles"), F.col("total_econ_weight"))
    )


def dense_panel(scored: DataFrame, topics: Sequence[str]) -> DataFrame:
    return spread_topics(region_weeks(scored, topics), topics)


def topic_prior(panel: DataFrame, topics: Sequence[str], prior_mode: str = "per_panel_row") -> DataFrame:
    """Global share per topic. By default the total weight is counted once per panel row, so all
    priors add up to one over the number of topics; `per_region_week` gives plain shares."""
    rows_per_week = len(topics) if prior_mode == "per_panel_row" else 1
    total = F.sum("total_econ_weight") * F.lit(float(rows_per_week))
    return panel.groupBy("topic").agg(math.safe_ratio(F.sum("n_articles"), total).alias("topic_prior"))


def with_posterior(panel: DataFrame, prior: DataFrame, cfg: Settings) -> DataFrame:
    """Share shrunk toward the topic's prior. The prior has one row per configured topic."""
    return panel.join(F.broadcast(prior), "topic").withColumn(
        "p_post",
        math.posterior_share(
            F.col("n_articles"), F.col("total_econ_weight"), F.col("topic_prior"), cfg.prior_strength
        ),
    )


def _previous_mean(value: str, rows: int, least: int) -> Column:
    """Mean of the previous rows (active weeks, not calendar weeks); null when there are too few."""
    window = Window.partitionBy("region", "topic").orderBy("week").rowsBetween(-rows, -1)
    return F.when(F.count(value).over(window) >= least, F.avg(value).over(window))


def with_baselines(panel: DataFrame, cfg: Settings) -> DataFrame:
    filled = panel.withColumn(
        "baseline_share",
        F.coalesce(_previous_mean("p_post", cfg.baseline_window, cfg.baseline_min_rows), "topic_prior"),
    )
    return filled.withColumn(
        "recent_share",
        F.coalesce(_previous_mean("p_post", cfg.recent_window, cfg.recent_min_rows), "baseline_share"),
    )


def with_surprise(panel: DataFrame) -> DataFrame:
    return panel.withColumns(
        {
            "surprise": F.col("p_post") - F.col("baseline_share"),
            "momentum": F.col("p_post") - F.col("recent_share"),
        }
    )


def with_persistence(panel: DataFrame) -> DataFrame:
    """Length of the current run of weeks with a positive surprise.

    Rows since the last week without one. Surprise is rounded to twelve places first, as quiet
    weeks differ from zero by float noise only.
    """
    order = Window.partitionBy("region", "topic").orderBy("week")
    position = F.row_number().over(order)
    up = F.round("surprise", 12) > 0
    numbered = panel.withColumn("_at", position)
    last_break = F.max(F.when(~up, F.col("_at"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn(
        "persistence_weeks", (F.col("_at") - F.coalesce(last_break, F.lit(0))).cast("int")
    ).drop("_at")


Z_COLUMNS = ("surprise", "momentum", "mean_similarity")


def with_zscores(panel: DataFrame, cfg: Settings) -> DataFrame:
    """Clipped z-score within the topic. Statistics per topic are joined back, not windowed, so
    the panel keeps its parallelism; they have one row per configured topic."""
    stats = panel.groupBy("topic").agg(
        *[F.avg(name).alias(f"_{name}_mean") for name in Z_COLUMNS],
        *[F.stddev_pop(name).alias(f"_{name}_std") for name in Z_COLUMNS],
    )
    joined = panel.join(F.broadcast(stats), "topic")
    return joined.withColumns(
        {
            f"{name}_z": math.zscore(
                F.col(name), F.col(f"_{name}_mean"), F.col(f"_{name}_std"), cfg.zscore_clip
            )
            for name in Z_COLUMNS
        }
    ).drop(*[f"_{name}_{kind}" for name in Z_COLUMNS for kind in ("mean", "std")])


def with_risk(panel: DataFrame, cfg: Settings) -> DataFrame:
    supported = panel.withColumn("support", math.support(F.col("total_econ_weight"), cfg.support_k))
    return supported.withColumn(
        "risk_score",
        F.col("support")
        * (
            F.lit(cfg.weight_surprise) * F.col("surprise_z")
            + F.lit(cfg.weight_momentum) * F.col("momentum_z")
            + F.lit(cfg.weight_similarity) * F.col("mean_similarity_z")
        ),
    )


def posterior_panel(scored: DataFrame, topics: Sequence[str], cfg: Settings) -> DataFrame:
    """Panel with prior and posterior. The reduced region-week table is staged: the prior and the
    panel both read it, so the article-grain input behind it is read once."""
    panel = spread_topics(stage(region_weeks(scored, topics), "region_weeks"), topics)
    return with_posterior(panel, topic_prior(panel, topics, cfg.prior_mode), cfg)


def surprise_panel(scored: DataFrame, topics: Sequence[str], cfg: Settings) -> DataFrame:
    return with_persistence(with_surprise(with_baselines(posterior_panel(scored, topics, cfg), cfg)))


def full_panel(scored: DataFrame, topics: Sequence[str], cfg: Settings) -> DataFrame:
    return with_risk(with_zscores(surprise_panel(scored, topics, cfg), cfg), cfg)


def build_index(scored: DataFrame, cfg: Settings, topics: Sequence[str] | None = None) -> DataFrame:
    """Risk index from rows (week, region, assigned_topic, is_econ, effective_weight,
    top1_similarity), at article or bucket grain. `topics` defaults to the configured ones."""
    names = [*topics, OTHER_TOPIC] if topics is not None else cfg.panel_topics
    return full_panel(scored, names, cfg).select(*INDEX_COLUMNS)
