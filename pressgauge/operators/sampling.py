"""Seeded samples that do not depend on row order or partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.config import Settings
from pressgauge.functions.hashing import stable_hash
from pressgauge.operators.skew import first_n_by_hash, first_n_per_group
from pressgauge.session import stage

TIERS = ("strong", "weak_url")


def sample_per_stratum(df: DataFrame, stratum: str, row_id: str, k: int, seed: int) -> DataFrame:
    """k rows per stratum, each row equally likely: those with the smallest hashes of their ids.

    One pass counts, one keeps the rows below a hash that the counts give; only these move, texts and
    all. `df` is read twice, so pass a stored or staged table. A missing id counts as a value; rows
    without a stratum are in no sample. Among rows sharing an id the first by their other columns count.
    """
    hashed = stable_hash(seed, F.col(row_id))
    sizes = df.groupBy(stratum).agg(F.lit(k).cast("long").alias("n"), F.count("*").alias("size"))
    rest = [F.col(name) for name in df.columns if name not in (stratum, row_id)]
    return first_n_by_hash(df, [stratum], hashed, [F.col(row_id), *rest], sizes, [row_id])


def tier_targets(stories: DataFrame, cap: int, strong_share: float) -> DataFrame:
    """Rows (sampling_tier, available, target): unused slots go to the strong tier first."""
    strong_goal = int(round(cap * strong_share))
    tier = F.col("sampling_tier")
    counted = stories.agg(
        *[F.count_if(tier == name).alias(name) for name in TIERS],
    )
    strong, weak = F.col("strong"), F.col("weak_url")
    base_strong, base_weak = F.least(F.lit(strong_goal), strong), F.least(F.lit(cap - strong_goal), weak)
    unused = F.lit(cap) - base_strong - base_weak
    more_strong = F.least(unused, strong - base_strong)
    more_weak = F.least(unused - more_strong, weak - base_weak)
    rows = F.array(
        _tier_row("strong", strong, base_strong + more_strong),
        _tier_row("weak_url", weak, base_weak + more_weak),
    )
    return counted.select(F.inline(rows))


def _tier_row(name, available, target):
    return F.struct(
        F.lit(name).alias("sampling_tier"),
        available.cast("long").alias("available"),
        target.cast("long").alias("target"),
    )


def quota_allocation(stories: DataFrame, targets: DataFrame) -> DataFrame:
    """Largest-remainder quotas (sampling_tier, region, week, story_count, quota).

    `stories` holds one row per story with its tier, region and week. Ties on the remainder go to
    the first region, then the first week.
    """
    bucket = ["sampling_tier", "region", "week"]
    shares = (
        stories.groupBy(*bucket)
        .agg(F.count("*").alias("story_count"))
        .join(F.broadcast(targets), "sampling_tier")  # two rows
        .withColumn("_raw", F.col("story_count") / F.col("available") * F.col("target"))
        .withColumn(
            "_base",
            F.when(F.col("available") <= F.col("target"), F.col("story_count")).otherwise(
                F.floor("_raw").cast("long")
            ),
        )
        .withColumn("_remainder", F.col("_raw") - F.floor("_raw"))
    )
    shares = stage(shares, "shares")
    open_slots = shares.groupBy("sampling_tier").agg((F.max("target") - F.sum("_base")).alias("n"))
    extra = first_n_per_group(
        shares.where(F.col("available") > F.col("target")).select(*bucket, "_remainder"),
        ["sampling_tier"],
        [("_remainder", False), ("region", True), ("week", True)],
        open_slots,
        None,
    )
    return (
        shares.select(*bucket, "story_count", F.col("_base").alias("_slots"))
        .unionByName(
            extra.select(*bucket, F.lit(0).cast("long").alias("story_count"), F.lit(1).cast("long").alias("_slots"))
        )
        .groupBy(*bucket)
        .agg(F.sum("story_count").alias("story_count"), F.sum("_slots").alias("quota"))
    )


def take_by_quota(stories: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """Per (tier, region, week), the stories with the smallest hashes, as many as the quota says."""
    hashed = stable_hash(seed, F.col("sampling_tier"), F.col("story_key"))
    limits = quotas.select("sampling_tier", "region", "week", F.col("quota").alias("n"), F.col("story_count").alias("size"))
    return first_n_by_hash(
        stories, ["sampling_tier", "region", "week"], hashed, [F.col("story_key")], limits, ["story_key"]
    )


def sample_stories(stories: DataFrame, cfg: Settings) -> DataFrame:
    """At most `embedding_story_cap` stories, stratified by tier, region and week; all in full mode."""
    if cfg.run_mode == "full":
        return stories
    stories = stage(stories, "stories")
    targets = tier_targets(stories, cfg.embedding_story_cap, cfg.embedding_strong_share)
    return take_by_quota(stories, quota_allocation(stories, targets), cfg.random_state)
