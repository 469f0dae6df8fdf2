"""Result tables derived from the index.

The index is an aggregate (weeks x regions x topics); pass a stored or staged one. What all tables
share, such as the reference week, is one row (`report_scope`): stage it once and pass it to each, or
leave it out and every table derives its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.config import NO_LEADER, Settings
from pressgauge.functions import text
from pressgauge.functions.math import positive
from pressgauge.functions.once import with_columns_once
from pressgauge.operators.skew import first_k_per_group
from pressgauge.session import stage

# Order of rows with equal risk.
TIES = ["region", "topic", "week"]

# Columns of the snippet table.
SNIPPET_COLUMNS = [
    "week",
    "region",
    "topic",
    "risk_score",
    "n_articles",
    "topic_share",
    "snippet_rank",
    "unique_article_id",
    "resolved_url",
    "top1_similarity",
    "region_spread",
    "representative_snippet",
]


def topic_index(index: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Index rows of the configured topics only."""
    return index.where(F.col("topic").isin(list(topics)))


def active(index: DataFrame) -> DataFrame:
    return index.where(F.col("n_articles") > 0)


def reference_week(index: DataFrame, cfg: Settings) -> DataFrame:
    """One row: the latest active week of the first preferred year that has one, else of all."""
    week = F.col("week")
    return active(index).agg(
        F.coalesce(*[F.max(F.when(F.year(week) == y, week)) for y in cfg.preferred_years], F.max(week)).alias(
            "reference_week"
        )
    )


def report_scope(index: DataFrame, cfg: Settings) -> DataFrame:
    """One row (reference_week, weeks, showcase_topic): what the report is about.

    `weeks` are the latest active weeks up to the reference week, newest first, as many as the longest
    window asks for.
    """
    cell = F.struct("week", "topic", *[F.negative(name).alias(name) for name in RANKED])
    # one scan: weeks x topics cells, gathered in the row that is asked for
    gathered = _ranking(active(index), "week", "topic").agg(F.collect_list(cell).alias("cells"))
    weeks = gathered.select("cells", F.sort_array(F.array_distinct(F.col("cells.week")), asc=False).alias("weeks"))
    latest_of = lambda year: F.array_max(F.filter("weeks", lambda w: F.year(w) == year))
    in_year = [latest_of(year) for year in cfg.preferred_years]
    dated = weeks.withColumn("reference_week", F.coalesce(*in_year, F.array_max("weeks")))
    strongest = F.array_min(
        F.transform(
            F.filter("cells", lambda c: c["week"] == F.col("reference_week")),
            lambda c: F.struct(*[c[name].alias(name) for name in (*RANKED, "topic")]),
        )
    )
    up_to = F.filter("weeks", lambda w: w <= F.col("reference_week"))
    return dated.select(
        "reference_week",
        F.slice(up_to, 1, max(cfg.recent_weeks, cfg.trend_weeks)).alias("weeks"),
        strongest["topic"].alias("showcase_topic"),
    )


def _scope(index: DataFrame, cfg: Settings, scope: DataFrame | None) -> DataFrame:
    return report_scope(index, cfg) if scope is None else scope


def _reference(scope: DataFrame) -> Column:
    return scope.select("reference_week").scalar()


def last_active_weeks(index: DataFrame, cfg: Settings, n: int, scope: DataFrame | None = None) -> DataFrame:
    """The n latest active weeks up to the reference week."""
    return _scope(index, cfg, scope).select(F.explode(F.slice("weeks", 1, n)).alias("week"))


def in_last_weeks(index: DataFrame, scope: DataFrame, n: int) -> DataFrame:
    return index.where(F.array_contains(scope.select(F.slice("weeks", 1, n)).scalar(), F.col("week")))


def reference_pairs(index: DataFrame, cfg: Settings, scope: DataFrame | None = None) -> DataFrame:
    return active(index).where(F.col("week") == _reference(_scope(index, cfg, scope)))


def _by_risk(score: str = "risk_score") -> list[Column]:
    return [F.desc(score), *[F.asc(name) for name in TIES]]


def latest_pairs(index: DataFrame, cfg: Settings, scope: DataFrame | None = None) -> DataFrame:
    return (
        reference_pairs(index, cfg, scope)
        .orderBy(*_by_risk())
        .limit(cfg.hot_pairs_top_n)
        .withColumn("window", F.lit("reference_week"))
    )


def rolling_pairs(index: DataFrame, cfg: Settings, scope: DataFrame | None = None) -> DataFrame:
    scope = _scope(index, cfg, scope)
    means = ["total_econ_weight", "topic_share", "mean_similarity", "baseline_share", "surprise", "momentum"]
    return (
        in_last_weeks(active(index), scope, cfg.recent_weeks)
        .groupBy("region", "topic")
        .agg(
            F.max("week").alias("week"),
            F.sum("n_articles").alias("n_articles"),
            *[F.avg(name).alias(name) for name in means],
            F.max("persistence_weeks").alias("persistence_weeks"),
            F.avg("risk_score").alias("risk_score"),
        )
        .orderBy(*_by_risk())
        .limit(cfg.hot_pairs_top_n)
        .withColumn("window", F.lit("recent_active_weeks"))
    )


def hot_pairs(index: DataFrame, cfg: Settings, scope: DataFrame | None = None) -> DataFrame:
    return latest_pairs(index, cfg, scope).unionByName(rolling_pairs(index, cfg, scope))


def top_panel_rows(index: DataFrame, n: int) -> DataFrame:
    return index.orderBy(*_by_risk()).limit(n)


def topic_ranking(index: DataFrame, cfg: Settings, scope: DataFrame | None = None) -> DataFrame:
    """Topics of the reference week by positive risk, strongest first."""
    return _ranked(reference_pairs(index, cfg, scope))


#: what topics are ranked by, largest first
RANKED = ("total_risk", "active_regions", "max_risk")


def _ranking(pairs: DataFrame, *keys: str) -> DataFrame:
    return pairs.groupBy(*keys).agg(
        F.sum(positive(F.col("risk_score"))).alias("total_risk"),
        # the set holds region names of one week and topic: bounded by the number of regions
        F.size(F.collect_set("region")).cast("long").alias("active_regions"),
        F.max("risk_score").alias("max_risk"),
    )


def _ranked(pairs: DataFrame) -> DataFrame:
    return _ranking(pairs, "topic").orderBy(*[F.desc(name) for name in RANKED], "topic")


def showcase_topic(index: DataFrame, cfg: Settings, scope: DataFrame | None = None) -> DataFrame:
    return topic_ranking(index, cfg, scope).limit(1)


def _of_showcase(index: DataFrame, scope: DataFrame) -> DataFrame:
    return index.where(F.col("topic") == scope.select("showcase_topic").scalar())


def showcase_window(index: DataFrame, cfg: Settings, scope: DataFrame | None = None) -> DataFrame:
    """Showcase topic over the trend weeks, weeks without articles included."""
    scope = _scope(index, cfg, scope)
    return in_last_weeks(_of_showcase(index, scope), scope, cfg.trend_weeks)


def trend_regions(index: DataFrame, cfg: Settings, scope: DataFrame | None = None) -> DataFrame:
    """Regions with most active weeks in the showcase window, further keys breaking ties."""
    scope = _scope(index, cfg, scope)
    return _trend_regions(showcase_window(index, cfg, scope), _reference(scope), cfg)


def _trend_regions(window: DataFrame, reference: Column, cfg: Settings) -> DataFrame:
    at_reference = F.col("week") == reference
    return (
        window.groupBy("region")
        .agg(
            F.count_if(F.col("n_articles") > 0).alias("active_weeks"),
            F.sum(positive(F.col("risk_score"))).alias("positive_risk"),
            F.avg("topic_share").alias("avg_topic_share"),
            F.coalesce(F.max(F.when(at_reference, F.col("risk_score"))), F.lit(0.0)).alias("reference_week_risk"),
        )
        .orderBy(
            F.desc("active_weeks"),
            F.desc("positive_risk"),
            F.desc("reference_week_risk"),
            F.desc("avg_topic_share"),
            "region",
        )
        .limit(cfg.trend_regions)
    )


def topic_trend(index: DataFrame, cfg: Settings, scope: DataFrame | None = None) -> DataFrame:
    """Weekly share and risk of the selected regions, with the mean over all regions beside them.

    Rows of the mean have the series name 'mean'. The window (a topic, the trend weeks) is staged, so
    the index is read once.
    """
    scope = _scope(index, cfg, scope)
    window = stage(showcase_window(index, cfg, scope), "trend_window")
    regions = _trend_regions(window, _reference(scope), cfg).select("region")
    chosen = window.join(F.broadcast(regions), "region", "left_semi")
    lines = chosen.select("week", F.col("region").alias("series"), "topic_share", "risk_score")
    return lines.unionByName(topic_benchmark(window).withColumn("series", F.lit("mean")))


def topic_benchmark(window: DataFrame) -> DataFrame:
    return window.groupBy("week").agg(
        F.avg("topic_share").alias("topic_share"), F.avg("risk_score").alias("risk_score")
    )


def overall_region_risk(index: DataFrame, cfg: Settings, scope: DataFrame | None = None) -> DataFrame:
    """Positive risk over all topics per week and region, over the trend weeks."""
    return (
        in_last_weeks(index, _scope(index, cfg, scope), cfg.trend_weeks)
        .groupBy("week", "region")
        .agg(
            F.sum(positive(F.col("risk_score"))).alias("overall_risk"),
            F.count_if(F.col("n_articles") > 0).alias("active_topics"),
            F.avg("topic_share").alias("mean_topic_share"),
        )
    )


def top_regions_overall(index: DataFrame, cfg: Settings, scope: DataFrame | None = None) -> DataFrame:
    return _top_regions(overall_region_risk(index, cfg, scope), cfg)


def _top_regions(overall: DataFrame, cfg: Settings) -> DataFrame:
    return (
        overall.groupBy("region")
        .agg(
            F.sum("overall_risk").alias("total_risk"),
            F.count_if(F.col("overall_risk") > 0).alias("active_weeks"),
            F.max_by("overall_risk", "week").alias("last_risk"),
        )
        .orderBy(F.desc("total_risk"), F.desc("active_weeks"), F.desc("last_risk"), "region")
        .limit(cfg.trend_regions)
    )


def weekly_benchmark(index: DataFrame, cfg: Settings, scope: DataFrame | None = None) -> DataFrame:
    return _benchmark(overall_region_risk(index, cfg, scope))


def _benchmark(overall: DataFrame) -> DataFrame:
    return overall.groupBy("week").agg(F.avg("overall_risk").alias("overall_risk"), F.avg("active_topics").alias("active_topics"))


def overall_region_trend(index: DataFrame, cfg: Settings, scope: DataFrame | None = None) -> DataFrame:
    """Weekly overall risk of the top regions, with the mean over all regions as series 'mean'.

    The sums per week and region of the trend weeks are staged, so the index is read once.
    """
    overall = stage(overall_region_risk(index, cfg, scope), "trend_overall")
    chosen = overall.join(F.broadcast(_top_regions(overall, cfg).select("region")), "region", "left_semi")
    lines = chosen.select(
        "week", F.col("region").alias("series"), "overall_risk", F.col("active_topics").cast("double").alias("active_topics")
    )
    return lines.unionByName(_benchmark(overall).withColumn("series", F.lit("mean")))


def positive_or_all(df: DataFrame, score: str) -> DataFrame:
    """Rows with a positive score; all rows if there is none."""
    any_positive = df.agg(F.coalesce(F.bool_or(F.col(score) > 0), F.lit(False))).scalar()
    return df.where((F.col(score) > 0) | ~any_positive)


def reference_map(index: DataFrame, cfg: Settings, scope: DataFrame | None = None) -> DataFrame:
    """Risk of the showcase topic per region in the reference week."""
    scope = _scope(index, cfg, scope)
    at_reference = _of_showcase(index, scope).where(F.col("week") == _reference(scope))
    return at_reference.select("region", "risk_score", "n_articles")


def month_map(index: DataFrame, cfg: Settings, scope: DataFrame | None = None) -> DataFrame:
    """Mean risk and weight of the showcase topic per region in the configured month."""
    week = F.col("week")
    return (
        _of_showcase(index, _scope(index, cfg, scope))
        .where((F.year(week) == cfg.month_year) & (F.month(week) == cfg.month))
        .groupBy("region")
        .agg(F.avg("risk_score").alias("risk_score"), F.sum("n_articles").alias("n_articles"))
    )


def region_leaders(index: DataFrame, cfg: Settings, scope: DataFrame | None = None) -> DataFrame:
    """The topic with the highest risk per region in the reference week."""
    return first_k_per_group(
        reference_pairs(index, cfg, scope), ["region"], [F.desc("risk_score"), F.asc("topic")], 1
    ).select("region", F.col("topic").alias("top_topic"), F.col("risk_score").alias("top_risk_score"))


def top_risk_map(leaders: DataFrame) -> DataFrame:
    """The highest risk of any topic per region."""
    return leaders.select("region", F.col("top_risk_score").alias("risk_score"), "top_topic")


def top_risk_legend(leaders: DataFrame, cfg: Settings) -> DataFrame:
    return top_risk_map(leaders).orderBy(F.desc("risk_score"), "region").limit(cfg.map_regions)


def leader_legend(leaders: DataFrame) -> DataFrame:
    """Regions and highest risk per leading topic, positive leaders only."""
    return (
        leaders.where(F.col("top_risk_score") > 0)
        .groupBy("top_topic")
        .agg(F.count_distinct("region").alias("regions"), F.max("top_risk_score").alias("max_risk"))
        .orderBy(F.desc("regions"), F.desc("max_risk"), "top_topic")
    )


def leader_labels(leaders: DataFrame) -> DataFrame:
    """Topic label per region for the map; a fixed label where no topic is positive."""
    return leaders.select(
        "region", F.when(F.col("top_risk_score") > 0, F.col("top_topic")).otherwise(NO_LEADER).alias("label")
    )


def ranked_legend(values: DataFrame, score: str, cfg: Settings, ties: Sequence[Column] = ()) -> DataFrame:
    """The regions listed beside a map, positive ones if there are any."""
    top = positive_or_all(values, score).orderBy(F.desc(score), *ties, "region").limit(cfg.map_regions)
    order = Window.orderBy(F.desc(score), *ties, "region")  # over `map_regions` rows
    return top.withColumn("rank", F.row_number().over(order))


def map_values(
    boundaries: DataFrame, values: DataFrame, value: str, default: object, name: str = "name"
) -> DataFrame:
    """Every boundary with the value of its region, matched on the normalised name.

    If several regions share a normalised name, the largest value counts. Both sides are tables of
    places; their sizes are left to adaptive execution.
    """
    keyed = values.groupBy(text.region_key(F.col("region")).alias("region_key")).agg(F.max(value).alias(value))
    return (
        boundaries.withColumn("region_key", text.region_key(F.col(name)))
        .join(keyed, "region_key", "left")
        .withColumn(value, F.coalesce(F.col(value), F.lit(default)))
    )


def snippet_candidates(scored: DataFrame, pairs: DataFrame) -> DataFrame:
    """Articles of the given (week, region, topic) pairs; `pairs` has at most top-n rows."""
    keys = pairs.select(
        "week", "region", F.col("topic").alias("assigned_topic"), "risk_score", "n_articles", "topic_share"
    )
    return scored.join(F.broadcast(keys), ["week", "region", "assigned_topic"]).withColumnRenamed(
        "assigned_topic", "topic"
    )


def with_snippet(df: DataFrame, column: str, cfg: Settings) -> DataFrame:
    """Adds `representative_snippet`. Each step runs once per row, whatever reads it later."""
    collapsed = with_columns_once(df, {"_text": text.collapse_whitespace(F.col(column))})
    cleaned = with_columns_once(
        collapsed, {"_cleaned": text.clean_snippet(F.col("_text"), cfg.boilerplate_patterns)}
    )
    opened = with_columns_once(cleaned, {"_sentence": text.opening(F.col("_cleaned"))})
    snippet = text.first_sentence(
        F.col("_cleaned"), F.col("_sentence"), cfg.snippet_min_chars, cfg.snippet_chars
    )
    return with_columns_once(opened, {"representative_snippet": snippet}).drop("_text", "_cleaned", "_sentence")


def representative_snippets(scored: DataFrame, pairs: DataFrame, cfg: Settings) -> DataFrame:
    """Up to three article openings per pair: most similar first, then least syndicated.

    The rank limit is applied in every task before the shuffle, so a pair with very many articles
    sends a few rows per task.
    """
    pair = ["week", "region", "topic"]
    order = [F.desc("top1_similarity"), F.asc("region_spread"), F.asc("unique_article_id")]
    snippets = with_snippet(snippet_candidates(scored, pairs), "text_clean", cfg).where(
        F.col("representative_snippet") != ""
    )
    rank = F.row_number().over(Window.partitionBy(*pair).orderBy(*order))
    return (
        snippets.drop("text_clean")
        .withColumn("snippet_rank", rank)
        .where(F.col("snippet_rank") <= cfg.snippets_per_pair)
        .select(*SNIPPET_COLUMNS)
    )
