"""Every registered query: name -> (spark, sf_dir) -> DataFrame.

Doubles are rounded to six places, so that results can be compared with another engine's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressgauge.config import NO_LEADER, RAW_COLUMNS
from pressgauge.functions import dates, math, rules, text, vectors
from pressgauge.functions.once import with_columns_once
from pressgauge.operators import (
    candidates,
    cleaning,
    encoding,
    outputs,
    panel,
    profiles,
    sampling,
    scoring,
    stories,
)
from pressgauge.plans import pipeline
from pressgauge.session import stage, staged_dir
from pressgauge.sources import readers, tables, writers
from pressgauge.sources.tables import (
    DOC_MODEL_SETTINGS,
    DOC_SAMPLE_SETTINGS,
    DOC_SETTINGS,
    DOC_TOPICS,
    ORDER_SETTINGS,
    ORDER_TOPICS,
    VECTOR_SETTINGS,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

DAY_TIME = "yyyy-MM-dd HH:mm:ss"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            (F.round(f.name, 6) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(make: Query) -> Query:
    QUERIES[make.__name__] = lambda spark, sf_dir: rounded(make(spark, sf_dir))
    return make


# --- line items: weights ----------------------------------------------------------------------

PANEL_TOPICS = [*ORDER_TOPICS, "other_econ"]
CELL = ["week", "region", "topic"]


def _weighted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with duplicate weights, staged: story sizes and scored articles both read them."""
    weighed = cleaning.with_duplicate_weight(tables.line_articles(spark, sf_dir))
    flag = F.col("l_returnflag")
    source = F.when(flag == "R", "strong_keyword").when(flag == "A", "weak_keyword").otherwise("url_section")
    return stage(weighed.where("is_candidate").withColumn("candidate_source", source), "candidates")


def _spread_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = stories.region_spread(tables.line_candidates(spark, sf_dir))
    scores = tables.order_scores(spark, sf_dir).join(spread, "story_key")
    return scores.withColumns(
        {
            "econ_confidence": F.col("top1_similarity"),
            "top_topic": F.col("assigned_topic"),
            "topic_ambiguous": F.lit(False),
        }
    )


def _weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index input: one aggregation per (story, region, week), one shuffle on the story."""
    buckets = cleaning.bucket_weights(tables.line_articles(spark, sf_dir))
    return scoring.weigh_buckets(stories.with_region_spread(buckets), tables.order_scores(spark, sf_dir))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.build_index(_weighed(spark, sf_dir), ORDER_SETTINGS, ORDER_TOPICS)


def _topic_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the configured topics, staged: the result tables read it several times."""
    return stage(outputs.topic_index(_index(spark, sf_dir), ORDER_TOPICS), "index")


@query
def dup_weight(spark, sf_dir):
    weighed = cleaning.with_duplicate_weight(tables.line_articles(spark, sf_dir))
    return weighed.select("unique_article_id", "story_key", "region", "week", "dup_weight")


@query
def group_sizes(spark, sf_dir):
    return cleaning.group_sizes(tables.line_articles(spark, sf_dir))


@query
def bucket_weights(spark, sf_dir):
    return cleaning.bucket_weights(tables.line_articles(spark, sf_dir))


@query
def region_spread(spark, sf_dir):
    return stories.region_spread(tables.line_candidates(spark, sf_dir))


@query
def score_articles(spark, sf_dir):
    scored = scoring.score_articles(
        _weighted_candidates(spark, sf_dir), _spread_scores(spark, sf_dir)
    )
    return scored.select(
        "unique_article_id", "story_key", "week", "region", "dup_weight", "region_spread", "effective_weight",
        "is_econ", "assigned_topic", "top1_similarity", rules.review_group(F.col("assigned_topic")).alias("review_group"),
    )


@query
def effective_weight(spark, sf_dir):
    return _weighed(spark, sf_dir).select("story_key", "region", "week", "region_spread", "effective_weight")


# --- line items: panel ------------------------------------------------------------------------


@query
def econ_totals(spark, sf_dir):
    return panel.econ_totals(_weighed(spark, sf_dir))


@query
def topic_cells(spark, sf_dir):
    return panel.topic_cells(_weighed(spark, sf_dir))


@query
def dense_panel(spark, sf_dir):
    return panel.dense_panel(_weighed(spark, sf_dir), PANEL_TOPICS)


@query
def topic_prior(spark, sf_dir):
    return panel.topic_prior(panel.dense_panel(_weighed(spark, sf_dir), PANEL_TOPICS), PANEL_TOPICS)


@query
def topic_prior_per_region_week(spark, sf_dir):
    dense = panel.dense_panel(_weighed(spark, sf_dir), PANEL_TOPICS)
    return panel.topic_prior(dense, PANEL_TOPICS, "per_region_week")


@query
def posterior_share(spark, sf_dir):
    shares = panel.posterior_panel(_weighed(spark, sf_dir), PANEL_TOPICS, ORDER_SETTINGS)
    return shares.select(*CELL, "topic_prior", "p_post")


def _baselines(spark, sf_dir):
    shares = panel.posterior_panel(_weighed(spark, sf_dir), PANEL_TOPICS, ORDER_SETTINGS)
    return panel.with_baselines(shares, ORDER_SETTINGS)


@query
def baseline_share(spark, sf_dir):
    return _baselines(spark, sf_dir).select(*CELL, "baseline_share")


@query
def recent_share(spark, sf_dir):
    return _baselines(spark, sf_dir).select(*CELL, "recent_share")


@query
def surprise_momentum(spark, sf_dir):
    return panel.with_surprise(_baselines(spark, sf_dir)).select(*CELL, "surprise", "momentum")


@query
def persistence_weeks(spark, sf_dir):
    return panel.with_persistence(panel.with_surprise(_baselines(spark, sf_dir))).select(*CELL, "persistence_weeks")


@query
def topic_zscores(spark, sf_dir):
    full = panel.full_panel(_weighed(spark, sf_dir), PANEL_TOPICS, ORDER_SETTINGS)
    return full.select(*CELL, "surprise_z", "momentum_z", "mean_similarity_z")


@query
def support(spark, sf_dir):
    totals = panel.econ_totals(_weighed(spark, sf_dir))
    return totals.withColumn("support", math.support(F.col("total_econ_weight"), ORDER_SETTINGS.support_k))


@query
def risk_index(spark, sf_dir):
    return _index(spark, sf_dir)


@query
def top_risk_rows(spark, sf_dir):
    return outputs.top_panel_rows(_index(spark, sf_dir), 20)


# --- line items: result tables ----------------------------------------------------------------


def _result(name: str, make: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """A result table of the index and the report's scope, both staged once."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = _topic_index(spark, sf_dir)
        return rounded(make(index, stage(outputs.report_scope(index, ORDER_SETTINGS), "scope")))

    QUERIES[name] = run


def _with_settings(make):
    return lambda index, scope: make(index, ORDER_SETTINGS, scope=scope)


def _weeks(n):
    return lambda index, scope: outputs.last_active_weeks(index, ORDER_SETTINGS, n, scope)


def _leaders(make):
    return lambda index, scope: make(outputs.region_leaders(index, ORDER_SETTINGS, scope))


_result("reference_week", lambda index, scope: scope.select("reference_week"))
_result("recent_active_weeks", _weeks(ORDER_SETTINGS.recent_weeks))
_result("trend_active_weeks", _weeks(ORDER_SETTINGS.trend_weeks))
for _make in (
    outputs.latest_pairs, outputs.rolling_pairs, outputs.hot_pairs, outputs.topic_ranking, outputs.showcase_topic,
    outputs.trend_regions, outputs.topic_trend, outputs.overall_region_risk, outputs.top_regions_overall,
    outputs.weekly_benchmark, outputs.overall_region_trend, outputs.reference_map, outputs.region_leaders,
):
    _result(_make.__name__, _with_settings(_make))
_result("month_average", _with_settings(outputs.month_map))
_result("leader_legend", _leaders(outputs.leader_legend))
_result("leader_labels", _leaders(outputs.leader_labels))
_result("top_risk_map", _leaders(outputs.top_risk_map))
_result("top_risk_legend", _leaders(partial(outputs.top_risk_legend, cfg=ORDER_SETTINGS)))
_result(
    "reference_map_legend",
    lambda i, s: outputs.ranked_legend(outputs.reference_map(i, ORDER_SETTINGS, s), "risk_score", ORDER_SETTINGS),
)
_result(
    "month_map_legend",
    lambda i, s: outputs.ranked_legend(
        outputs.month_map(i, ORDER_SETTINGS, s), "risk_score", ORDER_SETTINGS, [F.desc("n_articles")]
    ),
)


def _places(name: str, make: Callable[[DataFrame, DataFrame], DataFrame], value: str, default: object) -> None:
    """Nations as places, with the value of each on a map."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = _topic_index(spark, sf_dir)
        scope = stage(outputs.report_scope(index, ORDER_SETTINGS), "scope")
        nations = tables.load(spark, sf_dir, "nation").select(F.initcap("n_name").alias("name"))
        return rounded(outputs.map_values(nations, make(index, scope), value, default))

    QUERIES[name] = run


_places("reference_map_places", _with_settings(outputs.reference_map), "risk_score", 0.0)
_places("month_map_places", _with_settings(outputs.month_map), "risk_score", 0.0)
_places("top_risk_map_places", _leaders(outputs.top_risk_map), "risk_score", 0.0)
_places("leader_label_places", _leaders(outputs.leader_labels), "label", NO_LEADER)


@query
def scoring_profile(spark, sf_dir):
    weighed = stage(_weighed(spark, sf_dir), "weighed")
    index = panel.build_index(weighed, ORDER_SETTINGS, ORDER_TOPICS)
    return profiles.scoring_profile(weighed, index, ORDER_TOPICS)


@query
def topic_value_counts(spark, sf_dir):
    return profiles.value_counts(_weighed(spark, sf_dir).where("is_econ"), "assigned_topic")


@query
def story_score_summary(spark, sf_dir):
    return profiles.story_score_summary(tables.order_scores(spark, sf_dir))


# --- line items: stories ----------------------------------------------------------------------


@query
def story_buckets(spark, sf_dir):
    return stories.story_buckets(tables.line_candidates(spark, sf_dir))


@query
def primary_bucket(spark, sf_dir):
    buckets = stories.story_buckets(tables.line_candidates(spark, sf_dir))
    return stories.primary_buckets(buckets, ORDER_SETTINGS.random_state)


@query
def story_first_row(spark, sf_dir):
    return stories.first_rows(tables.line_candidates(spark, sf_dir), ["unique_article_id", "candidate_source"])


@query
def story_flags(spark, sf_dir):
    return stories.story_flags(tables.line_candidates(spark, sf_dir))


@query
def story_meta(spark, sf_dir):
    return stories.story_meta(tables.line_candidates(spark, sf_dir), ORDER_SETTINGS)


SAMPLE_SETTINGS = ORDER_SETTINGS.with_(run_mode="dev", embedding_story_cap=6000)


@query
def tier_targets(spark, sf_dir):
    meta = stories.story_meta(tables.line_candidates(spark, sf_dir), SAMPLE_SETTINGS)
    return sampling.tier_targets(meta, SAMPLE_SETTINGS.embedding_story_cap, SAMPLE_SETTINGS.embedding_strong_share)


@query
def quota_allocation(spark, sf_dir):
    meta = stage(stories.story_meta(tables.line_candidates(spark, sf_dir), SAMPLE_SETTINGS), "stories")
    targets = sampling.tier_targets(
        meta, SAMPLE_SETTINGS.embedding_story_cap, SAMPLE_SETTINGS.embedding_strong_share
    )
    return sampling.quota_allocation(meta, targets)


@query
def story_sample(spark, sf_dir):
    meta = stories.story_meta(tables.line_candidates(spark, sf_dir), SAMPLE_SETTINGS)
    chosen = sampling.sample_stories(meta, SAMPLE_SETTINGS)
    return chosen.select("story_key", "sampling_tier", "region", "week")


@query
def story_numbers(spark, sf_dir):
    buckets = stories.story_buckets(tables.line_candidates(spark, sf_dir))
    primary = stories.primary_buckets(buckets, ORDER_SETTINGS.random_state)
    return stories.number_stories(primary).select("story_key", "embedding_row")


@query
def review_sample(spark, sf_dir):
    scored = scoring.score_articles(
        _weighted_candidates(spark, sf_dir), _spread_scores(spark, sf_dir), ["candidate_source"]
    ).select(
        rules.review_group(F.col("assigned_topic")).alias("review_group"),
        "unique_article_id", "week", "region", "candidate_source", "assigned_topic",
    )
    return sampling.sample_per_stratum(stage(scored, "scored"), "review_group", "unique_article_id", 20, 42)


@query
def rebuilt_lookup(spark, sf_dir):
    """Spread looked up for a story table that also has stories without candidates."""
    orders = tables.load(spark, sf_dir, "orders")
    old = orders.select(
        F.col("o_orderkey").alias("story_key"),
        F.col("o_orderkey").alias("embedding_row"),
        F.col("o_orderpriority").alias("text_for_embedding"),
        F.col("o_orderstatus").alias("region"),
        dates.week_start(F.col("o_orderdate")).alias("week"),
        F.lit("dev").alias("run_mode"),
    )
    return stories.rebuild_lookup(old, tables.line_candidates(spark, sf_dir))


# --- documents: cleaning ----------------------------------------------------------------------


def _digest(column: str):
    return F.md5(F.col(column))


def _documents(spark, sf_dir):
    return cleaning.keep_articles(tables.raw_documents(spark, sf_dir), DOC_SETTINGS)


def _cleaned(spark, sf_dir):
    """Cleaned documents, staged once before their groups are counted."""
    return cleaning.with_duplicate_weight(stage(_documents(spark, sf_dir), "kept"))


@query
def clean_text(spark, sf_dir):
    docs = tables.load(spark, sf_dir, "documents")
    cleaned = docs.withColumn("text_clean", text.clean_text(F.col("text")))
    return cleaned.select("doc_id", _digest("text_clean").alias("digest"), F.length("text_clean").alias("text_len"))


@query
def clean_page_text(spark, sf_dir):
    pages = tables.load(spark, sf_dir, "pages").withColumn("text_clean", text.clean_text(F.col("html")))
    return pages.select("page_id", _digest("text_clean").alias("digest"), F.length("text_clean").alias("text_len"))


@query
def text_prefix(spark, sf_dir):
    docs = tables.load(spark, sf_dir, "documents")
    cut = text.prefix(text.clean_text(F.col("text")), 1200)
    return docs.select("doc_id", cut.alias("text_for_embedding"))


@query
def region_coalesce(spark, sf_dir):
    raw = tables.raw_documents(spark, sf_dir)
    return raw.select("unique_article_id", cleaning.region_name(F.col("main_LAD"), F.col("LAD")).alias("region"))


@query
def story_key(spark, sf_dir):
    raw = tables.raw_documents(spark, sf_dir)
    key = cleaning.story_key(F.col("duplicate_group"), F.col("article_id"), F.col("unique_article_id"))
    return raw.select("unique_article_id", key.alias("story_key"))


@query
def multi_date_min(spark, sf_dir):
    """Events of a user and day listed in one value; the smallest part wins."""
    events = tables.load(spark, sf_dir, "events")
    stamp = F.date_format("ts", DAY_TIME)
    shifted = F.date_format(F.col("ts") - F.expr("interval 3 days"), DAY_TIME)
    many = F.when(
        F.col("event_id") % 3 == 0, F.concat(F.lit("\u00a0"), stamp, F.lit("\t;\n"), shifted, F.lit("\u2003;"))
    ).otherwise(F.concat(stamp, F.lit("\t")))
    listed = events.select("event_id", many.alias("tweet_date"))
    parsed = dates.parse_timestamp(
        F.when(dates.is_multi_value(F.col("tweet_date")), dates.first_of_many(F.col("tweet_date"))).otherwise(
            F.col("tweet_date")
        )
    )
    return listed.select(
        "event_id",
        dates.is_multi_value(F.col("tweet_date")).alias("has_multi_tweet"),
        F.date_format(parsed, DAY_TIME).alias("parsed"),
    )


@query
def primary_date(spark, sf_dir):
    dated = cleaning.with_dates(tables.raw_documents(spark, sf_dir), DOC_SETTINGS)
    return dated.select(
        "unique_article_id", F.date_format("date", DAY_TIME).alias("date"), "date_source", "has_multi_tweet"
    )


@query
def week_start(spark, sf_dir):
    orders = tables.load(spark, sf_dir, "orders")
    return orders.select("o_orderkey", dates.week_start(F.col("o_orderdate")).alias("week"))


@query
def keep_filter(spark, sf_dir):
    kept = _documents(spark, sf_dir)
    return kept.select("unique_article_id", "story_key", "region", "week", "text_len", "date_source")


@query
def cleaned_articles(spark, sf_dir):
    return _cleaned(spark, sf_dir).select(
        "unique_article_id", "story_key", "region", "week", "text_len", "has_multi_tweet", "dup_weight",
        F.date_format("date", DAY_TIME).alias("date"), _digest("text_for_embedding").alias("digest"),
    )


@query
def cleaning_counters(spark, sf_dir):
    counters = cleaning.cleaning_counters(tables.raw_documents(spark, sf_dir), DOC_SETTINGS)
    return _dated(counters, "clean_date_min", "clean_date_max")


def _dated(df, *names):
    return df.withColumns({name: F.date_format(name, DAY_TIME) for name in names})


@query
def missing_share(spark, sf_dir):
    return cleaning.missing_share(tables.raw_documents(spark, sf_dir))


@query
def top_region_counts(spark, sf_dir):
    return cleaning.top_regions(_documents(spark, sf_dir), DOC_SETTINGS.top_region_rows)


@query
def example_rows(spark, sf_dir):
    return _dated(cleaning.example_rows(_documents(spark, sf_dir), DOC_SETTINGS), "date")


@query
def cleaning_report(spark, sf_dir):
    raw = tables.raw_documents(spark, sf_dir)
    kept, counted = cleaning.clean_and_count(raw, DOC_SETTINGS)
    report = cleaning.cleaning_report(counted, raw.columns, kept, DOC_SETTINGS)
    return report.select(
        "run_parameters.text_min_length",
        "summary.rows_seen",
        "summary.rows_kept",
        "summary.duplicate_story_groups",
        F.col("missing_share.resolved_url").alias("missing_url_share"),
        F.col("top_regions")[0]["region"].alias("top_region"),
        F.col("top_regions")[0]["rows"].alias("top_region_rows"),
        F.col("examples")[0]["unique_article_id"].alias("first_example"),
    )


@query
def region_value_counts(spark, sf_dir):
    return profiles.value_counts(_documents(spark, sf_dir), "region")


@query
def text_length_profile(spark, sf_dir):
    return profiles.describe_lengths(_documents(spark, sf_dir), "text_len")


@query
def parse_mixed_dates(spark, sf_dir):
    """Order dates written in many ways, some unreadable."""
    orders = tables.load(spark, sf_dir, "orders")
    kind = F.col("o_orderkey") % 14
    day = F.col("o_orderdate")
    written = (
        F.when(kind == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(kind == 1, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .when(kind == 2, F.date_format(day, "yyyy/MM/dd"))
        .when(kind == 3, F.date_format(day, "yyyyMMdd"))
        .when(kind == 4, F.date_format(day, "'on' dd MMM"))
        .when(kind == 6, F.date_format(day, "EEE MMM dd '20:19:24 +0000' yyyy"))
        .when(kind == 7, F.date_format(day, "'\t'd MMMM yyyy'\u00a0\n'"))
        .when(kind == 8, F.date_format(day, "MMM d, yyyy"))
        .when(kind == 9, F.date_format(day, "MM/dd/yyyy' 10:00'"))
        .when(kind == 10, F.date_format(day, "dd/MM/yyyy"))
        .when(kind == 11, F.date_format(day, "EEEE, d MMM yyyy' 10:00:00 +01:00'"))
        .when(kind == 12, F.date_format(day, "MMM d yyyy' 3:00 PM'"))
        .when(kind == 13, F.date_format(day, "yyyy-M-d"))
    )
    return orders.select("o_orderkey", F.date_format(dates.parse_timestamp(written), DAY_TIME).alias("parsed"))


# --- documents: candidates --------------------------------------------------------------------


def _flagged(spark, sf_dir):
    return candidates.flag_candidates(_documents(spark, sf_dir), DOC_SETTINGS)


def _candidates(spark, sf_dir):
    return _flagged(spark, sf_dir).where("is_candidate")


@query
def keyword_flags(spark, sf_dir):
    return _flagged(spark, sf_dir).select(
        "unique_article_id", "strong_keyword_hit", "weak_keyword_hit", "url_section_hit", "is_candidate"
    )


@query
def candidate_source(spark, sf_dir):
    return _candidates(spark, sf_dir).select("unique_article_id", "candidate_source")


@query
def candidate_summary(spark, sf_dir):
    return candidates.candidate_summary(_flagged(spark, sf_dir))


@query
def stratified_review_sample(spark, sf_dir):
    staged = stage(_candidates(spark, sf_dir), "candidates")
    sample = candidates.candidate_review_sample(staged, DOC_SETTINGS)
    return _dated(sample, "date").withColumn("text_clean", _digest("text_clean"))


@query
def candidate_profile(spark, sf_dir):
    return profiles.candidate_profile(_candidates(spark, sf_dir))


@query
def source_value_counts(spark, sf_dir):
    return profiles.value_counts(_candidates(spark, sf_dir), "candidate_source")


@query
def url_keywords(spark, sf_dir):
    pages = tables.load(spark, sf_dir, "pages")
    return pages.select("page_id", text.has_keyword(F.col("url"), DOC_SETTINGS.url_terms).alias("url_section_hit"))


# --- documents: stories, snippets -------------------------------------------------------------


@query
def sampled_story_texts(spark, sf_dir):
    rows = stage(_candidates(spark, sf_dir), "candidates")
    chosen = sampling.sample_stories(stories.story_meta(rows, DOC_SAMPLE_SETTINGS), DOC_SAMPLE_SETTINGS)
    built = stories.build_stories(rows, stage(chosen, "sample"), DOC_SAMPLE_SETTINGS)
    return built.select(
        "story_key", "region", "week", "region_spread", "run_mode", "sampling_tier",
        _digest("text_for_embedding").alias("digest"),
    )


@query
def snippet_clean(spark, sf_dir):
    docs = tables.load(spark, sf_dir, "documents")
    collapsed = with_columns_once(docs, {"_text": text.collapse_whitespace(F.col("text"))})
    cleaned = with_columns_once(
        collapsed, {"_cleaned": text.clean_snippet(F.col("_text"), DOC_SETTINGS.boilerplate_patterns)}
    )
    return cleaned.select("doc_id", _digest("_cleaned").alias("digest"), F.length("_cleaned").alias("chars"))


@query
def first_sentence(spark, sf_dir):
    docs = tables.load(spark, sf_dir, "documents").select("doc_id", "text")
    return outputs.with_snippet(docs, "text", DOC_SETTINGS).drop("text")


@query
def region_name_key(spark, sf_dir):
    places = tables.supplier_boundaries(spark, sf_dir)
    return places.select("s_suppkey", text.region_key(F.col("name")).alias("region_key"))


def _scored_documents(spark, sf_dir):
    flagged = candidates.flag_candidates(_cleaned(spark, sf_dir), DOC_SETTINGS)
    rows = stage(flagged.where("is_candidate"), "candidates")
    scores = tables.document_scores(stories.story_meta(rows, DOC_SETTINGS), stories.first_rows(rows, ["LAD"]))
    return stage(scoring.score_articles(rows, scores), "scored")


@query
def document_index(spark, sf_dir):
    return panel.build_index(_scored_documents(spark, sf_dir), DOC_SETTINGS, DOC_TOPICS)


@query
def representative_snippets(spark, sf_dir):
    scored = _scored_documents(spark, sf_dir)
    index = stage(outputs.topic_index(panel.build_index(scored, DOC_SETTINGS, DOC_TOPICS), DOC_TOPICS), "index")
    return outputs.representative_snippets(scored, outputs.latest_pairs(index, DOC_SETTINGS), DOC_SETTINGS)


# --- places -----------------------------------------------------------------------------------


@query
def outer_rings(spark, sf_dir):
    rings = readers.outer_rings(tables.supplier_boundaries(spark, sf_dir))
    return rings.select(
        "s_suppkey", "ring_index", F.size("ring").alias("points"), F.col("ring")[1][0].alias("second_x")
    )


@query
def boundary_join(spark, sf_dir):
    return outputs.map_values(tables.customer_places(spark, sf_dir), tables.supplier_values(spark, sf_dir), "risk_score", 0.0)


# --- vectors ----------------------------------------------------------------------------------


def _similar(spark, sf_dir):
    return scoring.similarities(tables.vector_stories(spark, sf_dir), tables.vector_references(spark, sf_dir))


def _best(spark, sf_dir):
    refs = tables.vector_references(spark, sf_dir)
    return scoring.best_topics(scoring.similarities(tables.vector_stories(spark, sf_dir), refs), refs.topic_names)


def _scores(spark, sf_dir):
    return scoring.score_stories(
        tables.vector_stories(spark, sf_dir), tables.vector_references(spark, sf_dir), VECTOR_SETTINGS
    )


@query
def vector_dot(spark, sf_dir):
    refs = tables.vector_references(spark, sf_dir)
    dots = vectors.dot_products(F.col("embedding"), refs.all_vectors)
    stories_ = tables.vector_stories(spark, sf_dir)
    return stories_.select("story_key", F.posexplode(dots).alias("reference", "similarity"))


@query
def anchor_max(spark, sf_dir):
    scored = _similar(spark, sf_dir).withColumn("econ_margin", F.col("pos_max") - F.col("neg_max"))
    return scored.select("story_key", "pos_max", "neg_max", "econ_margin")


@query
def topic_argmax_top2(spark, sf_dir):
    return _best(spark, sf_dir).select("story_key", "top_topic", "top1_similarity", "top2_similarity")


@query
def econ_gate(spark, sf_dir):
    flagged = _similar(spark, sf_dir).withColumn("strong", F.coalesce("strong_keyword_hit", F.lit(False)))
    gate = rules.passes_gate(F.col("pos_max"), F.col("neg_max"), F.col("strong"), VECTOR_SETTINGS)
    return flagged.select("story_key", gate.alias("is_econ"))


@query
def assigned_topic(spark, sf_dir):
    return _scores(spark, sf_dir).select("story_key", "is_econ", "assigned_topic", "topic_ambiguous")


@query
def story_scores(spark, sf_dir):
    return _scores(spark, sf_dir)


@query
def review_group(spark, sf_dir):
    scored = _scores(spark, sf_dir).withColumn("review_group", rules.review_group(F.col("assigned_topic")))
    return scored.groupBy("review_group").agg(F.count("*").alias("rows"))


@query
def l2_normalize(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    rows = tables.load(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_normalize(scaled).alias("unit"))
    return rows.select("vec_id", F.posexplode("unit").alias("position", "value"))


@query
def vector_profile(spark, sf_dir):
    return profiles.vector_profile(tables.vector_stories(spark, sf_dir))


@query
def vector_parity(spark, sf_dir):
    """Document numbers against vector numbers: what one side lacks."""
    docs = tables.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("story_key"))
    vecs = tables.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("story_key"))
    return readers.check_vector_parity(docs, vecs)


@query
def topic_profile_text(spark, sf_dir):
    """Profile texts of the part types: their brands as keywords, their sizes as examples."""
    parts = tables.load(spark, sf_dir, "part")
    rows = parts.groupBy("p_type").agg(
        F.sort_array(F.collect_set("p_brand")).alias("keywords"),
        F.sort_array(F.collect_set(F.concat(F.lit("Size "), F.col("p_size").cast("string"), F.lit(".")))).alias("examples"),
    )
    profile = text.topic_text(
        F.col("p_type"), F.concat(F.lit("Parts of type "), F.col("p_type")), F.col("keywords"), F.col("examples")
    )
    return rows.select("p_type", profile.alias("profile_text"))


@query
def embed_text(spark, sf_dir):
    docs = tables.load(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encoding.sparse_hashing_encoder(512)(docs, "text", "embedding")
    cells = F.arrays_zip(F.col("embedding.positions").alias("position"), F.col("embedding.values").alias("value"))
    return encoded.select("doc_id", F.inline(cells)).toDF("doc_id", "position", "value")


def _model_scored(spark, sf_dir):
    """Candidate documents and the scores of their stories, vectors included."""
    rows = stage(candidates.filter_candidates(_cleaned(spark, sf_dir), DOC_MODEL_SETTINGS), "candidates")
    return rows, pipeline.score_candidates(rows, encoding.sparse_hashing_encoder(512), DOC_MODEL_SETTINGS)


@query
def end_to_end_scores(spark, sf_dir):
    _, scores = _model_scored(spark, sf_dir)
    return scores.drop("candidate_source")


@query
def end_to_end_pairs(spark, sf_dir):
    """Raw documents to hot pairs, vectors included."""
    rows, scores = _model_scored(spark, sf_dir)
    index = stage(pipeline.index_of(rows, scores, DOC_MODEL_SETTINGS), "index")
    return outputs.hot_pairs(outputs.topic_index(index, DOC_MODEL_SETTINGS.topic_names), DOC_MODEL_SETTINGS)


@query
def stage_losses(spark, sf_dir):
    """What the way from candidates to scored articles loses: nothing."""
    rows, scores = _model_scored(spark, sf_dir)
    return pipeline.stage_losses(rows, scores, scoring.score_articles(rows, scores))


# --- round trips ------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{staged_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def csv_round_trip(spark, sf_dir):
    """Raw articles with quotes, line breaks and null tokens through a delimited file."""
    raw = tables.raw_documents(spark, sf_dir).withColumn("article_author", F.lit('says "x, y"\nand more'))
    path = _folder(spark, "raw_csv")
    writers.write_csv(raw.select(*RAW_COLUMNS), path)
    back = readers.read_raw_csv(spark, path)
    return back.select("unique_article_id", "article_author", "duplicate_group", "LAD", F.length("article_text").alias("chars"))


@query
def limited_rows(spark, sf_dir):
    """The first raw rows of a delimited file, in the order of their numbers."""
    path = _folder(spark, "raw_csv")
    writers.write_csv(tables.raw_documents(spark, sf_dir).select(*RAW_COLUMNS), path)
    first = readers.read_raw_csv(spark, path, limit=40, order=["unique_article_id"])
    return first.select("unique_article_id", "LAD", F.length("article_text").alias("chars"))


RESULT_SCHEMA = "o_orderkey long, day date, price double, urgent boolean, note string, nothing string"


@query
def result_read_back(spark, sf_dir):
    """A result table through a delimited file and back with its types."""
    orders = tables.load(spark, sf_dir, "orders")
    made = orders.select(
        "o_orderkey", F.to_date("o_orderdate").alias("day"), F.round("o_totalprice", 2).alias("price"),
        F.startswith("o_orderpriority", F.lit("1")).alias("urgent"),
        F.concat(F.lit(' "'), F.col("o_orderpriority"), F.lit('",\n'), F.col("o_orderstatus"), F.lit("\\ ")).alias("note"),
        F.lit(None).cast("string").alias("nothing"),
    )
    path = _folder(spark, "result_csv")
    writers.write_csv(made, path)
    return readers.read_result_csv(spark, path, RESULT_SCHEMA)


@query
def vector_round_trip(spark, sf_dir):
    """Vectors stored by key, read back and attached to their rows; both sides must hold the same keys."""
    vecs = tables.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("story_key"), "embedding", "label")
    path = _folder(spark, "vectors")
    writers.write_table(vecs.select("story_key", "embedding"), path)
    back = readers.attach_vectors(vecs.drop("embedding"), readers.read_table(spark, path))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select(
        "story_key", "label", F.size("embedding").alias("components"), total.alias("total"),
        F.get("embedding", 0).cast("double").alias("first"),
    )


@query
def stage_guards(spark, sf_dir):
    """Which stages the guard stops: those without rows."""
    orders = tables.load(spark, sf_dir, "orders")
    stages = {
        "orders": orders, "orders without a price": orders.where("o_totalprice < 0"), "urgent orders": orders.where("o_orderpriority = '1-URGENT'"),
        "orders of no customer": orders.join(tables.load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
    }

    def stopped(rows) -> bool:
        try:
            readers.require_rows(rows, "no rows")
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(name, stopped(rows)) for name, rows in stages.items()], "stage string, stopped boolean")


@query
def parquet_round_trip(spark, sf_dir):
    path = _folder(spark, "table")
    writers.write_table(tables.load(spark, sf_dir, "orders"), path, ["o_orderstatus"])
    return readers.read_table(spark, path, ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query
def json_round_trip(spark, sf_dir):
    path = _folder(spark, "json")
    parts = tables.load(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 10, F.col("p_size").cast("string")).alias("size"))
    writers.write_json(parts, path)
    return spark.read.schema(parts.schema).json(path)


def write_boundaries(places, path):
    """Every place as a feature collection on a line of its own; a missing geometry is null."""
    shape = F.concat(F.lit('{"type":"'), F.col("geometry_type"), F.lit('","coordinates":'), F.col("coordinates"), F.lit("}"))
    places.select(
        F.concat(
            F.lit('{"features":[{"type":"Feature","properties":{"LAD23NM":"'), F.trim("name"), F.lit('"},"geometry":'),
            F.coalesce(shape, F.lit("null")), F.lit("}]}"),
        ).alias("value")
    ).write.text(path)


@query
def geojson_round_trip(spark, sf_dir):
    """Boundaries as a feature collection per line, in as many files as tasks, read back as rings."""
    path = _folder(spark, "geojson")
    write_boundaries(tables.supplier_boundaries(spark, sf_dir), path)
    rings = readers.outer_rings(readers.read_boundaries(spark, path, lines=True))
    return rings.select(text.region_key(F.col("name")).alias("region_key"), "ring_index", F.size("ring").alias("points"))


@query
def ordered_preview(spark, sf_dir):
    """The first rows in a stated order."""
    return readers.preview(spark, f"{sf_dir}/orders.parquet", ["o_totalprice", "o_orderkey"], ["o_orderkey", "o_totalprice"], 25)
