"""Keyword and URL rules that choose the articles worth scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.config import CANDIDATE_SOURCES, Settings
from pressgauge.functions import text
from pressgauge.functions.once import with_columns_once
from pressgauge.operators.sampling import sample_per_stratum
from pressgauge.session import observed

# Columns of the review sample.
REVIEW_COLUMNS = [
    "candidate_source",
    "unique_article_id",
    "date",
    "week",
    "region",
    "resolved_url",
    "strong_keyword_hit",
    "weak_keyword_hit",
    "url_section_hit",
    "text_clean",
]


def flag_candidates(articles: DataFrame, cfg: Settings) -> DataFrame:
    lists = cfg.strong_keywords, cfg.weak_keywords
    found = with_columns_once(
        articles,
        {
            "_found": text.keywords_found(F.col("text_clean"), *lists),
            "url_section_hit": text.has_keyword(F.col("resolved_url"), cfg.url_terms),
        },
    )
    hits = {name: text.any_found(F.col("_found"), terms, *lists) for name, terms in zip(("strong_keyword_hit", "weak_keyword_hit"), lists)}
    flagged = found.select(
        *articles.columns, *[hit.alias(name) for name, hit in hits.items()], "url_section_hit"
    )
    strong, weak, url = (F.col(f"{n}_hit") for n in ("strong_keyword", "weak_keyword", "url_section"))
    return flagged.withColumns(
        {"is_candidate": strong | weak | url, "candidate_source": text.candidate_source(strong, weak, url)}
    )


def filter_candidates(articles: DataFrame, cfg: Settings) -> DataFrame:
    """Flagged articles with at least one hit: a narrow pass, no shuffle."""
    return flag_candidates(articles, cfg).where(F.col("is_candidate"))


def _summary_counts() -> dict[str, Column]:
    source = F.col("candidate_source")
    return {"total_cleaned_rows": F.count("*"), "candidate_rows": F.count_if("is_candidate")} | {
        f"candidate_source__{name}": F.count_if(source == name) for name in CANDIDATE_SOURCES
    }


def _with_story_count(counted: DataFrame, candidates: DataFrame) -> DataFrame:
    """The summary, from its counts and the candidates' story keys."""
    sources = [c for c in counted.columns if c.startswith("candidate_source__")]
    told = candidates.agg(F.count_distinct("story_key")).scalar().alias("unique_candidate_story_keys")
    return counted.select("total_cleaned_rows", "candidate_rows", told, *sources)


def candidate_summary(flagged: DataFrame) -> DataFrame:
    """One row: all rows, candidate rows, distinct candidate stories, rows per source."""
    counts = {name: column.alias(name) for name, column in _summary_counts().items()}
    told = F.count_distinct(F.when(F.col("is_candidate"), F.col("story_key"))).alias("unique_candidate_story_keys")
    sources = [column for name, column in counts.items() if name.startswith("candidate_source__")]
    return flagged.agg(counts["total_cleaned_rows"], counts["candidate_rows"], told, *sources)


def filter_and_count(articles: DataFrame, cfg: Settings, write: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The candidates as `write` stores them, and the summary. One pass over the texts flags, filters and counts."""
    flagged, counted = observed(flag_candidates(articles, cfg), _summary_counts())
    rows = write(flagged.where(F.col("is_candidate")))
    return rows, _with_story_count(counted(), rows)


def candidate_review_sample(candidates: DataFrame, cfg: Settings) -> DataFrame:
    return sample_per_stratum(
        candidates.select(*REVIEW_COLUMNS),
        "candidate_source",
        "unique_article_id",
        cfg.review_sample_per_stratum,
        cfg.random_state,
    )
