"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare

SF = "/root/testdata/sf0.001"
FAST = [
    "dup_weight", "score_articles", "risk_index", "hot_pairs", "topic_trend", "overall_region_trend", "story_meta",
    "story_sample", "cleaned_articles", "cleaning_counters", "keyword_flags", "representative_snippets",
    "story_scores", "boundary_join", "text_length_profile", "rebuilt_lookup", "parse_mixed_dates", "stage_losses",
    "end_to_end_pairs", "top_risk_map_places", "csv_round_trip",
]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, con, name):
    verdict, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    assert entry.entry(spark).count() > 0
