import datetime as dt

import pytest
from pyspark.sql import functions as F

from pressgauge.config import Settings
from pressgauge.operators import outputs
from pressgauge.session import stage

CFG = Settings(hot_pairs_top_n=3, trend_regions=2, map_regions=2)
SCHEMA = (
    "week date, region string, topic string, n_articles double, total_econ_weight double, topic_share double, "
    "mean_similarity double, baseline_share double, surprise double, momentum double, persistence_weeks int, risk_score double"
)


def cell(week, region, topic, n, risk):
    return (dt.date.fromisoformat(week), region, topic, n, 10.0, n / 10, 0.5, 0.1, 0.1, 0.1, 1, risk)


W = ["2022-11-28", "2022-12-05", "2022-12-12", "2022-12-19", "2022-12-26", "2023-01-02"]
CELLS = [
    cell(W[5], "A", "x", 1.0, 9.0),  # later year, not preferred
    cell(W[4], "A", "x", 2.0, 1.0),
    cell(W[4], "B", "x", 2.0, 1.0),
    cell(W[4], "C", "x", 1.0, -1.0),
    cell(W[4], "A", "y", 1.0, 0.5),
    cell(W[4], "D", "y", 0.0, 5.0),  # empty cell
    cell(W[3], "A", "x", 1.0, 2.0),
    cell(W[2], "A", "x", 1.0, 0.0),
    cell(W[1], "B", "x", 1.0, -3.0),
    cell(W[0], "B", "x", 4.0, 8.0),
]


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame(CELLS, SCHEMA).cache()


def column(df, name):
    return [r[name] for r in df.collect()]


def test_reference_week_prefers_years(index):
    week = lambda df: outputs.reference_week(df, CFG).first().reference_week.isoformat()
    assert week(index) == W[4]
    assert week(index.where(F.year("week") == 2023)) == W[5]


def test_recent_weeks(index):
    assert [w.isoformat() for w in column(outputs.last_active_weeks(index, CFG, 3), "week")] == [W[4], W[3], W[2]]


def test_latest_pairs_order_and_cut(index):
    got = [(r.region, r.topic) for r in outputs.latest_pairs(index, CFG).collect()]
    assert got == [("A", "x"), ("B", "x"), ("A", "y")]


def test_rolling_pairs(index):
    got = {(r.region, r.topic): r for r in outputs.rolling_pairs(index, CFG).collect()}
    assert got["A", "x"].n_articles == 4.0 and got["A", "x"].risk_score == 1.0
    assert got["A", "x"].week.isoformat() == W[4] and got["A", "x"].window == "recent_active_weeks"
    assert set(got) == {("A", "x"), ("A", "y"), ("B", "x")}


def test_hot_pairs_is_a_union(index):
    assert column(outputs.hot_pairs(index, CFG), "window").count("reference_week") == 3


def test_showcase_and_trend_regions(index):
    assert outputs.showcase_topic(index, CFG).first().topic == "x"
    assert column(outputs.trend_regions(index, CFG), "region") == ["B", "A"]


def test_trend_has_a_mean_series(index):
    series = set(column(outputs.topic_trend(index, CFG), "series"))
    assert series == {"A", "B", "mean"}


def test_overall_regions(index):
    got = outputs.top_regions_overall(index, CFG).collect()
    # empty cells count here
    assert [(r.region, r.total_risk, r.last_risk) for r in got] == [("B", 9.0, 1.0), ("D", 5.0, 5.0)]


def test_leaders_and_legend(index):
    leaders = outputs.region_leaders(index, CFG)
    assert {r.region: r.top_topic for r in leaders.collect()} == {"A": "x", "B": "x", "C": "x"}
    assert [(r.top_topic, r.regions, r.max_risk) for r in outputs.leader_legend(leaders).collect()] == [("x", 2, 1.0)]
    assert {r.region: r.label for r in outputs.leader_labels(leaders).collect()}["C"] == "No positive topic signal"


def test_positive_or_all(index):
    assert outputs.positive_or_all(index, "risk_score").where("risk_score <= 0").isEmpty()
    low = index.where("risk_score <= 0")
    assert outputs.positive_or_all(low, "risk_score").count() == low.count()


def test_ranked_legend(index):
    got = outputs.ranked_legend(outputs.reference_map(index, CFG), "risk_score", CFG).collect()
    assert sorted((r.rank, r.region) for r in got) == [(1, "A"), (2, "B")]


def test_map_values(spark):
    places = spark.createDataFrame([("King’s  Lynn",), ("Leeds",), (None,)], "name string")
    values = spark.createDataFrame([("King's Lynn", 2.0)], "region string, risk_score double")
    got = {r.name: r.risk_score for r in outputs.map_values(places, values, "risk_score", 0.0).collect()}
    assert got == {"King’s  Lynn": 2.0, "Leeds": 0.0, None: 0.0}


def test_snippets(spark, index):
    body = "This is a first sentence of the article, long enough. And more."
    rows = [(dt.date.fromisoformat(W[4]), "A", "x", f"a{i}", None, body, 0.6 if i < 3 else 0.9, i) for i in range(6)]
    rows.append((dt.date.fromisoformat(W[4]), "A", "x", "empty", None, "Read more", 0.99, 0))
    rows.append((dt.date.fromisoformat(W[4]), "Z", "x", "off", None, body, 0.99, 0))
    schema = "week date, region string, assigned_topic string, unique_article_id string, resolved_url string, text_clean string, top1_similarity double, region_spread int"
    scored = spark.createDataFrame(rows, schema)
    got = outputs.representative_snippets(scored, outputs.latest_pairs(index, CFG), CFG).orderBy("snippet_rank").collect()
    assert [(r.snippet_rank, r.unique_article_id) for r in got] == [(1, "a3"), (2, "a4"), (3, "a5")]
    assert got[0].representative_snippet == "This is a first sentence of the article, long enough."


def test_trends_read_few_tables(spark, index):
    """The final plans read the staged window, and the scope, four times at most."""
    scope = stage(outputs.report_scope(index, CFG), "scope")
    for made in (outputs.topic_trend(index, CFG, scope), outputs.overall_region_trend(index, CFG, scope)):
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[0].count("Scan parquet") <= 4 and "InMemoryTableScan" not in plan


def test_scope_of_an_index_without_active_rows(index):
    row = outputs.report_scope(index.where("n_articles = 0"), CFG).first()
    assert (row.reference_week, row.weeks, row.showcase_topic) == (None, [], None)
