import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pressgauge.config import RAW_COLUMNS, Settings
from pressgauge.operators import candidates, cleaning, skew
from pressgauge.sources.readers import RAW_SCHEMA

CFG = Settings()
LONG = "word " * 60


def article(uid, article_date=None, tweet_date=None, main="Leeds", lad=None, dup=None, art=None, text=LONG, url=None):
    row = dict.fromkeys(RAW_COLUMNS)
    row.update(
        unique_article_id=uid, article_date=article_date, tweet_date=tweet_date, main_LAD=main, LAD=lad,
        duplicate_group=dup, article_id=art, article_text=text, resolved_url=url,
    )
    return tuple(row[c] for c in RAW_COLUMNS)


ROWS = [
    article("u1", "2022-03-02", "2022-03-05", dup="g1", art="a1"),
    article("u2", "2015-01-01", "2022-03-05", art="a2"),
    article("u3", "2021-03-05", "2022-03-05"),
    article("u4", "2022-03-02", None, main=None, lad="York", art="a4"),
    article("u5", None, "2022-03-09; 2022-03-05", dup="g1", art="a5"),
    article("u6", None, " ; ", art="a6"),
    article("u7", None, "2023-12-31 10:00:00", art="a7"),
    article("u8", None, "2023-12-31 00:00:00", art="a8"),
    article("u9", None, "2022-03-05", main="  ", lad="York", art="a9"),
    article("u10a", None, "2022-03-05", text="x" * 199),
    article("u10b", None, "2022-03-05", text="x" * 200),
    article("u12", None, "2022-03-05", main=None, text="short"),
    article("u13", None, "2022-03-05", dup="g9"),
    article("u14", None, "2022-03-05", dup="g9"),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, RAW_SCHEMA)


@pytest.fixture(scope="module")
def cleaned(raw):
    return {r.unique_article_id: r for r in cleaning.clean_articles(raw, CFG).collect()}


def test_kept_rows(cleaned):
    assert set(cleaned) == {"u1", "u2", "u3", "u4", "u5", "u8", "u10b", "u13", "u14"}


def test_dates_and_keys(cleaned):
    facts = {k: (r.date.strftime("%Y-%m-%d"), r.date_source, r.story_key, r.region) for k, r in cleaned.items()}
    assert facts["u1"] == ("2022-03-02", "article_date", "g1", "Leeds")
    assert facts["u2"] == ("2022-03-05", "tweet_date", "a2", "Leeds")
    assert facts["u3"] == ("2021-03-05", "article_date", "u3", "Leeds")
    assert facts["u4"] == ("2022-03-02", "article_date", "a4", "York")
    assert facts["u5"][:2] == ("2022-03-05", "tweet_date") and cleaned["u5"].has_multi_tweet
    assert cleaned["u1"].week == dt.date(2022, 2, 28) and cleaned["u8"].week == dt.date(2023, 12, 25)


def test_duplicate_weights(cleaned):
    assert cleaned["u13"].dup_weight == cleaned["u14"].dup_weight == 0.5
    groups = {(r.story_key, r.region, r.week) for r in cleaned.values()}
    assert sum(r.dup_weight for r in cleaned.values()) == len(groups)


def test_counters_overlap(raw):
    row = cleaning.cleaning_counters(raw, CFG).first()
    assert (row.rows_seen, row.rows_kept, row.multi_tweet_rows) == (14, 9, 2)
    assert (row.rows_dropped_short_text, row.rows_dropped_missing_region) == (2, 2)
    assert (row.rows_dropped_missing_date, row.rows_dropped_date_outlier) == (1, 1)


def test_report(raw):
    report = cleaning.cleaning_report(cleaning.derive_flags(raw, CFG), raw.columns, cleaning.clean_articles(raw, CFG), CFG, limit=14).first()
    assert report.summary.duplicate_story_groups == 7 and report.run_parameters.limit == 14
    assert report.top_regions[0].region == "Leeds" and report.top_regions[0].rows == 8
    assert report.missing_share.twitter == 1.0 and report.missing_share.unique_article_id == 0.0
    assert len(report.examples) == 9 and report.examples[0].unique_article_id == "u3"


def test_missing_share_of_no_rows(raw):
    assert all(r.missing_share is None for r in cleaning.missing_share(raw.limit(0)).collect())


def test_bucket_weights_equal_article_weights(raw):
    flagged = cleaning.clean_articles(raw, CFG).withColumn("is_candidate", F.col("unique_article_id") != "u14")
    per_article = flagged.where("is_candidate").groupBy("story_key").agg(F.sum("dup_weight").alias("w"))
    per_bucket = cleaning.bucket_weights(flagged).groupBy("story_key").agg(F.sum("dup_weight").alias("w"))
    assert sorted(per_article.collect()) == sorted(per_bucket.collect())


def test_candidates(spark):
    texts = [("a", "wages and jobs", "https://x.y/business"), ("b", "jobs", "https://x.y/money/1"), ("c", "jobs", None), ("d", "none", "https://x.y/energy"), ("e", "none", None)]
    frame = spark.createDataFrame(texts, "unique_article_id string, text_clean string, resolved_url string").withColumn("story_key", F.lit("s"))
    flagged = candidates.flag_candidates(frame, CFG)
    got = {r.unique_article_id: r.candidate_source for r in flagged.collect()}
    assert got == {"a": "strong_keyword", "b": "weak_keyword+url_section", "c": "weak_keyword", "d": "url_section", "e": ""}
    summary = candidates.candidate_summary(flagged).first()
    assert summary.total_cleaned_rows == 5 and summary.candidate_rows == 4 and summary.unique_candidate_story_keys == 1


def test_one_pattern_per_column(spark):
    """Both keyword lists are sought in one scan of the text."""
    rows = spark.createDataFrame([("t", "u", "s")], "text_clean string, resolved_url string, story_key string")
    plan = candidates.filter_candidates(rows, CFG)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.upper().count("RLIKE") == 1


@pytest.mark.parametrize("bits", [1 << 27, 1 << 16, 8])
def test_duplicate_weights_equal_counts(spark, monkeypatch, bits):
    """A third of all rows in one group, null keys, pairs and lone rows; few bits only send more rows to the join."""
    monkeypatch.setattr(skew, "BITS", bits)
    rows = [(f"u{i}", "hot" if i % 3 == 0 else f"s{i // 2}" if i % 3 == 1 else f"x{i}", None if i % 50 == 7 else "r", "w") for i in range(3000)]
    articles = spark.createDataFrame(rows, "unique_article_id string, story_key string, region string, week string")
    counts = Counter(r[1:] for r in rows if r[2] is not None)
    got = {r.unique_article_id: r.dup_weight for r in cleaning.with_duplicate_weight(articles).collect()}
    assert got == {r[0]: 1.0 / counts.get(r[1:], 1) for r in rows}
    assert cleaning.with_duplicate_weight(articles.limit(0)).count() == 0


def test_rows_of_groups_of_one_are_not_exchanged(spark, tmp_path):
    rows = [(f"u{i}", f"s{min(i, 900)}", "r", "w", "text " * 50) for i in range(1000)]
    schema = "unique_article_id string, story_key string, region string, week string, text_clean string"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(str(tmp_path / "a"))
    articles = spark.read.parquet(str(tmp_path / "a"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        weighed = cleaning.with_duplicate_weight(articles)
        assert sum(r.dup_weight for r in weighed.collect()) == pytest.approx(901)
        moved = exchanged_rows(weighed, "text_clean")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved == [100]


def exchanged_rows(df, column):
    """Rows that pass each shuffle of a collected frame whose output has a column."""
    waiting, found = [df._jdf.queryExecution().executedPlan()], []
    while waiting:
        node = waiting.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            waiting.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            waiting.append(node.plan())
        else:
            if name == "Exchange" and f"{column}#" in node.output().toString():
                found.append(node.metrics().apply("shuffleRecordsWritten").value())
            waiting += [node.children().apply(i) for i in range(node.children().size())]
    return found
