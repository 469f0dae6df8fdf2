import inspect
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pressgauge import session
from pressgauge.config import Settings
from pressgauge.functions import vectors
from pressgauge.functions.text import topic_texts
from pressgauge.operators import encoding, scoring
from pressgauge.plans import pipeline

CFG = Settings()
REFS = scoring.References([(1, 0, 0)], [(0, 1, 0)], [(1, 0, 0), (0, 0, 1), (1, 0, 0)], ["a", "b", "c"])


def stories(spark, vectors):
    rows = [(f"s{i}", [float(x) for x in v], strong, "strong_keyword", 4) for i, (v, strong) in enumerate(vectors)]
    return spark.createDataFrame(rows, "story_key string, embedding array<float>, strong_keyword_hit boolean, candidate_source string, region_spread int")


def test_story_scores(spark):
    frame = stories(spark, [((0.9, 0.1, 0.2), False), ((0.48, 0.44, 0.1), True), ((0.48, 0.44, 0.1), None), ((0.51, 0.0, 0.86), False)])
    got = {r.story_key: r for r in scoring.score_stories(frame, REFS, CFG).collect()}
    # equal best scores: the first topic, and ambiguous
    assert (got["s0"].assigned_topic, got["s0"].topic_ambiguous) == ("a", True)
    assert got["s1"].is_econ and got["s1"].assigned_topic == "other_econ"
    assert not got["s2"].is_econ and got["s2"].assigned_topic == "unassigned"
    assert got["s3"].top_topic == "b" and not got["s3"].topic_ambiguous
    assert got["s3"].econ_confidence == pytest.approx(0.51, abs=1e-6)


def test_single_topic_has_no_second(spark):
    refs = scoring.References(REFS.positive, REFS.negative, [(1, 0, 0)], ["a"])
    (row,) = scoring.best_topics(scoring.similarities(stories(spark, [((0.9, 0, 0), False)]), refs), ["a"]).collect()
    assert row.top2_similarity == 0.0


ARTICLES = [("a1", "s0", "L", 0.5, "x"), ("a2", "s0", "L", 0.5, "x"), ("a3", "s1", "M", 1.0, "x"), ("a4", "gone", "M", 1.0, "x")]


def test_articles_inherit_story_scores(spark):
    frame = stories(spark, [((0.9, 0.1, 0.2), False), ((0.1, 0.9, 0.1), False)])
    scores = scoring.score_stories(frame, REFS, CFG)
    articles = spark.createDataFrame(ARTICLES, "unique_article_id string, story_key string, region string, dup_weight double, candidate_source string")
    got = {r.unique_article_id: r for r in scoring.score_articles(articles, scores, ["candidate_source"]).collect()}
    assert set(got) == {"a1", "a2", "a3"} and got["a1"].candidate_source == "x"
    assert got["a1"].effective_weight == 0.25 and got["a3"].effective_weight == 0.5
    assert (got["a1"].assigned_topic, got["a3"].assigned_topic) == ("a", "unassigned")
    buckets = articles.withColumn("week", F.lit("w")).groupBy("story_key", "region", "week").agg(F.sum("dup_weight").alias("dup_weight"))
    weighed = {r.story_key: r.effective_weight for r in scoring.weigh_buckets(buckets, scores).collect()}
    assert weighed == {"s0": 0.5, "s1": 0.5}


def test_hashing_encoder_gives_unit_count_vectors(spark):
    frame = spark.createDataFrame([("1", "the cat the dog"), ("2", "dog THE cat; the"), ("3", None), ("4", "bird")], "k string, t string")
    got = {r.k: np.array(r.v) for r in encoding.hashing_encoder(64)(frame, "t", "v").collect()}
    assert np.allclose(got["1"], got["2"]) and np.linalg.norm(got["1"]) == pytest.approx(1.0, abs=1e-6)
    assert sorted(got["1"][got["1"] > 0]) == pytest.approx(sorted(np.array([2, 1, 1]) / np.sqrt(6)), abs=1e-6)
    assert not got["3"].any()


def test_sparse_vectors_equal_dense_ones(spark):
    texts = [("1", "the cat the dog"), ("2", None), ("3", "...!"), ("4", "bird " * 40 + "Ünï ß"), ("5", "a b c d e f g")]
    frame = spark.createDataFrame(texts, "k string, t string").repartition(3)
    dense = {r.k: list(r.v) for r in encoding.hashing_encoder(64)(frame, "t", "v").collect()}
    coded = encoding.sparse_hashing_encoder(64)(frame, "t", "v")
    assert {r.k: vectors.dense(r.v) for r in coded.collect()} == dense
    refs = np.random.default_rng(2).random((3, 64)).tolist()
    got = coded.select("k", vectors.sparse_dot_products(F.col("v"), refs).alias("d")).collect()
    for r in got:
        assert np.allclose(r.d, np.array(refs) @ np.array(dense[r.k]))
    none = coded.select("k", F.when(F.col("k") != "1", F.col("v")).alias("v")).select("k", vectors.sparse_dot_products(F.col("v"), refs).alias("d"))
    assert {r.k: r.d is None for r in none.collect()} == {k: k == "1" for k, _ in texts}
    with pytest.raises(Exception, match="components"):
        coded.select(vectors.sparse_dot_products(F.col("v"), [[1.0]])).collect()
    assert encoding.encode_texts(spark, ["the cat the dog"], encoding.sparse_hashing_encoder(64)) == [dense["1"]]


@pytest.mark.parametrize("make", [encoding.hashing_encoder, encoding.sparse_hashing_encoder])
def test_encoders_hold_little_beside_a_large_batch(make):
    """Working memory is bounded by what is counted at once, not by the batch; results are those of rows alone."""
    rng = np.random.default_rng(3)
    texts = [[f"w{x}" for x in rng.integers(0, 3000, n)] for n in [*rng.integers(0, 1500, 3000), 0, 200_000, 1]]
    words = pa.array(texts, pa.list_(pa.string()))
    count = inspect.getclosurevars(make(32)).nonlocals["unit_counts"].func
    count(words[:5])
    tracemalloc.start()
    whole = count(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20
    assert [whole[i].as_py() for i in (0, 7, 2999, 3000, 3001, 3002)] == [count(words.slice(i, 1))[0].as_py() for i in (0, 7, 2999, 3000, 3001, 3002)]
    assert len(whole) == len(words) and len(count(words[:0])) == 0


def test_sparse_products_hold_little_beside_a_large_batch():
    sizes = np.full(9000, 300, np.int32)
    ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    place = np.tile(np.arange(300, dtype=np.int32), 9000)
    vector = pa.StructArray.from_arrays(
        [pa.array(np.full(9000, 512, np.int32)), pa.ListArray.from_arrays(ends, pa.array(place)), pa.ListArray.from_arrays(ends, pa.array(place / 7.0))],
        ["size", "positions", "values"],
    )
    refs = np.random.default_rng(1).random((3, 512))
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(vectors.F, "arrow_udf", lambda kind: lambda f: lambda column: seen.append(f))
        vectors.sparse_dot_products(None, refs.tolist())
    tracemalloc.start()
    got = seen[0](vector)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 << 20
    assert np.allclose(got[8999].as_py(), refs[:, :300] @ (np.arange(300) / 7.0))


def test_workers_get_small_batches_where_stories_are_scored(spark, monkeypatch):
    """However many stories a task has and however long they are, a worker never holds many at once."""
    monkeypatch.setitem(session.BATCH_LIMITS, "spark.sql.execution.arrow.maxBytesPerBatch", "64k")

    @F.arrow_udf("array<double>")
    def checked(text: pa.Array) -> pa.Array:
        if len(text) > 1000 or len(text) > 1 and text.nbytes > 128 << 10:
            raise ValueError(f"{len(text)} rows of {text.nbytes} bytes at once")
        return pa.array([[1.0, 0.0]] * len(text), pa.list_(pa.float64()))

    encoder = lambda df, text, vector: df.withColumn(vector, checked(F.col(text)))
    number = F.col("id").cast("string")
    rows = spark.range(12_000).select(
        F.concat(F.lit("s"), number).alias("story_key"), number.alias("unique_article_id"), F.lit("r").alias("region"),
        F.lit("2022-01-03").alias("date"), F.lit("2022-01-03").alias("week"), F.lit("strong_keyword").alias("candidate_source"),
        F.lit(True).alias("strong_keyword_hit"),
        F.when(F.col("id") % 500 == 0, F.repeat(number, 9000)).otherwise(number).alias("text_for_embedding"),
    )
    scores = pipeline.score_candidates(rows.coalesce(1), encoder, CFG)
    assert scores.count() == 12_000 and scores.where("top1_similarity != 1").isEmpty()
    assert [spark.conf.get(key, None) for key in session.BATCH_LIMITS] == [None, None]


def test_small_batches_leave_limits_of_the_session(spark):
    rows, size = session.BATCH_LIMITS
    spark.conf.set(rows, 70)
    try:
        with session.small_batches(spark):
            assert (spark.conf.get(rows), spark.conf.get(size)) == ("70", "16m")
            with session.small_batches(spark):
                pass
            assert spark.conf.get(size) == "16m"
        with pytest.raises(KeyError), session.small_batches(spark):
            raise KeyError
        assert (spark.conf.get(rows), spark.conf.get(size, None)) == ("70", None)
    finally:
        spark.conf.unset(rows)


def test_configured_texts_need_no_python_workers(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    seen = []

    def encoder(df, text, vector):
        seen.append(df)
        return df.withColumn(vector, F.array(F.length(text).cast("double")))

    texts = ["ab", "", "a \u0416", "ab"] * 3
    assert encoding.encode_texts(spark, texts, encoder) == [[float(len(t))] for t in texts]
    assert encoding.encode_texts(spark, [], encoder) == []
    topics = encoding.topic_table(spark, CFG)
    assert [(r.topic, r.description, r.keywords, r.seed_examples) for r in topics.collect()] == topic_texts(CFG.topics)
    assert all("ExistingRDD" not in plan(df) for df in [*seen, topics])


def test_scored_articles_have_fixed_columns_and_move_no_other_text(spark):
    scores = scoring.score_stories(stories(spark, [((0.9, 0.1, 0.2), False)]), REFS, CFG)
    wide = spark.createDataFrame([(f"a{i}", "s0", 1.0, "raw " * 50, "clean", "2022-01-03") for i in range(9)], "unique_article_id string, story_key string, dup_weight double, article_text string, text_clean string, week string")
    scored = scoring.score_articles(wide.withColumn("resolved_url", F.lit("u")).withColumn("date", F.col("week")).withColumn("region", F.lit("r")), scores)
    assert scored.columns == scoring.SCORED_COLUMNS and scored.count() == 9
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "article_text" not in plan.split("LogicalRDD")[0]


def test_dot_products_of_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [0.0, 3.0])], "k int, v array<double>")
    got = {r.k: r.d for r in rows.select("k", vectors.dot_products(F.col("v"), [(1, 1), (0, 2)]).alias("d")).collect()}
    assert got == {1: [3.0, 4.0], 2: None, 3: None, 4: [3.0, 6.0]}
    short = spark.createDataFrame([([1.0],), ([1.0, 2.0, 3.0],)], "v array<double>")
    with pytest.raises(Exception, match="components"):
        short.select(vectors.dot_products(F.col("v"), [(1, 1)])).collect()


def test_norms(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0] * 4096)], "k int, v array<double>")
    got = {r.k: r.u for r in rows.select("k", vectors.l2_normalize(F.col("v")).alias("u")).collect()}
    assert got[1] == [0.6, 0.8] and got[2] == [0.0, 0.0] and got[3] is None and got[4] == [1 / 64] * 4096
