import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pressgauge.config import Settings
from pressgauge.functions.hashing import stable_hash
from pressgauge.operators import sampling, skew, stories
from pressgauge.session import stage

CFG = Settings()


def test_hot_split_join_equals_a_plain_join(spark):
    """One key holds a third of all rows."""
    rows = spark.range(6000).select(
        F.col("id").cast("string").alias("uid"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 977).cast("string")).alias("k"),
    )
    lookup = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("uid").alias("m")).where("k != '5'")
    got = skew.hot_split_join(rows, lookup, ["k"], "n", ["m"], ["uid"], share=0.1)
    plain = rows.join(lookup.select("k", "m"), "k", "left").select("uid", "k", "m")
    assert got.count() == 6000 and got.exceptAll(plain).isEmpty()
    inner = skew.hot_split_join(rows, lookup, ["k"], "n", ["m", "n"], ["uid"], "inner", share=0.1)
    assert inner.count() == rows.where("k != '5'").count() and inner.columns == ["uid", "k", "m", "n"]


def test_hot_rows_are_spread_over_the_shuffle(spark):
    """With broadcasts of measured size off, rows of the hot key land in all partitions."""
    rows = spark.range(8000).select(
        F.col("id").cast("string").alias("uid"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
    )
    lookup = rows.groupBy("k").agg(F.count("*").alias("n"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        joined = skew.hot_split_join(rows, lookup, ["k"], "n", ["n"], ["uid"], share=0.1)
        assert joined.where("n IS NULL").isEmpty() and joined.count() == 8000
        placed = joined.where("k = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    sizes = [r["count"] for r in placed]
    assert len(sizes) == 4 and sum(sizes) == 2667 and max(sizes) < 2 * min(sizes)


@pytest.mark.parametrize("salt", [None, ["uid"]])
def test_first_n_per_group_equals_a_sort(spark, salt):
    rng = random.Random(1)
    data = [(f"g{min(rng.randrange(6), 2)}", rng.randrange(4), rng.randrange(3), f"u{i:04d}") for i in range(900)]
    data += [("tiny", 1, 1, "t1"), ("none", 1, 1, "n1")]
    limits = {"g0": 37, "g1": 900, "g2": 251, "tiny": 1, "none": 0}
    frame = spark.createDataFrame(data, "g string, a int, b int, uid string")
    wanted = spark.createDataFrame(list(limits.items()), "g string, n long")
    got = skew.first_n_per_group(frame, ["g"], [("a", False), ("b", True), ("uid", True)], wanted, salt)
    expected = set()
    for group, n in limits.items():
        mine = sorted((r for r in data if r[0] == group), key=lambda r: (-r[1], r[2], r[3]))
        expected |= {r[3] for r in mine[:n]}
    assert {r.uid for r in got.collect()} == expected and got.columns == ["g", "a", "b", "uid"]


def sha(*parts):
    return hashlib.sha256("::".join(map(str, parts)).encode()).hexdigest()


def python_sample(meta, cap, share, seed):
    """Brute-force stratified sample over (key, tier, region, week) rows."""
    tiers = {t: [m for m in meta if m[1] == t] for t in ("strong", "weak_url")}
    goal = round(cap * share)
    target = {"strong": min(goal, len(tiers["strong"])), "weak_url": min(cap - goal, len(tiers["weak_url"]))}
    left = cap - sum(target.values())
    for tier in target:
        more = min(left, len(tiers[tier]) - target[tier])
        target[tier] += more
        left -= more
    chosen = set()
    for tier, rows in tiers.items():
        buckets = defaultdict(list)
        for row in rows:
            buckets[row[2:]].append(row[0])
        if len(rows) <= target[tier]:
            quota = {b: len(v) for b, v in buckets.items()}
        else:
            raw = {b: len(v) / len(rows) * target[tier] for b, v in buckets.items()}
            quota = {b: math.floor(x) for b, x in raw.items()}
            spare = target[tier] - sum(quota.values())
            for b in sorted(raw, key=lambda b: (-(raw[b] - math.floor(raw[b])), *b))[:spare]:
                quota[b] += 1
        for b, keys in buckets.items():
            chosen |= set(sorted(keys, key=lambda k: (sha(seed, tier, k), k))[: quota[b]])
    return chosen


@pytest.mark.parametrize("cap", [10, 97, 400, 5000])
def test_story_sample_equals_brute_force(spark, cap):
    rng = random.Random(cap)
    meta = [
        (f"s{i}", "strong" if rng.random() < 0.2 else "weak_url", "hot" if rng.random() < 0.34 else f"r{rng.randrange(9)}", f"2022-0{rng.randrange(1, 4)}-01")
        for i in range(1200)
    ]
    frame = spark.createDataFrame(meta, "story_key string, sampling_tier string, region string, week string").withColumn("week", F.to_date("week"))
    cfg = CFG.with_(run_mode="dev", embedding_story_cap=cap)
    got = {r.story_key for r in sampling.sample_stories(frame, cfg).collect()}
    assert got == python_sample(meta, cap, cfg.embedding_strong_share, cfg.random_state)
    assert len(got) == min(cap, len(meta))


def test_quota_cases(spark):
    buckets = [("a", 5), ("b", 3), ("c", 2)]
    rows = [(f"{r}{i}", "weak_url", r, "2022-01-03") for r, n in buckets for i in range(n)]
    frame = spark.createDataFrame(rows, "story_key string, sampling_tier string, region string, week string")
    quota = lambda cap: {
        r.region: r.quota for r in sampling.quota_allocation(frame, sampling.tier_targets(frame, cap, 0.7)).collect()
    }
    assert quota(5) == {"a": 3, "b": 1, "c": 1}
    assert quota(10) == {"a": 5, "b": 3, "c": 2}
    assert quota(0) == {"a": 0, "b": 0, "c": 0}


def test_unused_slots_spill_over(spark):
    rows = [(f"s{i}", "strong") for i in range(4)] + [(f"w{i}", "weak_url") for i in range(20)]
    frame = spark.createDataFrame(rows, "story_key string, sampling_tier string")
    got = {r.sampling_tier: (r.available, r.target) for r in sampling.tier_targets(frame, 10, 0.7).collect()}
    assert got == {"strong": (4, 4), "weak_url": (20, 6)}


def test_sample_per_stratum(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"),
        F.col("id").cast("string").alias("uid"),
        F.lit("text").alias("t"),
    )
    got = sampling.sample_per_stratum(rows, "g", "uid", 20, 42)
    picked = defaultdict(set)
    for r in got.collect():
        picked[r.g].add(r.uid)
    everything = defaultdict(list)
    for r in rows.collect():
        everything[r.g].append(r.uid)
    for group, ids in everything.items():
        assert picked[group] == set(sorted(ids, key=lambda u: (sha(42, u), u))[:20])


def test_sample_keeps_null_ids_and_large_k(spark):
    rows = spark.createDataFrame([("g", "1"), ("g", "2"), ("g", None)], "g string, uid string")
    assert {r.uid for r in sampling.sample_per_stratum(rows, "g", "uid", 3, 42).collect()} == {"1", "2", None}
    many = spark.range(6000).select((F.col("id") % 2).cast("string").alias("g"), F.col("id").cast("string").alias("uid"))
    got = {r.uid for r in sampling.sample_per_stratum(many, "g", "uid", 2000, 42).collect()}
    want = set()
    for g in (0, 1):
        want |= set(sorted((str(i) for i in range(g, 6000, 2)), key=lambda u: (sha(42, u), u))[:2000])
    assert got == want


CANDIDATES = [
    ("s1", "Leeds", "2022-01-03", "a3", "2022-01-05", "strong_keyword", True, "later"),
    ("s1", "York", "2022-01-03", "a1", "2022-01-04", "weak_keyword", False, "first"),
    ("s1", "Hull", "2022-01-10", "a2", "2022-01-10", "weak_keyword", False, "last"),
    ("s1", "Hull", "2022-01-10", "a4", "2022-01-11", "weak_keyword", False, "last"),
    ("s2", "Hull", "2022-01-10", "a5", "2022-01-11", "strong_keyword", True, "two"),
]


@pytest.fixture(scope="module")
def rows(spark):
    schema = "story_key string, region string, week string, unique_article_id string, date string, candidate_source string, strong_keyword_hit boolean, text_for_embedding string"
    return spark.createDataFrame(CANDIDATES, schema).withColumns({"week": F.to_date("week"), "date": F.to_timestamp("date")})


def test_story_meta(rows):
    meta = {r.story_key: r for r in stories.story_meta(rows, CFG).collect()}
    one = meta["s1"]
    assert (one.region, one.region_spread, one.article_rows) == ("Hull", 3, 4)
    # the first row decides the tier, any row the flag
    assert (one.sampling_tier, one.strong_keyword_hit, one.candidate_source) == ("weak_url", True, "weak_keyword")
    assert meta["s2"].sampling_tier == "strong"


def test_primary_bucket_ties_go_by_hash(spark):
    buckets = spark.createDataFrame([("s", "A", "2022-01-03", 2), ("s", "B", "2022-01-03", 2)], "story_key string, region string, week string, article_rows long")
    (row,) = stories.primary_buckets(buckets, 42).collect()
    assert row.region == min("AB", key=lambda r: sha(42, "s", r, "2022-01-03"))


def test_stories_built(rows):
    chosen = stories.story_meta(rows, CFG)
    built = {r.story_key: r for r in stories.build_stories(rows, chosen, CFG.with_(run_mode="dev")).collect()}
    assert built["s1"].text_for_embedding == "first" and built["s1"].run_mode == "dev"
    full = stories.build_stories(rows, chosen, CFG.with_(run_mode="full"))
    assert {r.text_for_embedding for r in full.collect()} == {"first", "two"}


def test_story_numbers(spark):
    frame = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("story_key")).repartition(7)
    got = [(r.story_key, r.embedding_row) for r in stories.number_stories(frame).collect()]
    assert sorted(got) == [(k, i) for i, k in enumerate(sorted(k for k, _ in got))]


def test_rebuilt_lookup(rows):
    old = rows.sparkSession.createDataFrame([("s1", 0, "t", "Hull", "w", "dev"), ("gone", 1, "t", "Hull", "w", "dev")], "story_key string, embedding_row int, text_for_embedding string, region string, week string, run_mode string")
    assert {r.story_key: r.region_spread for r in stories.rebuild_lookup(old, rows).collect()} == {"s1": 3, "gone": 1}


def nodes(df):
    """(name, columns) of every node of the plan before adaptive execution."""
    plan = df._jdf.queryExecution().executedPlan()
    waiting, found = [plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan], []
    while waiting:
        node = waiting.pop()
        found.append((node.nodeName(), node.output().toString()))
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return found


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("written", [False, True])
def test_texts_are_exchanged_once_and_never_sorted(spark, rows, no_broadcast, tmp_path, written):
    if written:
        rows.write.parquet(f"{tmp_path}/rows")
        rows = spark.read.parquet(f"{tmp_path}/rows")
    chosen = stage(stories.story_meta(rows, CFG), "chosen")
    for built in (stories.first_rows(rows, ["text_for_embedding", "region"]), stories.build_stories(rows, chosen, CFG)):
        with_text = [name for name, columns in nodes(built) if "text_for_embedding" in columns]
        assert with_text.count("Exchange") == 1 and "Sort" not in with_text and "SortMergeJoin" not in with_text
        assert not [n for n in with_text if "Aggregate" in n]
        scans = [columns for name, columns in nodes(built) if name.startswith("Scan")]
        assert any("text_for_embedding" not in c for c in scans)
        assert {r.text_for_embedding for r in built.collect()} == {"first", "two"}


def test_first_row_of_repeated_rows(spark, rows):
    """A row that stands twice is fetched once; a story without a key is one story."""
    twice = rows.unionByName(rows).unionByName(rows.where("story_key = 's1'").withColumn("story_key", F.lit(None).cast("string")))
    found = stories.first_rows(twice, ["text_for_embedding"]).collect()
    assert sorted((r.story_key or "", r.text_for_embedding) for r in found) == [("", "first"), ("s1", "first"), ("s2", "two")]
    assert stories.first_rows(rows.limit(0), ["text_for_embedding"]).count() == 0


def test_story_without_a_row_keeps_an_empty_text(spark, rows):
    chosen = stories.story_meta(rows, CFG)
    built = stories.build_stories(rows.where("story_key = 's2'"), chosen, CFG).collect()
    assert {r.story_key: r.text_for_embedding for r in built} == {"s1": "", "s2": "two"}


@pytest.mark.parametrize("few", [10_000, 0])
def test_smallest_hashes_equal_a_sort(spark, monkeypatch, few):
    """Groups of all sizes, one where all rows share an id and so a hash, with n below, at and beyond the size."""
    monkeypatch.setattr(skew, "FEW_GROUPS", few)
    rows = [(f"g{i % 3}", f"u{i}", i) for i in range(3000)] + [("one", "same", i) for i in range(500)] + [("two", f"v{i}", i) for i in range(2)]
    frame = stage(spark.createDataFrame(rows, "g string, uid string, x int"), "rows")
    wanted = {"g0": 3, "g1": 400, "g2": 5000, "one": 7, "two": 2}
    sizes = frame.groupBy("g").agg(F.count("*").alias("size"))
    limits = sizes.join(spark.createDataFrame(list(wanted.items()), "g string, n long"), "g")
    got = skew.first_n_by_hash(frame, ["g"], stable_hash(42, F.col("uid")), [F.col("x")], limits, ["uid"])
    expected = set()
    for group, n in wanted.items():
        expected |= set(sorted((r for r in rows if r[0] == group), key=lambda r: (sha(42, r[1]), r[2]))[:n])
    assert {tuple(r) for r in got.collect()} == expected and got.columns == frame.columns
    assert skew.first_n_by_hash(frame, ["g"], stable_hash(42, F.col("uid")), [F.col("x")], limits.limit(0), ["uid"]).count() == 0
