"""Exact search against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pressgauge.llm import mtree

SCHEMA = "vec_id long, embedding array<float>, score int"


def slow(rows, k=5, every=10):
    vectors = {}
    for vec_id, x, *_ in rows:
        if vec_id is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            vectors[(vec_id, tuple(math.floor(256 * v) for v in x))] = None
    vectors = list(vectors)
    size = max((len(x) for _, x in vectors), default=0)
    pad = lambda x: x + (0,) * (size - len(x))
    result = {}
    for query in {i for i, _ in vectors if i % every == 0}:
        q = pad(min(x for i, x in vectors if i == query))
        scored = sorted((-sum(a * b for a, b in zip(q, pad(x))), i) for i, x in vectors if i != query)
        result[query] = [(rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return {q: r for q, r in result.items() if r}


def found(spark, rows, every=10):
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA)
    result = {}
    for r in mtree.search(df, F.col("vec_id") % every == 0).collect():
        result.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(r) for q, r in result.items()}


@pytest.mark.parametrize("page", [16, 512])
def test_equals_brute_force(spark, monkeypatch, page):
    monkeypatch.setattr(mtree, "PAGE", page)
    rng = random.Random(page)
    f32 = lambda v: float(__import__("numpy").float32(v))
    centers = [[rng.gauss(0, 0.3) for _ in range(6)] for _ in range(8)]
    rows = [(i, [f32(c + rng.gauss(0, 0.05)) for c in rng.choice(centers)]) for i in range(600)]
    rows += [(600 + i, rows[0][1]) for i in range(300)]  # a third of all rows are one vector
    assert found(spark, rows) == slow(rows)


@pytest.mark.parametrize("scale", [1.0, 200.0])  # products in single and in double precision
def test_tiles_of_a_few_pages(spark, monkeypatch, scale):
    for name, value in {"PAGE": 8, "TILE_BYTES": 0, "SENT_BYTES": 0, "QUERY_BLOCK": 5, "TASKS_PER_CORE": 1}.items():
        monkeypatch.setattr(mtree, name, value)
    rng = random.Random(3)
    whole = lambda: [scale * rng.randint(-300, 300) / 256 for _ in range(5)]
    rows = [(i, whole()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(200)]  # more equal products than k
    rows += [(i, rows[7][1]) for i in range(250, 350)] + [(i, whole()) for i in range(0, 40, 4)]  # ids that repeat
    rows += rows[:100]
    assert found(spark, rows) == slow(rows)


def test_queries_that_visit_every_leaf(spark, monkeypatch):
    """Queries of more than 2**31 bytes in a task if each leaf had its own copy of them."""
    import numpy as np

    monkeypatch.setattr(mtree, "PAGE", 1)
    n, size = 1000, 1500
    number = lambda j: (F.pmod(F.xxhash64("vec_id", j), F.lit(41)) - 20) / 256
    df = spark.range(n).select(F.col("id").alias("vec_id")).withColumn("embedding", F.transform(F.sequence(F.lit(1), F.lit(size)), number))
    table = df.toArrow().sort_by("vec_id")
    x = np.rint(256 * table["embedding"].combine_chunks().flatten().to_numpy().reshape(n, size))
    product = x @ x.T
    # all rows are asked for, so no bound excludes a leaf
    result = mtree.search(df, F.col("vec_id") >= 0, k=n).toArrow().sort_by([("query_id", "ascending"), ("rank", "ascending")])
    best = np.array([[j for j in np.lexsort((np.arange(n), -product[i])) if j != i] for i in range(n)])
    assert (result["query_id"].to_numpy() == np.repeat(np.arange(n), n - 1)).all()
    assert (result["rank"].to_numpy() == np.tile(np.arange(1, n), n)).all()
    assert (result["vec_id"].to_numpy() == best.ravel()).all()
    assert (result["score"].to_numpy() == np.take_along_axis(product, best, 1).ravel()).all()


def test_odd_rows(spark):
    rows = [
        (0, [0.5, -0.25]), (0, [0.5, -0.25]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 0.0]),
        (None, [1.0, 1.0]), (10, [0.25, 0.25, 1.0]), (20, []), (7, [0.001, -0.001]), (10, [0.125, 0.25, 1.0]), (-10, [1.0, 1.0]),
    ]
    assert found(spark, rows) == slow(rows)


def test_few_and_no_rows(spark):
    assert found(spark, [(0, [1.0])]) == {}
    assert found(spark, []) == {}
    assert found(spark, [(5, [1.0]), (6, [2.0])]) == {}


def test_large_components_are_refused(spark):
    with pytest.raises(ValueError):
        found(spark, [(0, [1e30]), (1, [1e30])])


def test_no_vectors_but_empty_ones(spark):
    rows = [(10, []), (20, []), (5, [])]
    assert found(spark, rows) == slow(rows)


def test_leaves_out_of_reach_are_skipped():
    import numpy as np

    x = np.array([[0.0, 0.0], [100.0, 0.0], [0.0, 100.0], [100.0, 100.0]])
    tree = mtree.Tree(1, 0.0, x, np.arange(4), np.arange(2), np.array([0, 1, 0, 1]), np.array([0.0, 0.0, 100.0, 100.0]), np.full(4, 5.0), np.full(2, 105.0))
    assert mtree.leaves_in_reach(tree, np.array([1.0, 1.0]), 10.0) == [0]
    assert mtree.leaves_in_reach(tree, np.array([1.0, 1.0]), np.inf) == [0, 1, 2, 3]
