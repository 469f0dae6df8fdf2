"""MinHash forest against the similarity of all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest

from pressgauge.llm import lshforest
from pressgauge.llm.common import table

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def set_of(text):
    words = (text or "").translate(LOWER).encode().split()
    return frozenset(b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))) if words else frozenset()


def slow(rows):
    """{(doc_id, n_shingles, component_id, kept)} from all pairs that share a shingle."""
    classes = defaultdict(list)
    for doc, text in rows:
        classes[set_of(text)].append(doc)
    sets = [s for s in classes if s]
    root = list(range(len(sets)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                shared[j] += 1
            holders[x].append(i)
        for j, n in shared.items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, s in enumerate(sets):
        ids[find(i)] += classes[s]
    lowest = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    component = {s: lowest[find(i)] for i, s in enumerate(sets)}
    out = []
    for doc, text in rows:
        s = set_of(text)
        c = component[s] if s else doc
        out.append((doc, len(s), c, doc == c))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def edited(words, rng, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def near_copies(rng, bases=12, copies=25):
    rows = []
    for _ in range(bases):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randint(30, 300))]
        for _ in range(rng.randint(1, copies)):
            kind = rng.random()
            text = base if kind < 0.2 else edited(base, rng, rng.randint(1, max(1, len(base) // 18)))
            rows.append(" ".join(text).title() if kind < 0.1 else " ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


def test_equals_all_pairs(spark):
    rows = near_copies(random.Random(2), 40)
    expected = slow(rows)
    assert 30 < sum(r[3] for r in expected) < len(rows) - 100
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string").repartition(5)
    assert found(lshforest.near_duplicates(docs)) == expected


def test_equals_all_pairs_on_the_given_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(lshforest.near_duplicates(docs)) == slow(rows)


def test_one_text_with_many_copies(spark):
    """Copies that are linked by the text they come from only, among them a third of all rows."""
    rng = random.Random(4)
    base = [f"v{i}" for i in range(200)]
    rows = list(enumerate(" ".join(edited(base, rng, rng.randint(2, 9))) for _ in range(700)))
    rows += [(i + 1000, " ".join(base)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = slow(rows)
    assert 3 < len({r[2] for r in expected}) < 500
    assert found(lshforest.near_duplicates(docs)) == expected


def test_groups_beyond_the_limit_are_cut(spark):
    """Pieces keep nearly all links and invent none."""
    rows = near_copies(random.Random(6), 3, 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = slow(rows)
    cut = found(lshforest.near_duplicates(docs, limit=2000))
    whole = {r[0]: r[2] for r in expected}
    assert all(whole[r[0]] == whole[r[2]] for r in cut)
    assert sum(r[3] for r in cut) <= 1.05 * sum(r[3] for r in expected)


def test_groups_beyond_the_limit_lose_no_link(spark):
    """Links that no piece holds: to the one text that many copies come from, and between texts of unequal length."""
    rng = random.Random(4)
    base = [f"v{i}" for i in range(200)]
    texts = [base, *(edited(base, rng, rng.randint(2, 9)) for _ in range(500))]
    texts += [base[: rng.randint(165, 199)] for _ in range(100)]
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = slow(rows)
    assert 3 < len({r[2] for r in expected}) < 500
    assert found(lshforest.near_duplicates(docs, limit=3000)) == expected


def test_known_parts_are_not_linked_again():
    sets = [np.arange(i, i + 100, dtype=np.uint64) for i in (0, 1, 2, 50, 51)]
    assert {tuple(sorted(x)) for x in lshforest.linked(sets, parts=[7, 7, 7, 3, 4])} == {(3, 4)}
    assert lshforest.linked(sets, parts=[7, 7, 7, 3, 3]) == []


def test_deep_regions():
    """A region of many alike rows is cut into parts that cover it, none too large."""
    rng = np.random.default_rng(5)
    sets = [np.unique(np.r_[np.arange(1, 81), rng.integers(100, 10**6, 8)].astype(np.uint64) * lshforest.MIX[0]) for _ in range(600)]
    labels = lshforest._labels(lshforest.min_hashes(sets), 3)
    labels = labels[np.lexsort(labels.T[::-1])]
    differ = labels[1:] != labels[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), labels.shape[1])
    parts = sorted(lshforest._parts(common, 0, len(labels), 0))
    assert all(b - a <= lshforest.SMALL_REGION for a, b in parts)
    assert all(x[1] <= y[0] for x, y in zip(parts, parts[1:])) and sum(b - a for a, b in parts) > 400


@pytest.mark.parametrize("similarity", [0.85, 0.5])
def test_values_agree_as_often_as_sets_are_alike(similarity):
    rng = np.random.default_rng(1)
    shared = int(1000 * similarity)
    rest = (1000 - shared) // 2
    pools = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (shared, rest, rest)]
    values = lshforest.min_hashes([np.r_[pools[0], pools[1]], np.r_[pools[0], pools[2]]])
    assert abs((values[0] == values[1]).mean() - similarity) < 0.17


def test_odd_rows(spark):
    long_ = " ".join(f"q{i % 70_000}" for i in range(300_000))
    rows = [
        (5, None), (6, ""), (7, " \n"), (None, None), (8, "One"), (3, "one"), (9, "one two"), (None, "one two"), (None, "alone here too now"),
        (None, "alone here too now"), (4, long_), (2, long_ + " end"), (2, long_ + " end"), (11, "a b c"), (12, "a b c"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(lshforest.near_duplicates(docs)) == slow(rows)
    assert found(lshforest.near_duplicates(docs.limit(0))) == []
