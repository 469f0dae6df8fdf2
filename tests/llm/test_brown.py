"""Class bigrams: counts and unigram figures by hand, exchange against exhaustive gains, odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressgauge.llm import brown
from pressgauge.llm.queries import op7_brown_score

SF = "/root/testdata/sf0.01"


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lower) if w] + ["\n"]


def unigram(train, texts):
    counts = Counter(t for text in train for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    for text in texts:
        words = tokens(text)
        yield len(words), sum(w in counts for w in words), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)


@pytest.mark.parametrize("small", [False, True])
def test_unigram_figures_and_better_model(spark, monkeypatch, small):
    if small:  # most words go through the join
        monkeypatch.setattr(brown, "DICTIONARY", 200)
        monkeypatch.setattr(brown, "CORE", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    want = dict(zip([d.doc_id for d in docs], unigram([d.text for d in docs if not held(d.doc_id)], [d.text for d in docs])))
    rows = op7_brown_score(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, known, train, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_score_by_hand(spark):
    """With every word in the core, the figure follows from counts and the classes alone."""
    texts = ["a b a b", "b a", "c c", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = brown.word_counts(docs.select("text")).cache()
    model = brown.learn(docs.select("text"), counts)
    found = {r.doc_id: r for r in brown.score(docs, F.lit(True)).collect()}
    number = {w: i for i, w in enumerate(model.words.words)}
    classes = {w: model.label[model.words.units[i]] for w, i in number.items()}
    mass, kinds = Counter(), Counter()
    for w, i in number.items():
        mass[classes[w]] += model.words.counts[i]
        kinds[classes[w]] += 1
    pairs = Counter()
    for text in texts:
        stream = [b"\n", *text.encode().split(), b"\n"]
        pairs.update((classes[x], classes[y]) for x, y in zip(stream, stream[1:]))
    before = Counter()
    for (x, _), n in pairs.items():
        before[x] += n
    for i, text in enumerate(texts):
        stream, total = [b"\n", *text.encode().split(), b"\n"], 0.0
        for x, y in zip(stream, stream[1:]):
            a, b = classes[x], classes[y]
            total += math.log10((pairs[a, b] + 0.5) / (before[a] + 0.5 * (brown.CLASSES + 1)))
            total += math.log10((model.words.counts[number[y]] + 0.5) / (mass[b] + 0.5 * (kinds[b] + 1)))
        assert found[i].score == pytest.approx(total, rel=1e-9)


def likelihood(pairs, label):
    one = np.eye(label.max() + 1)[label]
    grid = one.T @ pairs @ one
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(grid) - f(grid.sum(0)) - f(grid.sum(1))


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(8)
    pairs = rng.poisson(0.3, (25, 25)) + 6 * (np.arange(25)[:, None] % 3 == (np.arange(25) + 1) % 3)
    label = brown.exchange(pairs, classes=3, sweeps=50)
    best = likelihood(pairs, label)
    assert label[24] == 3 and (label[:24] < 3).all()
    for u in range(24):
        for c in range(3):
            other = label.copy()
            other[u] = c
            assert likelihood(pairs, other) <= best + 1e-6
    start = np.r_[np.arange(24) % 3, 3]
    assert best > likelihood(pairs, start)


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "A b c É", 0), (3, "x", 0), (3, "x", 0), (4, "w " * 60_000, 0), (5, "never seen", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    train = F.coalesce(F.col("doc_id") != 5, F.lit(True))
    found = brown.score(docs, train).collect()
    texts = [r[1] for r in rows]
    want = sorted((r[0] or 0, *u[:3]) for r, u in zip(rows, unigram(texts[:-1], texts)))
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens) for r in found) == want
    untrained = brown.score(docs, F.lit(False)).collect()
    assert len(untrained) == len(rows) and all(r.n_known == 0 and r.train_tokens == 0 for r in untrained)
    assert brown.score(docs.limit(0), F.lit(True)).count() == 0


def test_every_training_word_chooses_its_class(spark, monkeypatch):
    """Words of one ending and pool, some before x and some before y, part by their neighbours; the dictionary's size changes nothing."""
    texts = [f"a{i % 40}ing x p q" if i % 2 else f"b{i % 40}ing y r s" for i in range(400)] + ["once1ing x p q", "once2ing y r s", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(brown, "CORE", 8)
    scores = []
    for size in (300_000, 8):
        monkeypatch.setattr(brown, "DICTIONARY", size)
        counts = brown.word_counts(docs.select("text")).cache()
        model = brown.learn(docs.select("text"), counts)
        classes = {w: model.label[model.words.units[i]] for i, w in enumerate(model.words.words)}
        rare = {r.key: r.label for r in model.rare.collect()}
        of = lambda word: classes[word] if word in classes else rare[brown.key_of(word)]
        assert len(classes) + len(rare) == counts.count() and (size > 8 or len(rare) > 30)
        before_x, before_y = {of(b"a%ding" % i) for i in range(1, 40, 2)}, {of(b"b%ding" % i) for i in range(0, 40, 2)}
        assert not before_x & before_y and of(b"once1ing") in before_x and of(b"once2ing") in before_y
        scores.append([r.score for r in brown.score(docs, F.lit(True)).orderBy("doc_id").collect()])
    assert scores[0] == pytest.approx(scores[1], rel=1e-9)


def test_grid_and_scores_by_hand_with_words_outside_the_dictionary(spark, monkeypatch):
    texts = ["a b c d a b", "e f a", "a b", "", "f e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(brown, "DICTIONARY", 3)
    monkeypatch.setattr(brown, "CORE", 2)
    counts = brown.word_counts(docs.select("text")).cache()
    model = brown.learn(docs.select("text"), counts)
    classes = {w: int(model.label[model.words.units[i]]) for i, w in enumerate(model.words.words)}
    rare = {r.key: r.label for r in model.rare.collect()}
    assert rare
    of = lambda w: classes[w] if w in classes else rare[brown.key_of(w)]
    streams = [[b"\n", *text.encode().split(), b"\n"] for text in texts]
    pairs = Counter((of(x), of(y)) for s in streams for x, y in zip(s, s[1:]))
    n = Counter(w for s in streams for w in s[1:])
    first, mass, kinds = Counter(), Counter(), Counter()
    for (x, _), k in pairs.items():
        first[x] += k
    for w, k in n.items():
        mass[of(w)] += k
        kinds[of(w)] += 1
    for r in brown.score(docs, F.lit(True)).collect():
        total = 0.0
        for x, y in zip(streams[r.doc_id], streams[r.doc_id][1:]):
            total += math.log10((pairs[of(x), of(y)] + 0.5) / (first[of(x)] + 0.5 * (brown.CLASSES + 1)))
            total += math.log10((n[y] + 0.5) / (mass[of(y)] + 0.5 * (kinds[of(y)] + 1)))
        assert r.score == pytest.approx(total, rel=1e-9)
