"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pressgauge.llm import queries, variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow(counts, ratio=5):
    rows, forms = {}, {}
    for word, n in counts.items():
        others = [w for w in counts if near(word, w)]
        best = min(others, key=lambda w: (-counts[w], w), default=None)
        if best is not None and counts[best] < ratio * n:
            best = None
        forms[word] = best
        rows[word] = (n, len(others))
    found = set()
    for word, (n, n_near) in rows.items():
        root = word
        while forms[root] is not None:
            root = forms[root]
        found.add((word, forms[word], root, n, n_near, counts.get(forms[word])))
    return found


def columns(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("letters, longest, size", [("ab", 9, 600), ("abcdé", 5, 700), ("aÿ𝒳語", 4, 300)])
def test_equals_all_pairs(spark, letters, longest, size):
    rng = random.Random(size)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(size)}
    counts = {w: int(5 ** rng.uniform(0, 7)) for w in sorted(words)}
    df = spark.createDataFrame([(w, n, 0) for w, n in counts.items()], "word string, n long, word_id int").repartition(5)
    expected = slow(counts)
    assert any(root not in (word, form) for word, form, root, *_ in expected)
    assert columns(variants.variant_groups(df)) == expected


def test_nodes_are_prefixes(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(800)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(w,) for w in words], "word string")
        rows = variants.trie_nodes(df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    number = {}
    for r in rows:
        assert len(r.nodes) == len(r.word)
        for i, node in enumerate(r.nodes):
            assert number.setdefault(r.word[: i + 1], node) == node
    assert len(set(number.values())) == len(number) and len(rows) == len(words)
    ends = {r.nodes[-1]: r.word for r in rows}
    assert [ends[x] for x in sorted(ends)] == sorted(words)


def test_long_words_and_odd_rows(spark):
    long_ = "xy" * 4000
    rows = [(1, f"{long_} {long_}z Straße, STRASSE strasse"), (2, None), (3, ""), (None, f"{long_}Z"), (4, "a×bcdef ÷ Éclair ÉCLAIR")]
    rows += [(9, f"{long_} word_wordy")] * 5
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int")
    found = columns(variants.spelling_variants(docs, min_count=1, ratio=2))
    assert {(r[0], r[3]) for r in found} == {
        (long_, 6), (long_ + "z", 2), ("strasse", 2), ("straße", 1), ("a×bcdef", 1), ("Éclair", 2)
    }
    assert (long_ + "z", long_, long_, 2, 1, 6) in found
    assert columns(variants.spelling_variants(docs.limit(0))) == set()


def test_query_by_hand(spark, tmp_path):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdeéÀ") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(base) for _ in range(rng.randint(0, 400))).title()) for i in range(150)] + [(700, None), (701, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts, altered = Counter(), 0
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if h % 199 == 0:
                k, altered = h % len(run), altered + 1
                run = run[:k] + run[k + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    assert altered > 50
    expected = slow({w: n for w, n in counts.items() if n >= 5})
    assert any(r[1] for r in expected)
    assert columns(queries.op13_spelling_variants(spark, str(tmp_path))) == expected


def test_no_group_grows_with_the_table(spark):
    """A third of all words share a long prefix; groups stay as small as the alphabet."""
    words = [("prefixes" + format(i, "b"), i) for i in range(3000)] + [(format(i, "x") * 3, i) for i in range(6000)]
    counts = spark.createDataFrame(words, "word string, n long")
    forward = variants.trie_nodes(counts).withColumnRenamed("nodes", "forward")
    turned = variants.trie_nodes(counts.select(F.reverse("word").alias("word")))
    backward = turned.select(F.reverse("word").alias("word"), F.col("nodes").alias("backward"))
    gaps = variants._gaps(counts.join(forward, "word").join(backward, "word"))
    letters = len({c for w, _ in words for c in w})
    assert gaps.groupBy("prefix", "suffix").count().agg(F.max("count")).first()[0] <= letters + 1
