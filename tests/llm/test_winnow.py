"""Repeated runs of lines against a plain search over all windows."""

import random

from pyspark.sql import functions as F

from pressgauge.llm import winnow


def slow(docs, least):
    """Lines to delete per document, from every window that occurred before."""
    places, gone = {}, {}
    for doc, text in sorted(docs):
        lines = [(i, x.strip().lower()) for i, x in enumerate((text or "").split("\n")) if x.strip()]
        words = [len(x.split(" ")) for _, x in lines]
        windows = set()
        for a in range(len(lines)):
            ends = [b for b in range(a, len(lines)) if sum(words[a : b + 1]) >= least]
            windows |= {(a, ends[0])} if ends else set()
            starts = [b for b in range(a + 1) if sum(words[b : a + 1]) >= least]
            windows |= {(starts[-1], a)} if starts else set()
        for a, b in windows:
            places.setdefault(tuple(x for _, x in lines[a : b + 1]), []).append((doc, lines[a][0], lines[b][0]))
    for found in places.values():
        for doc, a, b in sorted(found)[1:]:
            gone.setdefault(doc, set()).update(range(a, b + 1))
    return gone


def result(spark, rows, least):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, deleted int")
    return winnow.dedup_lines(docs, min_words=least).collect()


def test_equals_plain_search(spark):
    rng = random.Random(9)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(14)]
    rows = []
    for doc in range(120):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 14))]
        if doc % 3 == 0:
            lines[2:2] = pool[3:8]
        rows.append((doc, "\n".join(x if rng.random() < 0.8 else f"  {x.upper()}\t" for x in lines)))
    want = slow(rows, 8)
    texts = dict(rows)
    for r in result(spark, rows, 8):
        gone = {i for run in r.deleted for i in range(run["first"], run["last"] + 1)}
        assert gone == want.get(r.doc_id, set())
        lines = texts[r.doc_id].split("\n")
        assert r.n_lines == len(lines) and r.text == "\n".join(x for i, x in enumerate(lines) if i not in gone)


def test_long_passages_go_and_short_lines_stay(spark):
    passage = " ".join(f"w{i}" for i in range(55))
    rows = [(2, f"own two\n{passage}\ncommon line"), (1, f"own one\ncommon line\n\n{passage}\nend"), (3, "own three\ncommon line")]
    found = {r.doc_id: r.text for r in result(spark, rows, winnow.MIN_WORDS)}
    assert found == {1: rows[1][1], 2: "own two\ncommon line", 3: rows[2][1]}


def test_repeated_lines_go_wherever_they_stand(spark):
    """A line of four words or more goes everywhere but at its first place; a lone shorter one stays."""
    lines = ["All rights reserved by us.", "Share this page now", "Yes."]
    rows = [(i, f"own {i} a b c\n{lines[i % 3]}\nmore {i} d e f\n{lines[(i + 1) % 3]}") for i in range(300)]
    found = {r.doc_id: r.text.split("\n") for r in result(spark, rows, winnow.MIN_WORDS)}
    for line, times in zip(lines, (1, 1, 200)):
        assert sum(line in text for text in found.values()) == times
    assert all(f"own {i} a b c" in found[i] and f"more {i} d e f" in found[i] for i in range(300))


def test_few_repeated_lines_stay_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    line = F.lower(F.btrim("line", F.lit(" \t\r\f\x0b"))).alias("line")
    lines = F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")
    repeated = lambda df: (
        df.select("doc_id", lines).select("doc_id", line).where(F.size(F.split("line", " ")) >= winnow.MIN_WORDS)
        .groupBy("line").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).where("docs > 1")
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]
    )
    assert repeated(docs) > 500
    assert repeated(winnow.dedup_lines(docs)) == 0


def test_odd_rows(spark):
    long = "\n".join(f"line {i} of many words" for i in range(20_000))
    rows = [(1, None), (2, ""), (None, long), (4, long), (5, "\n\n \n"), (6, "a b c d e\na b c d e"), (7, "x"), (7, "x")]
    found = {(r.doc_id, r.text): r for r in result(spark, rows, 5)}
    assert len(result(spark, rows, 5)) == len(rows)
    assert (1, "") in found and (2, "") in found and (5, "\n\n \n") in found and (7, "x") in found
    assert (None, long) in found and found[4, ""].n_lines == 20_000
    assert (6, "a b c d e") in found
    assert result(spark, [], 5) == []
