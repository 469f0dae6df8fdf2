"""Greedy string tiling against a plain implementation, reordered passages, odd rows."""

import random

import pytest

from pressgauge.llm import tiling


def slow_tiles(a, b, least):
    """Longest unmarked match first; ties by place in a, then in b."""
    in_a, in_b, tiles = set(), set(), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in in_a and j + n not in in_b:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            return tiles
        tiles.append(best)
        in_a.update(range(best[1], best[1] + best[0]))
        in_b.update(range(best[2], best[2] + best[0]))


@pytest.mark.parametrize("portion", [1, 20, 1_000_000])
def test_tiles_equal_plain_tiling(monkeypatch, portion):
    monkeypatch.setattr(tiling, "HITS_AT_ONCE", portion)
    rng = random.Random(6)
    for _ in range(150):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 25))]
        want = slow_tiles(a, b, 3)
        found = tiling.Items([(1, " ".join(b))], 3).compare(" ".join(a))
        assert [(0, len(b), sum(n for n, _, _ in want), len(want))] == found if want else not found


def test_one_word_again_and_again():
    items = tiling.Items([(1, "word " * 200), (2, "a b " * 100), (3, "a c b d e f")])
    assert items.compare("word " * 30_000 + "a b " * 5_000) == [(0, 200, 200, 1), (1, 200, 200, 1)]


ITEM = "one two three four five six seven eight nine ten eleven twelve"


def test_reordered_passages(spark):
    rows = [
        (1, "seven eight nine ten eleven twelve. And: ONE two three, four five six!", "x"), (2, ITEM.upper(), "x"),
        (3, "one two three four five but nothing more", "x"), (4, None, "x"), (5, "", "x"), (2, ITEM.upper(), "x"),
        (None, "prefix " * 30_000 + ITEM, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, ITEM), (11, None), (12, "too short"), (None, "")], "item_id long, text string")
    found = sorted(tiling.leaks(docs, bench).collect(), key=lambda r: r.doc_id or 0)
    assert [(r.doc_id, r.item_id, r.covered_words, r.tiles) for r in found] == [(None, 10, 12, 1), (1, 10, 12, 2), (2, 10, 12, 1), (2, 10, 12, 1)]
    clean = docs.where(~tiling.is_leak(docs, bench))
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5]


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(tiling, "BLOCK_CHARS", 100)
    words = [" ".join(f"w{i}x{k}" for k in range(8)) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(words)), "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in tiling.leaks(docs, bench).collect()) == [(i, i) for i in range(12)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert tiling.leaks(docs.limit(0), bench).count() == 0
    assert tiling.leaks(docs, bench.limit(0)).count() == 0
    assert docs.where(~tiling.is_leak(docs, bench.limit(0))).count() == 1


def test_short_items_and_scripts_without_spaces():
    items = tiling.Items([(1, "To be, or"), (2, "yes"), (3, "月が綺麗ですね"), (4, "one two three four five six"), (5, "")], short=True)
    shown = lambda text: [(items.ids[i], n, covered, tiles) for i, n, covered, tiles in items.compare(text)]
    assert shown("He said to be or not") == [(1, 3, 3, 1)]
    assert shown("to or be") == [] and shown("") == [] and shown("or to be") == []
    assert shown("yes: to be or. yes") == [(2, 1, 1, 1), (1, 3, 3, 1)]
    assert shown("昨日は月が綺麗ですねと言った") == [(3, 7, 7, 1)]
    assert shown("one two three four five") == [(4, 6, 5, 1)]
    assert tiling.words_of("GPT4は東京 été ไทย") == ["gpt4", "は", "東", "京", "été", "ไ", "ท", "ย"]


def test_documents_that_hold_a_short_item(spark):
    docs = spark.createDataFrame([(1, "He said to be or not"), (2, "or to be"), (3, "昨日は月が綺麗ですねと言った")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "To be, or"), (8, "月が綺麗ですね")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in tiling.leaks(docs, bench).collect()) == [(1, 7, 1.0), (3, 8, 1.0)]
    assert [r.doc_id for r in docs.where(~tiling.is_leak(docs, bench)).collect()] == [2]
