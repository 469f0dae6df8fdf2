"""Periodic runs against a search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from pressgauge.llm import periodic, queries


def slow(words, least=24, exponent=3):
    """Every stretch of equal words at each distance, less those that a smaller period explains."""
    found = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, exponent * q):
                stretch = words[i : i + length]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(rng):
    words = [rng.choice("abcdef") for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 3)):
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
        size = rng.randint(2 * len(unit), 6 * len(unit) + 9)
        words += (unit * 20)[:size] + [rng.choice("abcdef") for _ in range(rng.randint(0, 9))]
    return words


@pytest.mark.parametrize("least, exponent", [(24, 3), (4, 2), (9, 3), (2, 2)])
def test_equals_search_over_all_periods(least, exponent):
    rng = random.Random(least)
    hits = 0
    for _ in range(300):
        words = planted(rng)
        found = periodic.find_runs(np.array([ord(w) for w in words]), least, exponent)
        assert found == slow(words, least, exponent)
        hits += bool(found)
    assert hits > 30


def test_one_word_for_ever():
    assert periodic.find_runs(np.zeros(200_000, int)) == [(0, 200_000, 1)]


def test_repeated_line_is_no_run():
    line, rng = list(range(20)), random.Random(1)
    words = [w for i in range(3000) for w in [*line, 100 + i, *[rng.randint(30, 60) for _ in range(i % 3)]]]
    assert periodic.find_runs(np.array(words)) == []


def test_documents_do_not_touch_each_other(spark):
    rng = random.Random(5)
    texts = [planted(rng) for _ in range(120)] + [["x"] * 30, ["x"] * 30]
    rows = [(i, " ".join(t), 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(3)
    for row in periodic.periodic_runs(docs).collect():
        words = texts[row.doc_id]
        runs = [tuple(r) for r in row.runs]
        assert runs == slow(words) and row.n_words == len(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert row.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (None, "a " * 30), (4, "a\x0b" * 12 + "a\u00a0" * 30), (5, "é ü " * 40), (5, "é ü " * 40),
        (6, "A a " * 20), (7, "lang " * 400_000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.periodic_runs(docs).collect()}
    assert found == {
        (1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), (None, 30, ((0, 30, 1),), "a"),
        (4, 13, (), "a " * 12 + "a\u00a0" * 30), (5, 80, ((0, 80, 2),), "é ü"), (6, 40, ((0, 40, 2),), "A a"),
        (7, 400_000, ((0, 400_000, 1),), "lang"),
    }
    assert periodic.periodic_runs(docs).count() == len(rows)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_query_by_hand(spark, tmp_path):
    """The registered query against its contract, word by word."""
    rng = random.Random(7)
    rows = [(i, " ".join(planted(rng) * rng.randint(0, 2)) if i % 40 else None) for i in range(900)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    changed = 0
    for row in queries.op11_periodic_runs(spark, str(tmp_path)).collect():
        words = (dict(rows)[row.doc_id] or "").split()
        n, h = len(words), zlib.crc32(str(row.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        runs = slow(words)
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        best = min(runs, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == digest("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert row.collapsed_sha256 == digest(" ".join(w for i, w in enumerate(words) if i not in gone))
    assert changed > 20
