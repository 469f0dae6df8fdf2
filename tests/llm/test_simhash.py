"""SimHash groups against all pairs, and the guarantee of the Golay keys."""

import random

import numpy as np
import xxhash

from pressgauge.llm import simhash


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(marks):
    names = list(range(len(marks)))

    def find(i):
        while names[i] != i:
            i = names[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if bin(marks[i] ^ marks[j]).count("1") <= 3:
                a, b = find(i), find(j)
                names[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(marks))]


def test_fingerprint():
    rng = random.Random(1)
    for text in ["", " \t", "One", "one TWO", "a b c", "É é\xa0x  y\x0bz", "w " * 9000]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    for _ in range(50):
        text = " ".join(rng.choice(["Ab", "c", "déf", "gh"]) for _ in range(rng.randint(1, 60)))
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_fingerprints_within_three_bits_share_a_key():
    rng = np.random.default_rng(2)
    marks = rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2)
    for flips in (0, 1, 2, 3):
        other = marks.copy()
        for i in range(len(other)):
            for bit in rng.choice(64, flips, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(bit)
        key, row, own = simhash.keys_of(marks)
        near_key, near_row, _ = simhash.keys_of(other)
        mine = {(r, k) for r, k, o in zip(row.tolist(), key.tolist(), own.tolist()) if o}
        theirs = set(zip(near_row.tolist(), near_key.tolist()))
        assert {r for r, _ in mine & theirs} == set(range(len(marks)))


def test_groups_equal_all_pairs(spark):
    rng = random.Random(3)
    bases = [rng.getrandbits(64) for _ in range(12)] + [0]
    marks = list(bases)
    for b in bases:  # chains and dense clouds around each base
        for _ in range(60):
            m = b
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                m ^= 1 << bit
            marks.append(m)
    signed = [m - 2**64 if m >= 2**63 else m for m in marks]
    found = simhash.components(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long"))
    root = {r.fp: r.component_id for r in found.collect()}
    assert [root[m] for m in signed] == slow_groups(marks)


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "OWN_ROWS", 8)
    monkeypatch.setattr(simhash, "SMALL_GROUP", 4)
    rng = random.Random(4)
    center = rng.getrandbits(64)
    marks = sorted({center ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)} | {rng.getrandbits(64) for _ in range(20)})
    signed = [m - 2**64 if m >= 2**63 else m for m in marks]
    found = simhash.components(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long"))
    root = {r.fp: r.component_id for r in found.collect()}
    assert [root[m] for m in signed] == slow_groups(marks)


ROWS = [
    (1, "the quick brown fox jumps over it", 9), (2, "the quick brown fox jumps over it", 9), (3, None, 9), (4, "", 9),
    (None, "The QUICK brown fox jumps over it", 9), (5, "something else entirely here", 9), (5, "something else entirely here", 9),
    (None, "alone without any id at all", 9), (7, "x" * 50_000, 9),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, component_id int")
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    ids = {(r.doc_id, r.component_id) for r in rows}
    assert ids == {(1, 1), (2, 1), (None, 1), (3, 3), (4, 3), (5, 5), (None, None), (7, 7)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 5), (False, 7), (True, 0)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0
