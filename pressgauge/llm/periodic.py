"""Periodic runs of words within documents: Kruskal over suffixes by descending common prefix.

The suffixes of a document are vertices; two suffixes next to each other in suffix order are joined
by an edge of their longest common prefix (LCP). Edges are taken from the longest LCP to the
shortest. Union-find keeps, for each class of suffixes united so far, the ordered set of their
positions. When an edge of LCP L unites two classes, positions i < j that become neighbours in the
united set and come from different classes have an LCP of exactly L. If j - i <= L, the words
i … j + L - 1 have period j - i, and no smaller one: with a smaller period q the suffix i + q would
share a longer prefix with i and already stand between the two. The stretch cannot grow to the
right; if the words before i and j differ, it cannot grow to the left either and is a run. Every
run is met this way, at its first word. The smaller set is always put into the larger one.

Runs of at least `min_length` words and `min_exponent` periods need an LCP of some words at least
(16 for 24 words and three periods), so edges below that are never built.

Suffix order and LCPs come from prefix doubling over portions of many documents at once: a word's
number differs from document to document, hence no common prefix passes the end of a document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import ship_code

MIN_LENGTH = 24
MIN_EXPONENT = 3
#: Words handled at once; a longer document is a portion of its own.
PORTION = 1 << 18
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def least_prefix(min_length: int, min_exponent: int) -> int:
    """The LCP that the first two periods of any wanted run have at least."""
    return min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, min_length + 1))


def _ranks(ids: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per level m: the rank of every position by its first 2**m words, and the positions whose rank is shared.

    A rank is the number of positions in front, so that equal ranks mean equal words.
    """
    count = len(ids)
    order = np.argsort(ids, kind="stable").astype(np.int32)
    ordered = ids[order]
    heads = np.r_[True, ordered[1:] != ordered[:-1]]
    first = np.maximum.accumulate(np.where(heads, np.arange(count), 0))
    rank = np.empty(count, np.int32)
    rank[order] = first
    ranks, shared, width = [], [], 1
    while True:
        alone = heads & np.r_[heads[1:], True]
        open_ = order[~alone]
        ranks.append(rank)
        shared.append(open_)
        if not len(open_):
            return ranks, shared
        after = open_ + width
        follow = np.where(after < count, rank[np.minimum(after, count - 1)].astype(np.int64) + 1, 0)
        key = rank[open_].astype(np.int64) * (count + 1) + follow
        by_key = np.argsort(key, kind="stable")
        order, key = open_[by_key], key[by_key]
        old = rank[order]
        heads = np.r_[True, key[1:] != key[:-1]]
        at = np.arange(len(order))
        old_first = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
        rank = rank.copy()
        rank[order] = old + (np.maximum.accumulate(np.where(heads, at, 0)) - old_first).astype(np.int32)
        width *= 2


def _edges(ranks: list[np.ndarray], shared: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in suffix order that share `least` words with a neighbour, and the LCP of each with the next one."""
    level = least.bit_length() - 1
    if level >= len(shared) or not len(shared[level]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = shared[level].astype(np.int64)
    places = places[np.argsort(ranks[-1][places], kind="stable")]
    x, y, common, count = places[:-1], places[1:], np.zeros(len(places) - 1, np.int64), len(ranks[0])
    for m in range(len(ranks) - 1, -1, -1):
        left, right = x + common, y + common
        inside = np.maximum(left, right) < count
        same = ranks[m][np.minimum(left, count - 1)] == ranks[m][np.minimum(right, count - 1)]
        common += np.where(inside & same, 1 << m, 0)
    return places, common


def find_runs(ids: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a sequence of numbers, by start, then period.

    `ids` may be several texts one after the other, if none shares a number with another.
    """
    ids = np.asarray(ids, np.int64)
    if len(ids) < min_length:
        return []
    least = least_prefix(min_length, min_exponent)
    places, common = _edges(*_ranks(ids), least)
    wanted = np.nonzero(common >= least)[0]
    wanted = wanted[np.argsort(-common[wanted], kind="stable")]
    parent = list(range(len(places)))
    members: list[list[int] | None] = [[p] for p in places.tolist()]
    found = []

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    def meet(i: int, j: int, shared: int) -> None:
        period = j - i
        if shared >= (min_exponent - 1) * period and shared + period >= min_length:
            if i == 0 or ids[i - 1] != ids[j - 1]:
                found.append((i, shared + period, period))

    for edge, shared in zip(wanted.tolist(), common[wanted].tolist()):
        a, b = root(edge), root(edge + 1)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        large, small = members[a], members[b]
        parent[b], members[b] = a, None
        if len(small) == 1 or 16 * len(small) < len(large):
            fresh = set(small)
            for p in small:
                at = bisect_left(large, p)
                if at and large[at - 1] not in fresh:
                    meet(large[at - 1], p, shared)
                if at < len(large) and large[at] not in fresh:
                    meet(p, large[at], shared)
                large.insert(at, p)
        else:
            fresh = set(small)
            large = sorted(large + small)
            for i, j in zip(large, large[1:]):
                if (i in fresh) != (j in fresh):
                    meet(i, j, shared)
            members[a] = large
    return sorted(found, key=lambda run: (run[0], run[2]))


def _portion(texts: list[list[bytes]], min_length: int, min_exponent: int) -> tuple[list, list]:
    """Runs and collapsed text of each list of words."""
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.array([numbers.setdefault(w, len(numbers)) for words in texts for w in words], np.int64)
    ids += np.repeat(np.arange(len(texts)), sizes) * max(len(numbers), 1)
    starts = np.r_[0, np.cumsum(sizes)]
    runs: list[list[dict]] = [[] for _ in texts]
    for start, length, period in find_runs(ids, min_length, min_exponent):
        doc = int(np.searchsorted(starts, start, "right")) - 1
        runs[doc].append({"start": start - int(starts[doc]), "length": length, "period": period})
    kept = []
    for words, within in zip(texts, runs):
        if within:
            keep = np.ones(len(words), bool)
            for run in within:
                keep[run["start"] + run["period"] : run["start"] + run["length"]] = False
            words = [words[i] for i in np.nonzero(keep)[0].tolist()]
        kept.append(b" ".join(words))
    return runs, kept


def periodic_runs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed), one row per input row.

    A run is a stretch of words with smallest period q, at least `min_length` words and
    `min_exponent` * q long, that neither neighbouring word extends. Words are what stands between
    ASCII white space; runs are numbered by word and ordered by start, then period. `collapsed` is
    the words, joined by one space, without those that a run holds after its first q words.

    A null or empty text has no word, no run and an empty collapsed text. Repeated rows and rows
    without an id give one row each. Extra columns are ignored, and an empty table gives an empty
    table. A document is handled whole by one task, in O(n log² n) time and about 4 bytes a word and
    level of doubling.
    """
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            at, held, words = 0, 0, []
            for row in range(batch.num_rows):
                words.append((texts[row].as_py() or b"").split())
                held += len(words[-1])
                if held >= PORTION or row == batch.num_rows - 1:
                    runs, kept = _portion(words, min_length, min_exponent)
                    columns = [
                        ids.slice(at, len(words)),
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.array(runs, pa.list_(RUN)),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])
                    at, held, words = row + 1, 0, []

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, schema)
