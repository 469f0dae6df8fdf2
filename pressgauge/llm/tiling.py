"""Benchmark decontamination by greedy string tiling.

A benchmark item and a document are compared as sequences of lower-case words. Runs of MIN_MATCH
equal words are the seeds; their rolling Karp-Rabin hashes are joined with those of the items, and
each hit is verified on the words. Adjacent hits form maximal matches. The longest match whose words
are still unmarked on both sides becomes a tile, again and again, until no match of MIN_MATCH words
is left. The share of an item's words that lie in tiles is its coverage, so a passage that was cut
up and put together in another order still counts.

Items are taken in blocks of bounded size, each sent to the tasks once, and every block meets every
whole document, so neither side has to be small. An item of fewer words than MIN_MATCH is a seed as a
whole. In scripts without spaces (Han, Kana, Thai, Lao, Burmese, Khmer) every letter is a word.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import ship_code, texts_of

MIN_MATCH = 5
MIN_COVERAGE = 0.5
BLOCK_CHARS = 8_000_000
#: hits are merged into matches in portions, so a text of one repeated word needs no more memory than others
HITS_AT_ONCE = 1_000_000

_WORD = re.compile(r"\w+")
_NO_SPACES = (
    "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff"
    "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
)
_LETTER = re.compile(f"[{_NO_SPACES}]")
_WORD_OR_LETTER = re.compile(rf"(?=\w)[{_NO_SPACES}]|[^\W{_NO_SPACES}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    low = text.lower()
    return (_WORD if low.isascii() or not _LETTER.search(low) else _WORD_OR_LETTER).findall(low)


def rolling_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of all runs of `size` numbers."""
    count = len(ids) - size + 1
    value = np.zeros(max(count, 0), np.uint64)
    for k in range(size if count > 0 else 0):
        value = value * _BASE + ids[k : k + count]
    return value


def tile(matches: list[tuple[int, int, int]], min_match: int, item_words: int = -1) -> list[tuple[int, int, int]]:
    """Tiles (length, document position, item position) out of maximal matches, longest first.

    Ties go to the first place in the document, then in the item. Ends where all of the item's
    `item_words` words are marked, if that number is given.
    """
    heap = [(-n, d, i) for n, d, i in matches]
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    tiles = []
    while heap and len(in_item) != item_words:
        n, d, i = heapq.heappop(heap)
        n = -n
        free = [d + k not in in_doc and i + k not in in_item for k in range(n)]
        if all(free):
            tiles.append((n, d, i))
            in_doc.update(range(d, d + n))
            in_item.update(range(i, i + n))
            continue
        start = None
        for k in range(n + 1):
            if k < n and free[k]:
                start = k if start is None else start
            elif start is not None:
                if k - start >= min_match:
                    heapq.heappush(heap, (start - k, d + start, i + start))
                start = None
    return tiles


def _joined(runs: np.ndarray) -> np.ndarray:
    """Rows (item, shift, start, length), sorted; those that continue each other become one."""
    if not len(runs):
        return runs
    item, shift, start, length = runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))].T
    goes_on = (item[1:] == item[:-1]) & (shift[1:] == shift[:-1]) & (start[1:] == start[:-1] + length[:-1])
    heads = np.nonzero(np.r_[True, ~goes_on])[0]
    return np.stack([item[heads], shift[heads], start[heads], np.add.reduceat(length, heads)], axis=1)


class Items:
    """A block of benchmark items, ready to be compared with documents.

    Items of fewer words than `min_match` are seeds as a whole if `short` is set, else they are never found.
    """

    def __init__(self, rows: list[tuple[int, str]], min_match: int = MIN_MATCH, short: bool = False):
        self.min_match = min_match
        self.ids = [item for item, _ in rows]
        self.number: dict[str, int] = {}
        self.words = [
            np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text or "")], np.uint64)
            for _, text in rows
        ]
        hashes = [rolling_hashes(w, min_match) for w in self.words]
        owner = np.repeat(np.arange(len(rows)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes] or [np.zeros(0, np.int64)])
        seeds = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner, self.place = seeds[order], owner[order], place[order]
        self.flat = np.concatenate(self.words or [np.zeros(0, np.uint64)])
        self.begin = np.cumsum([0, *map(len, self.words)])
        #: items of n < min_match words by n, with their numbers here
        self.short: list[tuple[list[int], Items]] = []
        for n in sorted({len(w) for w in self.words if short and 0 < len(w) < min_match}):
            at = [i for i, w in enumerate(self.words) if len(w) == n]
            self.short.append((at, Items([rows[i] for i in at], n)))

    def _runs(self, ids: np.ndarray) -> np.ndarray:
        """Rows (item, item position - document position, document position, hits): adjacent verified seeds."""
        size = self.min_match
        known = ids != 0
        run = np.cumsum(np.r_[0, ~known])
        at = np.nonzero(run[size:] == run[: len(run) - size])[0]
        value = rolling_hashes(ids, size)[at]
        first = np.searchsorted(self.seeds, value, "left")
        count = np.searchsorted(self.seeds, value, "right") - first
        at, first, count = at[count > 0], first[count > 0], count[count > 0]
        total, low, parts = np.r_[0, np.cumsum(count)], 0, []
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(total, total[low] + HITS_AT_ONCE, "right")) - 1)
            n = count[low:high]
            d = np.repeat(at[low:high], n)
            k = np.arange(len(d)) + np.repeat(first[low:high] - (total[low:high] - total[low]), n)
            item, i = self.owner[k], self.place[k]
            same = np.ones(len(d), bool)
            for j in range(size):
                same &= ids[d + j] == self.flat[self.begin[item] + i + j]
            hits = np.stack([item, i - d, d, np.ones(len(d), np.int64)], axis=1)[same]
            parts.append(_joined(hits))
            low = high
        return _joined(np.concatenate(parts)) if parts else np.zeros((0, 4), np.int64)

    def compare(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, words, covered words, tiles) for every item that shares a seed with the text."""
        words = words_of(text)
        short = [(at[i], *rest) for at, items in self.short for i, *rest in items.compare_words(words)]
        return self.compare_words(words) + short

    def compare_words(self, words: list[str]) -> list[tuple[int, int, int, int]]:
        """The same for a text's words, by seeds of `min_match` words only."""
        if len(words) < self.min_match or not len(self.seeds):
            return []
        number = self.number.get
        matches: dict[int, list[tuple[int, int, int]]] = {}
        for item, shift, d, n in self._runs(np.array([number(w, 0) for w in words], np.uint64)).tolist():
            matches.setdefault(item, []).append((n + self.min_match - 1, d, d + shift))
        result = []
        for item, found in matches.items():
            tiles = tile(found, self.min_match, len(self.words[item]))
            result.append((item, len(self.words[item]), sum(n for n, _, _ in tiles), len(tiles)))
        return result


def item_blocks(benchmark: DataFrame, item_id: str, text: str, min_match: int) -> Iterator[Items]:
    """The items in blocks of about BLOCK_CHARS characters, one block in memory at a time."""
    ship_code(benchmark.sparkSession)
    rows = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS)
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        yield Items([(r["item_id"], r["text"]) for r in sorted(part, key=lambda r: (str(r["item_id"]), r["text"]))], min_match, short=True)


def leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, tiles, coverage) where the coverage reaches `min_coverage`.

    A document appears once per item that it leaks, a clean one not at all. Null texts on either
    side count as empty. Repeated rows give repeated results; ids may be null. Extra columns are ignored.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, item_words int, covered_words int, tiles int, coverage double"
    narrow = docs.select(F.col(doc_id).cast("long"), F.col(text))
    found = []
    for items in item_blocks(benchmark, item_id, item_text, min_match):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                rows = [
                    (doc, items.ids[item], total, covered, tiles, covered / total)
                    for doc, value in zip(batch.column(0).to_pylist(), texts_of(batch, 1))
                    for item, total, covered, tiles in items.compare(value)
                    if covered >= min_coverage * total
                ]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

        found.append(narrow.mapInArrow(run, schema))
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)


def is_leak(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE,
) -> Column:
    """A boolean column over `docs`: the text covers some item by at least `min_coverage`."""
    verdict = F.lit(False)
    for items in item_blocks(benchmark, item_id, item_text, min_match):
        sent = docs.sparkSession.sparkContext.broadcast(items)
        verdict = verdict | _covers(sent, min_coverage)(F.col(text))
    return verdict


def _covers(sent, min_coverage: float):
    @F.arrow_udf("boolean")
    def covers(texts: pa.Array) -> pa.Array:
        items = sent.value
        hit = [any(c >= min_coverage * n for _, n, c, _ in items.compare(t or "")) for t in texts.to_pylist()]
        return pa.array(hit, pa.bool_())

    return covers
