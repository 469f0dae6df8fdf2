"""Spelling variants: words one code point apart, by a dictionary of trie-node pairs.

All distinct prefixes of the words are the nodes of a trie, all distinct suffixes those of the trie
of the reversed words. Both are numbered: words are sorted, and a word adds one node for each code
point beyond what it shares with the word before, so a range of sorted words numbers its nodes by
itself. The base of a range is the prefix sum of the counts before it, and the nodes on the path
that its first word shares with the range before take the numbers they have there.

A word with a gap in front of its code point i is the pair (node of the prefix, node of the suffix)
around the gap. A *cut* at i skips nothing, a *skip* at i leaves out code point i. Two words differ
by

* one replaced code point if they have a skip in common, at one place only;
* one inserted or deleted code point if a skip of the longer is a cut of the shorter. Within a
  repeat of a code point every skip is the same, so only the first one of a repeat counts here.

Equal pairs are therefore exact neighbours, each met once. At most one word has a given cut, and a
skip is shared by no more words than there are code points, so groups are bounded by the alphabet.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import ship_code
from pressgauge.session import stage

#: `[A-Za-zÀ-ÿ]+` over UTF-8 bytes with A-Z lower-cased.
RUNS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
ROOT = -1
CUT, FIRST_SKIP, LATER_SKIP = 0, 1, 2
#: Different words a task holds before it passes their counts on.
HELD_WORDS = 200_000

Alter = Callable[[int | None], Callable[[bytes], bytes]]


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, alter: Alter | None = None) -> DataFrame:
    """(word, n): maximal runs of letters up to U+00FF, A-Z lower-cased, with their occurrences in all texts.

    Words of fewer than `min_length` code points are left out. `alter(doc_id)` may give a function
    that every run of a document passes through. Null and empty texts have no word; rows without an
    id and repeated rows count like any other; an empty table gives an empty table.
    """
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def passed_on() -> pa.RecordBatch:
            words = pa.array(list(held.keys()), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for row in range(batch.num_rows):
                found = Counter(RUNS.findall((texts[row].as_py() or b"").lower()))
                change = alter(batch.column(0)[row].as_py()) if alter else None
                for word, n in found.items():
                    if len(word) >= min_length:
                        held[change(word) if change else word] += n
                if len(held) >= HELD_WORDS:
                    yield passed_on()
                    held.clear()
        if held:
            yield passed_on()

    counted = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "word string, n long")
    return counted.where(F.length("word") >= min_length).groupBy("word").agg(F.sum("n").alias("n"))


def _shared(a: str, b: str) -> int:
    """The length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a.startswith(b[low:middle], low):
            low = middle
        else:
            high = middle - 1
    return low


def trie_nodes(words: DataFrame) -> DataFrame:
    """(word, nodes): for every distinct `word` the numbers of its prefixes of 1, 2, … code points.

    Equal prefixes have equal numbers, different ones different numbers. Numbers of whole words grow
    with their code-point order. One row per range of words reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, path, count = TaskContext.get().partitionId(), "", np.zeros(0, np.int64), 0
        for batch in batches:
            words = batch.column(0).to_pylist()
            paths = []
            for word in words:
                shared = _shared(before, word)
                fresh = len(word) - shared
                path = np.concatenate([path[:shared], np.arange(count, count + fresh)])
                before, count = word, count + fresh
                paths.append(path)
            if words:
                ends = np.cumsum([0] + [len(p) for p in paths]).astype(np.int32)
                nodes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(paths)))
                ranges = pa.array(np.full(len(words), part, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), nodes, ranges], ["word", "nodes", "part"])

    spark = words.sparkSession
    ship_code(spark)
    ordered = words.select("word").repartitionByRange("word").sortWithinPartitions("word")
    local = stage(ordered.mapInArrow(run, "word string, nodes array<long>, part int"), "trie_ranges")
    ranges = local.groupBy("part").agg(
        F.min("word").alias("first"), F.max("word").alias("last"), F.max_by("nodes", "word").alias("path"),
        F.max(F.array_max("nodes")).alias("top"),
    )
    shifts, base, last, path = [], 0, "", []
    for r in sorted(ranges.collect(), key=lambda r: r["first"]):
        known = path[: _shared(last, r["first"])]
        shifts.append((r["part"], base, known))
        path = [known[x] if x < len(known) else base + x for x in r["path"]]
        last, base = r["last"], base + r["top"] + 1
    shift = F.broadcast(spark.createDataFrame(shifts, "part int, base long, known array<long>"))
    number = lambda x: F.when(x < F.size("known"), F.get("known", x.cast("int"))).otherwise(F.col("base") + x)
    return local.join(shift, "part").select("word", F.transform("nodes", number).alias("nodes"))


def _gaps(words: DataFrame) -> DataFrame:
    """(prefix, suffix, kind, word_id, n) for every cut and skip of `words(word, n, forward, backward)`."""
    size = F.size("forward")
    before = lambda i: F.when(i == 0, F.lit(ROOT).cast("long")).otherwise(F.get("forward", i - 1))
    behind = lambda i: F.when(i == size, F.lit(ROOT).cast("long")).otherwise(F.get("backward", size - i - 1))
    letter = lambda i: F.get("letters", i)
    skip = lambda i: F.when((i > 0) & (letter(i) == letter(i - 1)), LATER_SKIP).otherwise(FIRST_SKIP)
    row = lambda p, s, kind: F.struct(p.alias("prefix"), s.alias("suffix"), kind.cast("byte").alias("kind"))
    cuts = F.transform(F.sequence(F.lit(0), size), lambda i: row(before(i), behind(i), F.lit(CUT)))
    skips = F.transform(F.sequence(F.lit(0), size - 1), lambda i: row(before(i), behind(i + 1), skip(i)))
    split = words.select("forward", "backward", "n", F.get("forward", size - 1).alias("word_id"), F.split("word", "").alias("letters"))
    return split.select("word_id", "n", F.inline(F.concat(cuts, skips)))


def neighbours(gaps: DataFrame) -> DataFrame:
    """(word_id, n_near, best struct<less, word_id>) of every word that has a near one; `less` is minus its count."""
    member = F.struct("kind", F.struct((-F.col("n")).alias("less"), "word_id").alias("rank"))
    groups = gaps.groupBy("prefix", "suffix").agg(F.collect_list(member).alias("members")).where(F.size("members") > 1)
    ranks = lambda keep: F.transform(F.filter("members", keep), lambda m: m["rank"])
    groups = groups.select(
        "members",
        ranks(lambda m: m["kind"] == CUT).alias("cuts"),
        ranks(lambda m: m["kind"] == FIRST_SKIP).alias("firsts"),
        ranks(lambda m: m["kind"] != CUT).alias("skips"),
    )
    groups = groups.withColumns({"best": F.array_min("skips"), "best_first": F.array_min("firsts")})
    groups = groups.withColumn("second", F.array_min(F.filter("skips", lambda r: r["word_id"] != F.col("best.word_id"))))

    def met(m):
        other = F.when(m["rank"]["word_id"] == F.col("best.word_id"), F.col("second")).otherwise(F.col("best"))
        cut, none = F.get("cuts", F.lit(0)), F.lit(0)
        near = (
            F.when(m["kind"] == CUT, F.size("firsts"))
            .when(m["kind"] == FIRST_SKIP, F.size("skips") - 1 + F.size("cuts"))
            .otherwise(F.size("skips") - 1)
        )
        top = (
            F.when(m["kind"] == CUT, F.col("best_first"))
            .when(m["kind"] == FIRST_SKIP, F.array_min(F.array_compact(F.array(other, cut))))
            .otherwise(other)
        )
        return F.struct(m["rank"]["word_id"].alias("word_id"), near.alias("near"), F.when(near > none, top).alias("top"))

    rows = groups.select(F.inline(F.transform("members", met))).where("near > 0")
    return rows.groupBy("word_id").agg(F.sum("near").cast("long").alias("n_near"), F.min("top").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word_id, root_id): where following `forms(word_id, form_id)` ends.

    Each round doubles the steps taken. A form is `RATIO` times as frequent as its word, so chains
    are as long as the logarithm of the largest count at most.
    """
    current = stage(forms.select("word_id", F.col("form_id").alias("root_id")), "roots")
    while True:
        further = current.select(F.col("word_id").alias("root_id"), F.col("root_id").alias("further"))
        joined = current.join(further, "root_id", "left")
        moved = stage(joined.select("word_id", F.coalesce("further", "root_id").alias("root_id"), F.col("further").isNotNull().alias("moved")), "roots")
        current = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return current


def variant_groups(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of `counts(word, n)`; words are distinct and not empty.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. The
    form is the near word of largest n (ties: smallest in code-point order) if that n is at least
    `ratio` times the word's own, else null. The root is where the forms end, the word itself if it
    has none. Extra columns are ignored, null words left out; an empty table gives an empty table.
    """
    counts = stage(counts.where("word is not null").select("word", "n"), "words")
    forward = trie_nodes(counts).withColumnRenamed("nodes", "forward")
    reversed_ = trie_nodes(counts.select(F.reverse("word").alias("word")))
    backward = reversed_.select(F.reverse("word").alias("word"), F.col("nodes").alias("backward"))
    words = stage(counts.join(forward, "word").join(backward, "word"), "word_nodes")
    own = F.get("forward", F.size("forward") - 1)
    ids = words.select(own.alias("word_id"), "word", "n")
    near = neighbours(_gaps(words))
    best_n = -F.col("best.less")
    joined = ids.join(near, "word_id", "left").withColumn("fits", F.coalesce(best_n >= ratio * F.col("n"), F.lit(False)))
    judged = stage(
        joined.select(
            "word_id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(F.col("fits"), F.col("best.word_id")).alias("form_id"), F.when(F.col("fits"), best_n).alias("form_n"),
        ),
        "judged_words",
    )
    moved = judged.where("form_id is not null")
    named = moved.select("word_id", "form_id").join(_roots(moved), "word_id")
    name = lambda to: ids.select(F.col("word_id").alias(f"{to}_id"), F.col("word").alias(to))
    named = named.join(name("form"), "form_id").join(name("root"), "root_id").select("word_id", "form", "root")
    return judged.join(named, "word_id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT, ratio: int = RATIO, alter: Alter | None = None,
) -> DataFrame:
    """`variant_groups` of the words that occur `min_count` times or more in all texts; see `count_words`."""
    return variant_groups(count_words(docs, doc_id, text, min_length, alter).where(F.col("n") >= min_count), ratio)
