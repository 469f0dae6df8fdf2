"""Repeated runs of lines, found by winnowing, in DataFrame functions only.

A line is hashed after trimming and lower-casing; blank lines do not count. A window is a shortest
sequence of lines, from a given line on or up to a given line, that holds at least MIN_WORDS words:
mostly one line, with a neighbour or more where lines are shorter than that. Each window selects the smallest of its line hashes as its fingerprint. Two equal windows select the
same fingerprint, so a repeated line of MIN_WORDS words or more, or a repeated run of shorter ones that
holds as many, is sure to share one. A shorter line that is repeated by itself stays; everything whose
fingerprint occurs at a single place is out after one aggregation.

The positions of repeated fingerprints are joined with the windows that selected them, forwards and
backwards, and equal windows are matched with their first occurrence. Overlapping matched windows
chain into the whole repeated run in both directions: the forward window of its first line, the
backward window of its last, and those between cover it. All occurrences but the first, in the order
of id, text hash and line, are deleted.

Every step groups by hash with partial aggregation or is a plain equi-join, so a line that a third of
all documents share is spread over many tasks. No pair of occurrences is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.session import stage

#: Lines of fewer words than this ("Yes.") count with their neighbours only.
MIN_WORDS = 4


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _units(text: Column) -> Column:
    """Non-blank lines as struct(line, h, words, chars); words are separated by single spaces."""
    folded = lambda x: F.lower(F.btrim(x, F.lit(" \t\r\f\x0b")))
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    units = F.transform(
        F.transform(_lines(text), folded),
        lambda x, i: F.struct(
            i.alias("line"), F.xxhash64(x).alias("h"), (spaces(x) + 1).alias("words"), F.length(x).alias("chars")
        ),
    )
    return F.filter(units, lambda u: u["chars"] > 0)


def _windows(units: Column, min_words: int) -> Column:
    """All forward and backward windows as struct(first, last, at, fp, seen, chars).

    A line holds a word at least, so no window has more than `min_words` lines.
    """
    zero = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"))
    grow = lambda a, u: F.when(a["words"] >= min_words, a).otherwise(
        F.struct((a["words"] + u["words"]).alias("words"), (a["n"] + 1).alias("n"))
    )
    count = lambda part: F.aggregate(part, zero, grow, lambda a: F.when(a["words"] >= min_words, a["n"]))
    size = F.size(units)

    def forward(i: Column) -> Column:
        n = count(F.slice(units, i, F.lit(min_words)))
        return F.struct(i.alias("i"), n.alias("n"))

    def backward(i: Column) -> Column:
        low = F.greatest(i - (min_words - 1), F.lit(1))
        n = count(F.reverse(F.slice(units, low, i - low + 1)))
        return F.struct((i - n + 1).alias("i"), n.alias("n"))

    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    cuts = F.array_union(F.transform(places, forward), F.transform(places, backward))
    cuts = F.filter(cuts, lambda c: c["n"].isNotNull())

    def window(c: Column) -> Column:
        inside = F.slice(units, c["i"], c["n"])
        hashes = F.transform(inside, lambda u: u["h"])
        smallest = F.array_min(F.transform(inside, lambda u: F.struct(u["h"].alias("h"), u["line"].alias("line"))))
        return F.struct(
            F.get(inside, 0)["line"].alias("first"),
            F.get(inside, c["n"] - 1)["line"].alias("last"),
            smallest["line"].alias("at"),
            smallest["h"].alias("fp"),
            F.xxhash64(hashes).alias("seen"),
            F.aggregate(inside, F.lit(0), lambda a, u: a + u["chars"]).alias("chars"),
        )

    return F.transform(cuts, window)


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, lines): sorted numbers, from 0, of the lines to delete; only rows that have some."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), _units(F.col(text)).alias("units"))
    windows = rows.select("doc_id", "text_hash", F.inline(_windows(F.col("units"), min_words)))
    windows = stage(windows, "windows")
    place = F.struct("doc_id", "text_hash", "at")
    spots = windows.groupBy("fp").agg(F.min(place).alias("one"), F.max(place).alias("other"))
    seeds = stage(spots.where("one <> other").select("fp"), "seeds")
    matched = windows.join(seeds, "fp")
    begin = F.struct("doc_id", "text_hash", "first")
    firsts = matched.groupBy("fp", "seen", "chars").agg(F.min(begin).alias("origin"), F.max(begin).alias("final"))
    firsts = stage(firsts.where("origin <> final").select("fp", "seen", "chars", "origin"), "origins")
    later = windows.join(firsts, ["fp", "seen", "chars"]).where(begin > F.col("origin"))
    numbers = F.flatten(F.collect_set(F.sequence("first", "last")))
    return later.groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(numbers)).alias("lines"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, deleted, text): the text without later repeated runs of lines, one row per input row.

    `deleted` holds runs as struct(first, last). Lines are split at line feeds. A null text counts as
    empty and gives an empty text. Rows with equal id and text are one document and get the same result. A missing
    id comes before all others. Extra columns are ignored; an empty table gives an empty table.
    """
    cuts = stage(repeated_lines(docs, doc_id, text, min_words), "cuts").withColumnsRenamed({"doc_id": "_cut_id", "text_hash": "_cut_hash"})
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.xxhash64(F.col(text)).alias("_hash"))
    # the cuts grow with the texts, so they are never broadcast; texts move once
    joined = rows.join(cuts.hint("merge"), rows["doc_id"].eqNullSafe(F.col("_cut_id")) & (F.col("_hash") == F.col("_cut_hash")), "left")
    gone = F.coalesce("lines", F.array().cast("array<int>"))
    split = joined.select("doc_id", "_text", gone.alias("gone"), F.split("_text", "\n").alias("_lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "gone")
    starts = F.filter("gone", lambda x, i: (i == 0) | (F.get("gone", i - 1) != x - 1))
    ends = F.filter("gone", lambda x, i: (i == F.size("gone") - 1) | (F.get("gone", i + 1) != x + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    clean = F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")
    return split.select(
        "doc_id", F.size("_lines").alias("n_lines"), runs.alias("deleted"),
        F.when(F.size("gone") == 0, F.col("_text")).otherwise(clean).alias("text"),
    )
