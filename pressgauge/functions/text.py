"""Text cleaning, keyword patterns, snippets, names."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressgauge.config import Topic

# Unicode white space plus the four separator control characters, as in Python's \s.
WHITESPACE = r"(?U)[\s\x{1c}-\x{1f}]+"

# Letters, digits and underscore of any script delimit a keyword.
WORD_CHAR = r"[\p{L}\p{N}_]"


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITESPACE, " "))


clean_text = collapse_whitespace


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    edge = WHITESPACE.removeprefix("(?U)")
    return F.regexp_replace(text, f"(?U)^{edge}|{edge}$", "")


def prefix(text: Column, length: int | None) -> Column:
    """The first `length` characters; the whole text without a length."""
    return text if length is None else F.substring(text, 1, length)


def keyword_pattern(terms: Sequence[str]) -> str:
    """One case-insensitive whole-word alternation of literal terms.

    A position whose letter starts no term is rejected by one plain character class, before any
    look-behind or case folding; the class lists every case variant of the first letters. Terms
    with the same first letter share a branch.
    """
    first, literal = _alternation(terms)
    return f"(?=[{first}])(?iu)(?<!{WORD_CHAR})(?:{literal})(?!{WORD_CHAR})"


def _alternation(terms: Sequence[str]) -> tuple[str, str]:
    """The letters that a term may start with, and the terms as alternatives."""
    if not terms:
        raise ValueError("a keyword list may not be empty")
    for term in terms:
        if not (re.match(r"\w", term) and re.search(r"\w\Z", term)):
            raise ValueError(f"keyword must start and end with a word character: {term!r}")
    heads: dict[str, list[str]] = {}
    for term in terms:
        heads.setdefault(term[0], []).append(term[1:])
    literal = "|".join(
        f"{head}(?:" + "|".join(rf"\Q{tail}\E" if tail else "" for tail in tails) + ")"
        for head, tails in heads.items()
    )
    return "".join(sorted({variant for head in heads for variant in case_variants(head)})), literal


@lru_cache
def case_variants(letter: str) -> tuple[str, ...]:
    """Characters equal to a letter when case is ignored, such as the long s for s."""
    everything = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    return tuple(re.findall(re.escape(letter), everything, re.IGNORECASE))


def has_keyword(text: Column, terms: Sequence[str]) -> Column:
    return F.coalesce(text, F.lit("")).rlike(keyword_pattern(terms))


def keywords_found(text: Column, *lists: Sequence[str]) -> Column:
    """The terms of all lists that a text holds as whole words, as many times as they stand there.

    One scan for all lists. Nothing is consumed, so terms may overlap; of terms that start at one
    place the longest is given (`any_found` knows what it implies).
    """
    terms = sorted({term for terms in lists for term in terms}, key=lambda term: (-len(term), term))
    first, literal = _alternation(terms)
    pattern = f"(?=[{first}])(?iu)(?<!{WORD_CHAR})(?=({literal})(?!{WORD_CHAR}))"
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)), _folded)


#: letters whose lower case is not that of the letter they equal when case is ignored, and that letter
SAME_LETTERS = ("\u017f\u212a\u0130\u0131\u03c2\u00b5", "skii\u03c3\u03bc")


def _folded(term: Column) -> Column:
    """Letters that are equal when case is ignored become one."""
    return F.lower(F.translate(term, *SAME_LETTERS))


def any_found(found: Column, terms: Sequence[str], *lists: Sequence[str]) -> Column:
    """Whether `found`, the result of `keywords_found` for `lists`, tells of one of `terms`.

    A found term holds each shorter one that it starts with, up to the end of a word.
    """
    words = [re.compile(re.escape(term) + r"(?!\w)", re.IGNORECASE) for term in terms]
    telling = sorted({t for each in lists for t in each if any(word.match(t) for word in words)} | set(terms))
    return F.arrays_overlap(found, F.array(*[_folded(F.lit(term)) for term in telling]))


def candidate_source(strong: Column, weak: Column, url: Column) -> Column:
    return (
        F.when(strong, "strong_keyword")
        .when(weak & url, "weak_keyword+url_section")
        .when(weak, "weak_keyword")
        .when(url, "url_section")
        .otherwise("")
    )


def clean_snippet(collapsed: Column, patterns: Sequence[str]) -> Column:
    """Drop boilerplate from white-space collapsed text, then stray punctuation at both ends.

    Patterns apply one after the other, to texts that may hold one of them at all.
    """
    dropped = collapsed
    for pattern in patterns:
        dropped = F.regexp_replace(dropped, f"(?iu){pattern}", "")
    kept = F.when(may_match(collapsed, patterns), F.regexp_replace(dropped, WHITESPACE, " ")).otherwise(collapsed)
    return F.trim(kept, F.lit(" -:;,."))


# Characters that equal an ASCII letter when case is ignored, but not after lower-casing.
ODD_CASE = ("\u017f", "\u212a", "\u0130", "\u0131")


def may_match(text: Column, patterns: Sequence[str]) -> Column:
    """False only where no pattern can match: a search for the literal starts of all patterns,
    many times cheaper than the patterns. True throughout if one has no literal start."""
    starts = [literal_start(pattern) for pattern in patterns]
    if not all(starts):
        return F.lit(bool(patterns))
    folded = F.lower(text)
    found = [F.contains(folded, F.lit(start)) for start in dict.fromkeys(starts)]
    found += [F.contains(text, F.lit(letter)) for letter in ODD_CASE]
    return reduce(or_, found, F.lit(False))


def literal_start(pattern: str) -> str:
    """Lower-case letters, digits and spaces every match of a pattern starts with."""
    outside = re.sub(r"\([^()]*\)", "", pattern)
    start = re.match(r"[A-Za-z0-9 ]*", pattern)[0]
    if "|" in outside:
        return ""
    if pattern[len(start) : len(start) + 1] in ("?", "*", "{"):
        start = start[:-1]
    return start.lower()


def opening(cleaned: Column) -> Column:
    """Text up to the first sentence end that is followed by white space."""
    return F.split(cleaned, r"(?<=[.!?])\s+", 2)[0]


def first_sentence(cleaned: Column, sentence: Column, min_chars: int = 40, max_chars: int = 220) -> Column:
    """The first sentence if its length fits, else the whole text, else its start with dots."""
    return (
        F.when(F.length(sentence).between(min_chars, max_chars), sentence)
        .when(F.length(cleaned) <= max_chars, cleaned)
        .otherwise(F.concat(F.rtrim(prefix(cleaned, max_chars - 3)), F.lit("...")))
    )


def region_key(name: Column) -> Column:
    """Join key of a place name: straight apostrophe, single spaces, lower case."""
    return F.lower(collapse_whitespace(F.replace(F.coalesce(name, F.lit("")), F.lit("’"), F.lit("'"))))


def topic_text(name: Column, description: Column, keywords: Column, examples: Column) -> Column:
    return F.concat_ws(
        "\n",
        name,
        description,
        F.concat(F.lit("Keywords: "), F.array_join(keywords, ", ")),
        F.concat(F.lit("Seed examples: "), F.array_join(examples, " ")),
    )


def topic_texts(topics: Sequence[Topic]) -> list[tuple[str, str, list[str], list[str]]]:
    """Rows of the topic dimension."""
    return [(t.name, t.description, list(t.keywords), list(t.seed_examples)) for t in topics]
