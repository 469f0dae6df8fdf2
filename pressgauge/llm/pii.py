"""Personal data in texts, disguised or not, with positions in the source text.

Plain identifiers are found in the text as it stands. Then a chain of small transducers rewrites the
text: look-alike characters to the plain ones, `at` and `dot` disguises to the signs, spelled digits
to digits. Every character that a transducer puts out remembers the span of source characters it
stands for, so identifiers found in the rewritten text are mapped back to the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import over_batches, ship_code, texts_of

# --- fixed values: kinds, patterns, look-alikes, number words -----------------------------------
KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CYRILLIC = dict(zip("аеорсухіјѕԁһɡАВЕКМНОРСТУХІЈЅ", "aeopcyxijsdhgABEKMHOPCTYXIJS"))
GREEK = dict(zip("οανιρυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavipuxABEZHIKMNOPTYX"))
SIGNS = {"․": ".", "。": ".", "．": ".", "＠": "@", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-"}
HIDDEN = "­​‌‍⁠﻿"
AT_WORDS = "at|arroba|arobase"
DOT_WORDS = "dot|punkt|point|punto"
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4",
    "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "cero": "0", "uno": "1", "dos": "2",
    "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9", "zéro": "0",
    "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
#: words that stand for two digits, and words that repeat the digit after them
TENS = {"ten": "10", "zehn": "10", "dix": "10", "diez": "10"}
REPEATS = {"double": 2, "triple": 3}
AT_CODES = "&#0{0,3}64;|&#x0{0,3}40;|&commat;|%40"
DOT_CODES = "&#0{0,3}46;|&#x0{0,3}2e;|&period;"
#: how a host may end where neither `at` nor `dot` is marked as a sign by anything but its words
TOP_DOMAINS = (
    "com|org|net|edu|gov|mil|int|info|biz|name|io|ai|app|dev|tv|co|eu|uk|ie|de|ch|fr|nl|lu|es|pt|se|dk|fi|pl|cz|sk|hu|"
    "ro|bg|gr|ru|ua|tr|ca|mx|br|ar|cl|au|nz|cn|jp|kr|sg|hk|za|example|test|invalid|local"
)
#: those that are words as well; not after `point`, which is a word itself
TOP_WORDS = "in|at|is|me|no|be|it|us"
# -----------------------------------------------------------------------------------------------

Span = tuple[str, int, int]

_LOCAL_END = re.compile(f"[{LOCAL}]*$")
_DOMAIN = re.compile(DOMAIN)
_DIGITS = re.compile("[0-9]+")
_CARD = re.compile(CARD)
_PHONE = re.compile(PHONE)


# --- plain identifiers --------------------------------------------------------------------------


def _local_start(text: str, end: int, free: int = 0) -> int:
    """Where the signs of a local part that lead up to `end` begin, from `free` on."""
    while end > free and (c := text[end - 1]).isascii() and (c.isalnum() or c in "._%+-"):
        end -= 1
    return end


def emails(text: str) -> list[Span]:
    """From each @ outwards, so that time is linear in the text."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = _local_start(text, at, free)
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    return found


def addresses(text: str) -> list[Span]:
    """Four runs of digits joined by dots; runs are chained first, so long runs are read once."""
    if text.count(".") < 3:
        return []
    found, chain = [], []
    for m in _DIGITS.finditer(text):
        start, end = m.span()
        if chain and not (text[chain[-1][1]] == "." and chain[-1][1] + 1 == start):
            chain = []
        chain.append((start, end))
        if len(chain) == 4:
            if all(b - a < 10 and int(text[a:b]) <= 255 or not text[a:b].lstrip("0") or _small(text[a:b]) for a, b in chain):
                found.append(("ip", chain[0][0], end))
            chain = []
            # a match ends here; the next one starts at a digit of its own
    return found


def _small(digits: str) -> bool:
    rest = digits.lstrip("0")
    return len(rest) <= 3 and int(rest or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            digits = "".join(c for c in m.group() if c.isdigit())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    return found


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m.group())) <= 15]


def identifiers(text: str) -> list[Span]:
    return emails(text) + addresses(text) + cards(text) + phones(text)


# --- transducers --------------------------------------------------------------------------------


class Traced:
    """A text whose characters know their span of the source."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text = text
        self.starts = list(range(len(text))) if starts is None else starts
        self.ends = [i + 1 for i in range(len(text))] if ends is None else ends

    def rewrite(self, pattern: re.Pattern, output: Callable[[re.Match], list[tuple[str, int, int]]]) -> Traced:
        """Replaces each match by characters, each with the part of this text that it stands for."""
        text, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            text.append(self.text[at : m.start()])
            starts += self.starts[at : m.start()]
            ends += self.ends[at : m.start()]
            for char, a, b in output(m):
                text.append(char)
                starts.append(self.starts[a])
                ends.append(self.ends[b - 1])
            at = m.end()
        if not at:
            return self
        return Traced("".join(text) + self.text[at:], starts + self.starts[at:], ends + self.ends[at:])

    def source(self, span: Span) -> Span:
        kind, a, b = span
        return kind, self.starts[a], self.ends[b - 1]


def plain_character(char: str) -> str:
    """What a look-alike stands for; the character itself if nothing."""
    if char in HIDDEN:
        return ""
    known = CYRILLIC.get(char) or GREEK.get(char) or SIGNS.get(char)
    if known:
        return known
    if char.isdecimal():
        return str(unicodedata.digit(char))
    folded = unicodedata.normalize("NFKC", char)
    return folded if len(folded) == 1 and folded.isascii() else char


_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_GAP = r"[\x20,-]{1,2}"
_OPEN, _CLOSE, _PAD = r"[(\[{<]\x20?", r"\x20?[)\]}>]", r"\x20{0,2}"
_LOOKALIKE = re.compile(r"[^\x00-ɏ]|[\xa0\xad\xb2\xb3\xb9]")
_BOXED_AT = re.compile(rf"{_PAD}{_OPEN}(?:{AT_WORDS}|@){_CLOSE}{_PAD}", re.I)
_BOXED_DOT = re.compile(rf"{_PAD}{_OPEN}(?:{DOT_WORDS}|\.){_CLOSE}{_PAD}", re.I)
_ANY_DOT = rf"\x20{{1,2}}(?:{DOT_WORDS}|\.)\x20{{1,2}}"
_BARE_AT = re.compile(
    rf"(?<=[A-Za-z0-9])\x20{{1,2}}(?:{AT_WORDS}|@)\x20{{1,2}}"
    rf"(?=(?:[A-Za-z0-9.-]++{_ANY_DOT}){{1,8}}(?<!point\x20)(?<!point\x20\x20)(?:{TOP_DOMAINS}|{TOP_WORDS})(?![\w-])"
    rf"|(?:[A-Za-z0-9.-]++{_ANY_DOT}){{1,8}}(?:{TOP_DOMAINS})(?![\w-]))",
    re.I,
)
_CODED_AT = re.compile(rf"\x20?(?:{AT_CODES})\x20?(?=[A-Za-z0-9-]++(?:\.|{DOT_CODES}|{_ANY_DOT}|[(\[{{<])[A-Za-z]?)", re.I)
_CODED_DOT = re.compile(DOT_CODES, re.I)
#: signs as words between underscores or hyphens: name_at_host_dot_com
_JOINED = re.compile(
    rf"(?<=[A-Za-z0-9])(?:_(?:{AT_WORDS})_(?:[A-Za-z0-9-]{{1,63}}_(?:{DOT_WORDS})_){{1,4}}"
    rf"|-(?:{AT_WORDS})-(?:[A-Za-z0-9]{{1,63}}-(?:{DOT_WORDS})-){{1,4}})(?=[A-Za-z]{{2}})",
    re.I,
)
_JOINED_SIGN = re.compile(rf"([_-])(?:({AT_WORDS})|{DOT_WORDS})\1", re.I)
_BOXED_DIGIT = re.compile(rf"(?<=[0-9\x20])[(\[](?:{_WORDS})[)\]](?=\x20?[0-9])", re.I)
_COUNT = rf"(?:(?:{'|'.join(REPEATS)})\x20)?(?:{_WORDS})"
_PART = rf"(?:[0-9]{{1,3}}|{'|'.join(TENS)}|{_COUNT}(?:[\x20-]{_COUNT}){{0,2}})"
#: four numbers with dots between, of which any may be spelled
_CHAIN = re.compile(rf"(?<![\w.]){_PART}(?:\x20{{1,2}}(?:{DOT_WORDS})\x20{{1,2}}{_PART}){{3}}(?!\w)", re.I)
_CHAIN_SIGN = re.compile(rf"\x20{{1,2}}(?:{DOT_WORDS})\x20{{1,2}}|[0-9]|(?:{'|'.join(TENS)})(?!\w)|{_COUNT}(?!\w)", re.I)
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])\x20{1,2}@\x20{1,2}(?=[A-Za-z0-9-]++\.[A-Za-z])")
_BARE_DOT = re.compile(rf"(?<=[A-Za-z0-9]){_ANY_DOT}(?=[A-Za-z0-9])", re.I)
_SPELLED = re.compile(rf"(?<!\w)(?:(?:plus|\+){_GAP})?(?:{_WORDS})(?:{_GAP}(?:{_WORDS})(?!\w)){{2,}}(?!\w)", re.I)
_SPELLED_DOT = re.compile(rf"(?<=[0-9])\x20{{1,2}}(?:{DOT_WORDS})\x20{{1,2}}(?=[0-9])", re.I)
_DIGIT_WORD = re.compile(rf"(?:{_WORDS})(?!\w)|plus|\+", re.I)
#: a run of digits of which some are spelled; single gaps, as plain numbers have them
_MIXED = re.compile(rf"(?<!\w)(?:(?:plus|\+)\x20?)?(?:(?:{_COUNT}|[0-9]+)[\x20-]){{2,}}(?:{_COUNT}|[0-9]+)(?!\w)", re.I)
_RUN_WORD = re.compile(rf"(?<!\w)(?:{_COUNT}|plus)(?!\w)", re.I)
_HOST = re.compile(r"[A-Za-z0-9.-]*")
#: letters that ignoring case takes for i and s, beside the capitals
_FOLDED = str.maketrans("ıİſ", "iis")
# what tells, in a folded text, that a transducer may have work, never less than it can rewrite; each starts with a set of characters
_ANY_AT = re.compile(rf"\x20(?:{AT_WORDS}|@)\x20{{1,2}}[a-z0-9.-]++{_ANY_DOT}")
_AFTER_WORD = re.compile(rf"(?:{_WORDS}|plus|{'|'.join(TENS)})(?:{_GAP}(?:{_WORDS})(?!\w)|\x20{{1,2}}(?:{DOT_WORDS})\x20)")
_REPEATED = re.compile(rf"(?:{'|'.join(REPEATS)})\x20(?:{_WORDS})")
_AT_JOINED = re.compile(rf"[_-](?:{AT_WORDS})[_-]")
_AFTER_DIGIT = re.compile(rf"[0-9](?:[\x20-](?:{_WORDS})(?!\w)|\x20{{1,2}}(?:{DOT_WORDS})\x20{{1,2}}(?:[0-9]|(?:{_WORDS})(?!\w)))")


def _folded(text: str) -> str:
    """Lower-cased as far as patterns that ignore case see it."""
    return text.lower() if text.isascii() else text.translate(_FOLDED).lower()


def _sign(char: str):
    return lambda m: [(char, m.start(), m.end())]


def _digits(m: re.Match) -> list[tuple[str, int, int]]:
    """The words of a run as digits without gaps."""
    found = []
    for w in _DIGIT_WORD.finditer(m.string, m.start(), m.end()):
        word = _folded(w.group())
        found.append(("+" if word in ("plus", "+") else DIGIT_WORDS[word], *w.span()))
    return found


def _counted(w: re.Match) -> list[tuple[str, int, int]]:
    """A spelled number as digits: a digit word, one that is repeated, or a word for two digits."""
    head, _, word = _folded(w.group()).rpartition(" ")
    if word in TENS:
        return [(c, *w.span()) for c in TENS[word]]
    return [(DIGIT_WORDS.get(word, "+"), *w.span())] * REPEATS.get(head, 1)


def _chain(m: re.Match) -> list[tuple[str, int, int]]:
    """The numbers of an address as digits, with dots between."""
    found = []
    for w in _CHAIN_SIGN.finditer(m.string, m.start(), m.end()):
        sign = w.group()
        if sign.isdigit():
            found.append((sign, *w.span()))
        else:
            found += [(".", *w.span())] if sign[0] == " " else _counted(w)
    return found


def _joined(m: re.Match) -> list[tuple[str, int, int]]:
    found, at = [], m.start()
    for w in _JOINED_SIGN.finditer(m.string, m.start(), m.end()):
        found += [(m.string[i], i, i + 1) for i in range(at, w.start())]
        # the first sign is the @, a later `at` is a part of the host
        found.append(("@" if w.start() == m.start() else ".", *w.span()))
        at = w.end()
    return found + [(m.string[i], i, i + 1) for i in range(at, m.end())]


def _mixed(m: re.Match) -> list[tuple[str, int, int]]:
    """Spelled digits as digits, all else as it is; nothing changes in a run of one spelled digit or none."""
    words = {w.start(): w for w in _RUN_WORD.finditer(m.string, m.start(), m.end())}
    spelled = sum(len(_counted(w)) for w in words.values())
    found, at = [], m.start()
    while at < m.end():
        if spelled > 1 and (w := words.get(at)):
            found += _counted(w)
            at = w.end()
            if _folded(w.group()) == "plus":
                at += 1  # its gap
        else:
            found.append((m.string[at], at, at + 1))
            at += 1
    return found


def _email_dots(traced: Traced) -> Traced:
    """`dot` next to an @ or to a converted one, on either side, as long as the chain goes on."""
    text = traced.text
    dots = [m.span() for m in _BARE_DOT.finditer(text)]
    if not dots:
        return traced
    after, before, wanted = dict(dots), {b: a for a, b in dots}, set()
    # chains end at the next @, so each is walked twice at most
    for at in (i for i, c in enumerate(text) if c == "@"):
        low, high = _local_start(text, at), _HOST.match(text, at + 1).end()
        if low == at or high == at + 1:
            continue
        while low in before:
            wanted.add((before[low], low))
            low = _local_start(text, before[low])
        while high in after:
            wanted.add((high, after[high]))
            high = _HOST.match(text, after[high]).end()
    if not wanted:
        return traced
    keep = lambda m: [(".", *m.span())] if m.span() in wanted else [(c, m.start() + i, m.start() + i + 1) for i, c in enumerate(m.group())]
    return traced.rewrite(_BARE_DOT, keep)


def _suspicious(text: str) -> bool:
    """Whether any transducer could change the text."""
    if not text.isascii() and _LOOKALIKE.search(text):
        return True
    low = _folded(text)
    if any(x in text for x in "([{<") and (_BOXED_AT.search(text) or _BOXED_DOT.search(text)):
        return True
    if _ANY_AT.search(low) or ("@" in text and (_BARE_DOT.search(low) or _SPACED_AT.search(low))):
        return True
    if ("&" in text or "%" in text) and (_CODED_AT.search(text) or _CODED_DOT.search(text)):
        return True
    if _AT_JOINED.search(low) or ("(" in text or "[" in text) and _BOXED_DIGIT.search(text):
        return True
    return bool(_AFTER_DIGIT.search(low) or _AFTER_WORD.search(low) or _REPEATED.search(low))


def deobfuscate(text: str) -> Traced:
    traced = Traced(text)
    traced = traced.rewrite(_LOOKALIKE, lambda m: [(c, *m.span()) for c in plain_character(m.group())])
    traced = traced.rewrite(_CODED_AT, _sign("@")).rewrite(_CODED_DOT, _sign(".")).rewrite(_JOINED, _joined)
    traced = traced.rewrite(_BOXED_AT, _sign("@")).rewrite(_BOXED_DOT, _sign("."))
    traced = traced.rewrite(_BARE_AT, _sign("@")).rewrite(_SPACED_AT, _sign("@"))
    if "@" in traced.text:
        traced = _email_dots(traced)
    traced = traced.rewrite(_BOXED_DIGIT, lambda m: [(DIGIT_WORDS[_folded(m.group()[1:-1])], *m.span())])
    traced = traced.rewrite(_CHAIN, _chain)
    return traced.rewrite(_MIXED, _mixed).rewrite(_SPELLED, _digits).rewrite(_SPELLED_DOT, _sign("."))


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(plain spans, further spans of disguised identifiers).

    A further span may hold a plain one that is only a part of the identifier, as where a look-alike stands
    in the local part of an address. It never lies within a plain span of its kind.
    """
    rank = {k: i for i, k in enumerate(KINDS)}
    order = lambda s: (s[1], rank[s[0]], s[2])
    base = sorted(identifiers(text), key=order)
    if not _suspicious(text):
        return base, []
    traced = deobfuscate(text)
    more = []
    taken = {k: sorted((a, b) for kind, a, b in base if kind == k) for k in KINDS}
    for span in identifiers(traced.text):
        kind, a, b = traced.source(span)
        at = bisect_right(taken[kind], (a, len(text)))
        if at == 0 or taken[kind][at - 1][1] < b:
            more.append((kind, a, b))
    return base, sorted(more, key=order)


# --- tables -------------------------------------------------------------------------------------

SPANS = "array<struct<kind:string,start:long,end:long,disguised:boolean>>"


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) per row: kind, start, end (code points, end exclusive), whether disguised.

    Spans are in the order of start, then kind. Null texts count as empty and have no span. Repeated
    rows, null ids and extra columns change nothing; an empty table gives an empty table.
    """
    ship_code(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())]))
    rank = {k: i for i, k in enumerate(KINDS)}

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in texts_of(batch, 1):
            base, more = find(text)
            both = [(*s, False) for s in base] + [(*s, True) for s in more]
            both.sort(key=lambda s: (s[1], rank[s[0]], s[2]))
            rows.append([dict(zip(("kind", "start", "end", "disguised"), s)) for s in both])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(over_batches(make), f"doc_id long, spans {SPANS}")
