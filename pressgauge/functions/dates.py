"""Dates. The session time zone is UTC (see `session.use_utc`)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressgauge.functions.text import strip

# --- fixed values: written forms of dates -------------------------------------------------------
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
MONTH = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
WEEKDAY = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[.,]?\s+"
ORDINAL = r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\b"
#: names of zones in dates; other zones are written as offsets or region names
ZONES = {
    "UTC": "+00:00", "GMT": "+00:00", "Z": "+00:00", "BST": "+01:00", "CET": "+01:00", "CEST": "+02:00", "EST": "-05:00",
    "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
}
#: two-digit years below this are of this century
PIVOT = 69
# -----------------------------------------------------------------------------------------------

_REST = r"(?![\d/.-])(.*)$"
#: Forms with a month's name, which stands as its number between two signs, to year-month-day.
NAMED_FORMS = (
    (r"^(\d{1,2})[ -]*#(\d+)#[ -]*(\d{4})" + _REST, "$3-$2-$1$4"),
    (r"^#(\d+)# *(\d{1,2}) +(\d{1,2}:\d\d(?::\d\d)?) *([+-]\d\d:?\d\d)? *(\d{4})$", "$5-$1-$2 $3$4"),
    (r"^#(\d+)#[ -]*(\d{1,2})[ -]+(\d{4})" + _REST, "$3-$1-$2$4"),
    (r"^(\d{4})[ -]*#(\d+)#[ -]*(\d{1,2})" + _REST, "$1-$2-$3$4"),
    (r"^#(\d+)#[ -]*(\d{4})$", "$2-$1-1"),
)
#: Forms of digits that begin with the year.
YEAR_FORMS = (
    (r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3"),
    (r"^(\d{4})(\d\d)(\d\d)T?(\d\d)(\d\d)(\d\d)?$", "$1-$2-$3 $4:$5:0$6"),
    (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})" + _REST, "$1-$2-$3$4"),
    (r":0(\d\d)$", ":$1"),
    (r":0$", ":00"),
)
NUMBERS = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})" + _REST
AFTERNOON = r"(?i)^(.*?\d) +(\d{1,2}):(\d\d)(:\d\d)? *([ap])\.?m\.?$"

MICROS_PER_DAY = 86_400_000_000


def _rewritten(written: Column, forms: tuple[tuple[str, str], ...]) -> Column:
    for pattern, order in forms:
        written = F.regexp_replace(written, pattern, order)
    return written


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _tidy(written: Column) -> Column:
    """Single spaces, no commas, weekdays or ordinals, zones as offsets that follow the time."""
    offsets = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])

    def with_offset(plain: Column) -> Column:
        zone = offsets[F.upper(F.regexp_extract(plain, r"(?i)\d ?([a-z]{1,4})$", 1))]
        moved = lambda offset: F.when(offset.isNull(), plain).otherwise(F.concat(F.regexp_replace(plain, r" ?[A-Za-z]{1,4}$", ""), offset))
        return F.regexp_replace(_bound(zone, moved), r"(\d) ([+-]\d\d:?\d\d)$", "$1$2")

    return _bound(_rewritten(written, ((r",|\s+", " "), (r" +", " "), (WEEKDAY, ""), (ORDINAL, "$1"))), with_offset)


def _by_clock(written: Column) -> Column:
    """Hours of the afternoon as a clock of 24 hours shows them."""
    group = lambda i: F.regexp_extract(written, AFTERNOON, i)
    hour = group(2).try_cast("int") % 12 + F.when(F.lower(group(5)) == "p", 12).otherwise(0)
    clock = F.concat(group(1), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), group(3), group(4))
    return F.when(written.rlike(AFTERNOON), F.when(group(2).try_cast("int").between(1, 12), clock)).otherwise(written)


def _number_pairs(written: Column) -> Column:
    """Dates that end with the year: month first, day first only if that is no date."""
    year = F.regexp_extract(written, NUMBERS, 3)
    century = F.when(F.length(year) == 4, "").when(year.try_cast("int") < PIVOT, "20").otherwise("19")
    in_order = lambda order: F.concat(century, F.regexp_replace(written, NUMBERS, order)).try_cast("timestamp")
    return F.coalesce(in_order("$3-$1-$2$4"), in_order("$3-$2-$1$4"))


def parse_timestamp(text: Column) -> Column:
    """Timestamp of a string, null if it cannot be read. Times without a date do not count.

    Strings that the engine reads as they are cost one cast. All others are brought to its form by
    patterns for their kind, so that no reading fails on the way and nothing is tried twice.
    """
    plain = strip(text)
    direct = F.when(plain.rlike(r"^\d{4}"), plain).try_cast("timestamp")

    def other(tidy: Column) -> Column:
        month = F.lower(F.regexp_extract(tidy, MONTH, 1))
        number = ((F.instr(F.lit(MONTHS), month) + 2) / 3).cast("int").cast("string")
        named = F.regexp_replace(tidy, F.lit(MONTH), F.concat(F.lit("#"), number, F.lit("#")))
        return (
            F.when(tidy.rlike(MONTH), F.when(tidy.rlike(r"\d{4}"), _rewritten(named, NAMED_FORMS).try_cast("timestamp")))
            .when(tidy.rlike(r"^\d{4}"), _rewritten(tidy, YEAR_FORMS).try_cast("timestamp"))
            .when(tidy.rlike(r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{2}"), _number_pairs(tidy))
        )

    tidied = _bound(_tidy(plain), lambda tidy: _bound(_by_clock(tidy), other))
    return F.coalesce(direct, F.when(plain.rlike(r"\d"), tidied))


def is_multi_value(text: Column) -> Column:
    return F.contains(F.coalesce(text, F.lit("")), F.lit(";"))


def first_of_many(text: Column) -> Column:
    """The smallest part, as a string, of a value that lists several dates split by ';'."""
    parts = F.transform(F.split(text, ";"), strip)
    return F.array_min(F.filter(parts, lambda part: part != ""))


def days_between(left: Column, right: Column) -> Column:
    return F.abs(F.unix_micros(left) - F.unix_micros(right)) / F.lit(float(MICROS_PER_DAY))


def use_article_date(article: Column, tweet: Column, max_delta_days: int) -> Column:
    """True where the article date is trusted: it is alone, or close enough to the tweet date."""
    return article.isNotNull() & (
        tweet.isNull() | F.coalesce(days_between(article, tweet) <= max_delta_days, F.lit(False))
    )


def week_start(timestamp: Column) -> Column:
    return F.to_date(F.date_trunc("week", timestamp))
