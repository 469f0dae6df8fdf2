import random
import re

import pytest
from pyspark.sql import functions as F

from pressgauge.config import TOPICS, Settings
from pressgauge.functions import dates, math, rules, text, vectors
from pressgauge.functions.hashing import hash_bin, stable_hash

CFG = Settings()


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def evaluate(spark, values, expression, kind="string"):
    rows = column(spark, values, kind).select("i", expression.alias("out")).collect()
    return [row.out for row in sorted(rows, key=lambda row: row.i)]


def test_white_space_is_pythons(spark):
    every = [c for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    got = evaluate(spark, [f"a{chr(c)}b" for c in every], text.clean_text(F.col("v")))
    expected = [re.sub(r"\s+", " ", f"a{chr(c)}b") for c in every]
    assert [hex(c) for c, g, e in zip(every, got, expected) if g != e] == []


def test_clean_text_trims_and_fills(spark):
    assert evaluate(spark, [None, "  a\n\tb ", ""], text.clean_text(F.col("v"))) == ["", "a b", ""]


WORDS = ["MORTGAGE up", "parent", "my_rent", "rent", "re-rent!", "the cost of living.", "rént", "rents2", "prénom rent", "ſalary", "loan"]


def test_keywords_match_like_python(spark):
    pattern = re.compile(r"\b(?:" + "|".join(map(re.escape, CFG.strong_keywords)) + r")\b", re.IGNORECASE)
    got = evaluate(spark, WORDS, text.has_keyword(F.col("v"), CFG.strong_keywords))
    assert got == [bool(pattern.search(w)) for w in WORDS]


def test_url_terms(spark):
    urls = ["https://x.y/business-news/1", "https://x.y/my_business/", None, "https://x.y/cost-of-living"]
    assert evaluate(spark, urls, text.has_keyword(F.col("v"), CFG.url_terms)) == [True, False, False, True]


def test_one_scan_tells_all_lists(spark):
    """Overlapping, nested and folded terms of several lists, against a search per list."""
    rng = random.Random(4)
    strong, weak = ("cost of living", "rates", "interest rates rise"), ("cost", "living wage", "rise", "of", "interest")
    words = ["cost", "of", "living", "wage", "rates", "ſ", "INTERE\u017fT", "rise", "risen", "xof", "co\u017ft", "r\u0130se", "a-", "_cost"]
    values = ["", None, *[" ".join(rng.choice(words) for _ in range(rng.randint(0, 7))) for _ in range(600)]]
    lists = strong, weak
    for terms in lists:
        one = evaluate(spark, values, text.has_keyword(F.col("v"), terms))
        assert evaluate(spark, values, text.any_found(text.keywords_found(F.col("v"), *lists), terms, *lists)) == one
        assert 50 < sum(one) < 590
    given = WORDS + [f"{a} {b}" for a in WORDS if a for b in CFG.weak_keywords[:6]]
    lists = CFG.strong_keywords, CFG.weak_keywords
    for terms in lists:
        got = evaluate(spark, given, text.any_found(text.keywords_found(F.col("v"), *lists), terms, *lists))
        assert got == evaluate(spark, given, text.has_keyword(F.col("v"), terms))


def test_keywords_need_word_ends():
    with pytest.raises(ValueError):
        text.keyword_pattern(["c++"])
    with pytest.raises(ValueError):
        text.keyword_pattern([])


def test_candidate_source(spark):
    flags = spark.createDataFrame(
        [(True, True, True), (False, True, True), (False, True, False), (False, False, True), (False, False, False)],
        "s boolean, w boolean, u boolean",
    )
    got = flags.select(text.candidate_source(F.col("s"), F.col("w"), F.col("u")).alias("o")).collect()
    assert [r.o for r in got] == ["strong_keyword", "weak_keyword+url_section", "weak_keyword", "url_section", ""]


def python_snippet(value):
    out = re.sub(r"\s+", " ", value).strip()
    for pattern in CFG.boilerplate_patterns:
        out = re.sub(pattern, "", out, flags=re.IGNORECASE)
    return re.sub(r"\s+", " ", out).strip(" -:;,.")


SNIPPETS = [
    "Sign up to our daily newsletter here. Prices rose again in the city this week, said firms.",
    "Read more: Read More the end.",
    "READ MORE  image: a picture of a town. - Text;",
    "no boilerplate at all - here, we go.",
    "ſubscribe for more. Real text",
    "subread morescribe now. x",
    "",
    " -:;,. ",
]


def test_snippet_cleaning(spark):
    collapsed = text.collapse_whitespace(F.col("v"))
    got = evaluate(spark, SNIPPETS, text.clean_snippet(collapsed, CFG.boilerplate_patterns))
    assert got == [python_snippet(s) for s in SNIPPETS]


def test_literal_starts():
    assert text.literal_start(r"read more[: ]?") == "read more"
    assert text.literal_start(r"licensed? x") == "license"
    assert text.literal_start(r"(a|b) c") == ""
    assert text.literal_start(r"a|b") == ""


@pytest.mark.parametrize("length,kind", [(40, "first"), (39, "whole"), (220, "first"), (221, "whole")])
def test_first_sentence_lengths(spark, length, kind):
    first = "x" * (length - 1) + "."
    cleaned = first + " " + "y" * 10
    (got,) = evaluate(spark, [cleaned], text.first_sentence(F.col("v"), text.opening(F.col("v"))))
    if kind == "first":
        assert got == first
    elif len(cleaned) <= 220:
        assert got == cleaned
    else:
        assert got == cleaned[:217].rstrip() + "..."


def test_region_key(spark):
    names = ["  King’s  Lynn ", "King's lynn", None]
    assert evaluate(spark, names, text.region_key(F.col("v"))) == ["king's lynn", "king's lynn", ""]


def test_topic_text(spark):
    from pressgauge.operators.encoding import topic_table

    row = topic_table(spark, CFG).orderBy("topic").first()
    topic = next(t for t in TOPICS if t.name == row.topic)
    assert row.profile_text == "\n".join(
        [topic.name, topic.description, "Keywords: " + ", ".join(topic.keywords), "Seed examples: " + " ".join(topic.seed_examples)]
    )


def test_parse_timestamp(spark):
    values = ["2022-03-05", "2022-03-05T10:30:00Z", "2022-03-05 10:30:00.5", "2022-03-05T10:00:00+02:00", "2022/03/05", "20220305", "10:30", "none", None, ""]
    got = evaluate(spark, values, F.date_format(dates.parse_timestamp(F.col("v")), "yyyy-MM-dd HH:mm:ss"))
    day = "2022-03-05 "
    assert got == [day + "00:00:00", day + "10:30:00", day + "10:30:00", day + "08:00:00", day + "00:00:00", day + "00:00:00", None, None, None, None]


def test_first_of_many(spark):
    values = ["2022-03-09; 2022-03-05", " ; ", "2023-12-31 10:00:00;"]
    assert evaluate(spark, values, dates.first_of_many(F.col("v"))) == ["2022-03-05", None, "2023-12-31 10:00:00"]


def test_week_start(spark):
    got = evaluate(spark, ["2023-12-31", "2024-01-01", "2022-03-06 23:59:59"], dates.week_start(F.col("v").cast("timestamp")).cast("string"))
    assert got == ["2023-12-25", "2024-01-01", "2022-02-28"]


def test_math_worked_example(spark):
    row = spark.range(1).select(
        math.posterior_share(F.lit(3.0), F.lit(10.0), F.lit(0.08), 20.0).alias("p"),
        math.support(F.lit(10.0), 5.0).alias("s"),
        math.effective_weight(F.lit(0.5), F.lit(4)).alias("w"),
        math.safe_ratio(F.lit(1.0), F.lit(0.0)).alias("r"),
        math.zscore(F.lit(9.0), F.lit(0.0), F.lit(1.0), 3.0).alias("z"),
        math.zscore(F.lit(9.0), F.lit(0.0), F.lit(0.0), 3.0).alias("z0"),
    ).first()
    assert round(row.p, 4) == 0.1533 and round(row.s, 3) == 0.816
    assert (row.w, row.r, row.z, row.z0) == (0.25, 0.0, 3.0, 0.0)
    assert round(row.s * (0.5 * 1.4 + 0.3 * 1.0 + 0.2 * 0.6), 2) == 0.91


def test_gate_rules(spark):
    cases = [
        (0.50, 0.44, False, True),  # main rule, both bounds inclusive
        (0.48, 0.44, True, True),  # relaxed rule
        (0.48, 0.44, False, False),
        (0.60, 0.55, False, False),  # margin
        (0.46, 0.10, True, False),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "p double, n double, s boolean")
    got = [r.o for r in df.select(rules.passes_gate(F.col("p"), F.col("n"), F.col("s"), CFG).alias("o")).collect()]
    assert got == [c[3] for c in cases]
    loose = CFG.with_(econ_min_similarity=0.0, econ_margin_threshold=-1.0)
    guard = df.sparkSession.createDataFrame([(0.1, 0.2, False)], "p double, n double, s boolean")
    assert guard.select(rules.passes_gate(F.col("p"), F.col("n"), F.col("s"), loose).alias("o")).first().o is False


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0],), ([0.6, 0.0, 0.8],)], "e array<float>")
    dots = df.select(vectors.dot_products(F.col("e"), [[1, 0, 0], [0, 0, 1]]).alias("d")).collect()
    assert [[round(x, 6) for x in r.d] for r in dots] == [[1.0, 0.0], [0.6, 0.8]]
    tie = spark.createDataFrame([([0.3, 0.7, 0.7],), ([0.4],)], "s array<double>")
    got = tie.select(vectors.best_index(F.col("s")).alias("i"), vectors.second_largest(F.col("s")).alias("t")).collect()
    assert [(r.i, r.t) for r in got] == [(2, 0.7), (1, 0.0)]
    unit = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "e array<float>").select(vectors.l2_normalize(F.col("e")).alias("u"))
    assert [r.u for r in unit.collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_hash_is_stable(spark):
    import hashlib

    (got,) = evaluate(spark, ["a"], stable_hash(42, F.lit("strong"), F.col("v")))
    assert got == hashlib.sha256(b"42::strong::a").hexdigest()
    (number,) = evaluate(spark, [got], hash_bin(F.col("v")))
    assert number == int(got[:3], 16)


WRITTEN = {
    "5-Jan-2022": "2022-01-05 00:00:00",
    "2022 Jan 5": "2022-01-05 00:00:00",
    "Jan 2022": "2022-01-01 00:00:00",
    "1/5/22": "2022-01-05 00:00:00",
    "31/5/69": "1969-05-31 00:00:00",
    "2022.01.05": "2022-01-05 00:00:00",
    "20220105T101010": "2022-01-05 10:10:10",
    "20220105101010": "2022-01-05 10:10:10",
    "202201051010": "2022-01-05 10:10:00",
    "2022/01/05 10:00:00.5": "2022-01-05 10:00:00",
    "January 5th, 2022": "2022-01-05 00:00:00",
    "2022-01-05 10:00:00 EST": "2022-01-05 15:00:00",
    "Sat, 1 Jan 2022 10:00:00 gmt": "2022-01-01 10:00:00",
    "5 Jan 2022 12:30 a.m.": "2022-01-05 00:30:00",
    "5 Jan 2022 13:30 PM": None,
    "30 Feb 2022": None,
    "13/13/2022": None,
    "5 Jan 2022 or so": None,
    "Wed Oct 10 20:19:24 +0000 2022": "2022-10-10 20:19:24", "31/12/2022": "2022-12-31 00:00:00", "10 Jan 2022": "2022-01-10 00:00:00",
    "Jan 10, 2022": "2022-01-10 00:00:00", "01/10/2022 10:00": "2022-01-10 10:00:00", "13/10/2022 10:00:05": "2022-10-13 10:00:05",
    "2022-01-10T10:00:00+02:00": "2022-01-10 08:00:00", "Mon, 10 Jan 2022 10:00:00 +0100": "2022-01-10 09:00:00", "10.01.2022": "2022-10-01 00:00:00",
    "20220110": "2022-01-10 00:00:00", "Jan 10 2022 3:04 PM": "2022-01-10 15:04:00", "2022-1-5": "2022-01-05 00:00:00",
    "10 January 2022 10:00": "2022-01-10 10:00:00", "\t2022-01-10\u00a0\n": "2022-01-10 00:00:00", "2022-01-10 05:06:07 GMT": "2022-01-10 05:06:07",
    "not a date": None, "10:30": None, "": None, None: None, "32/13/2022": None, "May": None, "Monday": None,
}


def test_written_dates(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.createDataFrame([(w,) for w in WRITTEN], "w string")
    got = {r.w: r.p for r in rows.select("w", F.date_format(dates.parse_timestamp(F.col("w")), "yyyy-MM-dd HH:mm:ss").alias("p")).collect()}
    assert got == WRITTEN


def test_strip_takes_white_space_of_any_script(spark):
    rows = spark.createDataFrame([("\tLeeds\n",), ("\u00a0",), ("g1\n",), ("a \u2003 b",), (None,)], "w string")
    got = [r.s for r in rows.select(text.strip(F.col("w")).alias("s")).collect()]
    assert got == ["Leeds", "", "g1", "a \u2003 b", None]
