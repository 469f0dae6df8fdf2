"""Tables whose further columns carry the names that the operators use inside."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pressgauge.llm import brown, langid, lshforest, mtree, periodic, pfair, pii, preference, simhash, tiling, tokenfiles, variants, winnow
from pressgauge.session import stage

PATH = public_tokenizers.path("byte_bpe_50k.json")
INSIDE = [
    "fp", "root", "component_id", "text_hash", "first_id", "key", "block", "cycle", "slot", "position", "digest", "bucket", "tie",
    "n", "base", "spans", "place", "row", "word", "c", "cell", "held_out", "lang_pred", "score", "_guess", "item_id", "coverage",
    "start", "part", "n_tokens", "_o0", "_o1", "lines", "gone", "deleted", "_text", "_hash", "_lines", "_cut_id", "_cut_hash",
    "_kept_id", "_kept_hash", "_position", "_placed_id", "item", "a", "b", "side", "pair", "turns", "x", "q", "bound", "leaf",
    "distance", "rank", "query_id", "number", "values", "order", "kept", "members", "_id", "word", "nodes", "part", "prefix", "suffix", "kind", "collapsed",
    "runs", "n_words", "n_shingles", "_turn", "_last", "form", "x", "y", "count", "label", "weight", "units", "seen", "chars", "first", "last", "at", "_doc_id", "v",
]
BODY = "the words of a text that is long enough to be told from another one of its kind\n" * 4
ROWS = [
    (1, BODY, "en", "s", 5), (1, BODY, "en", "s", 5), (2, BODY, "en", "s", 5), (3, None, "en", None, 0), (4, "", "fr", "", 0),
    (None, "le texte sans numéro mais avec des mots", None, "t", 9), (None, None, None, None, None), (5, "mot " * 50_000, "fr", "t", 1),
    (6, "un autre texte en langue connue, écrire à ann (at) example (dot) org", "fr", "t", 1),
]


def clashing(rows, names):
    """`rows` with a text column for each name that is not taken."""
    for i, name in enumerate(x for x in INSIDE if x not in names):
        rows = rows.withColumn(name, F.lit(None).cast("string") if i % 3 else F.lit("!"))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return stage(rows, "plain"), stage(clashing(rows, rows.columns), "clashing")


@pytest.fixture(scope="module")
def items(spark):
    rows = spark.createDataFrame([(1, BODY), (2, None), (None, "x y"), (3, "")], "item_id long, text string")
    return rows, clashing(rows, [*rows.columns, "doc_id"])


OPERATORS = {
    "pii": lambda d, i: pii.personal_data(d),
    "simhash": lambda d, i: simhash.near_duplicates(d),
    "token files": lambda d, i: tokenfiles.token_table(d, PATH, 2, [F.col("doc_id"), F.xxhash64("text")]),
    "language ID": lambda d, i: langid.identify(d, d),
    "class model": lambda d, i: brown.score(d, F.col("lang") == "en").drop("row"),
    "tiling": lambda d, i: tiling.leaks(d, i),
    "mixing": lambda d, i: pfair.mix(d).drop("position"),
    "winnowing": lambda d, i: winnow.dedup_lines(d),
    "periodic runs": lambda d, i: periodic.periodic_runs(d),
    "MinHash forest": lambda d, i: lshforest.near_duplicates(d),
    "spelling variants": lambda d, i: variants.spelling_variants(d, min_count=1),
}


def shown(df):
    return sorted(map(repr, df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes]).collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_change_nothing(name, docs, items):
    step = OPERATORS[name]
    plain = shown(step(docs[0], items[0]))
    assert plain
    assert shown(step(docs[1], items[1])) == plain


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, docs, items):
    assert OPERATORS[name](docs[1].limit(0), items[1].limit(0)).count() == 0


@pytest.mark.parametrize("name, step", corpus_pipeline.STAGES)
def test_stages(spark, tmp_path, name, step, docs, items):
    items[1].write.parquet(f"{tmp_path}/benchmark.parquet")
    plain, found = stage(step(spark, docs[0], str(tmp_path)), "one"), stage(step(spark, docs[1], str(tmp_path)), "two")
    if name != corpus_pipeline.STAGES[-1][0]:
        assert found.columns == docs[1].columns
    assert shown(found.select(*plain.columns)) == shown(plain)


def test_vectors(spark):
    rows = spark.createDataFrame(
        [(i, [i / 7, 1.0, -i / 3]) for i in range(60)] + [(None, [1.0, 1.0, 1.0]), (60, None), (7, [1.0, 1.0, -7 / 3])],
        "vec_id long, embedding array<float>",
    )
    search = lambda df: shown(mtree.search(df, F.col("vec_id") % 20 == 0))
    assert search(clashing(rows, rows.columns)) == search(rows)


def test_conversations(spark):
    rows = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (None, 0, "user", "q"), (2, None, None, None)],
        "pair_id long, turn int, role string, text string",
    )
    other = clashing(rows, rows.columns)
    assert shown(preference.format_pairs(other, other)) == shown(preference.format_pairs(rows, rows))
