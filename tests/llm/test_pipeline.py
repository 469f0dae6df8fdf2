"""The pipeline's stages on the smallest tables and on odd rows."""

from pyspark.sql import functions as F

import corpus_pipeline
from pressgauge.llm import langid, simhash, tiling
from pressgauge.session import stage

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    at = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        at = stage(step(spark, at, SF), "t")
        assert at.columns == docs.columns, name
    known = {i for i, r in rows.items() if r.text and langid.features(r.text) is not None}
    grouped = simhash.near_duplicates(docs.where(docs.doc_id.isin(sorted(known)))).collect()
    one = {r.doc_id for r in grouped if r.doc_id == r.component_id}
    leaks = {r.doc_id for r in tiling.leaks(docs, bench).collect()}
    assert {r.doc_id for r in at.collect()} == one - leaks
    final = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in final} == one - leaks
    starts = sorted((r.start, r.n_tokens) for r in final)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_files_are_in_mixed_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = stage(corpus_pipeline.mixture(spark, docs, SF), "mixed")
    from pressgauge.llm import pfair

    position = {r.doc_id: r.position for r in pfair.mix(docs).collect()}
    final = sorted(corpus_pipeline.token_files(spark, mixed, SF).collect(), key=lambda r: r.start)
    assert [position[r.doc_id] for r in final] == sorted(position.values())


def test_odd_rows(spark, tmp_path):
    rows = [
        (1, "the words of a text that is long enough to be told", "en", "s", 5, "e"), (1, "the words of a text that is long enough to be told", "en", "s", 5, "e"),
        (None, "le texte sans numéro", None, None, None, "e"), (2, None, "en", "s", 0, "e"), (3, "", "fr", "", 0, "e"), (4, "12 34", "en", "s", 5, "e"),
        (5, "mot " * 30_000, "fr", "t", 1, "e"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, root string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0) for r in final) == [0, 1, 5]


def test_labels_are_told_from_the_texts(spark):
    """A wrong or missing label gives way to the language of the text; columns keep their places."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) > 300")
    wrong = F.when(F.col("doc_id") % 10 == 1, F.when(F.col("lang") == "fr", "de").otherwise("fr")).when(F.col("doc_id") % 10 != 2, F.col("lang"))
    truth = {r.doc_id: (r.lang, r.doc_id % 10) for r in docs.collect()}
    told = corpus_pipeline.language(spark, docs.withColumn("lang", wrong), SF)
    assert told.columns == docs.columns
    rows = told.collect()
    assert len(rows) == len(truth)
    for kind in (1, 2):
        right = [r.lang == truth[r.doc_id][0] for r in rows if truth[r.doc_id][1] == kind]
        assert len(right) > 30 and sum(right) >= 0.9 * len(right)


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_unlabelled_texts_stay(spark):
    rows = [(1, "words", None), (2, "12 34", None), (3, None, None), (4, "пять слов", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()) == [1, 4]
