"""Language ID: held-out accuracy, families, odd rows."""

import math

import numpy as np
from pyspark.sql import functions as F

from pressgauge.llm import langid
from pressgauge.llm.queries import op6_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op6_language_id(spark, SF).join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 250
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_families():
    assert langid.family_of("en") == langid.family_of("de-AT") == "germanic"
    assert langid.family_of("FR") == "romance"
    assert langid.family_of("xx") != langid.family_of("yy")


def test_close_languages_are_told_apart(spark):
    say = {"es": "el perro come la carne y no quiere ", "fr": "le chien mange la viande et ne veut pas ", "de": "der Hund frisst das Fleisch und will nicht "}
    rows = [(i * 3 + k, t * (1 + i % 4), lang, 0.0) for i in range(20) for k, (lang, t) in enumerate(say.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    found = langid.identify(docs, docs).collect()
    assert {r.doc_id: r.lang_pred for r in found} == {r[0]: r[2] for r in rows}


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", "de"), (4, "some words here", "en"), (4, "some words here", "en"), (None, "le mot " * 20_000, "fr"), (6, "texte sans étiquette", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(docs, docs).collect()
    assert len(found) == len(rows)
    und = {r.doc_id for r in found if r.lang_pred == "und"}
    assert und == {1, 2, 3} and all(r.score == 0 for r in found if r.lang_pred == "und")
    assert {r.lang_pred for r in found if r.doc_id not in und} <= {"en", "fr"}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs, docs).select("lang_pred", "score").collect() == [("und", 0.0)]
    none = docs.where(F.lit(False))
    assert langid.identify(none, none).count() == 0


def test_few_texts_many_times_are_learned(spark):
    say = {"es": "el perro come la carne y no quiere ", "fr": "le chien mange la viande et ne veut pas "}
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'fr' AS lang", f"concat('{say['fr']}', 'abc ', id % 2) AS text")
    docs = docs.union(spark.range(50).selectExpr("id AS doc_id", "'es' AS lang", f"concat('{say['es']}', id) AS text"))
    model = langid.fit(docs)
    assert model.languages == ["es", "fr"]
    found = langid.identify(docs, docs).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in found} == {"fr": 20_000, "es": 50}


def test_copies_count_once_in_the_sample(spark, monkeypatch):
    learned = []
    machine = langid._machine
    monkeypatch.setattr(langid, "_machine", lambda x, y: learned.append(len(x)) or machine(x, y))
    docs = spark.range(30_000).selectExpr("'fr' AS lang", "concat('le mot ', if(id % 3 = 0, 'x', cast(id % 2000 as string))) AS text")
    langid.fit(docs)
    assert learned == [langid.SAMPLE_PER_LANGUAGE]
    learned.clear()
    langid.fit(docs.where("text = 'le mot x'"))
    assert learned == [1]


def test_every_language_is_learned(spark):
    rows = [(f"x{k}", chr(97 + k % 26) * 3 + chr(97 + k // 26) * 2 + f" {i}") for k in range(70) for i in range(2)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert model.languages == sorted(f"x{k}" for k in range(70))


def test_numerals_are_no_letters(spark):
    rows = [(1, "½ ² Ⅷ ① 12 _"), (2, "½ a"), (3, "ª"), (4, "ʰ"), (5, "٣ ৪"), (6, "中")]
    learn = spark.createDataFrame([("the words of it", "en"), ("les mots de la", "fr"), ("½ ② Ⅻ", "xx")], "text string, lang string")
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), learn)
    assert {r.doc_id: r.lang_pred == "und" for r in found.collect()} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}
    assert "xx" not in langid.fit(learn).languages


def test_votes_equal_a_plain_loop(spark):
    """Family, then votes of the machines of its pairs, then belief, by a loop over the fitted weights."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    rows = {r.doc_id: r for r in langid.identify(docs, docs).collect()}
    sharp = lambda m: 1 / (1 + math.exp(-4 * max(-50.0, min(50.0, m))))
    for doc in docs.collect():
        vector = langid.features(doc.text or "")
        if vector is None:
            assert (rows[doc.doc_id].lang_pred, rows[doc.doc_id].score) == ("und", 0.0)
            continue
        x = np.append(vector, 1).astype(np.float32)
        chances = [sharp(float(w @ x)) for w in model.of_family] if len(model.families) > 1 else [1.0]
        family = max(range(len(chances)), key=lambda i: (chances[i], -i))
        members = [i for i, lang in enumerate(model.languages) if langid.family_of(lang) == model.families[family]]
        votes, belief = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
        for a, b, w in model.pairs[model.families[family]]:
            p = sharp(float(x @ w))
            votes[a if p >= 0.5 else b] += 1
            belief[a] += p
            belief[b] += 1 - p
        best = max(members, key=lambda i: (votes[i], belief[i], -i))
        score = chances[family] / sum(chances) * (belief[best] / (len(members) - 1) if len(members) > 1 else 1)
        assert rows[doc.doc_id].lang_pred == model.languages[best]
        assert abs(rows[doc.doc_id].score - score) < 1e-4
