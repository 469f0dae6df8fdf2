"""Language of a text by hierarchical discrimination.

First a linear classifier picks the language family, then one-versus-one linear support vector
machines pick the language within the family. Features are counts of letter sequences of one to
three bytes of the whole text, hashed to a fixed number of cells, square-rooted and scaled to
length one. Training runs on a bounded, hash-ordered sample of different labelled texts of every
language; every text is scored by a task of its own partition, with the fitted weights as a small closure.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import over_batches, ship_code, texts_of
from pressgauge.session import stage

# --- fixed values: families of language codes ---------------------------------------------------
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "semitic": ("ar", "he", "mt", "am"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "gu", "pa", "ne", "si"),
    "sinitic": ("zh", "yue"),
}
UNDETERMINED = "und"
# -----------------------------------------------------------------------------------------------

CELLS = 4096
SAMPLE_PER_LANGUAGE = 500
#: vectors of 16 KB that the driver holds (131 MB); with more languages than fit, each gives an equal part
SAMPLE = 8_000
ROUNDS = 120
PENALTY = 1e-4

_HAS_LETTER = r"\p{L}"
_LETTER = regex.compile(_HAS_LETTER)
_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def family_of(language: str) -> str:
    """A language without an entry is a family of its own."""
    base = language.lower().replace("_", "-").split("-")[0]
    return next((name for name, members in FAMILIES.items() if base in members), f"only {language}")


def features(text: str) -> np.ndarray | None:
    """The vector of a whole text; None if it has no letter."""
    if not _LETTER.search(text):
        return None
    raw = _FOLD[np.frombuffer(f" {text} ".encode("utf-8", "replace"), np.uint8)]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    raw = raw[keep]
    counts = np.zeros(CELLS, np.float32)
    code = raw
    for n in range(3):
        if n:
            code = code[:-1] << np.uint32(8) | raw[n:]
        cell = (code * np.uint32(2654435761) + np.uint32(n * 0x9E37)) >> np.uint32(20)
        counts += np.bincount(cell, minlength=CELLS)
    np.sqrt(counts, out=counts)
    return counts / np.linalg.norm(counts)


def _machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear support vector machine: squared hinge loss, accelerated descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    step = np.float32(1 / (4 + PENALTY))
    for k in range(ROUNDS):
        lack = np.maximum(0, 1 - y * (x @ v))
        after = v - step * (PENALTY * v - 2 * x.T @ (weight * y * lack))
        v, w = after + k / (k + 3) * (after - w), after
    return w


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    of_family: np.ndarray  # family machines, one against the rest
    pairs: dict[str, list[tuple[int, int, np.ndarray]]]  # per family: languages and their machine

    def predict(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, score) per row."""
        x = np.hstack([vectors, np.ones((len(vectors), 1), np.float32)])
        sharp = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -50, 50)))
        if len(self.families) > 1:
            chance = sharp(x @ self.of_family.T)
            chance = chance / chance.sum(1, keepdims=True)
        else:
            chance = np.ones((len(x), 1))
        chosen = chance.argmax(1)
        best, score = np.zeros(len(x), np.int64), chance.max(1)
        for f, name in enumerate(self.families):
            rows = np.nonzero(chosen == f)[0]
            members = [i for i, lang in enumerate(self.languages) if family_of(lang) == name]
            votes, belief = np.zeros((len(rows), len(self.languages))), np.zeros((len(rows), len(self.languages)))
            for a, b, w in self.pairs[name]:
                p = sharp(x[rows] @ w)
                votes[:, a] += p >= 0.5
                votes[:, b] += p < 0.5
                belief[:, a] += p
                belief[:, b] += 1 - p
            rank = votes * len(self.languages) + belief
            pick = np.array(members)[rank[:, members].argmax(1)]
            best[rows] = pick
            if len(members) > 1:
                score[rows] *= belief[np.arange(len(rows)), pick] / (len(members) - 1)
        return best, score


def _up_to(rows: DataFrame, limits: list[tuple[str, int]]) -> DataFrame:
    """The rows whose place is not beyond their language's limit."""
    limits = rows.sparkSession.createDataFrame(limits, "lang string, limit long")
    return rows.join(F.broadcast(limits), "lang").where("place <= limit")


def fit(docs: DataFrame, label: str = "lang", text: str = "text", order: Column | None = None) -> Model | None:
    """Learns from the labelled rows of `docs`; None if there are none.

    Copies of a text (of `order`, if given) count once. Every language is learned, from its first texts
    by a hash: all it has, or SAMPLE_PER_LANGUAGE, or SAMPLE by the number of languages. Texts without
    letters are no texts here. Only the hashes and feature vectors of the sample reach the driver.
    """
    spark = docs.sparkSession
    ship_code(spark)
    order = F.xxhash64(F.col(text) if order is None else order)
    rows = docs.select(F.col(label).alias("lang"), F.col(text).alias("text"), F.shiftrightunsigned(order, 11).alias("place"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(_HAS_LETTER))
    keys = stage(rows.select("lang", "place").distinct(), "sample_keys")
    counts = {r["lang"]: r["count"] for r in keys.groupBy("lang").count().collect()}
    if not counts:
        return None
    most = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE // len(counts)))
    # a threshold on the hash picks about a quarter more keys than needed, without sorting a language
    share = [(lang, int(min(1.0, (1.25 * most + 50) / n) * (1 << 53))) for lang, n in counts.items()]
    found: dict[str, list[int]] = {}
    for r in _up_to(keys, share).select("lang", "place").collect():
        found.setdefault(r["lang"], []).append(r["place"])
    chosen = _up_to(rows, [(lang, sorted(places)[:most][-1]) for lang, places in found.items()])
    chosen = chosen.groupBy("lang", "place").agg(F.min("text").alias("text"))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(i, v) for i, t in enumerate(texts_of(batch, 1)) if (v := features(t)) is not None]
        at = pa.array([i for i, _ in found], pa.int64())
        packed = pa.array([v.tobytes() for _, v in found], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), packed, batch.column(2).take(at)], ["lang", "x", "place"])

    vectors = chosen.select("lang", "text", "place").mapInArrow(over_batches(make), "lang string, x binary, place long")
    sample: dict[str, list] = {}
    for r in vectors.collect():
        sample.setdefault(r["lang"], []).append((r["place"], bytes(r["x"])))
    if not sample:
        return None
    languages = sorted(sample)
    x, y = [], []
    for i, lang in enumerate(languages):
        for _, packed in sorted(sample[lang]):
            x.append(np.frombuffer(packed, np.float32))
            y.append(i)
    x, y = np.array(x), np.array(y)
    names = sorted({family_of(lang) for lang in languages})
    group = np.array([names.index(family_of(lang)) for lang in languages])[y]
    of_family = np.array([_machine(x, np.where(group == f, 1, -1).astype(np.float32)) for f in range(len(names))])
    pairs = {}
    for f, name in enumerate(names):
        members = sorted(set(y[group == f].tolist()))
        pairs[name] = []
        for a, b in combinations(members, 2):
            rows_ab = (y == a) | (y == b)
            pairs[name].append((a, b, _machine(x[rows_ab], np.where(y[rows_ab] == a, 1, -1).astype(np.float32))))
    return Model(languages, names, of_family, pairs)


def has_letters(text: Column) -> Column:
    """Whether there is anything in a text to tell its language by."""

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([bool(_LETTER.search(t or "")) for t in texts.to_pylist()], pa.bool_())

    return found(text)


def predictor(model: Model | None):
    """A column function: text to struct(lang_pred, score).

    A null text, a text without letters, and any text where nothing was learned, is `und` with score 0.
    """

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for at in range(0, len(texts), 256):
            vectors = [features(t or "") for t in texts.slice(at, 256).to_pylist()]
            known = [i for i, v in enumerate(vectors) if v is not None] if model else []
            lang, score = [UNDETERMINED] * len(vectors), [0.0] * len(vectors)
            if known:
                for i, pick, value in zip(known, *model.predict(np.array([vectors[i] for i in known]))):
                    lang[i], score[i] = model.languages[pick], float(min(1.0, max(0.0, value)))
            names += lang
            scores += score
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict


def identify(
    docs: DataFrame, learn_from: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang"
) -> DataFrame:
    """(doc_id, lang_pred, score) per row of `docs`, learned from the labelled rows of `learn_from`.

    Whole texts count, however long. Of languages with equal votes the one with more belief is taken,
    then the first by name. Repeated rows, null ids and extra columns change nothing; an empty table
    gives an empty table.
    """
    guess = predictor(fit(learn_from, label, text))(F.col(text))
    return docs.select(F.col(doc_id).alias("doc_id"), guess.alias("_guess")).select(
        "doc_id", "_guess.lang_pred", "_guess.score"
    )
