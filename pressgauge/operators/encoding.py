"""Text to vectors. An encoder is a function (df, text column, vector column) -> df.

Its attribute `fingerprint` names what it computes; stored vectors are reused for an equal one only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.config import Settings
from pressgauge.functions import vectors
from pressgauge.functions.text import topic_text, topic_texts

Encoder = Callable[[DataFrame, str, str], DataFrame]

#: rows and words that a worker counts at once, however many an Arrow batch holds
ROWS_AT_ONCE, WORDS_AT_ONCE = 1000, 1 << 17
#: words whose position a worker keeps
KEPT_WORDS = 50_000


class _Positions:
    """Where words count: the first eight hex digits of their MD5 modulo the dimension."""

    def __init__(self, dimension: int):
        self.dimension, self.known = dimension, {"": -1}

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > KEPT_WORDS:
            known = self.known = {"": -1}
        for w in words:
            if w not in known:
                known[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dimension
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _word_list(text: str) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def _unit_cells(words: pa.Array, positions: _Positions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, value) of the components that are not zero, by row and position."""
    coded = words.flatten().dictionary_encode()
    place = positions.of(coded.dictionary.to_pylist())
    row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
    if not len(place):
        return row, row, np.zeros(0)
    place = place[coded.indices.to_numpy()]
    cells, counts = np.unique((row * positions.dimension + place)[place >= 0], return_counts=True)
    row = cells // positions.dimension
    length = np.sqrt(np.bincount(row, counts * counts, len(words)))
    return row, cells % positions.dimension, counts / length[row]


def _parts(words: pa.Array) -> Iterator[pa.Array]:
    """Rows of a batch, as many at once as the limits allow; a longer text comes alone."""
    ends = np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))
    at = 0
    while at < len(words):
        most = (ends[at - 1] if at else 0) + WORDS_AT_ONCE
        end = min(max(int(np.searchsorted(ends, most, "right")), at + 1), at + ROWS_AT_ONCE)
        yield words.slice(at, end - at)
        at = end


def hashing_encoder(dimension: int = 512) -> Encoder:
    """Unit vectors of hashed word counts of whole texts. Needs no model and no fit.

    Words are split in the JVM; counting runs on Arrow batches. A text without words is the zero vector.
    """
    positions = _Positions(dimension)

    @F.arrow_udf("array<double>")
    def unit_counts(words: pa.Array) -> pa.Array:
        parts = []
        for part in _parts(words):
            row, place, value = _unit_cells(part, positions)
            dense = np.zeros((len(part), dimension))
            dense[row, place] = value
            parts.append(dense.ravel())
        flat = np.concatenate(parts) if parts else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, dimension, dtype="int32")), pa.array(flat))

    def encode(df: DataFrame, text: str, vector: str) -> DataFrame:
        return df.withColumn(vector, unit_counts(_word_list(text)))

    encode.fingerprint = f"hashed words, {dimension}"
    return encode


def sparse_hashing_encoder(dimension: int = 512) -> Encoder:
    """The vectors of `hashing_encoder` as struct(size, positions, values) of the components that are not zero.

    Texts have far fewer different words than components, so vectors are stored, moved and multiplied
    by what they hold.
    """
    positions = _Positions(dimension)

    @F.arrow_udf(vectors.SPARSE)
    def unit_counts(words: pa.Array) -> pa.Array:
        sizes, places, values = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
        for part in _parts(words):
            row, place, value = _unit_cells(part, positions)
            sizes.append(np.bincount(row, minlength=len(part)))
            places.append(place.astype(np.int32))
            values.append(value)
        ends = pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (places, values)]
        size = pa.array(np.full(len(words), dimension, np.int32))
        return pa.StructArray.from_arrays([size, *lists], ["size", "positions", "values"])

    def encode(df: DataFrame, text: str, vector: str) -> DataFrame:
        return df.withColumn(vector, unit_counts(_word_list(text)))

    encode.fingerprint = f"hashed words, {dimension}, sparse"
    return encode


def embed_stories(stories: DataFrame, encoder: Encoder) -> DataFrame:
    """One vector per story, from `text_for_embedding`."""
    return encoder(stories, "text_for_embedding", "embedding")


def _few_rows(spark: SparkSession, columns: list[tuple[str, pa.DataType]], rows: Iterable[tuple]) -> DataFrame:
    """Configured rows as a table. As Arrow data they need no Python workers, which would stay beside those that encode."""
    names = [name for name, _ in columns]
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(names, row)) for row in rows], pa.schema(columns)))


def topic_table(spark: SparkSession, cfg: Settings) -> DataFrame:
    """The topic dimension with its profile text, one row per configured topic."""
    columns = [("topic", pa.string()), ("description", pa.string()), ("keywords", pa.list_(pa.string())), ("seed_examples", pa.list_(pa.string()))]
    rows = _few_rows(spark, columns, topic_texts(cfg.topics))
    return rows.withColumn(
        "profile_text", topic_text(F.col("topic"), F.col("description"), F.col("keywords"), F.col("seed_examples"))
    )


def encode_texts(spark: SparkSession, texts: Sequence[str], encoder: Encoder) -> list[list[float]]:
    """Vectors of a few configured texts, in order."""
    rows = _few_rows(spark, [("position", pa.int32()), ("text", pa.string())], enumerate(texts))
    encoded = encoder(rows, "text", "vector").select("position", "vector").collect()
    return [vectors.dense(row.vector) for row in sorted(encoded, key=lambda row: row.position)]
