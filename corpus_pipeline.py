"""A training corpus out of `documents`: language, near duplicates, benchmark leaks, mixture, token files.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given. The first four return the
columns of `documents`: rows that a stage rejects are gone, and the mixture's decision is the order
of the rows in the written files. The last stage writes the token files in that order and returns
where each document lies in them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.functions.once import with_columns_once
from pressgauge.llm import langid, pfair, simhash, tiling, tokenfiles
from pressgauge.llm.common import crc_remainder, free_name, table
from pressgauge.llm.queries import END_ID
from pressgauge.session import stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with `lang` as it is told from the text, whatever the label said.

    Rejected are those whose language cannot be told: null texts and texts without letters. The
    labels of two thirds of the rows, by id, are learned from; where there are none, labels stay as
    they are. Repeated rows are judged one by one; an empty table gives an empty table.
    """
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    if model is None:  # nothing is labelled
        return docs.where(langid.has_letters(F.col("text")))
    name = free_name(docs, "_guess")
    told = with_columns_once(docs, {name: langid.predictor(model)(F.col("text"))["lang_pred"]})
    told = told.where(F.col(name) != langid.UNDETERMINED)
    return told.select(*[F.col(name).alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id (a missing id comes last).

    Null texts and texts without words are near duplicates of each other. Of repeated rows one stays;
    extra columns go along; an empty table gives an empty table.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that leak a benchmark item.

    Null and empty texts leak nothing, an empty benchmark rejects nothing, repeated rows go or stay together.
    """
    return docs.where(~tiling.is_leak(docs, table(spark, sf_dir, "benchmark")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources are mixed. A null source is a source; repeated rows all stay."""
    return pfair.in_mixed_order(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the rows in `docs`' files; by id if `docs` does not come from files.

    A null or empty text is its end alone. Every row is written, repeated ones too.
    """
    path = public_tokenizers.path("byte_bpe_50k.json")
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    try:
        docs.select(name, row).schema
        order = [F.length(name), name, row]
    except AnalysisException:
        order = [F.col("doc_id"), F.xxhash64("text")]
    return tokenfiles.token_table(docs, path, END_ID, order)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mixture),
    ("token files", token_files),
]

#: Neither a trained classifier nor a 64-bit string hash can be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stage(docs, f"corpus_{number}")
    return docs
