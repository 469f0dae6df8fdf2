"""The operators over their whole tables with production parameters."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.llm import brown, langid, lshforest, mtree, periodic, pfair, pii, preference, simhash, tiling, tokenfiles, variants, winnow
from pressgauge.llm.common import crc_remainder, table
from pressgauge.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

END_ID = 2


def op1_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    plain = F.filter("spans", lambda s: ~s["disguised"])
    count = lambda kind: F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(joined(plain), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op3_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is the chosen side; the rejected one ends with the next conversation's last answer instead of its own."""
    chosen = table(spark, sf_dir, "conversations").withColumn("pair_id", F.col("conv_id").cast("long"))
    pairs = preference.format_pairs(chosen, preference.with_other_answer(chosen))
    shown = lambda c: F.array_join(F.transform(c, lambda r: F.concat_ws("-", r["start"], r["end"])), ",")
    return pairs.select(
        "pair_id", F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen", "rejected",
        shown("chosen_mask").alias("chosen_mask"), shown("rejected_mask").alias("rejected_mask"),
    )


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    order = [F.col("doc_id"), F.xxhash64("text")]
    return tokenfiles.token_table(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, order)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return langid.identify(docs, docs.where(~held_out)).select(
        "doc_id", F.coalesce(crc_remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op7_brown_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    return brown.score(docs, ~held_out).withColumn("held_out", held_out)


def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair.mix(table(spark, sf_dir, "documents"))


def op10_line_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = winnow.dedup_lines(table(spark, sf_dir, "documents"))
    runs = F.array_join(F.transform("deleted", lambda r: F.concat_ws("-", r["first"], r["last"])), ",")
    gone = F.aggregate("deleted", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1)
    return cleaned.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), gone.cast("long").alias("n_deleted"), runs.alias("deleted"), "text"
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """`docs`, where a tenth of the texts, chosen by their id, repeat a stretch of words from some word on.

    With h = crc32 of the id, g = h div 10 and n words, a text with h % 10 = 0 has from word a = g % n on the
    words a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words):
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i))), " ")

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # the lambda's argument is computed once, however often the body names it
    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.lit(""))), F.lit(0))
    return docs.withColumn("text", F.when(h % 10 == 0, changed).otherwise(F.col("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))

    def order(a, b):
        """Greatest length / period first, then the smallest start and period."""
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        earlier = (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))
        return F.when(left > right, -1).when(left < right, 1).when(earlier, -1).otherwise(1)

    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.get(F.array_sort("runs", order), F.lit(0))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.near_duplicates(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With h = crc32 of `<doc_id>:<run>`, a run whose h is a multiple of 199 loses its code point h % length."""

    def alter(doc_id: int | None):
        start = zlib.crc32(b"%d:" % doc_id) if doc_id is not None else None

        def shortened(run: bytes) -> bytes:
            h = zlib.crc32(run, start) if start is not None else 1
            if h % 199:
                return run
            letters = run.decode()
            k = h % len(letters)
            return (letters[:k] + letters[k + 1 :]).encode()

        return shortened

    return variants.spelling_variants(table(spark, sf_dir, "documents"), alter=alter)


QUERIES = {
    "op1_mtree": op1_mtree,
    "op2_pii": op2_pii,
    "op3_preference_pairs": op3_preference_pairs,
    "op4_simhash_golay": op4_simhash_golay,
    "op5_token_files": op5_token_files,
    "op6_language_id": op6_language_id,
    "op7_brown_score": op7_brown_score,
    "op8_string_tiling": op8_string_tiling,
    "op9_pfair_mix": op9_pfair_mix,
    "op10_line_winnow": op10_line_winnow,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_minhash_forest": op12_minhash_forest,
    "op13_spelling_variants": op13_spelling_variants,
}


