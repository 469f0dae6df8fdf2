"""The bundled relational tables seen as articles, stories and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.config import BOILERPLATE_PATTERNS, OTHER_TOPIC, Settings, Topic
from pressgauge.functions import dates
from pressgauge.session import use_utc

# --- line items as articles -------------------------------------------------------------------

ORDER_TOPICS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")
ORDER_SETTINGS = Settings(
    preferred_years=(2000, 1999), month_year=1999, month=12
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item is an article: story = order, region = the supplier's nation."""
    lines = load(spark, sf_dir, "lineitem")
    suppliers = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("region"))
    return (
        lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
        .join(nations, F.col("s_nationkey") == nations.n_nationkey)
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("unique_article_id"),
            F.col("l_orderkey").cast("string").alias("story_key"),
            F.col("l_shipdate").cast("timestamp").alias("date"),
            dates.week_start(F.col("l_shipdate")).alias("week"),
            "region",
            "l_returnflag",
            (F.col("l_quantity") >= 5).alias("is_candidate"),
        )
    )


def order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a scored story."""
    orders = load(spark, sf_dir, "orders")
    priority = F.col("o_orderpriority")
    topic = F.when(priority.isin(*ORDER_TOPICS), priority).otherwise(OTHER_TOPIC)
    econ = F.col("o_orderstatus") != "P"
    return orders.select(
        F.col("o_orderkey").cast("string").alias("story_key"),
        econ.alias("is_econ"),
        F.when(econ, topic).otherwise("unassigned").alias("assigned_topic"),
        (F.lit(0.45) + F.floor(F.col("o_totalprice") / 100.0) * 0.0000513717).alias("top1_similarity"),
    )


def line_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate line articles with flags as a keyword stage would set them."""
    flag = F.col("l_returnflag")
    source = F.when(flag == "R", "strong_keyword").when(flag == "A", "weak_keyword").otherwise("url_section")
    return (
        line_articles(spark, sf_dir)
        .where("is_candidate")
        .withColumns({"strong_keyword_hit": flag == "R", "candidate_source": source})
    )


# --- documents as raw articles ----------------------------------------------------------------

DOC_SETTINGS = Settings(
    cleaning_date_min="1996-01-01",
    cleaning_date_max="2000-12-31",
    strong_keywords=("license", "copyright", "und der"),
    weak_keywords=("that", "with", "avec", "que"),
    url_terms=("en", "blog"),
    review_sample_per_stratum=5,
    preferred_years=(1999, 1998),
    month_year=1999,
    # one pattern for what the texts hold beside the default ones
    boilerplate_patterns=(*BOILERPLATE_PATTERNS, r"licensed? [^.?!]{0,120}"),
)

# For the queries that sample on purpose.
DOC_SAMPLE_SETTINGS = DOC_SETTINGS.with_(run_mode="dev", embedding_story_cap=100)

DOC_TOPICS = ("en", "fr", "de")

# Anchors and topics in the words of the documents, with thresholds to match.
DOC_MODEL_SETTINGS = DOC_SETTINGS.with_(
    positive_anchors=("the that with and this for", "license copyright notice"),
    negative_anchors=("le la les aux des queux", "und der die das sch"),
    topics=(
        Topic("open", "the that with", ("license", "copyright"), ("the license with that",)),
        Topic("plain", "and of the in", ("that", "the"), ("the thing that this",)),
        Topic("mixed", "que les der und", ("avec", "und"), ("que la der sch",)),
    ),
    econ_min_similarity=0.05,
    econ_margin_threshold=0.01,
    econ_strong_min_similarity=0.02,
    econ_strong_margin_threshold=0.0,
    topic_min_similarity=0.05,
)


def document_scores(meta: DataFrame, first: DataFrame) -> DataFrame:
    """Story scores by rule: topic = language of the first article, similarity from the counts."""
    spread = (F.col("article_rows") * 37 + F.col("region_spread") * 11) % 100
    language = F.col("LAD")
    return meta.join(first, "story_key").select(
        "story_key",
        "region_spread",
        F.lit(True).alias("is_econ"),
        (F.lit(0.5) + spread / 500.0).alias("econ_confidence"),
        F.when(language.isin(*DOC_TOPICS), language).otherwise(OTHER_TOPIC).alias("assigned_topic"),
        language.alias("top_topic"),
        (F.lit(0.5) + spread / 500.0).alias("top1_similarity"),
        (spread < 10).alias("topic_ambiguous"),
    )


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the raw article layout.

    URL from the page of the same number, dates from an order that five documents of a source share,
    and rules on the numbers for what a raw corpus has: missing, blank and multiple values, shared story
    ids, odd white space, dates written in several ways. Orders and stories grow with the documents.
    """
    docs = load(spark, sf_dir, "documents")
    pages = load(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("resolved_url"))
    orders = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("_order"), "o_orderdate", "o_custkey", "o_orderstatus", "o_orderpriority"
    )
    day = lambda shift: F.date_format(F.date_add(F.to_date("o_orderdate"), shift), "yyyy-MM-dd")
    number = F.col("doc_id")
    shared = F.floor(number / 100) * 20 + F.pmod(number, F.lit(20))
    written = lambda fmt: F.date_format(F.to_date("o_orderdate"), fmt)
    none = F.lit(None).cast("string")
    tweet = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat_ws("; ", day(F.lit(3)), day(F.lit(0))))
        .when(F.col("o_orderpriority") == "5-LOW", F.concat(day(F.lit(0)), F.lit(" 10:30:00")))
        .when(F.col("o_orderpriority") == "2-HIGH", written("EEE MMM dd '10:30:00 +0000' yyyy"))
        .when(number % 11 == 0, F.concat(F.lit("\t"), written("dd MMM yyyy"), F.lit("\u00a0\n")))
        .when(number % 31 != 0, day(F.lit(0)))
    )
    article = F.when(
        F.col("o_orderstatus") == "F", day((F.pmod(F.col("o_custkey"), F.lit(900)) - 450).cast("int"))
    ).when(number % 13 == 0, F.lit("not a date"))
    return (
        docs.join(pages, "doc_id", "left")
        .join(orders, shared == F.col("_order"), "left")
        .select(
            F.lpad(number.cast("string"), 12, "0").alias("unique_article_id"),
            F.col("text").alias("article_text"),
            F.col("source").alias("domain"),
            "resolved_url",
            F.when(number % 7 != 0, F.col("lang")).alias("article_author"),
            article.alias("article_date"),
            F.when(number % 5 != 0, F.concat(F.lit("a"), number.cast("string"))).alias("article_id"),
            F.when(
                F.col("n_chars") % 2 == 0,
                F.concat(F.lit("g"), shared.cast("string"), F.when(number % 3 == 0, "\n").otherwise("")),
            ).alias("duplicate_group"),
            none.alias("twitter"),
            none.alias("twitter_id"),
            none.alias("tweet_url"),
            tweet.alias("tweet_date"),
            F.lit(None).cast("long").alias("retweet_count"),
            F.lit(None).cast("long").alias("reply_count"),
            F.lit(None).cast("long").alias("like_count"),
            F.lit(None).cast("long").alias("quote_count"),
            F.lit(None).cast("long").alias("impression_count"),
            F.col("lang").alias("LAD"),
            F.when(number % 29 == 0, F.lit("\u00a0\t "))
            .when(number % 17 != 0, F.concat(F.lit("\t"), F.col("source"), F.lit("\u00a0\n")))
            .alias("main_LAD"),
            F.col("source").alias("owner"),
        )
    )


# --- embeddings as stories --------------------------------------------------------------------

# Similarities of this table are spread differently from a text model's.
VECTOR_SETTINGS = Settings(
    econ_min_similarity=0.10,
    econ_margin_threshold=0.04,
    econ_strong_min_similarity=0.05,
    econ_strong_margin_threshold=-0.05,
    econ_negative_guard=0.02,
    topic_min_similarity=0.15,
    topic_ambiguous_margin=0.02,
)

POSITIVE_IDS = (0, 1, 2, 3)
NEGATIVE_IDS = (4, 5, 6, 7, 8)
TOPIC_IDS = (9, 10, 11, 12, 13, 14, 15)


def vector_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return vectors.select(
        F.col("vec_id").cast("string").alias("story_key"),
        "embedding",
        F.when(F.col("label") % 3 == 0, True).when(F.col("label") % 3 == 1, False).alias("strong_keyword_hit"),
        F.when(F.col("label") % 2 == 0, "strong_keyword").otherwise("url_section").alias("candidate_source"),
        (F.col("label") % 4 + 1).cast("int").alias("region_spread"),
        F.lit("dev").alias("run_mode"),
    )


def vector_references(spark: SparkSession, sf_dir: str):
    """Anchor and topic vectors: sixteen rows, picked by id."""
    from pressgauge.operators.scoring import References

    wanted = [*POSITIVE_IDS, *NEGATIVE_IDS, *TOPIC_IDS]
    rows = load(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(*wanted)).collect()
    by_id = {row.vec_id: [float(x) for x in row.embedding] for row in rows}
    pick = lambda ids: [by_id[i] for i in ids]
    return References(pick(POSITIVE_IDS), pick(NEGATIVE_IDS), pick(TOPIC_IDS), [f"topic_{i}" for i in TOPIC_IDS])


# --- suppliers as places ----------------------------------------------------------------------


def customer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place per customer, named like suppliers; most have no supplier of their number."""
    key = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(
        key.alias("place"), F.concat(F.lit(" SUPPLIER’S  "), key.cast("string")).alias("name")
    )


def supplier_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boundary per supplier: polygons with a hole, pairs of polygons, points, and none."""
    key = F.col("s_suppkey")
    square = lambda x: F.concat(
        F.lit("[["), x.cast("string"), F.lit(",0],["), (x + 1).cast("string"), F.lit(",0],["),
        (x + 1).cast("string"), F.lit(",1],["), x.cast("string"), F.lit(",0]]"),
    )
    polygon = F.concat(F.lit("["), square(key), F.lit(",[[0,0],[1,1],[0,0]]]"))
    pair = F.concat(F.lit("[["), square(key), F.lit("],["), square(key + 100), F.lit("]]"))
    kind = key % 4
    return load(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.concat(F.lit(" SUPPLIER’S  "), key.cast("string")).alias("name"),
        F.when(kind == 0, "Polygon").when(kind == 1, "MultiPolygon").when(kind == 2, "Point").alias("geometry_type"),
        F.when(kind == 0, polygon).when(kind == 1, pair).when(kind == 2, "[0,0]").alias("coordinates"),
    )


def supplier_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned quantity per supplier."""
    lines = load(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    return lines.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("risk_score")).select(
        F.concat(F.lit("Supplier's "), F.col("l_suppkey").cast("string")).alias("region"), "risk_score"
    )
