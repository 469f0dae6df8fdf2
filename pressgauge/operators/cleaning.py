"""Raw articles to cleaned articles, and the quality report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.config import RAW_COLUMNS, Settings
from pressgauge.functions import dates, text
from pressgauge.functions.once import with_columns_once
from pressgauge.operators.skew import hot_split_join, key_bitmaps, split_by_bitmaps
from pressgauge.session import observed, reads_one_table, stage

GROUP = ["story_key", "region", "week"]


def region_name(main: Column, fallback: Column) -> Column:
    """A blank main region does not fall through to the other column, only a null one does."""
    return text.strip(F.coalesce(main, fallback, F.lit("")))


def story_key(duplicate_group: Column, article_id: Column, unique_id: Column) -> Column:
    parts = [c.cast("string") for c in (duplicate_group, article_id, unique_id)]
    return text.strip(F.coalesce(*parts, F.lit("nan")))


def with_dates(raw: DataFrame, cfg: Settings) -> DataFrame:
    """Parsed dates, the one that counts and where it comes from. Reads no text."""
    tweet_text = text.strip(F.coalesce(F.col("tweet_date"), F.lit("")))
    multi = dates.is_multi_value(tweet_text)
    # many patterns may be tried for a date, and filters read it, so it is parsed once per row
    parsed = with_columns_once(
        raw,
        {
            "date_raw_article": dates.parse_timestamp(F.col("article_date")),
            "date_raw_tweet": dates.parse_timestamp(
                F.when(multi, dates.first_of_many(tweet_text)).otherwise(tweet_text)
            ),
            "has_multi_tweet": multi,
        },
    )
    article, tweet = F.col("date_raw_article"), F.col("date_raw_tweet")
    trusted = dates.use_article_date(article, tweet, cfg.date_max_delta_days)
    return parsed.withColumns(
        {
            "date": F.when(trusted, article).otherwise(tweet),
            "date_source": F.when(trusted, "article_date").otherwise("tweet_date"),
        }
    )


def derive(raw: DataFrame, cfg: Settings) -> DataFrame:
    """Every derived column and the reasons to drop a row; nothing is dropped yet."""
    dated = with_dates(raw, cfg).withColumn("region", region_name(F.col("main_LAD"), F.col("LAD")))
    # the cleaned text is read by a filter and by the result, so it is kept from being computed twice
    cleaned = with_columns_once(dated, {"text_clean": text.clean_text(F.col("article_text"))})
    first = F.lit(cfg.cleaning_date_min).cast("timestamp")
    last = F.lit(cfg.cleaning_date_max).cast("timestamp")
    return cleaned.withColumn("text_len", F.length("text_clean")).withColumns(
        {
            "_short": F.col("text_len") < cfg.text_min_length,
            "_no_date": F.col("date").isNull(),
            "_outlier": F.coalesce(~F.col("date").between(first, last), F.lit(False)),
            "_no_region": F.col("region") == "",
            "_missing": _missing_bits(raw),
        }
    )


REPORTED = ["date", "has_multi_tweet", "_short", "_no_date", "_outlier", "_no_region", "_missing"]


def derive_flags(raw: DataFrame, cfg: Settings) -> DataFrame:
    """What the report counts, without texts: a few numbers per raw row."""
    return derive(raw, cfg).select(*REPORTED)


def clean_and_count(raw: DataFrame, cfg: Settings, name: str = "kept") -> tuple[DataFrame, DataFrame]:
    """Cleaned articles without duplicate weights, staged, and the report's counters of all raw rows.

    One pass over the raw texts: the counters are gathered while the articles are written.
    """
    counters = _counters() | _missing_counts(_raw_columns(raw))
    micros = {c: F.unix_micros(counters[c]) for c in ("clean_date_min", "clean_date_max")}
    derived, counted = observed(derive(raw, cfg), counters | micros)
    kept = stage(keep(derived, cfg), name)
    return kept, counted().withColumns({c: F.timestamp_micros(c) for c in micros})


def _missing_bits(raw: DataFrame) -> Column:
    """A bit per raw column that is null, so that counting them later reads no texts."""
    bits = [
        F.when(F.col(name).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        for i, name in enumerate(_raw_columns(raw))
    ]
    return reduce(add, bits, F.lit(0).cast("long"))


def _raw_columns(df: DataFrame) -> list[str]:
    return [name for name in RAW_COLUMNS if name in df.columns]


def is_kept() -> Column:
    return ~(F.col("_short") | F.col("_no_date") | F.col("_outlier") | F.col("_no_region"))


def keep(derived: DataFrame, cfg: Settings) -> DataFrame:
    """Cleaned articles without duplicate weights, from derived rows."""
    return (
        derived.where(is_kept())
        .withColumns(
            {
                "story_key": story_key(
                    F.col("duplicate_group"), F.col("article_id"), F.col("unique_article_id")
                ),
                "week": dates.week_start(F.col("date")),
                "text_for_embedding": text.prefix(F.col("text_clean"), cfg.text_for_embedding_chars),
            }
        )
        .drop("_short", "_no_date", "_outlier", "_no_region", "_missing")
    )


def keep_articles(raw: DataFrame, cfg: Settings) -> DataFrame:
    """Cleaned articles without duplicate weights: one narrow pass, no shuffle."""
    return keep(derive(raw, cfg), cfg)


def group_sizes(articles: DataFrame) -> DataFrame:
    """Articles per story, region and week."""
    return articles.groupBy(*GROUP).agg(F.count("*").alias("group_rows"))


def bucket_weights(flagged: DataFrame) -> DataFrame:
    """Duplicate weight that the candidates of a (story, region, week) group add up to.

    Group sizes count all cleaned articles, the weight only candidates. One aggregation of four
    narrow columns replaces the weight on every article when only sums are needed.
    """
    share = F.col("_candidates") / F.col("group_rows")
    return (
        flagged.groupBy(*GROUP)
        .agg(F.count("*").alias("group_rows"), F.count_if("is_candidate").alias("_candidates"))
        .where(F.col("_candidates") > 0)
        .select(*GROUP, share.alias("dup_weight"))
    )


def with_duplicate_weight(articles: DataFrame) -> DataFrame:
    """1 / size of the (story, region, week) group on every row.

    Groups of two and more are looked up; everything else weighs one. A bitmap of the repeated groups
    tells most other rows without moving them, so wide rows are exchanged only where their group is
    repeated. Articles that are no stored table are staged, as they are read three times.
    """
    if not reads_one_table(articles):
        articles = stage(articles, "articles")
    repeated = stage(group_sizes(articles).where(F.col("group_rows") > 1), "repeated_groups")
    shared, alone = split_by_bitmaps(articles, stage(key_bitmaps(repeated, GROUP), "group_bitmaps"), GROUP)
    joined = hot_split_join(
        shared, repeated, GROUP, "group_rows", ["group_rows"], ["unique_article_id"]
    )
    weighed = joined.withColumn(
        "dup_weight", F.lit(1.0) / F.coalesce("group_rows", F.lit(1))
    ).drop("group_rows")
    return weighed.unionByName(alone.withColumn("dup_weight", F.lit(1.0)))


def clean_articles(raw: DataFrame, cfg: Settings) -> DataFrame:
    """Cleaned articles with duplicate weights."""
    return with_duplicate_weight(keep_articles(raw, cfg))


def cleaning_counters(raw: DataFrame, cfg: Settings) -> DataFrame:
    """One row of counters; each reason is counted on its own, so reasons may overlap."""
    return derive(raw, cfg).agg(*_named(_counters()))


def _named(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]


def _counters() -> dict[str, Column]:
    kept = is_kept()
    return {
        "rows_seen": F.count("*"),
        "rows_kept": F.count_if(kept),
        "rows_dropped_short_text": F.count_if("_short"),
        "rows_dropped_date_outlier": F.count_if("_outlier"),
        "rows_dropped_missing_date": F.count_if("_no_date"),
        "rows_dropped_missing_region": F.count_if("_no_region"),
        "multi_tweet_rows": F.count_if("has_multi_tweet"),
        "clean_date_min": F.min(F.when(kept, F.col("date"))),
        "clean_date_max": F.max(F.when(kept, F.col("date"))),
    }


def _missing_counts(columns: list[str]) -> dict[str, Column]:
    bit = lambda i: F.col("_missing").bitwiseAND(F.lit(1 << i).cast("long")) != 0
    return {f"_{name}": F.count_if(bit(i)) for i, name in enumerate(columns)}


def _share(name: str) -> Column:
    return F.when(F.col("rows_seen") > 0, F.bround(F.col(f"_{name}") / F.col("rows_seen"), 6))


def missing_share(raw: DataFrame) -> DataFrame:
    """Rows (column_name, missing_rows, missing_share), null share without rows."""
    columns = _raw_columns(raw)
    counted = raw.select(_missing_bits(raw).alias("_missing")).agg(
        F.count("*").alias("rows_seen"), *_named(_missing_counts(columns))
    )
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"_{c}").alias("missing_rows"), _share(c).alias("missing_share"))
        for c in columns
    ]
    return counted.select(F.inline(F.array(*rows)))


def region_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy("region").agg(F.count("*").alias("rows"))


def top_regions(articles: DataFrame, n: int) -> DataFrame:
    return region_counts(articles).orderBy(F.desc("rows"), "region").limit(n)


def example_rows(articles: DataFrame, cfg: Settings) -> DataFrame:
    """First rows by date and id, with previews of the text before and after cleaning.

    Of a stored table only the files that hold these rows are read for texts.
    """
    order = ["date", "unique_article_id"]
    if reads_one_table(articles):
        file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
        top = articles.select(*order, file.alias("_file"), row.alias("_row")).orderBy(*order, "_file", "_row").limit(cfg.example_rows)
        places = [(r["_file"], r["_row"]) for r in top.collect()]  # as many as the settings ask for
        here = [(file == F.lit(f)) & (row == r) for f, r in places]
        # a filter on files alone leaves the others unread
        articles = articles.where(file.isin([f for f, _ in places])).where(reduce(or_, here, F.lit(False)))
    return (
        articles.orderBy(*order)
        .limit(cfg.example_rows)
        .select(
            "unique_article_id",
            "date",
            "region",
            "text_len",
            text.prefix(F.col("article_text"), cfg.preview_chars).alias("raw_preview"),
            text.prefix(F.col("text_clean"), cfg.preview_chars).alias("clean_preview"),
        )
    )


def cleaning_report(
    flags: DataFrame, raw_columns: Sequence[str], articles: DataFrame, cfg: Settings, limit: int | None = None
) -> DataFrame:
    """The whole report as one nested row, ready for a JSON sink.

    `flags` holds the counters of all raw rows (`clean_and_count`), or their reasons, a few numbers
    each (`derive_flags`).
    """
    columns = [name for name in RAW_COLUMNS if name in raw_columns]
    counted = flags if "rows_seen" in flags.columns else flags.agg(*_named(_counters() | _missing_counts(columns)))
    groups = group_sizes(articles).agg(F.count("*").alias("n")).scalar()
    by_rank = F.sort_array(F.collect_list(F.struct(F.negative("rows").alias("rank"), "region", "rows")))
    tops = top_regions(articles, cfg.top_region_rows).agg(
        F.transform(by_rank, lambda r: F.struct(r["region"].alias("region"), r["rows"].alias("rows")))
    )
    examples = example_rows(articles, cfg)
    in_order = F.struct("date", *[name for name in examples.columns if name != "date"])
    example_list = examples.agg(F.sort_array(F.collect_list(in_order)))
    summary = [name for name in counted.columns if not name.startswith("_")]
    parameters = {
        "text_min_length": cfg.text_min_length,
        "text_for_embedding_chars": cfg.text_for_embedding_chars,
        "cleaning_date_min": cfg.cleaning_date_min,
        "cleaning_date_max": cfg.cleaning_date_max,
        "limit": limit,
    }
    typed = lambda value: F.lit(value).cast("string" if isinstance(value, str) else "long")
    return counted.select(
        F.struct(*[typed(value).alias(name) for name, value in parameters.items()]).alias("run_parameters"),
        F.struct(*summary, groups.alias("duplicate_story_groups")).alias("summary"),
        F.struct(*[_share(name).alias(name) for name in columns]).alias("missing_share"),
        tops.scalar().alias("top_regions"),
        example_list.scalar().alias("examples"),
    )
