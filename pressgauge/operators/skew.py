"""Joins and ranks that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.functions.hashing import hash_share
from pressgauge.session import stage

# A key is hot from this share of the weighed rows on, or from an average shuffle partition's share if
# that is less, so there are at most 1 / share hot keys and a cold one never outweighs a partition.
HOT_SHARE = 1e-4
SALTS = 4096
#: bits of a key bitmap: 16 MB, broadcast
BITS = 1 << 27
#: as many lookup rows are broadcast where they are counted first
FEW_GROUPS = 10_000


def hot_share(df: DataFrame) -> float:
    return min(HOT_SHARE, 1.0 / int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hot_split_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    weight: str,
    payload: Sequence[str],
    salt_by: Sequence[str],
    how: str = "left",
    share: float | None = None,
) -> DataFrame:
    """Equi-join `rows` with `lookup` (one row per key; `weight` = number of `rows` with that key).

    Hot keys are answered by a broadcast of at most 1 / `share` lookup rows (`hot_share`, if not given). Their rows carry a
    salt derived from their own id, so the shuffle for the remaining keys spreads them over all
    tasks. Every row of both kinds is kept. The lookup is staged, as it is read three times; its
    salt is stored with it, since a literal would be folded out of the join keys.
    """
    stored = [*keys, weight, *[p for p in payload if p != weight]]
    lookup = stage(lookup.select(*stored, F.lit(-1).alias("_salt")), "lookup")
    total = lookup.agg(F.sum(weight)).scalar()
    packed = F.struct(*payload)
    hot = lookup.where(F.col(weight) >= total * (share or hot_share(rows))).select(*keys, packed.alias("_hot"))
    cold = lookup.select(*keys, "_salt", packed.alias("_cold"))
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)).cast("int")
    joined = (
        rows.join(F.broadcast(hot), list(keys), "left")
        .withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(-1)).otherwise(salt))
        .join(cold, [*keys, "_salt"], "left")
        .withColumn("_found", F.coalesce("_hot", "_cold"))
    )
    if how == "inner":
        joined = joined.where(F.col("_found").isNotNull())
    elif how != "left":
        raise ValueError(f"unsupported join type {how!r}")
    return joined.select(*rows.columns, *[F.col(f"_found.{name}").alias(name) for name in payload])


def key_bitmaps(keyed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(_bucket, _bits): a bit for the hash of every key of `keyed`; at most BITS / 32,768 rows of 4 KB."""
    bit = _bit(keys)
    return keyed.select(F.bitmap_bucket_number(bit).alias("_bucket"), F.bitmap_bit_position(bit).alias("_at")).groupBy("_bucket").agg(
        F.bitmap_construct_agg("_at").alias("_bits")
    )


def _bit(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS)) + 1


def split_by_bitmaps(rows: DataFrame, bitmaps: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key of the bitmaps, rows that have none of them).

    Every row with such a key is in the first part, and as many others as share a bit with one. The
    bitmaps are broadcast, as their size is bounded. `rows` is read once for each part.
    """
    bit = _bit(keys)
    at = F.bitmap_bit_position(bit)
    octet = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = octet.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8 + 1).cast("int"))) != 0
    told = rows.withColumn("_bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(bitmaps), "_bucket", "left")
    told = told.withColumn("_set", F.coalesce(is_set, F.lit(False)))
    return told.where("_set").select(*rows.columns), told.where("NOT _set").select(*rows.columns)


def first_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """At most k rows per group. Each task keeps k rows per group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def first_n_per_group(
    df: DataFrame,
    group: Sequence[str],
    levels: Sequence[tuple[str, bool]],
    limits: DataFrame,
    salt_by: Sequence[str] | None,
) -> DataFrame:
    """The first n rows of each group, n taken from `limits(group…, n)`, for groups of any size.

    `levels` lists (column, ascending) from the coarsest to the finest sort key. A histogram of
    each level but the last finds the value at which n is reached: rows before it are in, rows
    after it are out, and only rows at that value stay open for the next level. So one task never
    sorts more than the rows that share a group and a value of every level but the last.

    `df` is read once per level, so pass a stored or staged table. `salt_by` spreads the rows of
    hot groups; None says that the number of groups is fixed and small.
    """
    *upper, (last, last_ascending) = levels
    keys = list(group)
    pending = limits.where(F.col("n") > 0).select(*keys, F.col("n").cast("long").alias("_left"))
    state = df.withColumn("_rest", F.lit(0).cast("long"))  # null once a row is known to be in
    for depth, (name, ascending) in enumerate(upper):
        cut = _cut_points(state.where(F.col("_rest").isNotNull()), keys, name, ascending, pending)
        cut = stage(cut, "cut_points")
        how = "inner" if depth == 0 else "left"
        if salt_by is None:
            state = state.drop("_rest").join(F.broadcast(cut.drop("_size")), keys, how)
        else:
            state = hot_split_join(state.drop("_rest"), cut, keys, "_size", ["_cut"], salt_by, how)
        inside = F.col(name) <= F.col("_cut.value") if ascending else F.col(name) >= F.col("_cut.value")
        state = (
            state.where(F.coalesce(inside, F.lit(True)))
            .withColumn("_rest", F.when(F.col(name) == F.col("_cut.value"), F.col("_cut.rest")))
            .drop("_cut")
        )
        pending = cut.where(F.col("_cut").isNotNull()).select(
            *keys, F.col("_cut.value").alias(name), F.col("_cut.rest").alias("_left")
        )
        keys = [*keys, name]
    order = F.col(last).asc() if last_ascending else F.col(last).desc()
    return (
        state.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
        .where(F.col("_rest").isNull() | (F.col("_rank") <= F.col("_rest")))
        .drop("_rank", "_rest")
    )


def first_n_by_hash(
    df: DataFrame, group: Sequence[str], hashed: Column, ties: Sequence[Column], limits: DataFrame, salt_by: Sequence[str]
) -> DataFrame:
    """The n rows of each group with the smallest hashes; `limits` has (group…, n, size), size the group's rows.

    Two passes whatever n: the sizes tell below which hash n rows and a margin of six standard
    deviations are to be expected, one pass keeps these rows, and they are ranked. A group that still
    falls short, as where many rows share a hash, is ranked as a whole. Ranked rows of a group meet
    in one task, so n is a number that a task can sort. `df` is read again for groups that fall
    short, so pass a stored or staged table.
    """
    group = list(group)
    limits = stage(limits.where((F.col("n") > 0) & (F.col("size") > 0)).select(*group, "n", "size"), "limits")
    margin = 6 * F.sqrt(F.col("n").cast("double")) + 20
    below = hash_share(hashed) < (F.col("n") + margin) / F.col("size")
    if limits.count() <= FEW_GROUPS:
        looked_up = df.join(F.broadcast(limits), group)
    else:
        looked_up = hot_split_join(df, limits, group, "size", ["n", "size"], salt_by, "inner")
    near = stage(looked_up.where(below), "smallest_hashes")
    found = near.groupBy(*group).agg(F.count("*").alias("_found"))
    short = limits.join(found, group, "left").where(F.coalesce("_found", F.lit(0)) < F.least("n", "size"))
    short = stage(short.select(*group, "n", "size"), "short_groups")
    if not short.isEmpty():
        again = df.join(short, group)
        near = near.join(short.select(*group), group, "left_anti").select(*again.columns).unionByName(again)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(hashed, *ties))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= F.col("n")).select(*df.columns)


def _cut_points(
    rows: DataFrame, keys: list[str], name: str, ascending: bool, pending: DataFrame
) -> DataFrame:
    """Per key: number of rows, and the value of `name` at which the limit is exceeded (or null)."""
    order = F.col(name).asc() if ascending else F.col(name).desc()
    histogram = (
        rows.groupBy(*keys, name)
        .agg(F.count("*").alias("_rows"))
        .withColumn("_through", F.sum("_rows").over(Window.partitionBy(*keys).orderBy(order)))
        .withColumn("_before", F.col("_through") - F.col("_rows"))
        .join(pending, keys)
    )
    falls_here = (F.col("_before") <= F.col("_left")) & (F.col("_through") > F.col("_left"))
    cut = F.struct(F.col(name).alias("value"), (F.col("_left") - F.col("_before")).alias("rest"))
    return histogram.groupBy(*keys).agg(
        F.max("_through").alias("_size"), F.max(F.when(falls_here, cut)).alias("_cut")
    )
