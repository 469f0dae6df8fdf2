"""Mixing sources to target weights by a proportionally fair schedule, in DataFrame functions only.

The documents of a source are cut into blocks of equal size. Weights become whole numbers of blocks
per cycle. Block k of a source with p blocks in a cycle of Q slots may not start before slot
floor(k Q / p) (release) and must be done by slot ceil((k + 1) Q / p) (deadline). In every slot the
released block with the earliest deadline runs. As the weights fill the cycle exactly, every deadline
is met, and after any number of slots each source is less than one block away from its share.

A source leaves after the cycle that takes its last block; the others go on with a cycle of their
own weights. So every document is placed exactly once and the shares hold among the sources that
still have documents. A schedule depends on the set of active sources alone, so there are at most as
many as there are sources, each as long as a cycle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.llm.common import free_name
from pressgauge.session import stage

BLOCK = 32
CYCLE = 1000
TEMPERATURE = 0.7
ROWS_PER_BUCKET = 2048


def _source_key(source: Column) -> Column:
    """A missing source is a source of its own, apart from the empty name."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def _numbered(docs: DataFrame, doc_id: str, source: str) -> DataFrame:
    """(doc_id, source, key, n): a number per source from 0, in the order of the id's digest.

    Bucketed by the digest, so a source with a third of all rows is numbered by many tasks; the
    buckets' bases are prefix sums of their counts.
    """
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    rest = [F.col(c) for c in docs.columns if c in ("n_chars", "lang") and c not in (doc_id, source)]
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _source_key(F.col(source)).alias("key"),
        F.xxhash64(F.lit(0), *rest).alias("tie"), digest.alias("digest"),
    )
    buckets = max(1, -(-docs.count() // ROWS_PER_BUCKET))
    # numbers of 32 bits keep the order of the digests
    lead = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("bucket", F.floor(lead * buckets / F.lit(1 << 32)).cast("long"))
    sizes = rows.groupBy("key", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("key").orderBy("bucket")) - F.col("count")
    bases = stage(sizes.select("key", "bucket", before.alias("base")), "bases")
    order = Window.partitionBy("key", "bucket").orderBy("digest", "doc_id", "tie")
    placed = rows.withColumn("k", F.row_number().over(order) - 1)
    placed = stage(placed.select("doc_id", "source", "key", "bucket", "k"), "placed")
    return placed.join(bases, ["key", "bucket"]).select("doc_id", "source", "key", (F.col("base") + F.col("k")).alias("n"))


def _weights(sizes: DataFrame, weights: Mapping[str | None, float] | None, temperature: float, cycle: int) -> DataFrame:
    """(key, blocks, per_cycle): whole blocks per cycle, one at least."""
    if weights is None:
        weight = F.pow(F.col("docs"), F.lit(temperature))
    else:
        pairs = [F.lit(x) for s, w in weights.items() for x in ("-" if s is None else f"+{s}", float(w))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("key")), F.lit(0.0))
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(0)))
    return sizes.withColumn("weight", weight).select(
        "key", "blocks", F.greatest(F.lit(1), F.floor(share * cycle + 0.5)).cast("long").alias("per_cycle")
    )


def _earliest_deadline_first(active: Column, slots: Column) -> Column:
    """The source number (from 0) of every slot of a cycle, for an array of struct(key, per_cycle)."""
    per_cycle = lambda i: F.get(active, i)["per_cycle"]

    def step(state: Column, t: Column) -> Column:
        def offer(done: Column, i: Column) -> Column:
            released = F.floor(done * slots / per_cycle(i)) <= t
            deadline = F.ceil((done + 1) * slots / per_cycle(i))
            return F.when((done < per_cycle(i)) & released, F.struct(deadline.alias("deadline"), i.alias("i")))

        pick = F.array_min(F.transform(state["done"], offer))["i"]
        after = lambda p: F.struct(
            F.transform(state["done"], lambda done, i: done + F.when(i == p, 1).otherwise(0).cast("long")).alias("done"),
            F.concat(state["picks"], F.array(p)).alias("picks"),
        )
        return F.get(F.transform(F.array(pick), after), 0)

    start = F.struct(
        F.transform(active, lambda _: F.lit(0).cast("long")).alias("done"),
        F.lit([]).cast("array<int>").alias("picks"),
    )
    return F.aggregate(F.sequence(F.lit(0).cast("long"), slots - 1), start, step)["picks"]


def _schedule(sources: DataFrame) -> DataFrame:
    """(key, k, since, until, slot, release, deadline): the slot of the k-th block of a cycle.

    It holds for cycles since <= cycle < until. The sources are one array; there are tens or hundreds.
    """
    cycles = F.ceil(F.col("blocks") / F.col("per_cycle")).cast("long")
    everyone = sources.agg(F.array_sort(F.collect_list(F.struct("key", "per_cycle", cycles.alias("cycles")))).alias("all"))
    ends = F.array_sort(F.array_distinct(F.transform("all", lambda s: s["cycles"])))
    phases = everyone.withColumn("ends", ends).select("all", "ends", F.posexplode("ends").alias("phase", "until"))
    phases = phases.select(
        F.when(F.col("phase") > 0, F.get("ends", F.col("phase") - 1)).otherwise(F.lit(0)).cast("long").alias("since"),
        "until",
        F.filter("all", lambda s: s["cycles"] >= F.col("until")).alias("active"),
    )
    slots = F.aggregate("active", F.lit(0).cast("long"), lambda total, s: total + s["per_cycle"])
    phases = phases.withColumn("slots", slots)
    picks = phases.select("since", "until", "active", "slots", F.posexplode(_earliest_deadline_first(F.col("active"), F.col("slots"))).alias("slot", "pick"))
    chosen = F.get("active", F.col("pick"))
    turn = F.row_number().over(Window.partitionBy("until", "pick").orderBy("slot")) - 1
    return picks.withColumn("k", turn.cast("long")).select(
        chosen["key"].alias("key"), "k", "since", "until", F.col("slot").cast("long"),
        F.floor(F.col("k") * F.col("slots") / chosen["per_cycle"]).alias("release"),
        F.ceil((F.col("k") + 1) * F.col("slots") / chosen["per_cycle"]).alias("deadline"),
    )


def mix(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, doc_id: str = "doc_id", source: str = "source",
    block: int = BLOCK, cycle: int = CYCLE, temperature: float = TEMPERATURE,
) -> DataFrame:
    """(doc_id, source, block, cycle, slot, release, deadline, position), one row per input row.

    `position` numbers all rows from 0 in the mixed order. `slot`, `release` and `deadline` count
    slots within the cycle. Without `weights` a source's weight is its number of rows to the power
    `temperature`. A source without a weight still gets one block per cycle, so no row is lost. A
    missing source is a source of its own. Rows with equal ids keep rows of their own; a missing id
    counts as the empty text in the order. Extra columns are ignored. An empty table gives an empty table.
    """
    rows = stage(_numbered(docs, doc_id, source), "numbered")
    rows = rows.withColumn("block", F.floor(F.col("n") / block))
    blocks = stage(rows.groupBy("key", "block").agg(F.count("*").alias("docs")), "blocks")
    sizes = blocks.groupBy("key").agg(F.sum("docs").alias("docs"), F.count("*").alias("blocks"))
    sources = stage(_weights(sizes, weights, temperature, cycle), "sources")
    schedule = stage(_schedule(sources), "schedule")
    turns = blocks.join(sources.select("key", "per_cycle"), "key").select(
        "key", "block", "docs", F.floor(F.col("block") / F.col("per_cycle")).alias("cycle"),
        (F.col("block") % F.col("per_cycle")).alias("k"),
    )
    in_phase = (F.col("cycle") >= F.col("since")) & (F.col("cycle") < F.col("until"))
    slotted = stage(turns.join(schedule, ["key", "k"]).where(in_phase), "slotted")
    # cycles are few: rows / (block * cycle)
    totals = slotted.groupBy("cycle").agg(F.sum("docs").alias("_docs"))
    earlier = F.sum("_docs").over(Window.partitionBy(F.lit(0)).orderBy("cycle")) - F.col("_docs")
    bases = stage(totals.select("cycle", earlier.alias("base")), "cycles")
    within = F.sum("docs").over(Window.partitionBy("cycle").orderBy("slot")) - F.col("docs")
    starts = slotted.withColumn("within", within).join(bases, "cycle").select(
        "key", "block", "cycle", "slot", "release", "deadline", (F.col("base") + F.col("within")).alias("start")
    )
    starts = stage(starts, "starts")
    return rows.join(starts, ["key", "block"]).select(
        "doc_id", "source", "block", "cycle", "slot", "release", "deadline",
        (F.col("start") + F.col("n") % block).alias("position"),
    )


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """`docs` with its own columns, range-partitioned and sorted by position.

    Written files then hold the rows in mixed order. Rows that share an id stand together.
    """
    doc_id = options.get("doc_id", "doc_id")
    position, placed_id = free_name(docs, "_position"), free_name(docs, "_placed_id")
    places = stage(mix(docs, **options).groupBy("doc_id").agg(F.min("position").alias(position)), "places")
    places = places.withColumnRenamed("doc_id", placed_id)
    joined = docs.join(places, docs[doc_id].eqNullSafe(places[placed_id]), "left")
    ordered = joined.repartitionByRange(position).sortWithinPartitions(position)
    return ordered.select(*[docs[c] for c in docs.columns])
