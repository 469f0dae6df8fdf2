"""Near-duplicate documents by word shingles: MinHash in an LSH forest, links confirmed on full sets.

A document's set holds its distinct word shingles. Documents with equal sets form a class, and only
classes go on. A class has 80 MinHash values. The forest has 20 orders: order t begins with values
4t … 4t + 3 in full and goes on with one byte of each other value, in rotation. Rows are cut into
ranges of (order, label) and sorted, so classes with a long common prefix stand next to each other.

* A *region* is a stretch with equal first four values. Two classes of similarity 0.85 share a region
  in one order with probability 0.85^4, and in none of the 20 orders with probability 4e-7.
* Candidates in a region are next neighbours in the order, and all classes of a part of at most 128;
  a region with more of them goes deeper, value by value, until its parts are that small.
* Candidates whose values agree in less than 65 of 100 cannot be links (4.9 standard deviations).

Groups of candidates are then compared on their full sets by an inverted list of shingles, with
all other members of the group, not with their candidates only: so a group finds all its links even
where deep regions missed some. Members of what is the largest component so far need no look-up of
their own. Groups come out as a spanning forest of links, never as all pairs.

Groups of more than LIMIT shingles do not fit a task. They are first cut into pieces of neighbours in
six of the orders, which find most links. What pieces leave apart is then compared in full: members
are dealt into blocks of half a LIMIT, and every two blocks that may hold a link between different
parts meet in a task. Members of the largest part are not compared with each other, and blocks whose
set sizes rule out a link do not meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import ship_code, star_components
from pressgauge.session import stage

SHINGLE = 3
PERCENT = 85
ORDERS, DEPTH = 20, 4
VALUES = ORDERS * DEPTH
HEAD, TAIL = 4 * DEPTH, VALUES - DEPTH
LEAST_AGREEMENT = 0.65
SMALL_REGION = 128
#: Rows of one region that a task holds; a longer region goes on with its last row.
HELD_ROWS = 1 << 16
LIMIT = 4_000_000
PIECE_ORDERS = 6
HELD_WORDS = 500_000
CHUNK = 1 << 14

MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
FACTORS = np.random.default_rng(12).integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --- sets and values ----------------------------------------------------------------------------


class ShingleHasher:
    """Sorted distinct 64-bit shingle hashes of texts; the hashes of a bounded number of words are kept."""

    def __init__(self, shingle: int = SHINGLE):
        self.shingle, self.words = shingle, {}

    def _word_hashes(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.words, xxhash.xxh64_intdigest
        if len(known) > HELD_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        hashes = self._word_hashes(words)
        width = min(self.shingle, len(words))
        mixed = np.full(len(words) - width + 1, width, np.uint64)
        for i in range(width):
            mixed = (mixed ^ hashes[i : i + len(mixed)]) * MIX[i % 3]
            mixed ^= mixed >> np.uint64(29)
        mixed *= MIX[1]
        return np.unique(mixed ^ (mixed >> np.uint64(32)))


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, VALUES) 32-bit MinHash values of sets that are not empty."""
    out = np.empty((len(sets), VALUES), np.uint32)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (size < CHUNK):
            size += len(sets[end])
            end += 1
        starts = np.cumsum([0] + [len(s) for s in sets[at : end - 1]])
        flat = np.concatenate(sets[at:end])
        for k, factor in enumerate(FACTORS):
            out[at:end, k] = np.minimum.reduceat(flat * factor, starts) >> np.uint64(32)
        at = end
    return out


def set_marks(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, key, values) per row; key names the set, values are its MinHash values."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = ShingleHasher(shingle)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            at = 0
            while at < batch.num_rows:
                sets, held = [], 0
                while at + len(sets) < batch.num_rows and held < 64 * CHUNK:
                    sets.append(hashed(texts[at + len(sets)].as_py()))
                    held += len(sets[-1])
                filled = [s for s in sets if len(s)]
                values = iter(min_hashes(filled).astype(">u4")) if filled else iter(())
                columns = [
                    batch.column(0).slice(at, len(sets)), batch.column(2).slice(at, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([next(values).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "key", "values"])
                at += len(sets)

    rows = docs.select(F.col(doc_id).cast("long"), F.col(text), F.xxhash64(F.col(text)))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, key binary, values binary")


# --- the forest ---------------------------------------------------------------------------------


def _labels(values: np.ndarray, order: int) -> np.ndarray:
    """Labels of one order: its own values in full, then a byte of each other value in rotation."""
    turned = np.roll(values, -DEPTH * order, axis=1)
    head = turned[:, :DEPTH].astype(">u4").view(np.uint8).reshape(len(values), HEAD)
    return np.concatenate([head, (turned[:, DEPTH:] & 0xFF).astype(np.uint8)], axis=1)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    count, width = rows.shape
    return pa.Array.from_buffers(
        pa.binary(), count, [None, pa.py_buffer(np.arange(0, (count + 1) * width, width, dtype=np.int32)), pa.py_buffer(rows.tobytes())]
    )


def _bytes_of(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of one width as rows of bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    packed = column.cast(pa.binary()).cast(pa.binary(width))
    offset = packed.offset * width
    return np.frombuffer(packed.buffers()[1], np.uint8)[offset : offset + len(packed) * width].reshape(-1, width)


def forest(classes: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(order, label, number) for every class of `classes(number, values)` and every order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _bytes_of(batch.column(1), 4 * VALUES).copy().view(">u4").astype(np.uint32)
            for order in range(orders):
                column = pa.array(np.full(batch.num_rows, order, np.int8))
                yield pa.RecordBatch.from_arrays(
                    [column, _fixed(_labels(values, order)), batch.column(0)], ["order", "label", "number"]
                )

    return classes.select("number", "values").mapInArrow(run, "order byte, label binary, number long")


def _parts(common: np.ndarray, start: int, end: int, depth: int) -> Iterator[tuple[int, int]]:
    """Parts of at most SMALL_REGION rows of sorted rows start … end - 1, by growing depth.

    `common[i]` is how many bytes rows i and i + 1 have in common. Parts of one row are left out.
    """
    waiting = [(start, end, depth)]
    while waiting:
        a, b, depth = waiting.pop()
        if b - a <= SMALL_REGION:
            if b - a > 1:
                yield a, b
            continue
        inner = common[a : b - 1]
        depth = max(depth, int(inner.min())) + 1
        if depth > HEAD + TAIL:
            continue  # equal labels: the chain of neighbours holds all of them
        cuts = a + 1 + np.nonzero(inner < depth)[0]
        waiting.extend((x, y, depth) for x, y in zip([a, *cuts.tolist()], [*cuts.tolist(), b]))


def _region_links(order: np.ndarray, label: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate links between sorted rows; parts of regions are given as stars."""
    least = LEAST_AGREEMENT * TAIL
    differ = label[1:] != label[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), HEAD + TAIL)
    common[order[1:] != order[:-1]] = 0
    near = (common >= HEAD) & ((~differ[:, HEAD:]).sum(axis=1) >= least)
    left, right = [number[:-1][near]], [number[1:][near]]
    heads = np.r_[0, 1 + np.nonzero(common < HEAD)[0], len(number)]
    for start, end in zip(heads[:-1][np.diff(heads) > 2].tolist(), heads[1:][np.diff(heads) > 2].tolist()):
        for a, b in _parts(common, start, end, HEAD):
            if b - a == 2:
                continue
            tail = label[a:b, HEAD:]
            alike = (tail[:, None, :] == tail[None]).sum(axis=2, dtype=np.uint8) >= least
            star = np.arange(b - a)
            while True:
                lower = np.where(alike, star[None, :], b - a).min(axis=1)
                lower = lower[lower]
                if np.array_equal(lower, star):
                    break
                star = lower
            left.append(number[a:b])
            right.append(number[a:b][star])
    return np.concatenate(left), np.concatenate(right)


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b) with a < b: candidate links between class numbers, a spanning set of every region's."""

    def links(rows) -> pa.RecordBatch | None:
        a, b = _region_links(*rows)
        pairs = np.unique(np.sort(np.stack([a, b])[:, a != b], axis=0), axis=1)
        if not pairs.size:
            return None
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = (
                batch.column(0).to_numpy(zero_copy_only=False), _bytes_of(batch.column(1), HEAD + TAIL),
                batch.column(2).to_numpy(zero_copy_only=False),
            )
            if held is not None:
                rows = tuple(np.concatenate(pair) for pair in zip(held, rows))
            # the last region may go on in the next batch
            same = (rows[0] == rows[0][-1]) & (rows[1][:, :HEAD] == rows[1][-1, :HEAD]).all(axis=1)
            cut = int(np.argmax(same))
            done = len(same) if len(same) - cut > HELD_ROWS else cut
            if done and (out := links(tuple(x[:done] for x in rows))) is not None:
                yield out
            held = tuple(x[min(done, len(same) - 1) :].copy() for x in rows)
        if held is not None and (out := links(held)) is not None:
            yield out

    ordered = forest(classes).repartitionByRange("order", "label").sortWithinPartitions("order", "label")
    return ordered.mapInArrow(run, "a long, b long")


# --- links on full sets -------------------------------------------------------------------------


def linked(sets: list[np.ndarray], percent: int = PERCENT, parts: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets: 100 * intersection >= percent * union.

    Sets of equal `parts` are known to be connected; only links between different ones are told.
    """
    count = len(sets)
    if count < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    ends = np.r_[0, np.cumsum(sizes)]
    tokens, places = np.unique(np.concatenate(sets), return_inverse=True)
    by_token = np.argsort(places, kind="stable")
    owners = np.repeat(np.arange(count, dtype=np.int32), sizes)[by_token]
    starts = np.r_[0, np.cumsum(np.bincount(places, minlength=len(tokens)))]
    # sets of frequent shingles first: a text that many copies were made from gathers them at once
    central = np.add.reduceat(np.diff(starts)[places], ends[:-1]) / sizes
    # shingles that no other set holds are in no intersection
    sharable = np.add.reduceat((np.diff(starts)[places] > 1).astype(np.int64), ends[:-1])
    label = np.arange(count) if parts is None else np.unique(parts, return_inverse=True)[1]
    waiting, found = set(range(count)), []

    def largest() -> int:
        return int(np.bincount(label, minlength=count).argmax())

    while waiting:
        top = largest()
        todo = [int(x) for x in np.argsort(-central, kind="stable") if int(x) in waiting and label[x] != top]
        if not todo:
            return found
        for x in todo:
            if label[x] == top:
                continue
            waiting.discard(x)
            able = (100 + percent) * np.minimum(sharable[x], sharable) >= percent * (sizes[x] + sizes)
            if not (able & (label != label[x])).any():
                continue
            mine = places[ends[x] : ends[x + 1]]
            shared = np.bincount(np.concatenate([owners[starts[t] : starts[t + 1]] for t in mine]), minlength=count)
            hit = np.nonzero((100 * shared >= percent * (sizes[x] + sizes - shared)) & (label != label[x]))[0]
            if len(hit):
                groups, firsts = np.unique(label[hit], return_index=True)
                found.extend((x, int(y)) for y in hit[firsts])
                label[np.isin(label, groups)] = label[x]
                top = largest()
    return found


def _links_of(rows: DataFrame, percent: int, limit: int | None = None) -> DataFrame:
    """(a, b): `linked` within each group of `rows(root, order, number, part, members, label)`.

    With a limit, groups are cut into pieces of about so many shingles, in the order of their labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, numbers, parts, sets, held = None, [], [], [], 0

        def links() -> Iterator[pa.RecordBatch]:
            pairs = linked(sets, percent, parts)
            if pairs:
                ends = np.array(numbers)[np.array(pairs)]
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

        for batch in batches:
            roots, orders, found, known = (batch.column(i).to_pylist() for i in range(4))
            for i, key in enumerate(zip(roots, orders)):
                piece_full = limit is not None and held > limit and len(sets) > 32
                if key != group or piece_full:
                    yield from links()
                    group, numbers, parts, sets, held = key, [], [], [], 0
                if numbers and numbers[-1] == found[i]:
                    continue  # a repeated row
                numbers.append(found[i])
                parts.append(known[i])
                sets.append(np.frombuffer(batch.column(4)[i].as_buffer(), np.uint64).copy())
                held += len(sets[-1])
        if sets:
            yield from links()

    dealt = rows.repartition("root", "order").sortWithinPartitions("root", "order", "label", "number")
    return dealt.select("root", "order", "number", "part", "members").mapInArrow(run, "a long, b long")


def _meetings(members: DataFrame, found: DataFrame, percent: int, limit: int) -> DataFrame:
    """(number, root, part, order): where members of large groups meet, to find what `found` left apart.

    A part is what the links found connect. Every two members of different parts of a group that may
    be linked meet under one order, which holds about `limit` shingles.
    """
    links = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    parts = star_components(links).toDF("number", "part")
    owned = members.select("number", "root", "n_shingles").join(parts, "number", "left")
    owned = stage(owned.withColumn("part", F.coalesce("part", "number")), "parts")
    total = F.sum("n_shingles").alias("total")
    largest = owned.groupBy("root", "part").agg(total).groupBy("root").agg(F.max_by("part", F.struct("total", "part")).alias("top"))
    # sets that can be linked are of one tier or of neighbouring ones; a little wider than need be, for the logarithm's last digit
    tier = F.floor(F.log(F.col("n_shingles")) / F.log(F.lit(100 / max(percent - 0.5, 0.5))))
    owned = owned.join(largest, "root").select(
        "number", "root", "part", "n_shingles", tier.alias("tier"), (F.col("part") != F.col("top")).alias("apart")
    )
    blocks = F.ceil(2 * F.sum("n_shingles") / F.lit(limit)).alias("blocks")
    cells = owned.groupBy("root", "tier", "apart").agg(blocks)
    placed = owned.join(cells, ["root", "tier", "apart"]).select(
        "number", "root", "part", F.struct("tier", "apart", F.expr("pmod(xxhash64(number), blocks)").alias("block")).alias("cell")
    )
    cells = stage(cells.select("root", "tier", "apart", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block")), "cells")
    cells = cells.select("root", F.struct("tier", "apart", "block").alias("cell"))
    one, other = cells.withColumnRenamed("cell", "one"), cells.withColumnRenamed("cell", "other")
    near = (F.abs(F.col("one.tier") - F.col("other.tier")) <= 1) & (F.col("one.apart") | F.col("other.apart"))
    pairs = one.join(other, "root").where((F.col("one") <= F.col("other")) & near)
    pairs = stage(pairs.withColumn("order", F.monotonically_increasing_id()), "block_pairs")
    sides = F.explode(F.array_distinct(F.array("one", "other"))).alias("cell")
    return placed.join(pairs.select("root", "order", sides), ["root", "cell"]).select("number", "root", "part", "order")


def confirmed(members: DataFrame, docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int, limit: int) -> DataFrame:
    """(a, b): links within each group of `members(number, root, values, kept_id, kept_hash, n_shingles)` that connect all that are linked."""
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    large = stage(sizes.where((F.col("total") > limit) & (F.col("n") > 32)).select("root"), "large_groups")
    fetched = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("_hash"))
    keys = members.select("number", "root", "kept_id", "kept_hash")
    rows = fetched.join(keys, F.col("_id").eqNullSafe(F.col("kept_id")) & F.col("_hash").eqNullSafe(F.col("kept_hash")))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = ShingleHasher(shingle)
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for at in range(0, batch.num_rows, 256):
                part = [hashed(texts[i].as_py()).tobytes() for i in range(at, min(at + 256, batch.num_rows))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 256), batch.column(1).slice(at, 256), pa.array(part, pa.large_binary()).cast(pa.binary())],
                    ["number", "root", "members"],
                )

    sets = rows.select("number", "root", "_text").mapInArrow(to_sets, "number long, root long, members binary")
    own, unlabelled = F.col("number").alias("part"), F.lit(b"").alias("label")
    whole = lambda df: _links_of(df.select("root", F.lit(-1).alias("order"), "number", own, "members", unlabelled), percent)
    if large.isEmpty():
        return whole(sets)
    sets = stage(sets, "sets")
    held = sets.join(large, "root").select("number", "members")
    cut = members.join(large, "root")
    pieces = held.join(forest(cut, PIECE_ORDERS).join(cut.select("number", "root"), "number"), "number").withColumn("part", own)
    found = stage(_links_of(pieces, percent, limit), "piece_links")
    meetings = stage(_meetings(cut, found, percent, limit), "meetings")
    links = whole(sets.join(large, "root", "left_anti")).unionByName(found)
    if meetings.isEmpty():
        return links
    return links.unionByName(_links_of(held.join(meetings, "number").withColumn("label", F.lit(b"")), percent))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, limit: int = LIMIT
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct shingles
    (texts of fewer words: the whole sequence; A-Z lower-cased; words stand between ASCII white
    space). component_id is the smallest id that can be reached; kept says whether it is the row's
    own. Null texts and texts without words have an empty set and are linked with nothing. Rows
    without an id take part; a component of such rows only has a null id, and they are kept.
    Repeated rows give repeated rows. Extra columns are ignored; an empty table gives an empty table.
    """
    marks = stage(set_marks(docs, doc_id, text, shingle), "set_marks")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("kept")
    grouped = marks.where("n_shingles > 0").groupBy("key").agg(
        first, F.min("doc_id").alias("first_id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("values").alias("values")
    )
    classes = stage(
        grouped.select(
            F.monotonically_increasing_id().alias("number"), "key", "first_id", "n_shingles", "values",
            F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_hash").alias("kept_hash"),
        ),
        "set_classes",
    )
    groups = star_components(candidates(classes)).withColumnRenamed("v", "number")
    members = stage(groups.join(classes.drop("key", "first_id"), "number"), "candidate_groups")
    links = confirmed(members, docs, doc_id, text, shingle, percent, limit)
    roots = star_components(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    narrow = classes.select("number", "key", "first_id")
    rooted = stage(
        narrow.join(roots.withColumnRenamed("v", "number"), "number", "left").select("key", "first_id", F.coalesce("root", "number").alias("root")),
        "set_roots",
    )
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")).where("n > 1")
    named = rooted.join(lowest.select("root", "component_id", F.lit(True).alias("several")), "root", "left").select(
        "key", F.when(F.col("several"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id")
    )
    found = marks.where("n_shingles > 0").select("doc_id", "n_shingles", "key").join(named, "key")
    empty = marks.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    every = found.select("doc_id", "n_shingles", "component_id").unionByName(empty)
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
