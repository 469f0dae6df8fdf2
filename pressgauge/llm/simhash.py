"""Near-duplicate documents by SimHash, found through a Golay code.

A document's fingerprint has 64 bits: a bit is set if it is set in over half of the 64-bit hashes
of the document's word shingles. Documents whose fingerprints differ in at most three bits are
linked, and linked documents form groups.

Links are found without comparing all fingerprints. A fingerprint is cut into three segments of 22,
21 and 21 bits. The binary Golay code of length 23 is perfect: every word lies within three bits of
one codeword. A word's *own* key is that codeword; its *near* keys add the codewords at distance
four (there are five of them, and only for words at distance three). If two words differ in at most
one bit, the own key of each is among the near keys of the other. Three errors fall on the three
segments as (3,0,0), (2,1,0) or (1,1,1), up to order, or fewer, so two fingerprints share

* one segment exactly and the codeword of another one (six ordered pairs of segments), or
* the codewords of the last two segments and one half of the first exactly (two halves).

Each fingerprint gives 8 own keys and about 88 near keys of 33 to 35 bits. Equal keys are joined
and every candidate is verified by its bit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import free_name, over_batches, ship_code, star_components, texts_of
from pressgauge.session import stage

# --- fixed values: the Golay code and the segments ---------------------------------------------
GENERATOR = 0b110001110101
LENGTH, CHECK_BITS = 23, 11
SEGMENTS = ((0, 22), (22, 21), (43, 21))
HALF = 11
# -----------------------------------------------------------------------------------------------

SEED = 42
SHINGLE = 3
MAX_DISTANCE = 3
OWN_ROWS = 4096
SMALL_GROUP = 64


# --- fingerprints -------------------------------------------------------------------------------


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text; zero if it has no word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        block = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, text_hash) for every row; fp is the fingerprint as a signed long.

    A null text counts as empty; its fingerprint is zero, as for a text without words.
    """

    ship_code(docs.sparkSession)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = np.fromiter((fingerprint(x, shingle) for x in texts_of(batch, 1)), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(marks.view(np.int64)), batch.column(2)], ["doc_id", "fp", "text_hash"]
        )

    rows = docs.select(F.col(doc_id).cast("long"), F.col(text), F.xxhash64(F.col(text)))
    return rows.mapInArrow(over_batches(make), "doc_id long, fp long, text_hash long")


# --- Golay keys ---------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndrome of each single bit, correction for each syndrome, the six changes per syndrome)."""
    unit = np.zeros(LENGTH, np.int64)
    for bit in range(LENGTH):
        rest = 1 << bit
        for high in range(bit, CHECK_BITS - 1, -1):
            if rest >> high & 1:
                rest ^= GENERATOR << (high - CHECK_BITS)
        unit[bit] = rest
    changes = np.full((1 << CHECK_BITS, 6), -1, np.int64)
    used = np.zeros(1 << CHECK_BITS, np.int64)
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            syndrome = int(np.bitwise_xor.reduce(unit[list(bits)])) if bits else 0
            changes[syndrome, used[syndrome]] = sum(1 << b for b in bits)
            used[syndrome] += 1
    return unit, changes[:, 0], changes


@lru_cache(maxsize=1)
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    unit, _, _ = _code()
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for bit in range(12):
        low[np.arange(1 << 12) >> bit & 1 == 1] ^= unit[bit]
    for bit in range(11):
        high[np.arange(1 << 11) >> bit & 1 == 1] ^= unit[12 + bit]
    return low, high


def near_codewords(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word six codeword numbers, the nearest codeword first; -1 where there are fewer."""
    low, high = _syndromes()
    changes = _code()[2][low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(changes < 0, -1, (words[:, None] ^ changes) >> CHECK_BITS)


def keys_of(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, position of the fingerprint, whether it is an own key) for unsigned fingerprints."""
    segments = [(marks >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1) for at, width in SEGMENTS]
    codes = [near_codewords(s) for s in segments]
    where = np.arange(len(marks))
    keys, rows, own = [], [], []

    def add(kind: int, key: np.ndarray, valid: np.ndarray, is_own: bool) -> None:
        keys.append((kind << 36 | key)[valid])
        rows.append(where[valid])
        own.append(np.full(int(valid.sum()), is_own))

    for kind, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        for k in range(6):
            code = codes[j][:, k]
            add(kind, segments[i] << 12 | code, code >= 0, k == 0)
    for half in range(2):
        part = segments[0] >> (HALF * half) & ((1 << HALF) - 1)
        for k in range(6):
            for m in range(6):
                left, right = codes[1][:, k], codes[2][:, m]
                add(6 + half, part << 24 | left << 12 | right, (left >= 0) & (right >= 0), k == m == 0)
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(own)


def _keys(classes: DataFrame, only_own: bool = False) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(marks), 2000):
                part = marks[at : at + 2000]
                key, row, own = keys_of(part.view(np.uint64))
                if only_own:
                    key, row, own = key[own], row[own], own[own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(part[row]), pa.array(~own)], ["key", "fp", "probe"]
                )

    return classes.select("fp").mapInArrow(make, "key long, fp long, probe boolean")


# --- links --------------------------------------------------------------------------------------


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))


class _LargeGroup:
    """One key with many rows: own rows in memory (at most OWN_ROWS), probes as they come.

    Gives a spanning forest of the links, one edge per row at most, not all pairs.
    """

    def __init__(self, own: np.ndarray, limit: int):
        self.own, self.limit = own, limit
        self.label = np.arange(len(own))

    def feed(self, probes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(probes), 512):
            part = probes[at : at + 512]
            row, col = np.nonzero(_distance(self.own[:, None], part[None, :]) <= self.limit)
            if not len(row):
                continue
            while True:
                least = np.full(len(part), len(self.own))
                np.minimum.at(least, col, self.label[row])
                target = np.arange(len(self.own))
                np.minimum.at(target, self.label[row], least[col])
                label = target[self.label]
                while not np.array_equal(label, label[label]):
                    label = label[label]
                if np.array_equal(label, self.label):
                    break
                self.label = label
            met = least < len(self.own)
            yield part[met], self.own[least[met]]

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        return self.own, self.own[self.label]


def _links_of(limit: int):
    """mapInArrow function: rows (key, probe, fp) sorted by key, own rows first, to links (a, b)."""

    def small(key, fp, probe, starts, sizes):
        own_rows = np.nonzero(~probe)[0]
        group = np.searchsorted(starts, own_rows, "right") - 1
        reps = sizes[group]
        if not reps.sum():
            return None
        left = np.repeat(own_rows, reps)
        ends = np.cumsum(reps)
        right = np.arange(ends[-1]) - np.repeat(ends - reps, reps) + np.repeat(starts[group], reps)
        a, b = fp[left], fp[right]
        good = (a != b) & (_distance(a, b) <= limit)
        return (a[good], b[good]) if good.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        large, large_key = None, None

        def batch_of(pair):
            a, b = pair
            good = a != b
            lo, hi = np.minimum(a[good], b[good]), np.maximum(a[good], b[good])
            pairs = np.unique(np.stack([lo, hi]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        def grouped(key, fp, probe):
            starts = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0] if len(key) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[starts, len(key)])
            big = sizes > SMALL_GROUP
            for s, n in zip(starts[big].tolist(), sizes[big].tolist()):
                part, flag = fp[s : s + n], probe[s : s + n]
                if not flag.all():
                    work = _LargeGroup(part[~flag], limit)
                    yield from work.feed(part)
                    yield work.close()
            inside = np.repeat(~big & (sizes > 1), sizes)
            if inside.any() and (pair := small(*_narrow(key, fp, probe, inside))) is not None:
                yield pair

        for batch in batches:
            key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            probe = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if not len(key):
                continue
            if large is not None:
                same = int(np.searchsorted(key, large_key, "right"))
                for pair in large.feed(fp[:same]):
                    yield batch_of(pair)
                if same == len(key):
                    continue
                yield batch_of(large.close())
                large = None
                key, fp, probe = key[same:], fp[same:], probe[same:]
            kept.append((key, fp, probe))
            key, fp, probe = (np.concatenate(x) for x in zip(*kept))
            cut = int(np.searchsorted(key, key[-1], "left"))
            for pair in grouped(key[:cut], fp[:cut], probe[:cut]):
                yield batch_of(pair)
            kept = [(key[cut:], fp[cut:], probe[cut:])]
            if len(key) - cut > 4 * OWN_ROWS:
                own = fp[cut:][~probe[cut:]]
                large, large_key, kept = _LargeGroup(own, limit), key[-1], []
                for pair in large.feed(fp[cut:]):
                    yield batch_of(pair)
        if kept:
            for pair in grouped(*kept[0]):
                yield batch_of(pair)
        if large is not None:
            yield batch_of(large.close())

    return run


def _narrow(key, fp, probe, inside):
    key, fp, probe = key[inside], fp[inside], probe[inside]
    starts = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
    return key, fp, probe, starts, np.diff(np.r_[starts, len(key)])


def links(classes: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of `classes(fp)`: a spanning set, no link lost.

    Rows are shuffled by key and read in key order, own rows first. Keys with more than OWN_ROWS own
    rows are cut into blocks of own rows, each of which meets all probes of the key, so no task
    holds more than a block.
    """
    if max_distance > MAX_DISTANCE:
        raise ValueError("the keys guarantee links up to three bits")
    classes = stage(classes.select("fp"), "fingerprints")
    rows = _keys(classes)
    counts = _keys(classes, only_own=True).groupBy("key").count().where(F.col("count") > OWN_ROWS)
    hot = stage(counts.select("key", F.ceil(F.col("count") / (OWN_ROWS // 2)).cast("int").alias("blocks")), "hot_keys")
    if hot.isEmpty():
        placed = rows.withColumn("block", F.lit(0))
    else:
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        split = rows.join(hot, "key", "left")
        placed = (
            split.withColumn(
                "copies",
                F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("block"), F.col("probe"))))
                .when(F.col("probe"), F.transform(every, lambda b: F.struct(b.alias("block"), F.lit(True).alias("probe"))))
                .otherwise(F.transform(every, lambda b: F.struct(b.alias("block"), (b != block).alias("probe")))),
            )
            .select("key", "fp", F.inline("copies"))
        )
        # one number per (key, block), so that the reader sees blocks as keys of their own
        placed = placed.withColumn("key", F.when(F.col("block") == 0, F.col("key")).otherwise(
            -F.abs(F.xxhash64("key", "block")) - 1))
    ordered = (
        placed.select("key", "fp", "probe")
        .repartition("key")
        .sortWithinPartitions("key", "probe")
    )
    return ordered.mapInArrow(_links_of(max_distance), "a long, b long")


def components(marks: DataFrame) -> DataFrame:
    """(fp, root, component_id) per distinct fingerprint of `marks(doc_id, fp)`.

    root names the component by its smallest fingerprint. component_id is the smallest doc_id that
    can be reached, null if no row of the component has an id.
    """
    classes = stage(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = star_components(links(classes))
    joined = classes.join(roots, classes.fp == roots.v, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    joined = stage(joined, "rooted")
    firsts = stage(joined.groupBy("root").agg(F.min("first_id").alias("component_id")), "firsts")
    return stage(joined.join(firsts, "root").select("fp", "root", "component_id"), "members")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """(doc_id, fp, text_hash, root, component_id), one row per input row.

    Null texts count as empty, and texts without a word have fingerprint zero and are linked like
    any other. A row without an id takes part in links; it never names a component unless all rows
    of its component lack an id (then component_id is null). Repeated rows give repeated rows.
    Extra columns are ignored. An empty table gives an empty table.
    """
    marks = stage(fingerprints(docs, doc_id, text, shingle), "marks")
    return marks.join(components(marks), "fp").select("doc_id", "fp", "text_hash", "root", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`docs` without all but one row of each group, with its columns as they are.

    Kept is the row with the smallest id (a missing id comes last), then the smallest text hash.
    """
    grouped = stage(near_duplicates(docs, doc_id, text, shingle), "grouped")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    best = grouped.groupBy("root").agg(F.min(rank).alias("rank"))
    kept_id, kept_hash = free_name(docs, "_kept_id"), free_name(docs, "_kept_hash")
    kept = stage(best.select(F.col("rank.doc_id").alias(kept_id), F.col("rank.text_hash").alias(kept_hash)), "kept")
    same = docs[doc_id].cast("long").eqNullSafe(F.col(kept_id)) & (F.xxhash64(docs[text]) == F.col(kept_hash))
    rows = docs.join(kept, same, "left_semi")
    repeated = grouped.groupBy("doc_id", "text_hash").count().where("count > 1")
    return rows if repeated.isEmpty() else rows.dropDuplicates([doc_id, text])
