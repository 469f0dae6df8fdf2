"""Scoring texts by class-based bigrams (Brown clustering by the exchange algorithm).

A word's probability after another is the probability of its class after the other's class, times
the probability of the word in its class. Every word of the corpus has a class of its own choice:

* the CORE most frequent words, by rank, are exchanged one by one, and all other words in POOLS pools by
  their last three bytes;
* then every other word of the training rows moves to the class that suits the classes before and after it
  best. Counts by word and class are summed by key, and words choose in tasks; only the grid of classes and
  the labels of the dictionary meet the driver. The labels of all other words stay in a table.

Only words that no training row has get their class from their pool. Word counts, class sizes, transitions and the unigram figures come from all training rows. The words
above a second threshold (at most DICTIONARY) travel to the tasks with their counts, which covers
most tokens; the counts and classes of the others are joined, one row per place in a document.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import ship_code, texts_of
from pressgauge.session import stage

CORE = 1024
POOLS = 128
CLASSES = 48
DICTIONARY = 300_000
SWEEPS = 10
FLUSH = 400_000
STREAM = 2_000_000
SIDE = CLASSES + 1
CELL = np.dtype([("cell", "u1"), ("n", "<u4")])  # class after the word, or SIDE + class before it
#: the end of a text; no word holds a white-space byte
END = b"\n"


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z only) runs without ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def pool_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % POOLS


# --- counts -------------------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over a one-column table of texts, each followed by END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"]
            )
            counts.clear()
            return out

        for batch in batches:
            for text in texts_of(batch, 0):
                counts.update(words_of(text))
            counts[END] += batch.num_rows
            if len(counts) > FLUSH:
                yield flushed()
        if counts:
            yield flushed()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def threshold(counts: DataFrame, most: int) -> int:
    """The smallest power of two such that at most `most` words occur that often."""
    powers = [2**k for k in range(1, 62)]
    row = counts.agg(F.count("*"), *[F.count_if(F.col("c") >= p) for p in powers]).first()
    return next((p for p, n in zip([1, *powers], row) if n <= most), powers[-1])


@dataclass
class Words:
    """The dictionary: words, their counts and units. Units are CORE words, then pools, then END."""

    words: list[bytes]
    counts: np.ndarray
    units: np.ndarray
    core: int

    @property
    def n_units(self) -> int:
        return self.core + POOLS + 1

    def numbers(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}


_numbers: dict[str, dict[bytes, int]] = {}


def _lookup(name: str, words: Words) -> dict[bytes, int]:
    """The dictionary by word, built once per worker process."""
    if name not in _numbers:
        _numbers.clear()
        _numbers[name] = words.numbers()
    return _numbers[name]


def dictionary(counts: DataFrame) -> tuple[Words, int]:
    """The frequent words, those of the core by rank among them, and END; the count from which a word is frequent."""
    least = threshold(counts, DICTIONARY)
    top = counts.orderBy(F.desc("c"), "word").limit(CORE + 1)  # END may be one of them
    rows = counts.where((F.col("c") >= least) | (F.col("word") == F.lit(END))).unionByName(top).distinct().toArrow()
    words, c = rows.column("word").to_pylist(), rows.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))
    words, c = [bytes(words[i]) for i in order], c[order].astype(np.int64)
    core = min(CORE, sum(w != END for w in words))
    units, at = np.zeros(len(words), np.int64), 0
    for i, w in enumerate(words):
        if w == END:
            units[i] = core + POOLS
        elif at < core:
            units[i], at = at, at + 1
        else:
            units[i] = core + pool_of(w)
    return Words(words, c, units, core), least


def _units(words: list[bytes], known: dict[bytes, int], table: Words) -> tuple[np.ndarray, np.ndarray]:
    """(dictionary number or -1, unit) of each word."""
    get = known.get
    number = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
    unit = table.units[number] if len(table.units) else np.zeros(len(words), np.int64)
    for i in np.nonzero(number < 0)[0].tolist():
        unit[i] = table.core + pool_of(words[i])
    return number, unit


def key_of(word: bytes) -> int:
    """A negative number for a word outside the dictionary."""
    return -1 - (int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") >> 1)


def streams(texts: DataFrame, table: Words) -> DataFrame:
    """(numbers, keys): texts one after the other as int32 numbers, each followed by its end, in portions.

    Numbers are those of the dictionary, its size for an end, -1 - pool for all other words; the
    keys of these stand in `keys`, as int64, in the same order. A portion begins with an end.
    """
    name = uuid.uuid4().hex
    sent = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        known, end = _lookup(name, table), len(table.words)
        get = known.get

        def packed(numbers: list[int], keys: list[int]) -> pa.RecordBatch:
            data = [np.array(numbers, np.int32).tobytes()], [np.array(keys, np.int64).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array(d, pa.binary()) for d in data], ["numbers", "keys"])

        numbers, keys = [end], []
        for batch in batches:
            for text in texts_of(batch, 0):
                at, words = len(numbers), words_of(text)
                numbers += [get(w, -1) for w in words]
                for i, w in enumerate(words, at):
                    if numbers[i] < 0:
                        numbers[i] = -1 - pool_of(w)
                        keys.append(key_of(w))
                numbers.append(end)
                if len(numbers) > STREAM:
                    yield packed(numbers, keys)
                    numbers, keys = [end], []
        if len(numbers) > 1:
            yield packed(numbers, keys)

    return texts.mapInArrow(run, "numbers binary, keys binary")


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for numbers, keys in zip(batch.column(0), batch.column(1)):
            yield np.frombuffer(numbers.as_py(), np.int32), np.frombuffer(keys.as_py(), np.int64)


def unit_bigrams(stream: DataFrame, table: Words) -> np.ndarray:
    """How often unit a precedes unit b; END stands before the first word and after the last.

    Tasks send their non-zero cells, of a square of fixed size, which are summed before they are collected.
    """
    size = table.n_units
    units = np.r_[table.units, size - 1]
    core = table.core
    sent = stream.sparkSession.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, total = sent.value, np.zeros(size * size, np.int64)
        for numbers, _ in _portions(batches):
            at = np.where(numbers >= 0, units[np.maximum(numbers, 0)], core - 1 - numbers)
            total += np.bincount(at[:-1] * size + at[1:], minlength=size * size)
        cells = np.nonzero(total)[0]
        if len(cells):
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    rows = stream.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    result = np.zeros(size * size, np.int64)
    result[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return result.reshape(size, size)


# --- exchange clustering ------------------------------------------------------------------------


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit. The last unit (END) keeps a class of its own, the last one.

    Starting from classes dealt by frequency, each unit in turn moves to the class that raises the
    likelihood of the class bigrams most, until a sweep moves none (or `sweeps` have been made).
    """
    size = len(pairs)
    weight = pairs.sum(0) + pairs.sum(1)
    free = size - 1
    label = np.zeros(size, np.int64)
    label[np.argsort(-weight[:free], kind="stable")] = np.arange(free) % classes
    label[free] = classes
    one = np.eye(classes + 1, dtype=np.float64)[label]
    pairs = pairs.astype(np.float64)
    right, left = pairs @ one, pairs.T @ one
    grid = one.T @ right
    outs, ins = pairs.sum(1), pairs.sum(0)
    for _ in range(sweeps):
        moved = False
        for u in np.argsort(-weight[:free], kind="stable"):
            if not weight[u]:
                continue
            old, self_ = label[u], pairs[u, u]
            r, l = right[u].copy(), left[u].copy()
            r[old] -= self_
            l[old] -= self_
            grid[old] -= r
            grid[:, old] -= l
            grid[old, old] -= self_
            rows, cols = grid.sum(1), grid.sum(0)
            base = _f(grid)
            gain = (_f(grid + r) - base).sum(1) + (_f(grid + l[:, None]) - base).sum(0)
            diagonal = np.diagonal(grid)
            gain += _f(diagonal + r + l + self_) + _f(diagonal) - _f(diagonal + r) - _f(diagonal + l)
            gain -= _f(rows + outs[u]) - _f(rows) + _f(cols + ins[u]) - _f(cols)
            gain[classes] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9 * abs(gain[old]):
                new = old
            grid[new] += r
            grid[:, new] += l
            grid[new, new] += self_
            if new != old:
                label[u], moved = new, True
                right[:, old] -= pairs[:, u]
                right[:, new] += pairs[:, u]
                left[:, old] -= pairs[u]
                left[:, new] += pairs[u]
        if not moved:
            break
    return label


# --- every other word chooses its class ---------------------------------------------------------

#: decides between classes of equal gain, such as empty ones, alike for words among the same neighbours
_TIES = 1e-7 * np.random.default_rng(0).random((2 * SIDE, CLASSES))
#: counts whose gains are read from a table
TABLED = 32


def _unit_labels(numbers: np.ndarray, label: np.ndarray, pools: np.ndarray) -> np.ndarray:
    """The class of each token of a portion by its unit; `label` has those of the dictionary and the end."""
    found = label[np.maximum(numbers, 0)]
    rare = numbers < 0
    found[rare] = pools[-1 - numbers[rare]]
    return found


def contexts(stream: DataFrame, table: Words, label: np.ndarray, pools: np.ndarray) -> DataFrame:
    """(key, own, cells): how often each class stands after and before a word outside the core.

    Cells are sorted and summed within a portion, so a task holds a portion and sends one row per word
    and portion. `own` is the class of the word's unit.
    """
    chooses = np.r_[table.units >= table.core, False]
    sent = stream.sparkSession.sparkContext.broadcast((label, pools, chooses))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, pools, chooses = sent.value
        known, width = len(label), 2 * SIDE
        for numbers, keys in _portions(batches):
            classes = _unit_labels(numbers, label, pools)
            names, places = np.unique(keys, return_inverse=True)
            word = numbers.astype(np.int64)
            word[numbers < 0] = known + places
            at = np.flatnonzero((numbers < 0) | chooses[np.maximum(numbers, 0)])
            cells = np.concatenate([word[at] * width + classes[at + 1], word[at] * width + SIDE + classes[at - 1]])
            cells.sort()
            heads = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
            word, cell = cells[heads] // width, cells[heads] % width
            own = np.r_[label, np.zeros(len(names), label.dtype)]
            own[word[word >= known]] = 0
            own[known + places] = classes[numbers < 0]
            key = np.where(word < known, word, names[np.maximum(word - known, 0)] if len(names) else word)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
            packed = _packed(first, cell, np.diff(np.r_[heads, len(cells)]))
            for low in range(0, len(first), 50_000):
                part = slice(low, low + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[first][part]), pa.array(own[word[first]][part], pa.int32()), packed.slice(low, 50_000)], ["key", "own", "cells"]
                )

    return stream.mapInArrow(run, "key long, own int, cells binary")


def _packed(first: np.ndarray, cells: np.ndarray, counts: np.ndarray) -> pa.Array:
    """CELL records as bytes, one value from each of the places `first` on."""
    records = np.empty(len(cells), CELL)
    records["cell"], records["n"] = cells, counts
    offsets = (np.r_[first, len(cells)] * CELL.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(records.tobytes())])


def best_classes(own: np.ndarray, row: np.ndarray, cell: np.ndarray, n: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """The class that raises the likelihood most, for each word taken by itself; cells stand by row, then cell."""
    gain = np.zeros((len(own), CLASSES))
    rows, cols = grid.sum(1)[:CLASSES], grid.sum(0)[:CLASSES]
    sides = np.concatenate([grid[:CLASSES].T, grid[:, :CLASSES]])  # per cell, the counts with each class
    small = np.arange(1, TABLED + 1.0)[:, None, None]
    tabled = _f(sides + small) - _f(sides) + small * _TIES
    for low in range(0, len(cell), 50_000):
        part = slice(low, low + 50_000)
        here, size = cell[part], n[part]
        value = tabled[np.minimum(size, TABLED).astype(np.int64) - 1, here]
        large = np.flatnonzero(size > TABLED)
        base, many = sides[here[large]], size[large, None]
        value[large] = _f(base + many) - _f(base) + many * _TIES[here[large]]
        # the word's own class is counted without the word
        mine, at = own[row[part]], np.arange(len(here))
        base = np.maximum(sides[here, mine] - size, 0)
        value[at, mine] = _f(base + size) - _f(base) + size * _TIES[here, mine]
        heads = np.flatnonzero(np.r_[True, row[part][1:] != row[part][:-1]])
        gain[row[part][heads]] += np.add.reduceat(value, heads, axis=0)
    weight = np.bincount(row[cell < SIDE], n[cell < SIDE], len(own))
    for sums in (rows, cols):
        base = np.repeat(sums[None], len(own), axis=0)
        at = np.arange(len(own)), own
        base[at] = np.maximum(base[at] - weight, 0)
        gain -= _f(base + weight[:, None]) - _f(base)
    new, here = gain.argmax(1), np.arange(len(own))
    return np.where(gain[here, new] > gain[here, own] + 1e-9 * np.abs(gain[here, own]), new, own)


def choose(context: DataFrame, grid: np.ndarray) -> DataFrame:
    """(key, label, c): the class that each word chooses by the classes around it, and its count.

    Rows of `contexts` are dealt by word and read in order; a word's rows are summed as they come.
    """
    sent = context.sparkSession.sparkContext.broadcast(grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, width = sent.value, 2 * SIDE
        held = None  # the last word's key, class and counts so far

        def chosen(key: np.ndarray, own: np.ndarray, row: np.ndarray, cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            label = best_classes(own, row, cell, n, grid).astype(np.int32)
            count = np.bincount(row[cell < SIDE], n[cell < SIDE], len(own)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(label), pa.array(count)], ["key", "label", "c"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, owns = (batch.column(i).to_numpy() for i in (0, 1))
            heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            records = [x.as_py() for x in batch.column(2)]
            row = np.repeat(np.cumsum(np.r_[True, keys[1:] != keys[:-1]]) - 1, [len(x) // CELL.itemsize for x in records])
            records = np.frombuffer(b"".join(records), CELL)
            at, where = np.unique(row * width + records["cell"], return_inverse=True)
            n = np.bincount(where, records["n"], len(at))
            key, own, row, cell = keys[heads], owns[heads].astype(np.int64), at // width, at % width
            if held is not None:
                if held[0][0] == key[0]:
                    total = held[4] + np.bincount(cell[row == 0], n[row == 0], width)
                    rest = row > 0
                    full = np.flatnonzero(total)
                    row, cell = np.r_[np.zeros(len(full), np.int64), row[rest]], np.r_[full, cell[rest]]
                    n = np.r_[total[full], n[rest]]
                else:
                    full = np.flatnonzero(held[4])
                    yield chosen(held[0], held[1], np.zeros(len(full), np.int64), full, held[4][full])
            last = len(key) - 1
            done = row < last
            if last:
                yield chosen(key[:last], own[:last], row[done], cell[done], n[done])
            held = key[last:], own[last:], None, None, np.bincount(cell[~done], n[~done], width)
        if held is not None:
            full = np.flatnonzero(held[4])
            yield chosen(held[0], held[1], np.zeros(len(full), np.int64), full, held[4][full])

    dealt = context.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key long, label int, c long")


def class_grid(stream: DataFrame, label: np.ndarray, rare: DataFrame) -> np.ndarray:
    """How often class a precedes class b, by the final classes of all words.

    `label` has the classes of the dictionary and the end; those of all other words are joined to the
    pairs that such a word stands in.
    """
    sent = stream.sparkSession.sparkContext.broadcast(label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = sent.value
        for numbers, keys in _portions(batches):
            token = label[np.maximum(numbers, 0)]
            token[numbers < 0] = keys
            x, y = token[:-1], token[1:]
            both = (x >= 0) & (y >= 0)
            cells = np.bincount(x[both] * SIDE + y[both], minlength=SIDE * SIDE)
            full = np.flatnonzero(cells)
            columns = np.r_[full // SIDE, x[~both]], np.r_[full % SIDE, y[~both]], np.r_[cells[full], np.ones((~both).sum(), np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["x", "y", "n"])

    pairs = stage(stream.mapInArrow(run, "x long, y long, n long"), "pairs")
    total = F.sum("n").alias("n")
    of = lambda side: rare.select(F.col("key").alias(side), F.col("label").cast("long").alias("label"))
    right = pairs.where("y < 0").join(of("y"), "y").groupBy("x", F.col("label").alias("y")).agg(total)
    known = pairs.where("y >= 0").groupBy("x", "y").agg(total).unionByName(right)
    known = stage(known, "pairs")
    left = known.where("x < 0").join(of("x"), "x").groupBy(F.col("label").alias("x"), "y").agg(total)
    grid = np.zeros((SIDE, SIDE))
    for r in known.where("x >= 0").unionByName(left).groupBy("x", "y").agg(total).collect():
        grid[r["x"], r["y"]] = r["n"]
    return grid


@dataclass
class Model:
    words: Words
    label: np.ndarray  # class of each unit
    transitions: np.ndarray  # log10 P(class | class before)
    scale: np.ndarray  # log10 of the denominator of P(word | class)
    tokens: int  # training tokens, with ends
    least: int  # count from which a word is in the dictionary
    base_scale: float  # log10 of the denominator of the unigram figure
    rare: DataFrame | None = None  # (key, label, c) of the words outside the dictionary; not sent to tasks


def learn(texts: DataFrame, counts: DataFrame) -> Model:
    """Fits the model to a one-column table of training texts and its staged word counts."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    table, least = dictionary(counts)
    stream = stage(streams(texts, table), "streams")
    pairs = unit_bigrams(stream, table)
    units = exchange(pairs)
    one = np.eye(CLASSES + 1)[units]
    label, pools = np.r_[units[table.units], CLASSES], units[table.core : table.core + POOLS]
    chosen = stage(choose(contexts(stream, table, label, pools), one.T @ pairs @ one), "classes")
    rows = chosen.where("key >= 0").select("key", "label").toArrow()
    label[rows.column("key").to_numpy()] = rows.column("label").to_numpy()
    rare = chosen.where("key < 0")
    grid = class_grid(stream, label, rare)
    classes = CLASSES + 1
    transitions = np.log10((grid + 0.5) / (grid.sum(1, keepdims=True) + 0.5 * classes))
    mass, kinds = np.zeros(classes), np.zeros(classes)
    np.add.at(mass, label[:-1], table.counts)
    np.add.at(kinds, label[:-1], 1)
    for r in rare.groupBy("label").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        mass[r["label"]] += r["c"]
        kinds[r["label"]] += r["v"]
    scale = np.log10(mass + 0.5 * (kinds + 1))
    # from here on every word of the dictionary is a unit
    number = np.arange(len(table.words))
    ends = np.array([w == END for w in table.words], bool)
    table = Words(table.words, table.counts, np.where(ends, len(number) + POOLS, number), len(number))
    label = np.r_[label[:-1], units[-1 - POOLS : -1], CLASSES]
    base_scale = float(np.log10(tokens + 0.5 * (distinct + 1)))
    return Model(table, label, transitions, scale, tokens, least, base_scale, rare)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


# --- scores -------------------------------------------------------------------------------------


def score(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) per row of `docs`.

    The model learns from the rows where `train` holds. base_score is the add-half unigram log10
    probability, score the class model's. A null text counts as empty: it is its end alone. Repeated
    rows are scored one by one. Without training rows all words are unknown. Extra columns are
    ignored; an empty table gives an empty table.
    """
    ship_code(docs.sparkSession)
    texts = docs.where(train).select(F.col(text))
    counts = stage(word_counts(texts), "word_counts")
    model = learn(texts, counts)
    sent, name = docs.sparkSession.sparkContext.broadcast(replace(model, rare=None)), uuid.uuid4().hex
    schema = "row long, doc_id long, pos int, key long, label int, before int, after int, n_tokens long, n_known long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        known = _lookup(name, model.words)
        log_count = np.log10(model.words.counts + 0.5)
        row = TaskContext.get().partitionId() << 33  # numbers rows of a file scan the same way in every attempt
        end = known.get(END)
        end_log = log_count[end] if end is not None else np.log10(0.5)
        last = model.label[-1]
        for batch in batches:
            out: list[list] = [[] for _ in range(11)]

            def add(*values):
                for column, value in zip(out, values):
                    column.append(value)

            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch, 1)):
                words = words_of(text)
                number, unit = _units(words, known, model.words)
                found = np.r_[True, number >= 0, True]
                label = np.r_[last, model.label[unit], last]
                logs = float(log_count[number[number >= 0]].sum()) + end_log
                both = found[:-1] & found[1:]
                steps = float(model.transitions[label[:-1][both], label[1:][both]].sum())
                fit = steps - float(model.scale[label[1:][found[1:]]].sum()) + logs
                tokens = len(words) + 1
                base = logs - tokens * model.base_scale
                add(row, doc, None, None, None, None, None, tokens, int((number >= 0).sum()) + (end is not None), base, fit)
                near = np.where(found, label, -1).tolist()
                for i in np.nonzero(~found)[0].tolist():
                    add(row, None, i, key_of(words[i - 1]), int(label[i]), near[i - 1], near[i + 1], None, None, None, None)
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[f.split()[1]]) for c, f in zip(out, schema.split(", "))], [f.split()[0] for f in schema.split(", ")])

    rows = stage(docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, schema), "scored")
    learned = model.rare.withColumnRenamed("label", "own")
    rest = rows.where("key is not null").join(learned, "key", "left").select(
        "row", F.struct("pos", F.coalesce("own", "label").alias("label"), F.coalesce("c", F.lit(0)).alias("c"), "before", "after").alias("place")
    )

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            places = batch.column(1)
            owner = np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy())
            flat = places.flatten()
            pos, label, c, before, after = (flat.field(i).to_numpy() for i in range(5))
            order = np.lexsort((pos, owner))
            owner, label, c, before, after = (x[order] for x in (owner, label, c, before, after))
            # a word outside the dictionary after another one is the next place of the same row
            after = np.where(after < 0, np.r_[label[1:], 0], after)
            logs = np.log10(c + 0.5)
            fit = model.transitions[label, after] - model.scale[label] + logs
            fit += np.where(before < 0, 0, model.transitions[before, label])
            total = lambda x: pa.array(np.bincount(owner, x, batch.num_rows))
            known = pa.array(np.bincount(owner, c > 0, batch.num_rows).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), known, total(logs), total(fit)], ["row", "n_known", "logs", "fit"])

    part = rest.groupBy("row").agg(F.collect_list("place").alias("places")).mapInArrow(sums, "row long, n_known long, logs double, fit double")
    whole = rows.where("key is null").select("row", "doc_id", "n_tokens", "n_known", "base_score", "score", F.lit(0.0).alias("logs"), F.lit(0.0).alias("fit"))
    none = lambda kind: F.lit(None).cast(kind)
    part = part.select("row", none("long"), none("long"), "n_known", none("double"), none("double"), "logs", "fit")
    return whole.union(part).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        (F.max("base_score") + F.sum("logs")).alias("base_score"), (F.max("score") + F.sum("fit")).alias("score"),
    ).select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
