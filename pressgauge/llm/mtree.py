"""Exact top-k inner-product search over an M-tree.

Vectors of whole numbers are lifted by one component so that all have the same length, and a query
gets a zero there. Then the distance of a lifted vector and a query falls as their inner product
rises, and a metric tree finds the largest products.

The tree has three levels. Its routing objects come from a bounded sample of the vectors; each inner
entry keeps its covering radius and its distance to the parent entry. Every row goes to the leaf of
its nearest routing object. A leaf is a chain of pages, cut from one range sort by (leaf, distance to
the routing object, id): a page has at most PAGE rows, keeps each row's parent distance, and its
first and last one bound it. A leaf may have any number of pages, spread over many tasks. Pages that
follow each other make up a tile, which fits the memory of a task.

Search is best first, for blocks of queries. A query's bound starts as its k-th best product within
the sample. First it visits the leaf nearest to it, which tightens the bound, then every leaf that
the bound cannot exclude. An entry is excluded without computing its distance where the stored parent
distances already tell by the triangle inequality, and so is a page, and so are the rows of a page.
Pages move once in a round. The queries of a block move once for each tile in which they visit a leaf,
with a bit for each of the tile's leaves, and meet its pages one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressgauge.llm.common import ship_code
from pressgauge.session import small_batches, stage

K = 5
PAGE = 512
LEAVES = 1024
QUERY_BLOCK = 256
TILE_BYTES = 1 << 25  # the rows of a tile; twice that at most
SENT_BYTES = 1 << 24  # the queries a task hands on at once, about
TASKS_PER_CORE = 4


@dataclass
class Tree:
    size: int  # components of a vector
    length2: float  # squared length of all lifted vectors
    routers: np.ndarray  # lifted routing objects of the leaves
    ids: np.ndarray  # their row ids, used for the first bounds
    parents: np.ndarray  # numbers of the routing objects that are inner entries
    parent: np.ndarray  # inner entry of each leaf
    parent_distance: np.ndarray
    radius: np.ndarray  # covering radius of each leaf, once all rows are placed
    inner_radius: np.ndarray
    largest: float = 0.0  # size of the largest component
    rows: int = 0
    tiles: dict[int, np.ndarray] = field(default_factory=dict)  # the leaves of each tile

    @property
    def whole(self) -> type:
        """How components are kept."""
        return np.int16 if self.largest < 2**15 else np.int32

    @property
    def number(self) -> type:
        """In what products are summed up, exactly: no sum on the way is beyond the product of two lengths."""
        return np.float32 if self.length2 <= 2**24 else np.float64

    @property
    def tile_rows(self) -> int:
        return max(PAGE, TILE_BYTES // (np.dtype(self.number).itemsize * self.size + 16))  # 16 for id and distance

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.length2 - (x * x).sum(1)))
        return np.hstack([x, rest[:, None]])

    def reach(self, q: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The largest distance of a lifted vector whose product with the query is `bound` or more."""
        return np.sqrt(np.maximum(0, (q * q).sum(1) + self.length2 - 2 * bound)) * (1 + 1e-9) + 1e-6


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0, square))


def _nearest(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaf of the routing object nearest to each lifted vector, and its distance."""
    leaf, distance = np.zeros(len(x), np.int64), np.zeros(len(x))
    length2 = (tree.routers * tree.routers).sum(1)
    for at in range(0, len(x), 500):
        part = x[at : at + 500]
        square = (part * part).sum(1)[:, None] + length2[None, :] - 2 * (part @ tree.routers.T)
        leaf[at : at + 500] = near = square.argmin(1)
        distance[at : at + 500] = np.sqrt(np.maximum(0, square[np.arange(len(part)), near]))
    return leaf, distance


def _unpack(column: pa.Array, size: int) -> np.ndarray:
    """A list column of long as a matrix, short rows padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == size).all():
        return flat.reshape(len(lengths), size)
    out = np.zeros((len(lengths), size))
    out[np.arange(size)[None, :] < lengths[:, None]] = flat
    return out


def whole_vectors(df: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, x): floor(scale * component); rows without an id or with unusable components are out."""
    x = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(
        x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    )
    whole = F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")))
    return (
        df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
        .where(F.coalesce(usable, F.lit(False)))
        .select("vec_id", whole.alias("x"))
    )


def _sample(vectors: DataFrame, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """At most LEAVES different vectors, chosen by hash, about one per page."""
    wanted = int(min(LEAVES, max(1, -(-rows // PAGE))))
    share = min(1.0, (1.3 * wanted + 40) / max(rows, 1))
    place = F.xxhash64("x", "vec_id")
    picked = (
        vectors.select(place.alias("place"), "vec_id", "x")
        .where(F.shiftrightunsigned("place", 11) / float(1 << 53) <= share)
        .toArrow()
        .sort_by([("place", "ascending"), ("vec_id", "ascending")])
    )
    if not picked.num_rows:
        picked = vectors.select(place.alias("place"), "vec_id", "x").limit(1).toArrow()
    x = _unpack(picked.column("x"), size)
    _, first = np.unique(x, axis=0, return_index=True)
    first = np.sort(first)[:wanted]
    return x[first], picked.column("vec_id").to_numpy()[first]


def plant(vectors: DataFrame) -> Tree | None:
    """The routing objects; radii are not known yet. None for an empty table."""
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    top = F.array_max(F.transform("x", lambda v: F.abs(v)))
    rows, size, length2, largest = vectors.agg(
        F.count("*"), F.max(F.size("x")), F.max(norm), F.coalesce(F.max(top), F.lit(0))
    ).first()
    if not rows:
        return None
    if size * float(largest) ** 2 >= 2.0**53:
        raise ValueError("components too large for exact products")
    x, ids = _sample(vectors, rows, size)
    tree = Tree(size, length2, x, ids, *[np.zeros(0)] * 5, largest=float(largest), rows=rows)
    tree.routers = tree.lift(x)
    inner = max(1, int(np.sqrt(len(x))))
    tree.parents = np.arange(inner)
    to_inner = _distances(tree.routers, tree.routers[:inner])
    tree.parent = to_inner.argmin(1)
    tree.parent_distance = to_inner[np.arange(len(x)), tree.parent]
    return tree


def _tasks(spark: SparkSession, pieces: int) -> int:
    """Enough tasks for all cores, if there are as many pieces of work."""
    return max(1, min(pieces, TASKS_PER_CORE * spark.sparkContext.defaultParallelism))


def pages(vectors: DataFrame, tree: Tree) -> tuple[DataFrame, Tree]:
    """(tile, leaf, low, high, ids, distances, data) per page, written; and the tree with its radii and tiles."""
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = _unpack(part.column(1), tree.size)
                leaf, distance = _nearest(tree, tree.lift(x))
                data = [row.tobytes() for row in x.astype(tree.whole)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf, pa.int32()), pa.array(distance), part.column(0), pa.array(data, pa.binary())],
                    ["leaf", "distance", "vec_id", "x"],
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        leaf, last = None, None
        # a task's rows are one tile, or several if they are many
        tile, rows, most = TaskContext.get().partitionId(), 0, 2 * sent.value.tile_rows

        def page() -> pa.RecordBatch:
            distances = np.array([r[1] for r in kept])
            columns = [
                pa.array([tile], pa.int64()), pa.array([leaf], pa.int32()), pa.array([distances[0]]), pa.array([distances[-1]]),
                pa.array([np.array([r[2] for r in kept], np.int64).tobytes()]), pa.array([distances.tobytes()]),
                pa.array([b"".join(r[3] for r in kept)]),
            ]
            return pa.RecordBatch.from_arrays(columns, ["tile", "leaf", "low", "high", "ids", "distances", "data"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if kept and (row[0] != leaf or len(kept) == PAGE):
                    yield page()
                    rows += len(kept)
                    kept = []
                    if rows + PAGE > most:
                        tile, rows = tile + (1 << 32), 0
                leaf = row[0]
                if row != last:  # a repeated row stands next to its like
                    kept.append(row)
                last = row
        if kept:
            yield page()

    placed = vectors.mapInArrow(place, "leaf int, distance double, vec_id long, x binary")
    parts = max(-(-tree.rows // tree.tile_rows), _tasks(spark, -(-tree.rows // PAGE)))
    chain = placed.repartitionByRange(parts, "leaf", "distance", "vec_id").sortWithinPartitions("leaf", "distance", "vec_id", "x")
    chain = stage(
        chain.mapInArrow(cut, "tile long, leaf int, low double, high double, ids binary, distances binary, data binary"), "pages"
    )
    tree.radius = np.zeros(len(tree.routers))
    held: dict[int, list[int]] = {}
    for r in chain.groupBy("tile", "leaf").agg(F.max("high").alias("radius")).collect():
        tree.radius[r["leaf"]] = max(tree.radius[r["leaf"]], r["radius"] * (1 + 1e-9) + 1e-9)
        held.setdefault(r["tile"], []).append(r["leaf"])
    tree.tiles = {tile: np.array(sorted(leaves)) for tile, leaves in sorted(held.items())}
    tree.inner_radius = np.zeros(len(tree.parents))
    np.maximum.at(tree.inner_radius, tree.parent, tree.parent_distance + tree.radius)
    return chain, tree


def leaves_in_reach(tree: Tree, q: np.ndarray, reach: float) -> list[int]:
    """Leaves that may hold a vector within `reach` of a lifted query, the nearest first."""
    to_inner = np.sqrt(((tree.routers[tree.parents] - q) ** 2).sum(1))
    open_ = to_inner - tree.inner_radius <= reach
    # parent distances first: no distance to a leaf is computed where they suffice
    known = np.abs(to_inner[tree.parent] - tree.parent_distance) - tree.radius
    left = np.nonzero(open_[tree.parent] & (known <= reach))[0]
    d = np.sqrt(((tree.routers[left] - q) ** 2).sum(1))
    near = d - tree.radius[left] <= reach
    return left[near][np.argsort(d[near], kind="stable")].tolist()


class _Best:
    """The k best rows so far of each query of a block."""

    def __init__(self, query: np.ndarray, bound: np.ndarray, k: int):
        self.query, self.k = query, k
        self.bound = bound.copy()  # rows below cannot be among the k best,
        self.last = np.full(len(query), np.iinfo(np.int64).max)  # nor can rows at the bound with this id or a larger one
        self.found: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, of: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Rows with score[i, j] for query number of[i]."""
        if not len(ids):
            return
        least = self.bound[of] + (ids.min() > self.last[of])  # scores are whole numbers
        i, j = np.divmod(np.flatnonzero(score >= least.astype(score.dtype)[:, None]), len(ids))
        score, ids, of = score[i, j].astype(np.float64), ids[j], of[i]
        open_ = (ids != self.query[of]) & ((score > self.bound[of]) | (ids <= self.last[of]))
        self.found.append((of[open_], ids[open_], score[open_]))
        self.waiting += len(self.found[-1][0])
        if self.waiting > 8 * self.k * len(self.query):
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """(number of the query, id, score) of the k best rows; only what can still be one of them is taken from here on."""
        of, ids, score = (np.concatenate(c) for c in zip(*self.found)) if self.found else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((ids, -score, of))
        of, ids, score = of[order], ids[order], score[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of, "left")
        kth = rank == self.k - 1
        self.bound[of[kth]], self.last[of[kth]] = score[kth], ids[kth]
        best = rank < self.k
        self.found, self.waiting = [(of[best], ids[best], score[best])], 0
        return self.found[0]


def _meet(tree: Tree, shelf: list[tuple], live: dict[int, np.ndarray], query: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> _Best:
    """What the queries find on the pages of a tile: (leaf, low, high, ids, distances, x) each. `live`: who visits which leaf."""
    best, visited = _Best(query, bound, k), None
    lifted, mine = np.hstack([q, np.zeros((len(q), 1))]), q.astype(tree.number)
    for leaf, low, high, ids, distances, x in shelf:
        if leaf != visited:
            visited = leaf
            d, reach = _distances(lifted, tree.routers[leaf : leaf + 1])[:, 0], tree.reach(q, best.bound)
        of = np.flatnonzero(live[leaf] & (np.maximum(d - high, low - d) <= reach + 1e-6))
        if not len(of):
            continue
        a = int(np.searchsorted(distances, (d - reach)[of].min() - 1e-6, "left"))
        b = int(np.searchsorted(distances, (d + reach)[of].max() + 1e-6, "right"))
        best.add(of, ids[a:b], mine[of] @ x[a:b].T)
    return best


def _visit(chain: DataFrame, asked: DataFrame, n_queries: int, tree_sent, route, k: int) -> DataFrame:
    """(query_id, vec_id, score) of up to k rows per tile and query of `asked(query_id, q, bound, leaf)`.

    `route` gives the leaves that the queries of a block visit, as a matrix of truth values.
    """
    spark = asked.sparkSession
    schema = "tile long, kind int, leaf int, low double, high double, ids binary, distances binary, data binary, asked binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, out, size = tree_sent.value, [], 0
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 4]
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        while block := list(islice(rows, QUERY_BLOCK)):
            query, packed, bound, leaf = (list(c) for c in zip(*block))
            query, bound, leaf = np.array(query, np.int64), np.array(bound, np.float64), np.array(leaf, np.int64)
            q = np.frombuffer(b"".join(packed), tree.whole).reshape(len(block), tree.size)
            live = route(tree, q.astype(np.float64), bound, leaf)
            for tile, leaves in tree.tiles.items():
                visits = live[:, leaves]
                some = visits.any(1)
                if some.any():
                    columns = [query[some], bound[some], q[some], np.packbits(visits[some])]
                    out.append((tile, 1, -1, None, None, *(c.tobytes() for c in columns)))
                    size += sum(c.nbytes for c in columns)
                if size > SENT_BYTES:
                    yield pack(out)
                    out, size = [], 0
        if out:
            yield pack(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = tree_sent.value
        tile, shelf = None, []
        for batch in batches:
            found: list[tuple] = []
            for at, kind, leaf, low, high, ids, distances, data, asked in zip(*(c.to_pylist() for c in batch.columns)):
                if at != tile:
                    tile, shelf = at, []
                ids, distances = np.frombuffer(ids, np.int64), np.frombuffer(distances)
                x = np.frombuffer(data, tree.whole).reshape(len(ids), tree.size)
                if kind == 0:
                    shelf.append((leaf, low, high, ids, distances, x.astype(tree.number)))
                    continue
                leaves = tree.tiles[tile]
                visits = np.unpackbits(np.frombuffer(asked, np.uint8), count=len(ids) * len(leaves)).astype(bool)
                live = dict(zip(leaves.tolist(), visits.reshape(len(ids), len(leaves)).T))
                of, best, score = _meet(tree, shelf, live, ids, x.astype(np.float64), distances, k).settle()
                found.append((ids[of], best.astype(np.int64), score.astype(np.int64)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["query_id", "vec_id", "score"])

    blocks = asked.select("query_id", "q", "bound", "leaf").repartitionByRange(_tasks(spark, -(-n_queries // QUERY_BLOCK)), "leaf", "query_id")
    blocks = blocks.sortWithinPartitions("leaf", "query_id").mapInArrow(send, schema)
    here = chain.withColumns({"kind": F.lit(0), "asked": F.lit(None).cast("binary")}).select(*names).unionByName(blocks)
    # one task for a tile; the pages come first, those of a leaf together
    task = (F.col("tile").bitwiseAND(F.lit((1 << 32) - 1)) + F.shiftright("tile", 32)).cast("int")
    here = here.repartitionById(len(tree_sent.value.tiles), task).sortWithinPartitions("tile", "kind", "leaf", "low")
    return here.mapInArrow(run, "query_id long, vec_id long, score long")


def _top(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def search(
    df: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, scale: int = 256
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products per query, ties to the smaller id.

    `is_query` is a condition on vec_id. All rows but the query's own, by id, are candidates; a query
    has fewer rows only if there are fewer candidates. Vectors that are null or hold a null or
    non-finite component, and rows without an id, take no part. Shorter vectors count as padded with
    zeros. Equal rows count once; a query id with several vectors asks with the smallest one. Extra
    columns are ignored; an empty table gives an empty table. Products beyond 2**53 are refused.
    """
    spark = df.sparkSession
    ship_code(spark)
    with small_batches(spark):
        return _search(whole_vectors(df, vec_id, embedding, scale), is_query, k)


def _search(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    spark = vectors.sparkSession
    vectors = stage(vectors, "vectors")
    tree = plant(vectors)
    if tree is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chain, tree = pages(vectors, tree)
    sent = spark.sparkContext.broadcast(tree)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        sample = tree.routers[:, :-1]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                q = _unpack(part.column(1), tree.size)
                score = q @ sample.T
                score[part.column(0).to_numpy()[:, None] == tree.ids[None, :]] = -np.inf
                bound = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(q), -np.inf)
                leaf, _ = _nearest(tree, np.hstack([q, np.zeros((len(q), 1))]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([r.tobytes() for r in q.astype(tree.whole)], pa.binary()), pa.array(bound), pa.array(leaf, pa.int32())],
                    ["query_id", "q", "bound", "leaf"],
                )

    def first(tree: Tree, q: np.ndarray, bound: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        return leaf[:, None] == np.arange(len(tree.routers))[None, :]

    def descend(tree: Tree, q: np.ndarray, bound: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        live = np.zeros((len(q), len(tree.routers)), bool)
        for i, reach in enumerate(np.where(bound > -np.inf, tree.reach(q, bound), np.inf)):
            live[i, leaves_in_reach(tree, np.r_[q[i], 0.0], reach)] = True
        return live & ~first(tree, q, bound, leaf)

    asked = vectors.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("x").alias("x"))
    asked = stage(asked.mapInArrow(begin, "query_id long, q binary, bound double, leaf int"), "queries")
    n_queries = asked.count()
    nearest = stage(_top(_visit(chain, asked, n_queries, sent, first, k), k).select("query_id", "vec_id", "score", "rank"), "nearest")
    kth = nearest.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("kth"))
    tightened = asked.join(kth, "query_id", "left").withColumn("bound", F.greatest("bound", F.coalesce("kth", "bound")))
    rest = stage(_visit(chain, tightened, n_queries, sent, descend, k), "further")
    return _top(nearest.select("query_id", "vec_id", "score").unionByName(rest), k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
