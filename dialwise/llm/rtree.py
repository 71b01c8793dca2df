"""Hard negatives by an R-tree whose boxes bound inner products.

Building, as Spark tasks. Rows are packed sort-tile-recursively: slabs by label,
in each slab slabs by the coordinate of largest variance, and so on. The cut
points come from a hash sample of at most ``SAMPLE`` rows; they only balance the
cells, every row is indexed. A cell of more than ``TILE`` rows is split by a hash of
the id, so copies of one vector fill many tiles. A task sorts a tile
on, into leaves of ``LEAF`` rows and nodes of ``FAN`` leaves, and writes them as
arrays in the shared folder. The boxes of all tiles, a few hundred bytes for
every ``TILE`` rows, are written as arrays too and mapped like the rest.

Searching. A box holds the least and largest value of each coordinate, so the
inner product of a query with any row in it lies within a sum of intervals. Tasks
take anchors in blocks of neighbours and visit boxes from a queue, largest upper
bound first. A box goes when for every anchor of the block its interval lies
outside the score windows, or strictly below the worst of the rows held so far
(or level with it, and all its ids are larger). Nothing else is left out, so results are
those of a comparison with all rows. Workers map the files of the boxes they visit.

All scores are exact integers: rows whose products might leave 53 bits are
multiplied as 64-bit integers, and vectors that might leave 63 bits are refused.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialwise.llm.common import quoted, query, shared_path, store, table
from dialwise.llm.hasharrays import get, put

TILE = 4096
LARGEST_TILE = 65536
LEAF = 128
FAN = 16
SAMPLE = 50_000
#: coordinates, besides the label, that rows are packed by
PACKED = 3
#: slabs of a level at most; the cells of all levels stay a small table however large the input is
SLABS = 24
#: anchors that share a queue, and rows that a task of anchors aims at
BLOCK = 64
ANCHORS = 512
#: tiles whose files a worker keeps mapped
MAPPED = 512

POSITIVES = 5
NEGATIVES = 3
WINDOW = (50, 95)


def usable(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
           scale: int = 256, moved: int = 7, labels: int = 10) -> DataFrame:
    """``id, label, vector`` of the rows that take part, each once: components become ``floor(scale * x)``,
    and where the id is divisible by ``moved`` the label becomes ``(label + 1) % labels``.

    Rows without an id, a label or a vector, and rows with a component that is null or not finite, go.
    """
    row = vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(label_col)).cast("long").alias("label"),
                         F.col(quoted(vector_col)).cast("array<double>").alias("x"))
    whole = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = F.when(F.col("id") % moved == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return row.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & whole) \
        .select("id", label.alias("label"), F.transform("x", lambda v: F.floor(v * float(scale)).cast("long")).alias("vector")).distinct()


def bounded(rows: DataFrame) -> tuple[int, bool]:
    """Number of rows, and whether all products of two of them fit 53 bits."""
    largest = F.array_max(F.transform("vector", lambda v: F.abs(v)))
    n, width, most = rows.agg(F.count("id"), F.max("width"), F.max(largest)).first()
    total = (width or 0) * int(most or 0) ** 2
    if 100 * total >= 1 << 63:
        raise OverflowError("a hundred times the inner products of these vectors does not fit 64 bits")
    return n, total < 1 << 53


@dataclass
class Cuts:
    """Nested cut points: along the first axis, then within each of its slabs along the next."""

    axes: list[int]
    slabs: int
    points: list[dict[int, np.ndarray]]

    @classmethod
    def of(cls, sample: np.ndarray, axes: list[int], slabs: int) -> Cuts:
        made = cls(axes, slabs, [{} for _ in axes])

        def cut(rows: np.ndarray, level: int, cell: int) -> None:
            if level == len(axes):
                return
            values = np.sort(rows[:, axes[level]])
            at = np.unique(values[[len(values) * i // slabs for i in range(1, slabs)]]) if len(values) else values
            made.points[level][cell] = at
            where = np.searchsorted(at, rows[:, axes[level]], "right")
            for s in range(len(at) + 1):
                cut(rows[where == s], level + 1, cell * slabs + s)

        cut(sample, 0, 0)
        return made

    def cells(self, rows: np.ndarray) -> np.ndarray:
        """The cell of every row, as a number."""
        cell = np.zeros(len(rows), np.int64)
        for axis, points in zip(self.axes, self.points):
            slab = np.zeros(len(rows), np.int64)
            for c in np.unique(cell).tolist():
                own = cell == c
                slab[own] = np.searchsorted(points[c], rows[own, axis], "right")
            cell = cell * self.slabs + slab
        return cell


def lists(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def packed(keys: list[np.ndarray], n: int, leaf: int) -> np.ndarray:
    """Order of ``n`` rows that puts near ones into runs of ``leaf``: slabs by the first key, in each slabs by the next."""
    if n <= leaf or len(keys) == 1:
        return np.argsort(keys[0], kind="stable")
    slabs = int(np.ceil(np.ceil(n / leaf) ** (1 / len(keys))))
    size = -(-n // (slabs * leaf)) * leaf
    order = np.argsort(keys[0], kind="stable")
    return np.concatenate([part[packed([k[part] for k in keys[1:]], len(part), leaf)]
                           for part in (order[a:a + size] for a in range(0, n, size))])


def joined(boxes: dict[str, np.ndarray], size: int) -> dict[str, np.ndarray]:
    """The box of every run of ``size`` boxes: coordinates, labels and the least id. A row is a box too."""
    at = np.arange(0, len(boxes["least"]), size)
    by = {"lo": np.minimum, "hi": np.maximum, "low": np.minimum, "high": np.maximum, "least": np.minimum}
    return {k: f.reduceat(boxes[k], at) for k, f in by.items()}


def narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in the smallest signed type."""
    most = int(np.abs(values).max(initial=0))
    return values.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


BOX = ("lo", "hi", "low", "high", "least")


@dataclass
class RTree:
    """``tiles`` by vector length, under ``uri``; ``small`` states that products fit 53 bits."""

    uri: str
    tiles: dict[int, int]
    leaf: int
    small: bool
    held: OrderedDict = field(default_factory=OrderedDict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"held": OrderedDict()}

    def arrays(self, name: str, parts: tuple[str, ...]) -> dict[str, np.ndarray]:
        if name not in self.held:
            if len(self.held) >= MAPPED:
                self.held.popitem(last=False)
            self.held[name] = {p: get(self.uri, f"{name}-{p}.npy") for p in parts}
        self.held.move_to_end(name)
        return self.held[name]

    def top(self, width: int) -> dict[str, np.ndarray]:
        return self.arrays(f"top-{width}", BOX)

    def tile(self, width: int, t: int) -> dict[str, np.ndarray]:
        return self.arrays(f"tile-{width}-{t}", ("ids", "labels", "vectors", *(f"{level}-{p}" for level in ("leaf", "node") for p in BOX)))


def build(rows: DataFrame, uri: str, *, tile: int | None = None, leaf: int = LEAF) -> tuple[RTree, DataFrame]:
    """The tree over ``usable`` rows, and these rows with their ``width`` and ``tile``.

    Vectors of different lengths have no inner product; each length has a tree of its own.
    An empty table gives a tree without tiles.
    """
    rows = store(rows.withColumn("width", F.size("vector")))
    n, small = bounded(rows)
    tile = tile or max(TILE, min(LARGEST_TILE, n // 20_000))
    plans = {r["width"]: _cuts(rows.where(F.col("width") == r["width"]), r["count"], tile) for r in rows.groupBy("width").count().collect()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("width").to_numpy()
            for w in np.unique(width).tolist():
                part = batch.filter(pa.array(width == w))
                keyed = np.concatenate([part.column("label").to_numpy()[:, None], lists(part.column("vector"), w)], 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(plans[w].cells(keyed))], [*part.schema.names, "cell"])

    celled = store(rows.select("id", "label", "vector", "width").mapInArrow(
        place, T.StructType.fromDDL("id long, label long, vector array<long>, width int, cell long")))
    first, tiles = [], {}
    for r in celled.groupBy("width", "cell").agg(F.count("id").alias("n")).orderBy("width", "cell").collect():  # bounded by SLABS
        parts = -(-r["n"] // tile)
        first.append((r["width"], r["cell"], tiles.get(r["width"], 0), parts))
        tiles[r["width"]] = tiles.get(r["width"], 0) + parts
    starts = celled.sparkSession.createDataFrame(first, "width int, cell long, first long, parts long")
    tiled = store(celled.join(F.broadcast(starts), ["width", "cell"])
                  .select("id", "label", "vector", "width", (F.col("first") + F.pmod(F.xxhash64("id"), "parts")).alias("tile")))

    def save(group: pa.Table) -> pa.Table:
        w, t = group.column("width")[0].as_py(), group.column("tile")[0].as_py()
        ids, labels = (group.column(c).to_numpy() for c in ("id", "label"))
        vectors = lists(group.column("vector").combine_chunks(), w)
        spread = np.argsort(-vectors.astype(float).var(0), kind="stable")[:PACKED]
        order = np.argsort(ids, kind="stable")  # rows alike in all keys stay in order of id
        order = order[packed([labels[order], *(vectors[order, a] for a in spread)], len(ids), leaf)]
        ids, labels, vectors = ids[order], labels[order], narrow(vectors[order])
        leaves = joined({"lo": vectors, "hi": vectors, "low": labels, "high": labels, "least": ids}, leaf)
        nodes = joined(leaves, FAN)
        for name, values in {"ids": ids, "labels": labels, "vectors": vectors, **{f"leaf-{k}": v for k, v in leaves.items()},
                             **{f"node-{k}": v for k, v in nodes.items()}}.items():
            put(uri, f"tile-{w}-{t}-{name}.npy", values)
        whole = joined(nodes, len(nodes["least"]))
        wide = lambda k: pa.array([whole[k][0].astype(np.int64)], pa.list_(pa.int64()))
        return pa.table({"width": pa.array([w], pa.int32()), "tile": pa.array([t]), "lo": wide("lo"), "hi": wide("hi"),
                         "low": whole["low"], "high": whole["high"], "least": whole["least"]})

    made = store(tiled.groupBy("width", "tile").applyInArrow(
        save, "width int, tile long, lo array<long>, hi array<long>, low long, high long, least long"))

    def top(group: pa.Table) -> pa.Table:
        w, group = group.column("width")[0].as_py(), group.sort_by("tile")
        for name in BOX:
            column = group.column(name).combine_chunks()
            put(uri, f"top-{w}-{name}.npy", narrow(lists(column, w)) if name in ("lo", "hi") else column.to_numpy())
        return pa.table({"width": pa.array([w], pa.int32())})

    made.groupBy("width").applyInArrow(top, "width int").collect()  # one box for every tile
    return RTree(uri, tiles, leaf, small), tiled


def _cuts(rows: DataFrame, n: int, tile: int) -> Cuts:
    """Cut points for the rows of one length."""
    slabs = min(SLABS, int(np.ceil((n / tile) ** (1 / (1 + PACKED)))))
    if slabs <= 1:
        return Cuts([], 1, [])
    every = max(1, n // (SAMPLE // 2))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("label", "vector").limit(SAMPLE).toArrow()
    vectors = lists(sample.column("vector").combine_chunks(), rows.first()["width"])
    keyed = np.concatenate([sample.column("label").to_numpy()[:, None], vectors], 1)
    return Cuts.of(keyed, [0, *(1 + np.argsort(-vectors.astype(float).var(0), kind="stable")[:PACKED]).tolist()], slabs)


NONE = np.iinfo(np.int64).max
LEAST = np.iinfo(np.int64).min


class Best:
    """The ``k`` best (score, id) pairs of every query, larger scores first, smaller ids on ties."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), LEAST), np.full((n, k), NONE)

    def may_take(self, upper: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether a row with score up to ``upper`` and id from ``least`` could get in."""
        return (upper > self.score[:, -1:]) | ((upper == self.score[:, -1:]) & (least < self.id[:, -1:]))

    def take(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in rows where ``which`` (queries by rows) allows it."""
        q, r = np.nonzero(which & self.may_take(scores, ids[None]))
        if not len(q):
            return
        k, touched = self.score.shape[1], np.unique(q)
        s = np.concatenate([scores[q, r], self.score[touched].ravel()])
        i = np.concatenate([ids[r], self.id[touched].ravel()])
        q = np.concatenate([q, np.repeat(touched, k)])
        order = np.lexsort((i, np.invert(s), q))  # the complement turns the order of scores around
        at = order[np.searchsorted(q[order], touched)[:, None] + np.arange(k)]
        self.score[touched], self.id[touched] = s[at], i[at]


class Search:
    """One block of anchors of one length against a tree."""

    def __init__(self, tree: RTree, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.tree, self.width, self.kind = tree, vectors.shape[1], np.float64 if tree.small else np.int64
        self.ids, self.labels, self.vectors = ids, labels, vectors.astype(self.kind)
        self.plus, self.minus = np.maximum(self.vectors, 0), np.minimum(self.vectors, 0)

    def interval(self, box: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of each anchor with a row of each box."""
        lo, hi = (np.asarray(box[k]).astype(self.kind).T for k in ("lo", "hi"))
        return (self.plus @ lo + self.minus @ hi).astype(np.int64), (self.plus @ hi + self.minus @ lo).astype(np.int64)

    def visit(self, use, meet) -> None:
        """Boxes best first. ``use(lower, upper, box)`` tells (anchors by boxes) whether a box may hold something
        wanted, and up to which score; ``meet(scores, ids, labels)`` takes in the rows of a leaf."""
        queue, count = [], 0

        def offer(box: dict[str, np.ndarray], places: list[tuple[int, ...]]) -> None:
            nonlocal count
            lower, upper = self.interval(box)
            wanted, reach = use(lower, upper, box)
            for b in np.flatnonzero(wanted.any(0)).tolist():
                most = int(reach[wanted[:, b], b].max())
                own = {k: box[k][b:b + 1] for k in ("low", "high", "least")}
                heapq.heappush(queue, (-most, int(box["least"][b]), count, lower[:, b:b + 1], upper[:, b:b + 1], own, places[b]))
                count += 1

        top = self.tree.top(self.width)
        offer(top, [(t,) for t in range(len(top["least"]))])
        while queue:
            *_, lower, upper, box, place = heapq.heappop(queue)
            if not use(lower, upper, box)[0].any():  # what was found meanwhile is better
                continue
            part = self.tree.tile(self.width, place[0])
            if len(place) == 1:
                offer({k: part[f"node-{k}"] for k in BOX}, [(*place, b) for b in range(len(part["node-least"]))])
            elif len(place) == 2:
                some = slice(place[1] * FAN, (place[1] + 1) * FAN)
                inner = {k: part[f"leaf-{k}"][some] for k in BOX}
                offer(inner, [(*place, some.start + b) for b in range(len(inner["least"]))])
            else:
                some = slice(place[2] * self.tree.leaf, (place[2] + 1) * self.tree.leaf)
                rows = np.asarray(part["vectors"][some]).astype(self.kind)
                meet((self.vectors @ rows.T).astype(np.int64), np.asarray(part["ids"][some]), np.asarray(part["labels"][some]))

    def positives(self, k: int) -> Best:
        """The best ``k`` rows of an anchor's label with another id than its own."""
        best = Best(len(self.ids), k)

        def use(lower, upper, box):
            own = (box["low"][None] <= self.labels[:, None]) & (self.labels[:, None] <= box["high"][None])
            return own & best.may_take(upper, box["least"][None]), upper

        self.visit(use, lambda scores, ids, labels: best.take((labels[None] == self.labels[:, None]) & (ids[None] != self.ids[:, None]), scores, ids))
        return best

    def negatives(self, positives: Best, k: int, window: tuple[int, int]) -> Best:
        """For every positive of every anchor the best ``k`` rows of other labels within ``window`` percent of its score."""
        n, each = positives.score.shape
        there = (positives.id < NONE).ravel()
        score = np.where(there, positives.score.ravel(), 0)
        least, most = -((-window[0] * score) // 100), (window[1] * score) // 100
        anchor, best = np.repeat(np.arange(n), each), Best(n * each, k)
        open_ = there & (least <= most)

        def use(lower, upper, box):
            cap = np.minimum(upper[anchor], most[:, None])
            wanted = open_[:, None] & (lower[anchor] <= most[:, None]) & (upper[anchor] >= least[:, None]) & best.may_take(cap, box["least"][None])
            wanted &= ~((box["low"][None] == box["high"][None]) & (box["low"][None] == self.labels[anchor, None]))
            by_anchor = wanted.reshape(n, each, -1)
            return by_anchor.any(1), np.where(by_anchor, cap.reshape(n, each, -1), LEAST).max(1)

        def meet(scores, ids, labels):
            scores = scores[anchor]
            best.take(open_[:, None] & (scores >= least[:, None]) & (scores <= most[:, None]) & (labels[None] != self.labels[anchor, None]), scores, ids)

        if open_.any():
            self.visit(use, meet)
        return best


def hard_negatives(rows: DataFrame, uri: str, *, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   window: tuple[int, int] = WINDOW, tile: int | None = None, leaf: int = LEAF) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``usable`` rows.

    Anchors are the rows whose id is divisible by ``every``; rows with the anchor's id are not its positives.
    Ties go to the smaller id. Rows that share an id but differ are rows of their own. Anchors without
    positives, and positives without rows in their window, give no rows; so does an empty table.
    """
    tree, tiled = build(rows, uri, tile=tile, leaf=leaf)
    spark = rows.sparkSession
    anchors = tiled.where(F.col("id") % every == 0)
    tasks = max(spark.sparkContext.defaultParallelism, anchors.count() // ANCHORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("width").to_numpy()
            for w in np.unique(width).tolist():
                own = batch.filter(pa.array(width == w))
                for at in range(0, len(own), BLOCK):
                    part = own.slice(at, BLOCK)
                    block = Search(tree, part.column("id").to_numpy(), part.column("label").to_numpy(), lists(part.column("vector"), w))
                    near = block.positives(positives)
                    far = block.negatives(near, negatives, window)
                    p, r = np.nonzero(far.id < NONE)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (block.ids[p // positives], near.id.ravel()[p], (r + 1).astype(np.int32), far.id[p, r],
                                               near.score.ravel()[p], far.score[p, r])],
                        ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    # neighbours share a queue; a tile is bounded, so its anchors are
    dealt = anchors.repartition(tasks, "width", "tile").sortWithinPartitions("width", "tile", "label", "id")
    return dealt.mapInArrow(run, T.StructType.fromDDL(
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"))


ORACLE = """
WITH usable AS (
  SELECT DISTINCT vec_id::BIGINT AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
scored AS (
  SELECT a.id AS anchor_id, a.label AS anchor_label, r.id, r.label, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM usable a JOIN usable r ON len(a.v) = len(r.v) WHERE a.id % 50 = 0),
positive AS (
  SELECT anchor_id, anchor_label, id AS positive_id, score AS positive_score FROM scored
  WHERE label = anchor_label AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id, anchor_label ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, p.anchor_label, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positive p JOIN scored s USING (anchor_id, anchor_label)
WHERE s.label <> anchor_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query("op13_hard_negatives", ORACLE)
def op13(spark, sf_dir):
    return hard_negatives(usable(table(spark, sf_dir, "embeddings")), shared_path(spark, "rtree"))
