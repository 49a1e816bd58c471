"""Exact nearest-point and radius queries between two large point sets, without pairing everything with everything.

Distinct reference points are dealt to the leaves of a tree of median splits over all columns (fitted on a bounded sample; it
only decides how close neighbours stand) and cut into pages of at most ``PAGE`` points. The tree, with tight bounds and the weight
of every node, is bounded (``MOST_LEAVES``, ``MOST_BYTES``) and goes to all tasks. A query walks down to the closest leaf, is
compared with the points there, and walks the tree again for the other leaves whose bounds lie within the best distance; only
these, few in the columns of a table, cost a further row, whatever the number of leaves. Inside a page, blocks of ``BLOCK``
points have bounds too and are taken in the order of their distance until none can matter. The queries of a leaf come in batches
of ``BATCH``, so a task holds a leaf and a batch. The answer is exact; equal points are collapsed to one with a weight
first, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from twinloom.session import cut, width

PAGE, BLOCK = 1024, 16
BATCH = 16_384
#: Bounds of the tree: leaves, and bytes of all bounds.
SAMPLE, MOST_LEAVES, MOST_BYTES = 65_536, 8192, 32 << 20
#: Leaves of the second wave; the third takes what still can matter.
SECOND = 8
#: Pairs of query and node that a walk holds at a time.
HELD = 1 << 22


def as_points(df: DataFrame, cols: list[Column], weights: dict[str, Column] | None = None, part: Column | None = None) -> DataFrame:
    """(part, x, weights...): distinct coordinate arrays with summed weights; points of different parts never meet."""
    weights = weights or {"w": F.lit(1)}
    view = df.select((part if part is not None else F.lit(0)).cast("long").alias("part"), F.array(*[c.cast("double") for c in cols]).alias("x"), *[c.alias(n) for n, c in weights.items()])
    return view.groupBy("part", "x").agg(*[F.sum(n).alias(n) for n in weights])


# ---- the tree of median splits
def split(x: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Nodes (column, cut, left, right); a negative child is leaf -child - 1. Leaves are numbered from left to right."""
    nodes: list[tuple[int, float, int, int]] = []
    made = 0

    def grow(part: np.ndarray, want: int) -> int:
        nonlocal made
        spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(1)
        if want < 2 or spread.max(initial=0.0) <= 0.0:
            made += 1
            return -made
        j = int(spread.argmax())
        middle = float(np.quantile(part[:, j], 0.5, method="lower"))
        if middle >= part[:, j].max():  # more than half are the largest value
            middle = float(part[:, j][part[:, j] < middle].max())
        at = len(nodes)
        nodes.append((j, middle, 0, 0))
        left = grow(part[part[:, j] <= middle], want // 2)
        nodes[at] = (j, middle, left, grow(part[part[:, j] > middle], want - want // 2))
        return at

    grow(x, leaves)
    return nodes


def leaf_of(x: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))] if nodes else []
    while todo:
        node, rows = todo.pop()
        j, middle, left, right = nodes[node]
        low = x[rows, j] <= middle
        for child, some in ((left, rows[low]), (right, rows[~low])):
            if child < 0:
                out[some] = -child - 1
            elif len(some):
                todo.append((child, some))
    return out


def arranged(x: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in blocks of at most ``size`` by median splits of the widest column."""
    if len(rows) <= size:
        return [rows]
    part = x[rows]
    j = int((part.max(axis=0) - part.min(axis=0)).argmax())
    order = rows[np.argsort(part[:, j], kind="stable")]
    half = -(-len(order) // (2 * size)) * size
    return [*arranged(x, order[:half], size), *arranged(x, order[half:], size)]


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, d)


def parted(column: pa.Array) -> np.ndarray:
    """Part numbers; a missing one is that of no reference point."""
    return column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


class Tree:
    """The splits, with bounds and weight of every node by part. Inner nodes come first, then the leaves."""

    def __init__(self, nodes: list[tuple[int, float, int, int]], leaves: int, d: int, boxes: pa.Table):
        self.inner, total = len(nodes), len(nodes) + leaves
        child = lambda c: len(nodes) - c - 1 if c < 0 else c
        self.left, self.right = [np.array([child(n[i]) for n in nodes], np.int64) for i in (2, 3)]
        self.parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        part, leaf, pos, low, high, weight = [boxes.column(c).to_numpy() for c in ("part", "leaf", "pos", "low", "high", "weight")]
        for p in np.unique(part):
            at = part == p
            lo, hi, w = np.full((total, d), np.inf), np.full((total, d), -np.inf), np.zeros(total, np.int64)
            lo[self.inner + leaf[at], pos[at]], hi[self.inner + leaf[at], pos[at]], w[self.inner + leaf[at]] = low[at], high[at], weight[at]
            for i in range(self.inner - 1, -1, -1):  # children stand behind their node
                two = [self.left[i], self.right[i]]
                lo[i], hi[i], w[i] = lo[two].min(axis=0), hi[two].max(axis=0), w[two].sum()
            self.parts[int(p)] = lo, hi, w

    def closest(self, x: np.ndarray, part: int) -> np.ndarray:
        """A leaf with points for each query, by the nearer child at every node; -1 where the part has none."""
        if part not in self.parts:
            return np.full(len(x), -1)
        lo, hi, w = self.parts[part]
        node, row = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(row := row[node[row] < self.inner]):
            a, b = self.left[node[row]], self.right[node[row]]
            nearer = near2_to(x[row], lo[b], hi[b]) < near2_to(x[row], lo[a], hi[a])
            node[row] = np.where((w[a] > 0) & ~((w[b] > 0) & nearer), a, b)
        return node - self.inner

    def steps(self, rows: int) -> list[slice]:
        """Slices of a batch that keep a walk below ``HELD`` pairs."""
        step = max(1, HELD // (self.inner + 1))
        return [slice(i, i + step) for i in range(0, rows, step)]

    def within(self, x: np.ndarray, part: int, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, squared distance) of the leaves closer than the squared distance ``best`` of the row."""
        lo, hi, _ = self.parts[part]
        row, node, near = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        while len(row):
            done = node >= self.inner
            found.append((row[done], node[done] - self.inner, near[done]))
            row, node = np.tile(row[~done], 2), np.concatenate([self.left[node[~done]], self.right[node[~done]]])
            near = near2_to(x[row], lo[node], hi[node])
            row, node, near = [v[near < best[row]] for v in (row, node, near)]
        return tuple(np.concatenate(v) for v in zip(*found))

    def touched(self, x: np.ndarray, part: int, radius: float, enough: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Weight of the nodes wholly inside the circle, for each row (below ``enough`` exact); (row, leaf, distance) of the
        leaves it cuts, for rows without enough."""
        lo, hi, w = self.parts[part]
        own = self.closest(x, part) + self.inner
        sure = np.where(np.sqrt(far2_to(x, lo[own], hi[own])) < radius, w[own], 0)
        row = np.flatnonzero(sure < enough)
        sure[row] = 0
        node, found = np.zeros(len(row), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        while len(row):
            near = np.sqrt(near2_to(x[row], lo[node], hi[node]))
            row, node, near = [v[near < radius] for v in (row, node, near)]
            inside = np.sqrt(far2_to(x[row], lo[node], hi[node])) < radius
            np.add.at(sure, row[inside], w[node[inside]])
            on = ~inside & (sure[row] < enough)
            row, node, near = row[on], node[on], near[on]
            done = node >= self.inner
            found.append((row[done], node[done] - self.inner, near[done]))
            row, node = np.tile(row[~done], 2), np.concatenate([self.left[node[~done]], self.right[node[~done]]])
        row, leaf, near = (np.concatenate(v) for v in zip(*found))
        on = sure[row] < enough
        return sure, row[on], leaf[on], near[on]


def placed(row: np.ndarray, near: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """From 1: the place of each entry among those of its row, by distance."""
    order = np.lexsort((tie, near, row))
    first = np.r_[True, row[order][1:] != row[order][:-1]] if len(row) else np.zeros(0, bool)
    at = np.arange(len(row))
    out = np.empty(len(row), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0)) + 1
    return out


@dataclass(frozen=True)
class Index:
    """``pages``: (part, leaf, xs, ws, ...), a written table; ``tree``: bounds of all nodes."""

    pages: DataFrame
    tree: Tree
    d: int


PAGES = "part long, leaf long, xs binary, ws binary, lo array<double>, hi array<double>, w long"


def build(points: DataFrame, d: int, page: int = PAGE) -> Index | None:
    """Index (part, x, w); None when there are no points. A bounded sample and the bounds of the leaves reach the driver."""
    points = cut(points.where("part is not null"))
    sizes = points.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part").alias("parts")).first()
    n = sizes["n"]
    if not n:
        return None
    leaves = max(1, min(MOST_LEAVES, -(-n // page), MOST_BYTES // (32 * max(d, 1) * sizes["parts"])))
    sample = points.where(F.pmod(F.xxhash64("part", "x"), F.lit(n)) < SAMPLE).select("x").collect()
    nodes = split(np.array([r["x"] for r in sample], float).reshape(-1, d), leaves)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("leaf", pa.array(leaf_of(matrix(b.column(b.schema.get_field_index("x")), d), nodes)))

    kept = points.select("part", "x", F.col("w").cast("long").alias("w")).mapInArrow(dealt, "part long, x array<double>, w long, leaf long")
    ranged = kept.repartitionByRange(max(1, min(width(points.sparkSession), -(-n // page))), "part", "leaf", "x").sortWithinPartitions("part", "leaf")

    def made(key: tuple[int, int], x: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        order = np.concatenate(arranged(x, np.arange(len(x)), BLOCK))
        cols = [[key[0]], [key[1]], [x[order].tobytes()], [w[order].tobytes()], [x.min(axis=0).tolist()], [x.max(axis=0).tolist()], [int(w.sum())]]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in PAGES.split(", ")])

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, w, key = np.zeros((0, d)), np.zeros(0, np.int64), None
        for b in batches:
            part, leaf, ws = (b.column(c).to_numpy() for c in ("part", "leaf", "w"))
            xs = matrix(b.column("x"), d)
            starts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (leaf[1:] != leaf[:-1])]) if len(part) else []
            for lo, hi in zip(starts, [*starts[1:], len(part)]):
                if key != (now := (int(part[lo]), int(leaf[lo]))):
                    if len(x):
                        yield made(key, x, w)
                    x, w, key = x[:0], w[:0], now
                x, w = np.concatenate([x, xs[lo:hi]]), np.concatenate([w, ws[lo:hi]])
                while len(x) >= page:
                    yield made(key, x[:page], w[:page])
                    x, w = x[page:], w[page:]
        if len(x):
            yield made(key, x, w)

    pages = cut(ranged.select("part", "leaf", "x", "w").mapInArrow(paged, PAGES))
    sides = pages.select("part", "leaf", "w", F.posexplode(F.arrays_zip("lo", "hi")).alias("pos", "side"))
    boxes = sides.groupBy("part", "leaf", "pos").agg(F.min("side.lo").alias("low"), F.max("side.hi").alias("high"), F.sum("w").alias("weight"))
    return Index(pages, Tree(nodes, len(nodes) + 1, d, boxes.toArrow()), d)


# ---- distances to boxes and points; rounding is monotone, so a box is never farther than its points
def near2(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(lo)))
    for j in range(x.shape[1]):
        t = np.maximum(np.maximum(lo[None, :, j] - x[:, None, j], x[:, None, j] - hi[None, :, j]), 0.0)
        out += t * t
    return out


def near2_to(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Each query to a box of its own."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        t = np.maximum(np.maximum(lo[:, j] - x[:, j], x[:, j] - hi[:, j]), 0.0)
        out += t * t
    return out


def far2_to(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        t = np.maximum(np.abs(x[:, j] - lo[:, j]), np.abs(hi[:, j] - x[:, j]))
        out += t * t
    return out


class Blocks:
    """A page's points in blocks of ``BLOCK``, the last one filled up with weightless points far away."""

    def __init__(self, xs: bytes, ws: bytes, d: int):
        x, w = np.frombuffer(xs, float).reshape(-1, d), np.frombuffer(ws, np.int64)
        rest = -len(x) % BLOCK
        self.x = np.concatenate([x, np.full((rest, d), np.inf)]).reshape(-1, BLOCK, d)
        self.w = np.concatenate([w, np.zeros(rest, np.int64)]).reshape(-1, BLOCK)
        self.lo = self.x.min(axis=1)
        self.hi = np.where(np.isinf(self.x), -np.inf, self.x).max(axis=1)

    def distances2(self, x: np.ndarray, block: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), BLOCK))
        held = self.x[block]
        for j in range(x.shape[1]):
            t = held[:, :, j] - x[:, None, j]
            out += t * t
        return out


def nearest_in(x: np.ndarray, blocks: Blocks, best: np.ndarray) -> np.ndarray:
    """Squared distance to the nearest point of a page, or ``best`` where that is no farther."""
    best, box = best.copy(), near2(x, blocks.lo, blocks.hi)
    order = np.argsort(box, axis=1, kind="stable")
    for step in range(order.shape[1]):
        block = order[:, step]
        some = np.flatnonzero(box[np.arange(len(x)), block] < best)
        if not len(some):
            break
        best[some] = np.minimum(best[some], blocks.distances2(x[some], block[some]).min(axis=1))
    return best


def within_in(x: np.ndarray, blocks: Blocks, radius: float, have: np.ndarray, enough: int) -> np.ndarray:
    """Weight of a page's points closer than the radius, on top of ``have``; a query with enough stops."""
    total = have.copy()
    box = np.sqrt(near2(x, blocks.lo, blocks.hi))
    order = np.argsort(box, axis=1, kind="stable")
    for step in range(order.shape[1]):
        block = order[:, step]
        some = np.flatnonzero((box[np.arange(len(x)), block] < radius) & (total < enough))
        if not len(some) and (box[np.arange(len(x)), block] >= radius).all():
            break
        close = np.sqrt(blocks.distances2(x[some], block[some])) < radius
        total[some] += (close * blocks.w[block[some]]).sum(axis=1)
    return total - have


# ---- queries meet the pages of a leaf in batches
def meet(asked: DataFrame, pages: DataFrame, scored: Callable[[pa.Table, pa.Table], pa.Table], kinds: str) -> DataFrame:
    """``scored`` on every (batch of queries of a leaf, pages of the leaf). The table of batches has a row per leaf at most."""
    keys = ["part", "leaf"]
    batches = F.broadcast(asked.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BATCH).cast("int").alias("batches")))
    left = asked.join(batches, keys).withColumn("batch", F.pmod(F.xxhash64("q"), F.col("batches")).cast("int")).drop("batches")
    left = left.select(*[F.col(c).alias(c) for c in left.columns])  # columns of its own, though both sides may come from one table
    right = pages.select(*keys, "xs", "ws", "lo", "hi").join(batches, keys).withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1))).drop("batches")

    def both(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if len(mine) and len(theirs):
            return scored(mine, theirs)
        of = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
        return pa.table({f.split()[0]: pa.array([], of[f.split()[1]]) for f in kinds.split(", ")})

    return left.groupBy(*keys, "batch").cogroup(right.groupBy(*keys, "batch")).applyInArrow(both, kinds)


def pages_of(theirs: pa.Table, d: int) -> Iterator[tuple[np.ndarray, np.ndarray, Blocks]]:
    lo, hi = matrix(theirs.column("lo"), d), matrix(theirs.column("hi"), d)
    for i in range(len(theirs)):
        yield lo[[i]], hi[[i]], Blocks(theirs.column("xs")[i].as_py(), theirs.column("ws")[i].as_py(), d)


def nearest(queries: DataFrame, index: Index) -> DataFrame:
    """Add ``distance`` to (part, x, ...): exact Euclidean distance to the nearest reference point of the same part."""
    d, tree = index.d, index.tree

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, part, leaf = matrix(b.column("x"), d), parted(b.column("part")), np.full(b.num_rows, -1)
            for p in np.unique(part):
                leaf[part == p] = tree.closest(x[part == p], int(p))
            yield b.append_column("leaf", pa.array(leaf))

    def scored(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        x, best = matrix(mine.column("x"), d), mine.column("best").to_numpy().copy()
        for lo, hi, blocks in pages_of(theirs, d):
            some = np.flatnonzero(near2(x, lo, hi)[:, 0] < best)
            best[some] = nearest_in(x[some], blocks, best[some])
        return pa.table({"q": mine.column("q"), "part": mine.column("part"), "leaf": mine.column("leaf"), "x": mine.column("x"), "best": pa.array(best)})

    def worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(s.start, s.stop - s.start) for s in tree.steps(whole.num_rows)):
                x, part, best, own = matrix(b.column("x"), d), parted(b.column("part")), b.column("best").to_numpy(), b.column("leaf").to_numpy()
                for p in np.unique(part):
                    mine = np.flatnonzero(part == p)
                    row, leaf, near = tree.within(x[mine], int(p), best[mine])
                    row, leaf, near = [v[leaf != own[mine][row]] for v in (row, leaf, near)]
                    at = pa.array(mine[row])
                    yield pa.RecordBatch.from_arrays(
                        [b.column("q").take(at), b.column("part").take(at), pa.array(leaf), b.column("x").take(at), b.column("best").take(at), pa.array(near), pa.array(placed(row, near, leaf))],
                        names=["q", "part", "leaf", "x", "best", "near", "place"])

    asked = "q long, part long, leaf long, x array<double>, best double"
    held = cut(queries.withColumn("q", F.monotonically_increasing_id()).select("q", "part", "x", *[c for c in queries.columns if c not in ("part", "x")]))
    points = cut(held.select("q", "part", "x").mapInArrow(located, "q long, part long, x array<double>, leaf long").where("leaf >= 0"))
    first = cut(meet(points.withColumn("best", F.lit(float("inf"))), index.pages, scored, asked))
    rest = cut(first.mapInArrow(worth, asked + ", near double, place long"))
    best = first.select("q", "best")
    for i, wave in enumerate((rest.where(F.col("place") <= SECOND), rest.where(F.col("place") > SECOND))):
        if not wave.isEmpty():
            now = wave.drop("best").join(best, "q").where(F.col("near") < F.col("best")) if i else wave
            found = meet(now.select("q", "part", "leaf", "x", "best"), index.pages, scored, asked).select("q", "best")
            best = cut(best.unionByName(found).groupBy("q").agg(F.min("best").alias("best")))
    return held.join(best.select("q", F.sqrt("best").alias("distance")), "q", "left").drop("q")


def count_within(queries: DataFrame, index: Index, radius: float, enough: int = 2) -> DataFrame:
    """Add ``close`` to (part, x, ...): reference weight at a distance below ``radius``, exact below ``enough``.

    A node of the tree wholly inside the circle counts at once, and a point that has ``enough`` is not followed further; from there
    on ``close`` is only known to be at least ``enough``.
    """
    d, tree = index.d, index.tree

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(s.start, s.stop - s.start) for s in tree.steps(whole.num_rows)):
                x, part = matrix(b.column("x"), d), parted(b.column("part"))
                for p in (p for p in np.unique(part) if int(p) in tree.parts):
                    mine = np.flatnonzero(part == p)
                    sure, row, leaf, near = tree.touched(x[mine], int(p), radius, enough)
                    at = pa.array(np.concatenate([mine, mine[row]]))
                    yield pa.RecordBatch.from_arrays(
                        [b.column("q").take(at), b.column("part").take(at), pa.array(np.concatenate([np.full(len(mine), -1), leaf])), b.column("x").take(at),
                         pa.array(np.concatenate([sure, sure[row]])), pa.array(np.concatenate([np.zeros(len(mine), np.int64), placed(row, near, leaf)]))],
                        names=["q", "part", "leaf", "x", "close", "place"])

    def scored(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        x, have = matrix(mine.column("x"), d), mine.column("close").to_numpy()
        total = have.copy()
        for lo, hi, blocks in pages_of(theirs, d):
            some = np.flatnonzero((np.sqrt(near2(x, lo, hi)[:, 0]) < radius) & (total < enough))
            total[some] += within_in(x[some], blocks, radius, total[some], enough)
        return pa.table({"q": mine.column("q"), "close": pa.array(total - have)})

    held = cut(queries.withColumn("q", F.monotonically_increasing_id()))
    listed = cut(held.select("q", "part", "x").mapInArrow(cutting, "q long, part long, leaf long, x array<double>, close long, place long"))
    close = listed.where("leaf < 0").select("q", "close")
    rest = listed.where("leaf >= 0")
    for i, wave in enumerate((rest.where(F.col("place") <= SECOND), rest.where(F.col("place") > SECOND))):
        if not wave.isEmpty():
            now = wave.drop("close").join(close, "q").where(F.col("close") < enough) if i else wave
            found = meet(now.select("q", "part", "leaf", "x", "close"), index.pages, scored, "q long, close long")
            close = cut(close.unionByName(found).groupBy("q").agg(F.sum("close").alias("close")))
    return held.join(close, "q", "left").fillna(0, ["close"]).drop("q")
