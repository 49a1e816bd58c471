"""Forests of histogram trees whose digits do not depend on how rows are dealt out.

Features are cut at exact quantiles of the training rows. Rows of equal bins and label become one cell with a count, and
a cell's weight in a tree is a Poisson draw for that count, keyed by the cell's content and the tree. A level of all
trees is one aggregate: tasks walk their cells through the trees so far and add weights by (tree, feature, node, bin,
label) into arrays; sums are whole numbers, so their order does not matter. The best cut of each node is found per (tree, feature)
and then per node. The driver holds the trees alone: at most 2 ** depth nodes each.

Numeric labels are cut into 2 ** 20 steps between the training side's least and greatest value. Ties go to the smaller
feature, bin and label. A node without a cut that betters it is a leaf. Missing and NaN features count as 0.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from twinloom.functions import ordered, pairs
from twinloom.functions.pairs import REAL, SIDE, SYNTH
from twinloom.session import cut

BINS = 32
STEPS = 2**20
PRIME = 2**31 - 1
#: Counts up to here are drawn from the Poisson distribution, greater ones evenly, with the same mean and variance.
EXACT = 16
VOTES = 4_000_000
#: A task holds the sums of a level as arrays of up to so many numbers.
DENSE = 1 << 24


def edges(data: DataFrame, cols: list[str], bins: int = BINS) -> list[list[float]]:
    """Per feature: at most ``bins - 1`` values of the training rows, below the greatest, that close equal shares of them."""
    counts = pairs.counts_by_value(data.where(F.col(SIDE) == SYNTH), cols)
    cum = ordered.cumulate(counts, ["column"], ["v"], {"upto": "s"}, totals=True)
    kept = cum.where(F.expr(f"upto * {bins} div total_upto > (upto - s) * {bins} div total_upto and upto < total_upto"))
    found = {c: [] for c in cols}
    for r in kept.select("column", "v").collect():
        found[r["column"]].append(r["v"])
    return [sorted(found[c]) for c in cols]


def binned(cols: list[str], cuts: list[list[float]]) -> Column:
    """The bin of every feature: how many of its edges lie below."""
    def below(c, e):
        return F.size(F.filter(F.array(*[F.lit(x) for x in e]), lambda x: x < F.col(c))) if e else F.lit(0)

    return F.array(*[below(c, e) for c, e in zip(cols, cuts)])


def key_of(bins: Column, y: Column) -> Column:
    hexed = F.md5(F.concat_ws(",", F.transform(bins, lambda b: b.cast("string")), y.cast("string")))
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long") % PRIME


def mixers(trees: int, seed: int) -> list[tuple[int, int]]:
    """Per tree the factor and the summand that turn a cell's key into its draw."""
    words = [hashlib.md5(f"{seed}:{t}".encode()).hexdigest() for t in range(trees)]
    return [(1 + int(w[:8], 16) % (PRIME - 1), int(w[8:16], 16) % PRIME) for w in words]


def thresholds(n: int) -> list[int]:
    """A draw below PRIME is worth as many units as there are thresholds at or below it: Poisson with mean ``n``."""
    out, term, total, k = [], math.exp(-n), 0.0, 0
    while True:
        total += term
        at = math.floor(total * PRIME)
        if at >= PRIME - 1 or (k > n and term * PRIME < 0.5):
            return out
        out.append(at)
        k += 1
        term *= n / k


TABLE = [thresholds(n) for n in range(1, EXACT + 1)]


def weights(h: np.ndarray, n: np.ndarray, a: int, b: int) -> np.ndarray:
    u = (h * a + b) % PRIME
    root = np.floor(np.sqrt(3.0 * n)).astype(np.int64)
    out = n - root + (2 * u * root + PRIME // 2) // PRIME
    for k in np.unique(n[n <= EXACT]):
        at = n == k
        out[at] = np.searchsorted(TABLE[k - 1], u[at], side="right")
    return out


def offered(seed: int, tree: int, node: int, n_cols: int, k: int) -> list[int]:
    """The features a node may be cut by: the first ``k`` in the order of a keyed hash."""
    if k >= n_cols:
        return list(range(n_cols))
    return sorted(range(n_cols), key=lambda f: hashlib.md5(f"{seed}:{tree}:{node}:{f}".encode()).hexdigest())[:k]


@dataclass
class Forest:
    """Nodes are numbered from 1; the children of ``i`` are ``2 i`` and ``2 i + 1``; a leaf has feature -1."""

    cuts: list[list[float]]
    feature: np.ndarray
    at: np.ndarray
    #: per tree: node, label, weight and sum of steps of what its leaves hold
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def nodes(self, bins: np.ndarray, tree: int) -> np.ndarray:
        node = np.ones(len(bins), np.int64)
        row = np.arange(len(bins))
        while len(row):
            f = self.feature[tree, node[row]]
            row, f = row[f >= 0], f[f >= 0]
            here = node[row]
            node[row] = 2 * here + (bins[row, f] > self.at[tree, here])
        return node


def _matrix(b: pa.RecordBatch, width: int) -> np.ndarray:
    return b.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


#: ``cell`` numbers (tree, feature, node, bin); one number instead of four keeps the shuffle narrow
SUMS = "cell long, y long, w long, s long"


def _histogram(forest: Forest, level: int, mixed: list, masks: np.ndarray, numeric: bool, labels: int):
    """Tasks: sums of one level. Up to ``DENSE`` cells they are arrays that a task adds to, so it leaves one row for each (cell,
    label) it met; beyond, a row for each of a batch."""
    width, size = len(forest.cuts), forest.feature.shape[1]
    dense = len(mixed) * width * 2**level * BINS * labels <= DENSE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Dense(len(mixed) * width, 2**level * BINS, labels, numeric) if dense else None
        for b in batches:
            bins, (h, n, y) = _matrix(b, width), (b.column(c).to_numpy() for c in ("h", "n", "y"))
            label, found = np.zeros(len(y), np.int64) if numeric else y, []
            for t, (p, q) in enumerate(mixed):
                w, node = weights(h, n, p, q), forest.nodes(bins, t)
                live = np.flatnonzero((w > 0) & (node >= 2**level))
                offer = masks[t, node[live] - 2**level]
                for f in range(width):
                    pick = live[offer[:, f]]
                    if held is not None:
                        held.add(t * width + f, (node[pick] - 2**level) * BINS + bins[pick, f], label[pick], w[pick], y[pick])
                    else:
                        cell = ((t * width + f) * size + node[pick]) * BINS + bins[pick, f]
                        found.append(_summed(cell, label[pick], w[pick], w[pick] * y[pick]))
            if held is None:
                yield _batch(found)
        for group, at, label, w, s in held.rows() if held is not None else ():
            yield _batch([np.stack([(group * size + 2**level) * BINS + at, label, w, s])])

    return run


def _leaves(forest: Forest, mixed: list, numeric: bool, labels: int):
    """Tasks: sums of what the leaves hold; ``cell`` is tree and node."""
    width, size = len(forest.cuts), forest.feature.shape[1]
    dense = len(mixed) * size * labels <= DENSE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Dense(len(mixed), size, labels, numeric) if dense else None
        for b in batches:
            bins, (h, n, y) = _matrix(b, width), (b.column(c).to_numpy() for c in ("h", "n", "y"))
            label, found = np.zeros(len(y), np.int64) if numeric else y, []
            for t, (p, q) in enumerate(mixed):
                w = weights(h, n, p, q)
                pick = np.flatnonzero(w > 0)
                node = forest.nodes(bins[pick], t)
                if held is not None:
                    held.add(t, node, label[pick], w[pick], y[pick])
                else:
                    found.append(_summed(t * size + node, label[pick], w[pick], w[pick] * y[pick]))
            if held is None:
                yield _batch(found)
        for group, at, label, w, s in held.rows() if held is not None else ():
            yield _batch([np.stack([group * size + at, label, w, s])])

    return run


class Dense:
    """Sums of weights, and of weights times label steps, by (group, place, label) in arrays; whole numbers throughout."""

    def __init__(self, groups: int, places: int, labels: int, numeric: bool):
        self.places, self.labels = places, labels
        self.w = np.zeros((groups, places * labels), np.int64)
        self.s = np.zeros((groups, places * labels), np.int64) if numeric else None

    def add(self, group: int, place: np.ndarray, label: np.ndarray, w: np.ndarray, y: np.ndarray) -> None:
        at = place if self.labels == 1 else place * self.labels + label
        for held, v in ((self.w, w), (self.s, w * y if self.s is not None else None)):
            if held is None:
                continue
            if float(v.sum(dtype=float)) < 2.0**52:  # doubles hold such sums exactly
                held[group] += np.bincount(at, weights=v, minlength=held.shape[1]).astype(np.int64)
            else:
                np.add.at(held[group], at, v)

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for group, w in enumerate(self.w):
            at = np.flatnonzero(w)
            if len(at):
                place, label = np.divmod(at, self.labels)
                yield group, place, label, w[at], w[at] * label if self.s is None else self.s[group, at]


def _summed(cell: np.ndarray, label: np.ndarray, w: np.ndarray, s: np.ndarray) -> np.ndarray:
    order = np.lexsort((label, cell))
    if not len(order):
        return np.zeros((4, 0), np.int64)
    cell, label = cell[order], label[order]
    first = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (label[1:] != label[:-1])])
    return np.stack([cell[first], label[first], np.add.reduceat(w[order], first), np.add.reduceat(s[order], first)])


def _batch(found: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in np.hstack(found)], names=["cell", "y", "w", "s"])


def _cuts_of_group(width: int, size: int, numeric: bool):
    """The best cut of every node of one (tree, feature), where one betters the node."""

    def score(w, s):
        n = np.maximum(w.sum(2), 1.0)
        return s.sum(2) ** 2 / n if numeric else (w * w).sum(2) / n

    def run(g: pd.DataFrame) -> pd.DataFrame:
        tree, feature = divmod(int(g["cell"].iloc[0]) // (size * BINS), width)
        node, b = np.divmod(g["cell"].to_numpy() % (size * BINS), BINS)
        nodes, at = np.unique(node, return_inverse=True)
        labels, y = np.unique(g["y"].to_numpy(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        at, y, b, w, s = at[order], y[order], b[order], *(g[c].to_numpy()[order] for c in ("w", "s"))
        n_bins, out = int(b.max()) + 1, []
        step = max(1, VOTES // (n_bins * len(labels)))
        for lo in range(0, len(nodes), step):
            part = slice(*np.searchsorted(at, [lo, lo + step]))
            shape = (min(step, len(nodes) - lo), n_bins, len(labels))
            lw, ls = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
            np.add.at(lw, (at[part] - lo, b[part], y[part]), w[part])
            np.add.at(ls, (at[part] - lo, b[part], y[part]), s[part])
            lw, ls = lw.cumsum(1), ls.cumsum(1)
            # the last bin leaves nothing on the right, so its score is the node's own
            both = score(lw.astype(float), ls.astype(float)) + score((lw[:, -1:] - lw).astype(float), (ls[:, -1:] - ls).astype(float))
            best = both.argmax(1)
            top = both[np.arange(len(both)), best]
            good = np.flatnonzero(top > both[:, -1])
            out.append(pd.DataFrame({"node": nodes[lo + good], "at": best[good], "score": top[good]}))
        return pd.concat(out).assign(tree=tree, feature=feature)[["tree", "node", "feature", "at", "score"]]

    return run


def fit(data: DataFrame, cols: list[str], trees: int, depth: int, numeric: bool = False, seed: int = 42) -> Forest:
    """A forest for the whole-number column ``y`` of the training rows of (side, y, ``cols``).

    Classes see the square root of the number of features at each node, numbers all of them.
    """
    cuts = edges(data, cols)
    train = data.where((F.col(SIDE) == SYNTH) & F.col("y").isNotNull()).select(binned(cols, cuts).alias("bins"), "y")
    cells = train.groupBy("bins", "y").agg(F.count(F.lit(1)).alias("n")).withColumn("h", key_of(F.col("bins"), F.col("y")))
    # every cell costs ``trees`` rows later, so even few of them are spread over all tasks
    cells = cut(cells.repartition(ordered.width(data.sparkSession), "h"))
    width, mixed = len(cols), mixers(trees, seed)
    labels = 1 if numeric else 1 + (cells.agg(F.max("y")).first()[0] or 0)
    rows = cells.coalesce(data.sparkSession.sparkContext.defaultParallelism)  # every task leaves its sums once
    k = width if numeric or trees == 1 else math.isqrt(width - 1) + 1
    size = 2 ** (depth + 1)
    forest = Forest(cuts, np.full((trees, size), -1), np.full((trees, size), -1), [])
    open_nodes = [(t, 1) for t in range(trees)]
    for level in range(depth):
        masks = np.zeros((trees, 2**level, width), bool)
        for t, node in open_nodes:
            masks[t, node - 2**level, offered(seed, t, node, width, k)] = True
        hist = rows.mapInArrow(_histogram(forest, level, mixed, masks, numeric, labels), SUMS).groupBy("cell", "y").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
        splits = hist.groupBy(F.expr(f"cell div {size * BINS}")).applyInPandas(_cuts_of_group(width, size, numeric), "tree long, node long, feature long, at long, score double")
        best = splits.groupBy("tree", "node").agg(F.max_by(F.struct("feature", "at"), F.struct("score", -F.col("feature"))).alias("b"))
        open_nodes = []
        for r in best.select("tree", "node", "b.*").collect():
            forest.feature[r["tree"], r["node"]], forest.at[r["tree"], r["node"]] = r["feature"], r["at"]
            open_nodes += [(r["tree"], 2 * r["node"]), (r["tree"], 2 * r["node"] + 1)]
        if not open_nodes:
            break
    sums = rows.mapInArrow(_leaves(forest, mixed, numeric, labels), SUMS).groupBy("cell", "y").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
    held = np.array(sorted(tuple(r) for r in sums.collect()), np.int64).reshape(-1, 4)
    tree, node = np.divmod(held[:, 0], size)
    forest.held = [(node[tree == t], *held[tree == t, 1:].T) for t in range(trees)]
    return forest


def predicted(rows: DataFrame, cols: list[str], forest: Forest, keep: str, numeric: bool = False) -> DataFrame:
    """(``keep``, prediction): the label with the greatest sum of leaf shares over the trees, or the mean step of the leaves."""
    width, size = len(cols), forest.feature.shape[1]
    n_labels = 1 if numeric else 1 + max((int(y.max()) for _, y, _, _ in forest.held if len(y)), default=0)
    grown = [t for t, x in enumerate(forest.held) if len(x[0])]  # a tree whose rows all drew 0 is silent
    dtype = rows.schema[keep].dataType.simpleString()

    def leaf_votes(t: int) -> np.ndarray:
        node, y, w, s = forest.held[t]
        votes = np.zeros((size, n_labels), float if numeric else np.int64)
        if numeric:
            votes[node, 0] = s / w
        else:
            whole = np.zeros(size, np.int64)
            np.add.at(whole, node, w)
            votes[node, y] = w * STEPS // whole[node]
        return votes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every, out = _matrix(b, width), [np.zeros(0)]
            step = max(1, VOTES // n_labels)
            for bins in (every[i : i + step] for i in range(0, len(every), step)):
                sums = np.zeros((len(bins), n_labels), float if numeric else np.int64)
                for t in grown:
                    sums += leaf_votes(t)[forest.nodes(bins, t)]
                out.append(sums[:, 0] / max(len(grown), 1) if numeric else sums.argmax(1).astype(float))
            yield pa.RecordBatch.from_arrays([b.column(keep), pa.array(np.concatenate(out))], names=[keep, "prediction"])

    return rows.select(keep, binned(cols, forest.cuts).alias("bins")).mapInArrow(run, f"{keep} {dtype}, prediction double")


def accuracy(data: DataFrame, cols: list[str], trees: int, depth: int, seed: int = 42) -> float | None:
    """Share of real rows of (side, y, ``cols``) whose class a forest fitted on the synthetic rows tells; None below two classes."""
    if len(data.where((F.col(SIDE) == SYNTH) & F.col("y").isNotNull()).select("y").distinct().limit(2).collect()) < 2:
        return None
    forest = fit(data, cols, trees, depth, seed=seed)
    told = predicted(data.where(F.col(SIDE) == REAL), cols, forest, "y")
    return told.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]


def r_squared(data: DataFrame, cols: list[str], trees: int, depth: int, seed: int = 42) -> float | None:
    """R2 on real rows of (side, label, ``cols``) of a forest fitted on the synthetic rows; None where real labels do not differ."""
    low, high = data.where(F.col(SIDE) == SYNTH).agg(F.min("label"), F.max("label")).first()
    spread = high - low
    step = F.floor((F.col("label") - low) / spread * float(STEPS)).cast("long") if spread > 0 else F.lit(0).cast("long")
    forest = fit(data.withColumn("y", step), cols, trees, depth, numeric=True, seed=seed)
    told = predicted(data.where(F.col(SIDE) == REAL), cols, forest, "label", numeric=True)
    guess = F.lit(low) + (F.col("prediction") + 0.5) / float(STEPS) * spread
    err = F.sum((F.col("label") - guess) ** 2)
    return told.agg(1 - err / (F.nullif(F.var_pop("label"), F.lit(0.0)) * F.count(F.lit(1)))).first()[0]
