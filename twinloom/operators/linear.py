"""Linear classifiers: many classes at once, by accelerated Newton steps with a bounded curvature.

The penalised log-loss of a softmax classifier bends nowhere more than half of the features' product sums; their row sums,
one number per feature, bound it from above. A step divides the gradient by that number, so no matrix is inverted, no step
length is searched and every step goes down; a momentum makes the number of passes small. Rows are packed into blocks once, a
block's non-zero features as bytes, read once per step and reduced inside their tasks to one number per (class, feature);
these sums are all that reaches the driver.
The steps are a fixed number, so the result is a definite function of the rows, which SQL can say as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from twinloom.functions.blocks import matrix, summed
from twinloom.session import cut

ROUNDS = 60
RIDGE = 1.0
#: Numbers of a block, and its rows at most.
BLOCK_CELLS, BLOCK_ROWS = 1 << 20, 1024
BLOCKS = "rows int, at binary, x binary, y binary"


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Features with a last column of ones, and labels."""
    x = matrix(batch, "features")
    return np.hstack([x, np.ones((len(x), 1))]), batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)


def packed(data: DataFrame, features: int) -> DataFrame:
    """(features, label) as blocks of rows: places of the non-zero numbers in a block of ``_matrix``, these numbers, the labels."""
    step = max(1, min(BLOCK_ROWS, BLOCK_CELLS // (features + 1)))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                x, y = _matrix(b)
                at = np.flatnonzero(x)
                cells = [pa.array([v.tobytes()], pa.binary()) for v in (at.astype(np.int32), x.ravel()[at], y)]
                yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), *cells], names=["rows", "at", "x", "y"])

    return cut(data.select("features", "label").mapInArrow(part, BLOCKS))


def unpacked(batch: pa.RecordBatch, features: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``_matrix`` of each block."""
    for n, at, v, y in zip(*(batch.column(c).to_pylist() for c in ("rows", "at", "x", "y"))):
        x = np.zeros((n, features + 1))
        x.ravel()[np.frombuffer(at, np.int32)] = np.frombuffer(v)
        yield x, np.frombuffer(y, np.int64)


def _shares(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = x @ weights.T
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(data: DataFrame, classes: int, features: int, rounds: int = ROUNDS, ridge: float = RIDGE) -> np.ndarray:
    """Weights (class, feature), the intercept last and not penalised, from rows (features array<double>, label).

    Features must not be negative. An empty table gives zeros.
    """
    d = features + 1
    penalty = np.full(d, ridge)
    penalty[-1] = 0.0
    data = packed(data, features)

    def bound(batch: pa.RecordBatch) -> np.ndarray:
        return sum(x.T @ x.sum(axis=1) for x, _ in unpacked(batch, features))

    curve = 0.5 * summed(data, d, bound) + penalty
    curve = np.where(curve > 0, curve, 1.0)
    before = now = np.zeros((classes, d))
    for t in range(rounds):
        at = now + t / (t + 3) * (now - before)

        def slope(batch: pa.RecordBatch, at: np.ndarray = at) -> np.ndarray:
            total = np.zeros((classes, d))
            for x, y in unpacked(batch, features):
                p = _shares(x, at)
                p[np.arange(len(y)), y] -= 1.0
                total += p.T @ x
            return total.ravel()

        g = summed(data, classes * d, slope).reshape(classes, d) + penalty * at
        before, now = now, at - g / curve
    return now


def accuracy(data: DataFrame, weights: np.ndarray) -> float | None:
    """Share of the rows whose highest score (ties: the smaller label) is their label; None for an empty table."""

    def hits(batch: pa.RecordBatch) -> np.ndarray:
        x, y = _matrix(batch)
        return np.array([(np.argmax(x @ weights.T, axis=1) == y).sum(), len(y)], dtype=float)

    right, n = summed(data.select("features", "label"), 2, hits)
    return right / n if n else None
