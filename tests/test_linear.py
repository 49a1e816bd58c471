"""The linear classifier and the compression against numpy, on any partitioning."""

import numpy as np
import pytest

from twinloom.functions.blocks import CHUNK, summed
from twinloom.operators import linear, prepare


def plain_fit(x, y, classes, rounds=linear.ROUNDS, ridge=linear.RIDGE):
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 0.0]
    curve = 0.5 * (x.T @ x).sum(axis=1) + penalty
    before = now = np.zeros((classes, x.shape[1]))
    for t in range(rounds):
        at = now + t / (t + 3) * (now - before)
        before, now = now, at - (slopes(x, y, at) + penalty * at) / curve
    return now, penalty


def slopes(x, y, w):
    z = np.exp(x @ w.T)
    return (z / z.sum(axis=1, keepdims=True) - np.eye(len(w))[y]).T @ x


def labelled(spark, n=300, d=6, seed=1):
    r = np.random.default_rng(seed)
    x = r.random((n, d)) * (r.random((n, d)) < 0.5)
    x[: n // 3] = x[0]  # a third of all rows is one point
    y = (x @ r.normal(size=(d, 3)) + r.normal(size=(n, 3)) / 9).argmax(axis=1)
    return x, y, spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y)], "features array<double>, label long")


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_linear_fit_as_numpy(spark, parts):
    x, y, df = labelled(spark)
    want, _ = plain_fit(x, y, 3, rounds=12)
    got = linear.fit(df.repartition(parts), 3, 6, rounds=12)
    assert np.abs(got - want).max() < 1e-9
    x1 = np.hstack([x, np.ones((len(x), 1))])
    assert linear.accuracy(df.repartition(parts), got) == ((x1 @ want.T).argmax(axis=1) == y).mean()


def test_steps_reach_the_optimum(spark):
    x, y, df = labelled(spark)
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = plain_fit(x, y, 3, rounds=2000)
    assert np.abs(slopes(x1, y, w) + penalty * w).max() < 1e-4
    loss = lambda w: (np.log(np.exp(x1 @ w.T).sum(axis=1)) - (x1 @ w.T)[np.arange(len(y)), y]).sum() + 0.5 * (penalty * w * w).sum()
    assert loss(linear.fit(df, 3, 6)) - loss(w) < 1e-3 * loss(w)


def test_linear_without_rows_or_words(spark):
    empty = spark.createDataFrame([], "features array<double>, label long")
    assert not linear.fit(empty, 2, 3, rounds=2).any() and linear.accuracy(empty, np.zeros((2, 4))) is None
    blank = spark.createDataFrame([([0.0], 0), ([0.0], 1), ([0.0], 1)], "features array<double>, label long")
    w = linear.fit(blank, 2, 1, rounds=12)
    assert not w[:, 0].any() and linear.accuracy(blank, w) == pytest.approx(2 / 3)


def test_sums_longer_than_a_chunk(spark):
    size = 2 * CHUNK + 5
    df = spark.range(100).repartition(7)
    got = summed(df, size, lambda b: np.arange(size) * float(sum(b.column("id").to_pylist())))
    assert (got == np.arange(size) * 4950.0).all()
    assert not summed(df.limit(0), size, lambda b: np.ones(size)).any()


def lost(x, directions):
    c = x - x.mean(axis=0)
    return ((c - c @ directions @ directions.T) ** 2).sum()


@pytest.mark.parametrize("d,k,parts", [(12, 3, 5), (40, 3, 1), (40, 3, 16), (40, 40, 3), (2, 1, 2)])
def test_compression_loses_as_little_as_svd(spark, d, k, parts):
    r = np.random.default_rng(d)
    x = r.normal(size=(200, d)) @ np.diag(0.8 ** np.arange(d)) @ r.normal(size=(d, d)) + 5
    df = spark.createDataFrame([tuple(map(float, a)) for a in x], ", ".join(f"c{i} double" for i in range(d))).repartition(parts)
    cols = [f"c{i}" for i in range(d)]
    got = prepare.Compressor.fit(df, cols, k)
    tail = (np.linalg.svd(x - x.mean(axis=0), compute_uv=False)[k:] ** 2).sum()
    whole = ((x - x.mean(axis=0)) ** 2).sum()
    assert lost(x, got.directions) == pytest.approx(tail, rel=1e-6, abs=1e-9 * whole)
    assert np.abs(got.directions.T @ got.directions - np.eye(k)).max() < 1e-9
    top = np.abs(got.directions).argmax(axis=0)
    assert (got.directions[top, np.arange(k)] > 0).all()
    back = np.array(got.inverse(got.transform(df, []), []).collect())
    assert ((back - np.array(df.collect())) ** 2).sum() == pytest.approx(tail, rel=1e-6, abs=1e-9 * whole)


def test_compression_of_nothing(spark):
    df = spark.createDataFrame([], "a double, b double")
    c = prepare.Compressor.fit(df, ["a", "b"], 1)
    assert c.means == [0.0, 0.0] and c.transform(df, []).count() == 0
    flat = spark.createDataFrame([(1.0, None), (1.0, None)], "a double, b double")
    c = prepare.Compressor.fit(flat, ["a", "b"], 1)
    assert [tuple(r) for r in c.inverse(c.transform(flat, []), []).collect()] == [(1.0, 0.0)] * 2


def test_blocks_hold_all_rows(spark, monkeypatch):
    """Rows are packed once, in blocks of bounded size; what is unpacked are the rows."""
    monkeypatch.setattr(linear, "BLOCK_ROWS", 7)
    x, y, df = labelled(spark, n=50)
    held = linear.packed(df.coalesce(1), 6)
    assert max(r["rows"] for r in held.select("rows").collect()) <= 7
    blocks = [b for batch in held.toArrow().to_batches() for b in linear.unpacked(batch, 6)]
    got = np.vstack([np.column_stack(b) for b in blocks])
    want = np.column_stack([x, np.ones(50), y])
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_rows_are_not_dealt_by_their_class(spark):
    """The codes of few classes go to the rows."""
    from twinloom.operators.utility import _labelled

    pair = spark.createDataFrame([("real", "a", "x"), ("synth", "b", "y"), ("real", None, "z")], "side string, k string, t string")
    out = _labelled(pair, "k")
    assert sorted((r["t"], r["label"]) for r in out.collect()) == [("x", 0.0), ("y", 1.0), ("z", None)]
    assert "SortMergeJoin" not in out._jdf.queryExecution().sparkPlan().toString()
