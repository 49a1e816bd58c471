"""Forests against a plain version, and the same digits however rows are dealt out."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinloom.operators import trees, utility

COLS = ["f0", "f1", "f2", "f3"]


def table(spark, seed=0, n=400, numeric=False):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 4)), 1)
    x[: n // 3] = 0.5  # a third of all rows is one point
    y = (x[:, 0] * 900 + x[:, 1] * 300).astype(int) if numeric else (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] > 0.7)
    rows = [("synth" if i % 2 else "real", int(y[i]), *map(float, x[i])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "side string, y long, f0 double, f1 double, f2 double, f3 double")


def plain(rows, n_trees, depth, numeric, seed=42):
    """The same forest, cell by cell: predictions of the real rows."""
    train = [r for r in rows if r[0] == "synth"]
    cuts = []
    for j in range(4):
        v = sorted(r[2 + j] for r in train)
        ranks = {-(-i * len(v) // trees.BINS) for i in range(1, trees.BINS)}
        cuts.append(sorted({v[k - 1] for k in ranks if k and v[k - 1] < v[-1]}))
    bins = lambda r: tuple(sum(e < r[2 + j] for e in cuts[j]) for j in range(4))
    cells = {}
    for r in train:
        cells[bins(r), r[1]] = cells.get((bins(r), r[1]), 0) + 1
    votes = {}
    for t, (a, b) in enumerate(trees.mixers(n_trees, seed)):
        held = []
        for (x, y), n in cells.items():
            h = int(hashlib.md5(",".join(map(str, (*x, y))).encode()).hexdigest()[:8], 16) % trees.PRIME
            u = (h * a + b) % trees.PRIME
            root = int((3 * n) ** 0.5)
            w = sum(k <= u for k in trees.TABLE[n - 1]) if n <= trees.EXACT else n - root + (2 * u * root + trees.PRIME // 2) // trees.PRIME
            if w:
                held.append((x, y, w))

        def value(part):
            n = sum(w for *_, w in part)
            if numeric:
                return float(sum(y * w for _, y, w in part)) ** 2 / n
            return sum(sum(w for _, y, w in part if y == c) ** 2 for c in {y for _, y, _ in part}) / n

        def grow(node, part, asked):
            best = None
            if node < 2**depth:
                for f in trees.offered(seed, t, node, 4, 4 if numeric or n_trees == 1 else 2):
                    for k in sorted({x[f] for x, _, _ in part})[:-1]:
                        s = value([c for c in part if c[0][f] <= k]) + value([c for c in part if c[0][f] > k])
                        if s > value(part) and (best is None or (s, -f, -k) > best[0]):
                            best = ((s, -f, -k), f, k)
            if best is None:
                n = sum(w for *_, w in part)
                for i, _ in asked:
                    if numeric:
                        votes[i] = votes.get(i, 0.0) + sum(y * w for _, y, w in part) / n / n_trees
                    else:
                        for c in {y for _, y, _ in part}:
                            votes.setdefault(i, {})
                            votes[i][c] = votes[i].get(c, 0) + sum(w for _, y, w in part if y == c) * trees.STEPS // n
                return
            _, f, k = best
            grow(2 * node, [c for c in part if c[0][f] <= k], [a for a in asked if a[1][f] <= k])
            grow(2 * node + 1, [c for c in part if c[0][f] > k], [a for a in asked if a[1][f] > k])

        grow(1, held, [(i, bins(r)) for i, r in enumerate(rows) if r[0] == "real"])
    return [votes[i] if numeric else max(votes[i], key=lambda c: (votes[i][c], -c)) for i in sorted(votes)]


@pytest.mark.parametrize("numeric,n_trees,depth", [(False, 5, 3), (False, 1, 5), (True, 4, 3)])
def test_same_as_plain_version(spark, numeric, n_trees, depth):
    rows, df = table(spark, numeric=numeric)
    want = plain(rows, n_trees, depth, numeric)
    real = df.where("side = 'real'")
    for parts in (1, 4, 64):
        forest = trees.fit(df.repartition(parts), COLS, n_trees, depth, numeric)
        at = [r for r in rows if r[0] == "real"]
        got = sorted((tuple(r[k] for k in ("y", "prediction")) for r in trees.predicted(real, COLS, forest, "y", numeric).collect()))
        np.testing.assert_allclose(got, sorted((r[1], float(p)) for r, p in zip(at, want)))


def test_digits_do_not_depend_on_partitions(spark):
    rows, df = table(spark, seed=3, n=600)
    got = {trees.accuracy(df.repartition(p), COLS, 8, 4) for p in (1, 4, 64)}
    assert len(got) == 1 and got.pop() > 0.9


def test_draws_have_mean_and_variance_of_a_poisson():
    h = np.random.default_rng(1).integers(0, trees.PRIME, 40_000)
    (a, b), *_ = trees.mixers(1, 42)
    for n in (1, 2, 16, 17, 1000):
        w = trees.weights(h, np.full(len(h), n), a, b)
        assert w.min() >= 0 and abs(w.mean() / n - 1) < 0.02 and abs(w.var() / n - 1) < 0.06


def test_missing_values_constant_columns_and_few_rows(spark):
    rows = [("synth" if i % 2 else "real", float("nan") if i % 5 == 0 else None if i % 7 == 0 else float(i % 3), 1.0, "x" if i % 3 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "side string, a double, b double, y string")
    assert 0 <= utility.tstr_fast(df.fillna({"y": "z"}), "y").first()["score"] <= 1
    same = df.withColumn("y", F.lit(3.5))
    assert utility.tstr_regression(same.fillna(0.0).drop("a"), "y", trees=2, depth=2).first()["score"] == 0.5
    assert utility.tstr_fast(df.limit(0), "y").first()["score"] == 0.5


def test_a_task_leaves_each_cell_once(monkeypatch):
    """Sums of a level are held over all batches of a task; beyond ``DENSE`` numbers the rows of batches add up to the same."""
    import pyarrow as pa

    r = np.random.default_rng(2)
    forest = trees.Forest([[0.0] * 3, [0.0] * 3], np.full((2, 4), -1), np.full((2, 4), -1), [])
    masks = np.ones((2, 1, 2), bool)

    def batch():
        bins = r.integers(0, 4, (50, 2))
        cols = [pa.array(bins.tolist(), pa.list_(pa.int32())), *[pa.array(r.integers(lo, hi, 50)) for lo, hi in ((0, trees.PRIME), (1, 30), (0, 3))]]
        return pa.RecordBatch.from_arrays(cols, names=["bins", "h", "n", "y"])

    batches = [batch() for _ in range(4)]
    for numeric in (False, True):
        got = []
        for limit in (trees.DENSE, 0):
            monkeypatch.setattr(trees, "DENSE", limit)
            work = trees._histogram(forest, 0, trees.mixers(2, 42), masks, numeric, 1 if numeric else 3), trees._leaves(forest, trees.mixers(2, 42), numeric, 1 if numeric else 3)
            for run in work:
                sums, rows = {}, 0
                for b in run(iter(batches)):
                    for cell, y, w, s in zip(*[c.to_pylist() for c in b.columns]):
                        rows += 1
                        sums[cell, y] = tuple(np.add(sums.get((cell, y), (0, 0)), (w, s)))
                got.append(sums)
                assert limit == 0 or rows == len(sums)
            monkeypatch.undo()
        assert got[0] == got[2] and got[1] == got[3]
