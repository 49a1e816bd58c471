import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinloom.functions import pairs
from twinloom.operators import causal, compare, profile, temporal

SCHEMA = "side string, id long, x double, y double, k int, t string"


def table(spark, shift=0.0, n=300, seed=0, both=True):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = float(r.normal())
        y = float(2 * x + r.normal())
        row = (i, x, y, int(r.integers(4)), "abc"[int(r.integers(3))])
        rows.append(("real", *row))
        if both:
            rows.append(("synth", row[0], row[1] + shift, row[2], row[3], row[4]))
    return spark.createDataFrame(rows, SCHEMA)


def test_identical_sides(spark):
    p = table(spark)
    for r in compare.cdf_distances(p, ["x", "y", "k"]).collect():
        assert r["ks"] == 0 and r["w1"] == 0
    assert all(r["distance"] == pytest.approx(0, abs=1e-7) for r in compare.jsd_binned(p, ["x", "y"]).collect())
    assert all(r["distance"] == pytest.approx(0, abs=1e-7) for r in compare.jsd_categorical(p, ["t", "k"]).collect())
    assert all(r["score"] == 1 for r in compare.chi_square(p, ["t"]).collect())
    assert compare.corr_similarity(p, ["x", "y"]).first()["score"] == 1
    assert compare.realism(p).first()["realism"] == pytest.approx(1)
    assert causal.correlation_fidelity(p, cols=["x", "y", "k"]).first()["score"] == 1
    assert causal.edge_f1(causal.causal_skeleton(p, cols=["x", "y", "k"])).first()["score"] == 1
    assert profile.diversity(p, ["x", "y"]).first()["diversity"] == pytest.approx(1, abs=1e-5)


def test_distances_grow_with_the_shift_and_are_symmetric(spark):
    seen = []
    for shift in (0.0, 0.5, 1.5):
        p = table(spark, shift)
        r = compare.cdf_distances(p, ["x"]).first()
        flipped = p.withColumn("side", F.when(F.col("side") == "real", "synth").otherwise("real"))
        q = compare.cdf_distances(flipped, ["x"]).first()
        assert r["ks"] == pytest.approx(q["ks"]) and r["w1"] == pytest.approx(q["w1"])
        assert r["w1"] == pytest.approx(shift, abs=1e-9)
        seen.append(r["ks"])
    assert seen[0] < seen[1] < seen[2] <= 1


def test_disjoint_categories_reach_the_floor(spark):
    p = spark.createDataFrame([("real", "a"), ("real", "b"), ("synth", "c")], "side string, t string")
    assert compare.jsd_categorical(p, ["t"]).first()["score"] == pytest.approx(1 - math.sqrt(math.log(2)), abs=1e-5)


def test_constant_and_missing_columns(spark):
    p = spark.createDataFrame([("real", 5.0, None), ("real", 5.0, None), ("synth", 5.0, None), ("synth", 5.0, None)], "side string, c double, n double")
    assert compare.wasserstein(p, ["c", "n"]).count() == 0
    assert {r["column"]: r["score"] for r in compare.wasserstein_range(p, ["c", "n"]).collect()} == {"c": 1.0}
    assert {r["column"]: round(r["score"], 6) for r in compare.jsd_binned(p, ["c", "n"]).collect()} == {"c": 1.0}
    rho = {(r["a"], r["b"]): r["rho"] for r in compare.correlations(p, ["c"], ["side"]).collect()}
    assert rho == {("c", "c"): 0.0}


def test_neutral_when_nothing_applies(spark):
    p = spark.createDataFrame([("real", True), ("synth", False)], "side string, b boolean")
    assert compare.realism(p).first()["realism"] == 0.5
    assert causal.correlation_fidelity(p, cols=[]).first()["score"] == 0.8


def test_empty_pair(spark):
    p = spark.createDataFrame([], SCHEMA)
    assert compare.ks(p, ["x"]).count() == 0
    assert compare.chi_square(p, ["t"]).count() == 0
    assert compare.distributional(p, ["x"]).first()["distributional"] == 0.5


def test_columns_are_shared_by_name(spark):
    a = spark.createDataFrame([(1.0, "x")], "v double, only_real string")
    b = spark.createDataFrame([(2.0, 3)], "v double, only_synth int")
    assert pairs.make_pair(a, b).columns == ["side", "v"]


def test_markov_of_identical_sides_is_one(spark):
    p = table(spark)
    r = temporal.markov_score(p, "x", "id").first()
    assert r["method"] == "markov" and r["score"] == pytest.approx(1)


def test_markov_falls_back_on_short_series(spark):
    p = table(spark, n=20)
    r = temporal.markov_score(p, "x", "id").first()
    assert r["method"] == "autocorrelation" and r["score"] == pytest.approx(1)


def test_autocorr_matches_numpy(spark):
    r = np.random.default_rng(2)
    v = np.cumsum(r.normal(size=400))
    p = spark.createDataFrame([("real" if s == 0 else "synth", i, float(v[i])) for s in (0, 1) for i in range(400)], "side string, id long, v double")
    got = temporal.autocorr(p, "id", ["v"]).first()
    assert got["ac_real"] == pytest.approx(np.corrcoef(v[:-1], v[1:])[0, 1])
    assert got["score"] == pytest.approx(1)


def test_wide_moments_match_narrow_ones(spark, monkeypatch):
    import twinloom.functions.moments as m

    p = table(spark, 0.4)
    read = lambda: {(r["side"], r["a"], r["b"]): r["rho"] for r in compare.correlations(p, ["x", "y", "k"], ["side"]).collect()}
    narrow = read()
    monkeypatch.setattr(m, "WIDE", 1)
    wide = read()
    assert narrow.keys() == wide.keys() and all(narrow[k] == pytest.approx(wide[k]) for k in narrow)


def brute_skeleton(x, cols):
    """Level-wise search with partial correlations from regression residuals."""
    from itertools import combinations

    n, d = x.shape

    def parts(a, b, s):
        z = np.column_stack([np.ones(n), *[x[:, k] for k in s]])
        r = [x[:, c] - z @ np.linalg.lstsq(z, x[:, c], rcond=None)[0] for c in (a, b)]
        rho = float(np.clip(r[0] @ r[1] / math.sqrt((r[0] @ r[0]) * (r[1] @ r[1])), -1 + 1e-12, 1 - 1e-12))
        return abs(math.atanh(rho)) * math.sqrt(max(n - len(s) - 3, 1)) <= causal.NORMAL_975

    beside = {i: set(range(d)) - {i} for i in range(d)}
    orders = []
    for order in range(d - 1):
        still = {i: set(s) for i, s in beside.items()}
        for a in range(d):
            for b in still[a]:
                if any(parts(a, b, s) for s in combinations(sorted(still[a] - {b}), order)):
                    beside[a].discard(b)
                    beside[b].discard(a)
        orders.append(sum(map(len, beside.values())) // 2)
    return {(cols[a], cols[b]) for a in beside for b in beside[a] if a < b}, orders


@pytest.mark.parametrize("seed,d", [(0, 3), (1, 5), (2, 8), (3, 8)])
def test_skeleton_of_every_order(spark, seed, d):
    r = np.random.default_rng(seed)
    x = r.normal(size=(400, d))
    for j in range(1, d):
        for i in range(j):
            if r.random() < 0.6:
                x[:, j] += r.normal() * x[:, i]
    cols = [f"c{i}" for i in range(d)]
    want, orders = brute_skeleton(x, cols)
    rows = [("real", *map(float, v)) for v in x] + [("synth", *map(float, v)) for v in x[::-1]]
    df = spark.createDataFrame(rows, "side string, " + ", ".join(f"{c} double" for c in cols))
    got = causal.causal_skeleton(df, cols=cols).collect()
    for side in ("real", "synth"):
        assert {(g["a"], g["b"]) for g in got if g["side"] == side} == want
    if d == 8:
        assert orders[2] > orders[-1] or orders[1] > orders[2]  # sets of more than one column decide something


def test_skeleton_without_an_inverse(spark):
    """A column that is the sum of others, and one that repeats another: no crash, the same edges twice."""
    r = np.random.default_rng(7)
    x = r.normal(size=(200, 4))
    x = np.column_stack([x, x[:, 0] + x[:, 1], x[:, 2]])
    cols = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame([(s, *map(float, v)) for s in ("real", "synth") for v in x], "side string, " + ", ".join(f"{c} double" for c in cols))
    seen = [sorted(map(tuple, causal.causal_skeleton(df, cols=cols).collect())) for _ in range(2)]
    assert seen[0] == seen[1]
    assert {(a, b) for s, a, b in seen[0] if s == "real"} == {(a, b) for s, a, b in seen[0] if s == "synth"}
