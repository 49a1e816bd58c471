import numpy as np
import pytest
from pyspark.sql import functions as F

from twinloom.operators import attacks, proximity, utility


def frame(spark, m):
    return spark.createDataFrame([(x.tolist(),) for x in m], "x array<double>")


@pytest.mark.parametrize("d,page", [(1, 40), (2, 16), (5, 32), (10, 1024), (30, 50)])
def test_index_against_brute_force(spark, d, page):
    r = np.random.default_rng(d)
    q = np.round(r.normal(size=(400, d)), 2)
    ref = np.round(r.normal(size=(600, d)), 2)
    ref[:200] = 0.25  # a third of the reference is one point
    q[:150] = 0.3
    cols = [F.col("x")[i] for i in range(d)]
    index = proximity.build(proximity.as_points(frame(spark, ref), cols), d, page)
    points = proximity.as_points(frame(spark, q), cols)
    radius = 0.5 * d**0.5
    dist = np.sqrt(((q[:, None, :] - ref[None]) ** 2).sum(-1))
    near = {tuple(x.x): x.distance for x in proximity.nearest(points, index).collect()}
    close = {tuple(x.x): x.close for x in proximity.count_within(points, index, radius).collect()}
    for i, x in enumerate(q):
        assert near[tuple(x.tolist())] == pytest.approx(dist[i].min(), abs=1e-12)
        assert min(close[tuple(x.tolist())], 2) == min((dist[i] < radius).sum(), 2)


def test_queries_meet_few_leaves(spark):
    """A walk finds just the leaves within reach, and what is listed does not grow with the number of leaves."""
    r = np.random.default_rng(3)
    x, q = r.normal(size=(4000, 3)), r.normal(size=(500, 3))
    per_query = []
    for page in (500, 50):
        index = proximity.build(proximity.as_points(frame(spark, x), [F.col("x")[i] for i in range(3)]), 3, page)
        lo, hi, w = (v[index.tree.inner :] for v in index.tree.parts[0])
        assert w.sum() == 4000
        best = ((q[:, None] - x[None]) ** 2).sum(-1).min(axis=1) * 1.0001
        row, leaf, near = index.tree.within(q, 0, best)
        box = proximity.near2(q, lo, hi)
        assert sorted(zip(row, leaf)) == sorted(zip(*np.nonzero(box < best[:, None])))
        assert (near == box[row, leaf]).all()
        sure, row, leaf, _ = index.tree.touched(q, 0, 0.3, 10**9)
        far = proximity.far2_to(np.repeat(q, len(lo), axis=0), np.tile(lo, (len(q), 1)), np.tile(hi, (len(q), 1))).reshape(len(q), -1)
        assert (sure == (np.sqrt(far) < 0.3) @ w).all()
        assert sorted(zip(row, leaf)) == sorted(zip(*np.nonzero((np.sqrt(box) < 0.3) & ~(np.sqrt(far) < 0.3))))
        per_query.append(len(index.tree.within(q, 0, best)[0]) / len(q))
    assert max(per_query) < 5


def test_no_reference_points(spark):
    assert proximity.build(proximity.as_points(frame(spark, np.zeros((0, 2))), [F.col("x")[0], F.col("x")[1]]), 2) is None


def people(spark, synth_rows, real_rows):
    rows = [("real", str(i), *map(float, x)) for i, x in enumerate(real_rows)] + [("synth", None, *map(float, x)) for x in synth_rows]
    return spark.createDataFrame(rows, "side string, key string, a double, b double")


def test_copied_train_rows_are_noticed(spark):
    r = np.random.default_rng(0)
    real = r.normal(size=(300, 2))
    honest = people(spark, r.normal(size=(300, 2)), real)
    before = attacks.mia(honest, "key", ["a", "b"]).first()
    split = honest.where("side = 'real'").withColumn("tr", attacks.rng.uniform("key", "holdout") < 0.6)
    copied = [(x.a, x.b) for x in split.where("tr").collect()]
    after = attacks.mia(people(spark, copied, real), "key", ["a", "b"]).first()
    assert after["privacy_score"] < before["privacy_score"]
    assert after["attack_success"] == 1.0 and after["train_median"] == 0.0


def test_attacks_without_numbers_are_neutral(spark):
    p = spark.createDataFrame([("real", "1", "x"), ("synth", None, "y")], "side string, key string, t string")
    assert attacks.mia(p, "key", []).first()["privacy_score"] == 0.95
    assert attacks.mia_fast(p, "key", []).first()["score"] == 0.8
    assert attacks.singling_out(p, []).first()["safety_score"] == 1.0
    assert utility.attribute_leak(p, "t").first()["safety_score"] == 1.0


def test_missing_numbers(spark):
    p = spark.createDataFrame([("real", "1", 1.0, None), ("real", "2", 2.0, 3.0), ("real", "3", 2.5, 1.0), ("synth", None, 1.0, None), ("synth", None, 2.0, 3.0)], "side string, key string, a double, b double")
    assert attacks.nearest_distance(p, "key", ["a", "b"]).count() == 2
    assert attacks.singling_out(p, ["a", "b"]).first()["n_checked"] == 2


def test_leak_curve_and_lift_curve(spark):
    row = spark.range(1).select(
        attacks.leak_curve(F.lit(0.8), F.lit(0.8)).alias("none"), attacks.leak_curve(F.lit(0.9), F.lit(0.5)).alias("all"),
        utility.lift_curve(F.lit(1.0), F.lit(0.5)).alias("top"), utility.lift_curve(F.lit(0.5), F.lit(0.5)).alias("base")).first()
    assert row["none"] == 1 and row["all"] == 0
    assert row["top"] == pytest.approx(1, abs=1e-5) and row["base"] == pytest.approx(0.4, abs=1e-5)


def test_forest_scores(spark):
    r = np.random.default_rng(4)
    rows = []
    for side in ("real", "synth"):
        for _ in range(150):
            x = float(r.normal())
            rows.append((side, x, float(r.normal()), "hi" if x > 0 else "lo"))
    p = spark.createDataFrame(rows, "side string, a double, b double, y string")
    assert utility.tstr_classification(p, "y", trees=10, depth=4).first()["score"] > 0.9
    assert utility.attribute_leak(p, "y", trees=10, depth=4).first()["safety_score"] == 0.0
    assert utility.tstr_fast(p, "y").first()["score"] > 0.8
    assert utility.tstr_regression(p.withColumn("z", F.col("a") * 3), "z", trees=5, depth=5).first()["score"] > 0.9
    assert utility.tstr(p, None).first()["score"] == 0.5
    one = p.where("side = 'real' or y = 'hi'")
    assert utility.tstr_classification(one, "y", trees=2).first()["score"] == 0.5
