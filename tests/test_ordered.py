import numpy as np
import pytest
from pyspark.sql import functions as F

from twinloom.functions import ordered, pairs
from twinloom.operators import compare


def skewed(seed=3, n=4000):
    """A third of all values are equal, the rest has a long tail."""
    r = np.random.default_rng(seed)
    v = np.round(np.exp(r.normal(size=n) * 3), 2)
    v[: n // 3] = 1.0
    r.shuffle(v)
    return v


@pytest.mark.parametrize("slices", [2, 7, 64])
def test_running_sum_and_rank(spark, slices):
    v = skewed()
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id long, v double")
    s = ordered.with_value_slice(df, "v", slices).withColumn("one", F.lit(1))
    got = {r.id: (r.total, r.rn) for r in ordered.cumulate(s, [], ["v", "id"], {"total": "v", "rn": "one"}).collect()}
    order = np.lexsort((np.arange(len(v)), v))
    sums = np.cumsum(v[order])
    for place, i in enumerate(order):
        assert got[int(i)][1] == place + 1
        assert got[int(i)][0] == pytest.approx(sums[place], rel=1e-9)


@pytest.mark.parametrize("slices", [2, 9, 50])
def test_quantiles_match_numpy(spark, slices):
    v = skewed(5)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.733, "e": 1.0}
    row = ordered.exact_quantiles(df, "v", probs, slices=slices).first()
    for k, p in probs.items():
        assert row[k] == pytest.approx(np.percentile(v, p * 100), rel=1e-12)


@pytest.mark.parametrize("slices", [2, 11])
def test_next_row_within_groups(spark, slices):
    r = np.random.default_rng(1)
    rows = [(int(i), "hot" if r.random() < 0.4 else f"g{r.integers(30)}", float(r.normal())) for i in range(1500)]
    df = spark.createDataFrame(rows, "t long, g string, v double")
    got = {x.t: x.next_v for x in ordered.with_next(df, "t", ["v"], ["g"], slices).collect()}
    for g in {x[1] for x in rows}:
        mine = sorted(x for x in rows if x[1] == g)
        for a, b in zip(mine, [*mine[1:], None]):
            assert got[a[0]] == (b[2] if b else None)


def test_next_keeps_missing_values_apart_from_the_end(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "t long, v double")
    got = {r.t: (r.has_next, r.next_v) for r in ordered.with_next(df, "t", ["v"]).collect()}
    assert got == {1: (True, None), 2: (True, 3.0), 3: (False, None)}


def test_cdf_does_not_depend_on_slices(spark):
    v = skewed(8, 2000)
    df = spark.createDataFrame([("real" if i % 3 else "synth", float(x)) for i, x in enumerate(v)], "side string, v double")
    seen = {n: compare.cdf_distances(df, ["v"], n).first() for n in (2, 5, 40)}
    assert seen[2]["ks"] == seen[5]["ks"] == seen[40]["ks"]
    assert seen[2]["w1"] == pytest.approx(seen[40]["w1"], rel=1e-12)


def test_range_slice_ranks_text(spark):
    words = [f"w{i:04d}" for i in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "v string").withColumn("one", F.lit(1))
    s = ordered.with_range_slice(df, "v")
    got = {r.v: r.rn for r in ordered.cumulate(s, [], ["v"], {"rn": "one"}).collect()}
    assert got == {w: i + 1 for i, w in enumerate(words)}


def test_nan_is_missing(spark):
    df = spark.createDataFrame([("real", float("nan")), ("real", 1.0), ("synth", 1.0)], "side string, v double")
    assert pairs.numeric_view(df, ["v"]).where("v is null").count() == 1


@pytest.mark.parametrize("slices", [8, 30])
def test_ties_are_sliced_by_the_tie_column(spark, slices):
    v = skewed(9, 1500)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id long, v double")
    got = {r.id: r.rn for r in ordered.rank_by_value(df, "v", "id", slices=slices).collect()}
    for place, i in enumerate(np.lexsort((np.arange(len(v)), v))):
        assert got[int(i)] == place + 1
    s = ordered.with_value_slice(df, "v", slices, "id")
    largest = s.groupBy(ordered.SLICE).count().agg(F.max("count")).first()[0]
    assert largest < len(v) / 3
    nxt = {r.id: r.next_id for r in ordered.with_next(df, "v", ["id"], slices=slices, tie="id").collect()}
    order = [int(i) for i in np.lexsort((np.arange(len(v)), v))]
    assert all(nxt[a] == b for a, b in zip(order, [*order[1:], None]))
