import numpy as np
import pytest
from pyspark.sql import functions as F

from twinloom.operators import generate as G, graph, prepare, text as X


def people(spark, n=600, seed=0):
    """A class that holds two thirds of the rows, and a rare one."""
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c = "big" if r.random() < 0.67 else ("mid" if r.random() < 0.9 else "rare")
        rows.append((i, c, float(np.round(r.normal() + (3 if c == "mid" else 0), 2)), int(r.integers(20, 60)), "xyz"[int(r.integers(3))] if r.random() < 0.9 else None))
    return spark.createDataFrame(rows, "id long, cls string, v double, age int, t string")


def test_scaler_roundtrip_and_flat_column(spark):
    df = people(spark).withColumn("flat", F.lit(7.0))
    sc = prepare.Scaler.fit(df, ["v", "flat"])
    out = sc.transform(df)
    s = out.agg(F.avg("v"), F.stddev_pop("v"), F.max(F.abs("flat"))).first()
    assert s[0] == pytest.approx(0, abs=1e-9) and s[1] == pytest.approx(1) and s[2] == 0
    assert sc.inverse(out).join(df.select("id", F.col("v").alias("w")), "id").where(F.abs(F.col("v") - F.col("w")) > 1e-9).count() == 0


def test_large_vocabulary_codes(spark, monkeypatch):
    df = people(spark)
    small = {r.value: r.code for r in prepare.label_codes(df, "t").collect()}
    monkeypatch.setattr(prepare, "SMALL_VOCABULARY", 1)
    assert {r.value: r.code for r in prepare.label_codes(df, "t").collect()} == small == {"x": 0, "y": 1, "z": 2}


def test_decode_clips(spark):
    codes = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "value string, code long")
    df = spark.createDataFrame([(-3.0,), (0.5,), (1.5,), (9.0,)], "y double")
    assert [r.y for r in prepare.label_decode(df, "y", codes).collect()] == ["a", "a", "c", "c"]


def test_one_hot_lookalike(spark):
    df = spark.createDataFrame([(1, 0, 5, 1), (0, 1, 6, 0)], "c_a int, c_b int, d_a int, d_b int")
    assert [(r.prefix, r.members) for r in prepare.one_hot_groups(df).collect()] == [("c", ["c_a", "c_b"])]
    assert [r.c for r in prepare.one_hot_collapse(df, {"c": ["c_a", "c_b"]}).orderBy("d_a").collect()] == ["a", "b"]
    text = df.withColumn("c_z", F.lit("q"))
    assert prepare.one_hot_groups(text).count() == 0


def test_balanced_counts(spark):
    df = people(spark)
    n = {r.cls: r["count"] for r in df.groupBy("cls").count().collect()}
    per = df.count() // 3
    got = {r.cls: r["count"] for r in prepare.balance_classes(df, "cls", "id").groupBy("cls").count().collect()}
    assert got == {c: min(per, 4 * k) for c, k in n.items()}
    thin = prepare.balance_classes(df, "cls", "id").where("cls = 'big'")
    assert thin.select("id").distinct().count() == thin.count()


def test_rows_without_a_class_are_not_drawn(spark):
    df = people(spark)
    some = df.unionByName(df.withColumn("cls", F.lit(None).cast("string")))
    count = lambda d: {r.cls: r["count"] for r in prepare.balance_classes(d, "cls", "id").groupBy("cls").count().collect()}
    assert count(some) == count(df) and None not in count(some)


def test_a_word_of_every_text(spark, monkeypatch):
    """Frequent terms go the broadcast way: the same weights, and no join key with a row per text."""
    texts = [f"everywhere word{i % 50} word{i % 7} rare{i}" for i in range(400)] + [None, "", "everywhere everywhere"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {(r["id"], r["term"]): r["weight"] for r in X.tfidf(df, "id", "text").collect()}
    monkeypatch.setattr(X, "HEAVY_TEXTS", 100)
    monkeypatch.setattr(X, "HEAVY_PARTS", 10)
    split = X.tfidf(df, "id", "text")
    assert "BroadcastHashJoin" in split._jdf.queryExecution().executedPlan().toString()
    got = {(r["id"], r["term"]): r["weight"] for r in split.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_wide_values_are_not_broadcast(spark):
    df = spark.createDataFrame([(i, f"{i % 30}" + "x" * 3000) for i in range(60)], "id long, t string")
    held = G.Intervals.fit(df, ["t"])
    assert held.sizes["t"][0] == 30 and held.sizes["t"][1] >= 3000


def test_splits(spark):
    s = prepare.split_stratified(people(spark), "id", "cls")
    for r in s.groupBy("cls").agg(F.avg((F.col("part") == "train").cast("double")).alias("f"), F.count("*").alias("n")).collect():
        assert abs(r.f - 0.7) <= 1 / r.n + 1e-9


def test_enforce_and_restore(spark):
    df = people(spark)
    out = prepare.enforce(df.select("id", F.lit("9").alias("age"), F.lit(1).alias("stray")), df)
    assert out.dtypes == df.dtypes
    row = out.first()
    assert (row.cls, row.v, row.age, row.t) == ("", 0.0, 9, "")
    fitted = prepare.Ranges.fit(df, ["v", "age"])
    got = fitted.restore(spark.createDataFrame([(1e9, 30.5), (-1e9, 31.5)], "v double, age double")).orderBy("age").collect()
    lim = df.agg(F.min("v"), F.max("v")).first()
    assert [(r.v, r.age) for r in got] == [(lim[1], 30), (lim[0], 32)]


def test_compress_only_when_wide(spark):
    df = people(spark)
    assert prepare.compress_wide(df, ["id"]).columns == df.columns
    assert prepare.compress_wide(df.select("id", "v", "age"), ["id"], trigger=1, components=2).columns == ["id", "components"]


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_rows_do_not_depend_on_partitions(spark):
    df = people(spark)
    make = {
        "numeric": lambda: G.gen_numeric(df, ["v", "age"], 200), "categorical": lambda: G.gen_categorical(df, ["cls", "t"], 200),
        "conditional": lambda: G.gen_conditional(df, G.gen_labels(df, "cls", 200), "cls", ["v", "age"], ["t"]),
        "bootstrap": lambda: G.gen_bootstrap(df, "id", [], ["t", "cls"], 200), "balance": lambda: prepare.balance_classes(df, "cls", "id"),
    }
    wide = {k: rows_of(f()) for k, f in make.items()}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        for k, f in make.items():
            assert rows_of(f()) == wide[k], k
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_generated_values_stay_in_range_and_follow_frequencies(spark):
    df = people(spark)
    g = G.gen_numeric(df, ["v", "age"], 2000)
    a, b = df.agg(F.min("v"), F.max("v"), F.avg("v")).first(), g.agg(F.min("v"), F.max("v"), F.avg("v")).first()
    assert a[0] <= b[0] and b[1] <= a[1] and abs(a[2] - b[2]) < 0.2
    real = {r.cls: r["count"] / 600 for r in df.groupBy("cls").count().collect()}
    fake = {r.cls: r["count"] / 4000 for r in G.gen_labels(df, "cls", 4000).groupBy("cls").count().collect()}
    assert all(abs(real[k] - fake.get(k, 0)) < 0.03 for k in real)


def test_correlation_is_kept(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=500)
    df = spark.createDataFrame([(i, float(v), float(v * 2 + e), 5.0) for i, (v, e) in enumerate(zip(x, r.normal(size=500)))], "id long, x double, y double, flat double")
    want = df.agg(F.corr("x", "y")).first()[0]
    g = G.gen_correlated(df, ["x", "y", "flat"], 3000)
    assert g.agg(F.corr("x", "y")).first()[0] == pytest.approx(want, abs=0.05)
    assert g.agg(F.max(F.abs(F.col("flat") - 5))).first()[0] < 1e-9
    c = G.gen_copula(df, ["x", "y"], 500)
    assert sorted(r.x for r in c.collect()) == sorted(float(v) for v in x)
    assert c.agg(F.corr("x", "y")).first()[0] == pytest.approx(want, abs=0.12)


def test_text(spark):
    body = "This is the first long sentence of it. And here comes another sentence! Does a third sentence follow here? Short."
    docs = spark.createDataFrame([(1, body, "a"), (2, body.replace("first", "only"), "a"), (3, None, "b"), (4, "tiny", "b")], "id long, text string, cls string")
    pool = X.sentence_pool(docs, "id", "text", "cls")
    assert pool.count() == 6 and sorted(r.rn for r in pool.collect()) == [1, 2, 3, 4, 5, 6]
    out = X.gen_text(docs, "id", "text", "cls", 40).collect()
    assert len(out) == 40
    for r in out:
        if r.cls == "a":
            assert 3 <= r.n_sentences <= 5
        else:
            assert r.n_sentences == 0 and X.FALLBACK[0] in r.text


def test_graph(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "id long, v double")
    e = graph.sequence_edges(df, "id", "id")
    assert sorted((r.src, r.dst) for r in e.collect()) == sorted([(i, i + 1) for i in range(4)] + [(i + 1, i) for i in range(4)])
    got = {r.id: r.v for r in graph.neighbour_mean(df, e, "id", ["v"]).collect()}
    assert got == {0: 0.5, 1: 1.0, 2: 2.0, 3: 3.0, 4: 3.5}


def test_ensemble_prefers_the_closer_candidate(spark):
    df = people(spark)
    near = G.gen_categorical(df, ["cls"], 300)
    far = near.withColumn("cls", F.lit("rare"))
    assert rows_of(G.blend_categorical(df, far, near, ["cls"])) == rows_of(near)
    num = G.gen_numeric(df, ["v"], 300)
    off = num.withColumn("v", F.col("v") + 100)
    mixed = G.blend_numeric(df, num, off, ["v"])
    assert mixed.agg(F.avg("v")).first()[0] < num.agg(F.avg("v")).first()[0] + 20


def test_tfidf_deals_texts_not_pairs(spark, monkeypatch):
    """Pairs are counted where their text is: the one exchange before the count is by key, of texts."""
    plans, whole = [], X.cut
    monkeypatch.setattr(X, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or whole(df))
    docs = spark.createDataFrame([(1, "red red fish"), (1, "red cat"), (None, "blue fish"), (2, None)], "k long, t string")
    got = {(r["k"], r["term"]) for r in X.tfidf(docs, "k", "t").collect()}
    assert got == {(1, "red"), (1, "fish"), (1, "cat"), (None, "blue"), (None, "fish")}
    assert plans[0].count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_COL" in plans[0]


def test_a_normal_draw_is_made_once(spark):
    """The digest of a draw stands in the plan twice, once for each of its slots, however often the draw is compared."""
    df = people(spark)
    out = G.gen_conditional(df, G.gen_labels(df, "cls", 50), "cls", ["v", "age"], ["t"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f":{c}/z:42") for c in ("v", "age")] == [2, 2]
    for c in ("v", "age"):  # and the drawn values are those of the formula, kept inside the range of the class
        assert dict(out.dtypes)[c] == "double"
    ranges = {r["cls"]: r for r in df.groupBy("cls").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    assert all(ranges[r["cls"]]["lo"] <= r["v"] <= ranges[r["cls"]]["hi"] for r in out.where("v is not null").collect())
