import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinloom.operators import ledger as L
from twinloom.operators.roles import Contract
from twinloom.plans import release as P
from twinloom.sources import logs, registry, tables as T
from twinloom.streaming import ledger as stream


def table(spark, n=240):
    r = np.random.default_rng(0)
    rows = [(i, float(np.round(r.normal() * 10, 1)), float(np.round(r.normal(), 2)), int(r.integers(5)), "yes" if r.random() < 0.4 else "no") for i in range(n)]
    return spark.createDataFrame(rows, "id long, amount double, score double, grade int, outcome string")


@pytest.mark.parametrize("modality,temporal", [("tabular", False), ("graph", True)])
def test_release_writes_its_records(spark, tmp_path, modality, temporal):
    c = Contract("demo", "outcome", modality, is_temporal=temporal)
    out = P.release(table(spark), c, "id", str(tmp_path), sweep_trials=0, trees=5)
    r = out.first()
    assert 0 <= r["reward"] <= 1 and 0 <= r["privacy"] <= 1
    assert r["published"] == (not r["forced"])
    assert (r["temporal"] is not None) == temporal
    audit = spark.read.json(f"{tmp_path}/audit").first()
    assert audit["dataset"] == "demo" and audit["model"] == r["model"]
    assert logs.load_archive(spark, f"{tmp_path}/archive").count() == r["attempts"]
    assert logs.load_meta(spark, f"{tmp_path}/meta").count() == r["attempts"]
    if r["published"]:
        doc = json.loads(spark.read.text(f"{tmp_path}/receipts").first()[0])
        back = T.read_csv(spark, doc["outputFile"]["path"], table(spark).schema)
        assert T.table_digest(back).first()["digest"] == doc["outputFile"]["sha256"] == r["digest"]
        assert back.columns == table(spark).columns
        q = stream.follow(stream.entries(spark, f"{tmp_path}/ledger"), f"spend_{modality}", f"{tmp_path}/ck")
        q.processAllAvailable()
        q.stop()
        assert spark.table(f"spend_{modality}").first()["consumed"] == pytest.approx(r["epsilon"])


def test_exhausted_budget_stops_the_release(spark, tmp_path):
    spent = spark.createDataFrame([(1, "x", "spend", 9.0)], "seq long, dataset string, kind string, epsilon double")
    with pytest.raises(L.BudgetExhausted):
        P.release(table(spark), Contract("demo", "outcome"), "id", str(tmp_path), ledger=spent)


GOOD = dict(privacy=0.9, mia=0.9, singling=0.9, leak=0.9, utility=0.9, realism=0.9, diversity=0.9, causal=0.9, temporal=None)


def test_a_second_release_reads_what_the_first_wrote(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "evaluate", lambda *a: GOOD)  # the records are the matter here
    real = table(spark, 120).withColumns({"day": F.expr("timestamp'2024-01-01' + make_interval(0,0,0,cast(id % 9 as int))"), "flag": F.col("id") % 3 == 0, "name": F.concat(F.lit("n"), F.col("id") % 5)})
    c, path = Contract("demo", "outcome", "tabular", discrete=("outcome",)), str(tmp_path)
    first = P.release(real, c, "id", path, sweep_trials=0).first()
    ledger = L.load(spark, f"{path}/ledger")
    assert L.remaining(ledger).first()["consumed"] == pytest.approx(first["epsilon"])
    written = T.read_csv(spark, json.loads(spark.read.text(f"{path}/receipts").first()[0])["outputFile"]["path"], real.schema)
    assert written.where("day is null or flag is null or name is null").count() == 0 and written.select("day").distinct().count() > 1
    held = logs.load_history(spark, f"{path}/archive")
    assert held.select("seq").distinct().count() == first["attempts"] == held.where("n_rows = 120 and model <> ''").count()
    second = P.release(real, c, "id", path, sweep_trials=0).first()
    assert L.remaining(L.load(spark, f"{path}/ledger")).first()["consumed"] == pytest.approx(first["epsilon"] + second["epsilon"])
    assert logs.load_history(spark, f"{path}/archive").count() == first["attempts"] + second["attempts"]
    spark.createDataFrame([("demo", 99.0)], "dataset string, epsilon double").transform(lambda d: L.append(d, f"{path}/ledger") or d)
    with pytest.raises(L.BudgetExhausted):
        P.release(real, c, "id", path)
    L.reset(spark, f"{path}/ledger")
    assert L.remaining(L.load(spark, f"{path}/ledger")).first()["consumed"] == 0
    assert logs.load_history(spark, f"{path}/none") is None and L.load(spark, f"{path}/none").count() == 0
    q = stream.publish(stream.entries(spark, f"{path}/ledger"), f"{path}/totals", f"{path}/ck2")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{path}/totals").first()["entries"] == 3


def entry(spark, epsilon, name="demo"):
    return spark.createDataFrame([(name, float(epsilon))], "dataset string, epsilon double")


def test_reservations_between_write_and_read(spark, tmp_path, monkeypatch):
    """The other writer comes in just before we look: whoever is refused, the total holds and refusals leave no trace."""
    path, load = str(tmp_path / "ledger"), L.load
    L.reserve(entry(spark, 4), path, 10.0)
    other = []

    def interrupted(s, p):
        monkeypatch.setattr(L, "load", load)
        try:
            other.append(L.reserve(entry(spark, 5, "other"), path, 10.0))
        except L.BudgetExhausted:
            other.append(None)
        return load(s, p)

    monkeypatch.setattr(L, "load", interrupted)
    mine = L.reserve(entry(spark, 5, "mine"), path, 10.0)  # it was written first, so the other one sees it and gives way
    left = {r["dataset"]: r["consumed"] for r in L.by_dataset(load(spark, path)).collect()}
    assert mine and other == [None] and left == {"demo": 4.0, "mine": 5.0}


def test_parallel_reservations_never_exceed_the_total(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "ledger")

    def one(i):
        try:
            return L.reserve(entry(spark, 3, f"d{i}"), path, 10.0)
        except L.BudgetExhausted:
            return None

    with ThreadPoolExecutor(6) as pool:
        claims = [c for c in pool.map(one, range(6)) if c]
    used = L.remaining(L.load(spark, path), 10.0).first()["consumed"]
    assert used == 3.0 * len(claims) <= 10.0
    L.withdraw(spark, path, claims[0]) if claims else None
    L.withdraw(spark, path, claims[0]) if claims else None
    assert L.remaining(L.load(spark, path), 10.0).first()["consumed"] == max(0.0, used - 3.0)
    L.reset(spark, path)
    assert L.remaining(L.load(spark, path), 10.0).first()["consumed"] == 0.0
    L.withdraw(spark, path, claims[-1]) if claims else None  # after a reset: gives nothing back twice
    assert L.remaining(L.load(spark, path), 10.0).first()["consumed"] == 0.0


def test_a_release_that_no_longer_fits_publishes_nothing(spark, tmp_path, monkeypatch):
    total = L.fixed.PRIVACY_BUDGET

    def judged(*a):  # while we judge, another release spends nearly everything
        L.append(entry(spark, total - 1e-3, "other"), f"{tmp_path}/ledger")
        return GOOD

    monkeypatch.setattr(P, "evaluate", judged)
    with pytest.raises(L.BudgetExhausted):
        P.release(table(spark, 120), Contract("demo", "outcome", "tabular", discrete=("outcome",)), "id", str(tmp_path), sweep_trials=0)
    assert L.remaining(L.load(spark, f"{tmp_path}/ledger")).first()["consumed"] == pytest.approx(total - 1e-3)
    assert not list(tmp_path.glob("synthetic_output_*")) and not (tmp_path / "receipts").exists()


def test_a_release_sweeps_with_the_generator_of_its_attempt(spark, tmp_path, monkeypatch):
    asked, swept, plain = [], [], P.sweep

    def noted(*a):
        asked.append(a)
        swept.append(plain(*a))
        return swept[-1]

    monkeypatch.setattr(P, "evaluate", lambda *a: GOOD)
    monkeypatch.setattr(P, "sweep", noted)
    r = P.release(table(spark, 120), Contract("demo", "outcome"), "id", str(tmp_path), sweep_trials=2).first()
    assert len(asked) == r["attempts"] == 1 and asked[0][5] == 2 and asked[0][6] is P.GENERATORS[r["model"]]
    assert swept[0].count() == 2 and r["epsilon"] == swept[0].where("best").first()["epsilon"]


def test_the_report_is_a_whole_release(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(P, "release", lambda *a, **k: asked.append((a, k)))
    P.report(spark, "/root/testdata/sf0.001")
    assert len(asked[0][0]) == 4 and not asked[0][1]


@pytest.mark.parametrize("key", ["tabddpm", "ctgan", "gnn", "diffusion", "ensemble"])
def test_every_generator_fills_the_schema(spark, key):
    real = table(spark, 120)
    roles, _ = P.roles_of(real, Contract("demo", "outcome", "tabular"), "id")
    out = P.finish(real, P.GENERATORS[key](real, roles, 1.0, 120), roles)
    assert out.dtypes == real.dtypes
    assert out.where("outcome is null or amount is null").count() == 0
    lim = real.agg(F.min("amount"), F.max("amount")).first()
    assert out.where((F.col("amount") < lim[0]) | (F.col("amount") > lim[1])).count() == 0


def test_text_generator(spark):
    docs = spark.createDataFrame([(i, f"Sentence number {i} is long enough to keep. Another one follows with words {i}. And a third closes text {i}.", "ab"[i % 2], i % 7) for i in range(60)], "id long, body string, kind string, pages int")
    roles, _ = P.roles_of(docs, Contract("notes", "kind", "text"), "id")
    assert roles.long_text == "body"
    out = P.finish(docs, P.GENERATORS["llm"](docs, roles, 1.0, 60), roles)
    assert out.dtypes == docs.dtypes and out.where("length(body) < 60").count() == 0


def test_sweep(spark):
    few = P.sweep(table(spark, 50), "id", "outcome", ["amount"], 3.0, unswept=2.0).collect()
    assert [(r.epsilon, r.best, r.score) for r in few] == [(2.0, True, None)]
    rows = P.sweep(table(spark), "id", "outcome", ["amount", "score"], 3.0, 3).orderBy("trial").collect()
    assert [round(r.epsilon, 4) for r in rows] == [0.1, round(0.1 * 30**0.5, 4), 3.0]
    assert sum(r.best for r in rows) == 1 and max(rows, key=lambda r: r.score).best


def test_csv_without_header_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("6,148,33.6\n1,85,26.6\n\n\n")
    df = T.read_csv(spark, str(tmp_path / "a.csv"), "a int, b int, c double", header=False)
    assert df.count() == 2 and df.agg(F.sum("a")).first()[0] == 7


def test_digest_ignores_order_but_not_copies(spark):
    a = spark.createDataFrame([(1, 0.1, "x"), (2, None, None)], "i int, v double, t string")
    b = spark.createDataFrame([(2, None, None), (1, 0.1, "x")], "i int, v double, t string")
    d = lambda df: T.table_digest(df).first()["digest"]
    assert d(a) == d(b) != d(a.unionAll(b)) and d(a.where("false"))


def test_registry(spark):
    reg = registry.Registry([Contract("a", "t"), Contract("b")])
    with pytest.raises(KeyError):
        reg.get("zz")
    assert reg.get_safe("zz") is None and reg.names() == ["a", "b"]
    cat = spark.createDataFrame([("a",)], "dataset string")
    assert [r.name for r in reg.available(spark, cat).collect()] == ["a"]
    assert [r.name for r in reg.missing(spark, cat).collect()] == ["b"]
