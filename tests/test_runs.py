import numpy as np
import pytest
from pyspark.sql import functions as F

from twinloom.operators import ledger, runs
from twinloom.sources import logs


def run_rows(spark, rows):
    base = dict(seq=0, run_id=0, attempt=0, dataset="d", model="ctgan", privacy=0.9, utility=0.8, realism=0.8, diversity=0.8, mia=0.9, singling=0.9, leak=0.9, causal=0.9,
                reward=0.8, epsilon=1.0, n_rows=1000, n_cols=10, sparsity=0.1, imbalance=1.0, modality="tabular", is_temporal=False, epsilon_cap=10.0)
    types = ("seq long, run_id long, attempt long, dataset string, model string, privacy double, utility double, realism double, diversity double, mia double, singling double, "
             "leak double, causal double, reward double, epsilon double, n_rows long, n_cols long, sparsity double, imbalance double, modality string, is_temporal boolean, epsilon_cap double")
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], types)


def test_reward_fallbacks(spark):
    nan, inf = float("nan"), float("inf")
    r = run_rows(spark, [dict(privacy=nan, utility=inf, realism=nan, diversity=-inf), dict(privacy=1.0, utility=1.0, realism=1.0, diversity=1.0)])
    got = sorted(x[0] for x in r.select(runs.reward()).collect())
    assert got == [pytest.approx(0.4 * 0.5 + 0.2 * 0.5 + 0.1 * 0.5), pytest.approx(1.0)]


def test_gate_order_and_ties(spark):
    r = runs.gate(run_rows(spark, [
        dict(seq=1, privacy=0.70, mia=0.75, singling=0.80, leak=0.75, utility=0.60), dict(seq=2, privacy=0.5, mia=0.1), dict(seq=3, mia=0.1), dict(seq=4, singling=0.1),
        dict(seq=5, leak=0.1), dict(seq=6, utility=0.3)]))
    got = {x.seq: (x.released, x.gate_message) for x in r.collect()}
    assert got[1] == (True, "APPROVED")
    assert got[2] == (False, "BLOCKED: privacy 0.500 < floor 0.7")
    assert got[3][1].startswith("BLOCKED: MIA") and got[4][1].startswith("BLOCKED: singling-out") and got[5][1].startswith("BLOCKED: attr-leakage")
    assert got[6][0] and got[6][1].startswith("WARNING: utility 0.300 < target 0.60")


def test_first_pass_wins_over_better_reward(spark):
    r = runs.gate(run_rows(spark, [dict(run_id=1, attempt=0, privacy=0.1, reward=0.9), dict(run_id=1, attempt=1, reward=0.5), dict(run_id=1, attempt=2, reward=0.6),
                                   dict(run_id=2, attempt=0, privacy=0.1, reward=0.3), dict(run_id=2, attempt=1, privacy=0.1, reward=0.4)]))
    got = {x.run_id: x for x in runs.select_attempt(r).collect()}
    assert got[1].attempt == 1 and not got[1].forced
    assert got[2].attempt == 1 and got[2].forced and got[2].gate_message.endswith("[forced-release after 2-model chain exhausted]")


def test_signatures_and_avoidance(spark):
    hist = runs.archive(run_rows(spark, [dict(seq=1, model="tabddpm", utility=0.1, n_cols=600), dict(seq=2, model="ctgan", utility=0.1, sparsity=0.9), dict(seq=3, model="gnn", privacy=0.2)]))
    got = {x.model: x.failure_reasons for x in hist.collect()}
    assert got["tabddpm"] == ["tabddpm_high_dim_utility_collapse"] and got["ctgan"] == ["ctgan_sparse_utility_collapse"]
    assert got["gnn"] == ["privacy_gate_fail:gnn", "low_privacy:gnn"]
    probe = run_rows(spark, [dict(seq=1, model="tabddpm", n_cols=450), dict(seq=2, model="tabddpm", n_cols=400), dict(seq=3, model="ctgan", sparsity=0.6), dict(seq=4, model="gnn")])
    assert {x.seq: x.avoid for x in runs.should_avoid(probe, hist).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_empty_history(spark):
    none = runs.archive(run_rows(spark, [dict()]).where("false"))
    assert runs.best_run(none).first()["model"] == "none"
    p = run_rows(spark, [dict(seq=1)])
    assert not runs.meta_select(p, none).first()["confident"]
    assert runs.choose_model(p, none).first()["model"] == "ctgan"
    assert runs.history_kpis(runs.gate(none.drop("released", "gate_message"))).first()["epsilon_spent"] == 0.0


def test_meta_needs_three_runs_and_takes_neighbours(spark):
    h = run_rows(spark, [dict(seq=1, model="a", n_rows=500, reward=0.9, epsilon=0.01), dict(seq=2, model="b", n_rows=2000, reward=0.5), dict(seq=3, model="c", n_rows=2001, reward=1.0)])
    p = run_rows(spark, [dict(n_rows=1000)])
    r = runs.meta_select(p, h).first()
    assert (r["confident"], r["model"], r["epsilon"], r["n_similar"]) == (True, "a", 0.1, 2)
    assert not runs.meta_select(p, h.where("seq < 3")).first()["confident"]


@pytest.mark.parametrize("seed", [0, 1])
def test_dedupe_against_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    rows = [dict(seq=i, dataset="hot" if r.random() < 0.5 else f"d{r.integers(3)}", reward=0.5 if r.random() < 0.3 else float(np.round(r.random(), 5))) for i in range(600)]
    got = {x.seq for x in runs.dedupe(run_rows(spark, rows)).collect()}
    want = {a["seq"] for a in rows if not any(b["dataset"] == a["dataset"] and b["seq"] < a["seq"] and abs(b["reward"] - a["reward"]) < 1e-4 for b in rows)}
    assert got == want


def test_budget(spark):
    led = spark.createDataFrame([(1, "a", "spend", 1.0), (2, "b", "spend", 5.0), (3, None, "reset", 0.0), (4, "a", "spend", 2.5)], "seq long, dataset string, kind string, epsilon double")
    r = ledger.remaining(led).first()
    assert (r["consumed"], r["remaining"], r["exhausted"]) == (2.5, 0.5, False)
    over = led.unionAll(spark.createDataFrame([(5, "a", "spend", 9.0)], led.schema))
    assert ledger.remaining(over).first()["remaining"] == 0.0
    with pytest.raises(ledger.BudgetExhausted):
        ledger.require_budget(over)
    assert ledger.remaining(led.where("false")).first()["remaining"] == 3.0
    assert [x.cumulative for x in ledger.timeline(led.where("kind = 'spend'")).orderBy("seq").collect()] == [1.0, 6.0, 8.5]


def test_sensitivity_by_word(spark):
    cols = spark.createDataFrame([("a", "image_path"), ("b", "age_years"), ("c", "visit_no"), ("d", "ssn"), ("d", "age"), ("e", "zz")], "dataset string, column string")
    loose = {x.dataset: x.sensitivity for x in ledger.sensitivity(cols).collect()}
    strict = {x.dataset: x.sensitivity for x in ledger.sensitivity(cols, token=True).collect()}
    assert loose == {"a": "high", "b": "high", "c": "medium", "d": "critical", "e": "low"}
    assert strict == {"a": "low", "b": "high", "c": "medium", "d": "critical", "e": "low"}


def test_corrupt_history_lines(spark):
    lines = spark.createDataFrame([('{"model_key":"a","reward":0.5,"failure_reasons":["x"]}',), ("{broken",), ('{"model_key":"b","reward":NaN}',), ("",)], "value string")
    got = {x.model_key: (x.reward, x.failure_reasons, x.released) for x in logs.archive_rows(lines).collect()}
    assert got == {"a": (0.5, ["x"], False), "b": (0.0, [], False)}
    meta = spark.createDataFrame([('{"n_rows":1,"n_cols":2,"model_key":"a","reward":0.5}',), ('{"n_rows":1}',), ("no",)], "value string")
    assert logs.meta_rows(meta).count() == 1


def test_score_labels(spark):
    row = spark.range(1).select(*[runs.privacy_strength(F.lit(e)).alias(str(i)) for i, e in enumerate((0.4, 0.5, 2.0))], runs.score_band(F.lit(float("nan")), 0.7).alias("n")).first()
    assert tuple(row) == ("Strong", "Moderate", "Standard", "poor")
