"""From a real table and a contract to a judged synthetic table: the whole release as Spark jobs.

Generators are functions (real, roles, epsilon, n, seed) -> DataFrame, picked by key. Only bounded values reach the
driver: per-column statistics, small matrices and one score row per attempt (a chain has at most three attempts).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from twinloom.functions import fixed, pairs, rng
from twinloom.functions.pairs import REAL, SIDE, SYNTH
from twinloom.operators import attacks, causal, compare, generate as G, ledger as L, prepare, profile, roles as R, runs, temporal, text as X, utility
from twinloom.session import checkpoint_dir, cut
from twinloom.sources import logs, tables as T


@dataclass(frozen=True)
class Roles:
    """How the columns of one table are used."""

    key: str
    target: str | None = None
    numeric: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    long_text: str | None = None
    time: str | None = None
    path: str | None = None


def roles_of(real: DataFrame, contract: R.Contract, key: str) -> tuple[Roles, DataFrame]:
    """Roles from the column catalogue of the table. Times, dates, booleans and other text are drawn like discrete columns."""
    spark = real.sparkSession
    cat = R.catalogue(spark, {contract.name: real})
    con = R.contracts_frame(spark, [contract])
    discrete = {r["column"] for r in R.discrete_columns(cat, con).collect()}
    long_text = R.detect_text_column(cat, con).first()["first_long"]
    time = R.detect_time_column(cat, fixed.TIME_WORDS_GENERATOR, False).first()["time_col"]
    path = R.detect_path_column(cat).first()["path_col"]
    numeric = [c for c in pairs.numeric_columns(real) if c not in discrete and c != contract.target]
    numbers = set(pairs.numeric_columns(real))
    drawn = [c for c, t in real.dtypes if c in discrete or (c not in numbers and t != "binary" and "<" not in t)]
    text = [c for c in drawn if c not in (contract.target, key)]
    return Roles(key, contract.target if contract.target in real.columns else None, numeric, text, long_text, time, path), cat


def _marginals(real: DataFrame, roles: Roles, n: int, seed: int) -> DataFrame:
    cats = [*roles.text, *([roles.target] if roles.target else [])]
    return G.gen_categorical(real, cats, n, seed) if cats else G.rows(real.sparkSession, n)


def correlated(real, roles, epsilon, n, seed=42):
    base = _marginals(real, roles, n, seed)
    return base.select("*", *G.correlated_columns(real, roles.numeric, seed)) if roles.numeric else base


def class_correlated(real, roles, epsilon, n, seed=42):
    """Everything drawn given the class; a bootstrap of independent cells where there is no class."""
    if roles.target is None:
        return G.gen_bootstrap(real, roles.key, roles.numeric, roles.text, n, seed)
    labels = G.gen_labels(real, roles.target, n, seed)
    out = G.gen_conditional(real, labels, roles.target, [], roles.text, seed) if roles.text else labels
    return G.gen_correlated_by_class(real, out, roles.target, roles.numeric, seed) if roles.numeric else out


def sequential(real, roles, epsilon, n, seed=42):
    stats = G.numeric_stats(real, roles.numeric) if roles.numeric else {}
    out = _marginals(real, roles, n, seed).select("*", *[G.numeric_column(c, stats[c], epsilon, n, seed) for c in roles.numeric])
    return G.gen_temporal(out, roles.time) if roles.time in roles.numeric else out


def metadata(real, roles, epsilon, n, seed=42):
    cats = [*roles.text, *([roles.target] if roles.target else [])]
    return G.gen_metadata(real, roles.path, [c for c in cats if c != roles.path], roles.numeric, n, epsilon, seed)


def written(real, roles, epsilon, n, seed=42):
    label = roles.target or next(c for c in roles.text if c != roles.long_text)
    texts = X.gen_text(real, roles.key, roles.long_text, label, n, seed).select(G.ROW, label, F.col("text").alias(roles.long_text))
    rest = [c for c in roles.text if c not in (label, roles.long_text)]
    return G.gen_conditional(real, texts, label, roles.numeric, rest, seed)


def ensemble(real, roles, epsilon, n, seed=42):
    a, b = correlated(real, roles, epsilon / 2, n, seed), class_correlated(real, roles, epsilon / 2, n, seed + 1)
    out = G.blend_numeric(real, a, b, roles.numeric) if roles.numeric else G.rows(real.sparkSession, n)
    cats = [*roles.text, *([roles.target] if roles.target else [])]
    return out.join(G.blend_categorical(real, a, b, cats), G.ROW) if cats else out


GENERATORS = {"tabddpm": correlated, "ctgan": class_correlated, "gnn": sequential, "diffusion": metadata, "llm": written, "ensemble": ensemble}


def sweep(real: DataFrame, key: str, target: str | None, numeric: list[str], cap: float, trials: int = 5, generator=None, seed: int = 42, roles: Roles | None = None, unswept: float = 1.0) -> DataFrame:
    """Score every candidate epsilon of a generator; ``best`` marks the one to use. Below 100 rows nothing is swept: the one
    row holds ``unswept`` without scores.

    Distances of all candidates are searched in one go, each candidate being a part of its own; one small forest is
    fitted per candidate.
    """
    spark = real.sparkSession
    if real.limit(100).count() < 100:
        return spark.createDataFrame([(0, float(unswept), None, None, None, True)], "trial long, epsilon double, mia_score double, tstr_score double, score double, best boolean")
    eps = attacks.epsilon_candidates(cap, trials)
    train = cut(real.where(rng.uniform(key, "holdout", seed) < 0.7))
    hold = real.where(rng.uniform(key, "holdout", seed) >= 0.7)
    n = train.count()
    roles = roles or Roles(key, target, numeric, [])
    asked = [*numeric, *([target] if target else [])]
    sides, lifts = None, []
    for i, e in enumerate(eps):
        # a stream of its own per candidate
        synth = cut((generator or sequential)(train, roles, e, n, seed + i).select(G.ROW, *asked))
        s = synth.select(F.lit(SYNTH).alias(SIDE), F.col(G.ROW).cast("long").alias("_key"), *[F.col(c).cast("double").alias(c) for c in numeric])
        r = real.select(F.lit(REAL).alias(SIDE), F.col(key).cast("long").alias("_key"), *[F.col(c).cast("double").alias(c) for c in numeric])
        both = r.unionByName(s).withColumn("part", F.lit(i).cast("long"))
        sides = both if sides is None else sides.unionByName(both)
        lifts.append(utility.tstr_fast(pairs.make_pair(hold.select(*asked), synth.select(*asked)), target).first()["score"])
    near = attacks.mia_fast(sides, "_key", numeric, part="part")
    table = spark.createDataFrame([(i, float(e), float(u)) for i, (e, u) in enumerate(zip(eps, lifts))], "trial long, epsilon double, tstr_score double")
    out = table.join(near.select(F.col("part").alias("trial"), F.col("score").alias("mia_score")), "trial")
    out = out.withColumn("score", 0.4 * F.col("mia_score") + 0.3 * F.col("tstr_score"))
    top = out.agg(F.max_by("trial", F.struct("score", -F.col("trial")))).first()[0]
    return out.select("trial", "epsilon", "mia_score", "tstr_score", "score", (F.col("trial") == F.lit(top)).alias("best"))


def finish(real: DataFrame, synth: DataFrame, roles: Roles, balance: bool = True) -> DataFrame:
    """Real ranges, types and precision back; classes evened out; exactly the real columns."""
    ranged = prepare.Ranges.fit(real, [c for c in pairs.numeric_columns(real) if c in synth.columns]).restore(synth)
    if balance and roles.target:
        ranged = prepare.balance_classes(ranged, roles.target, G.ROW)
    return prepare.enforce(ranged, real)


def coherence(pair: DataFrame, order: str, cols: list[str]) -> float:
    """Mean Markov coherence of the columns in the order of one of them. Rows of one order value, which have no order of
    their own, follow a hash of the row; so do their slices."""
    placed = cut(pair.select(pairs.SIDE, F.col(order).cast("double").alias("_at"), F.xxhash64(*pair.columns).alias("_tie"), *cols))
    scores = [temporal.markov_score(placed, c, "_at", tie="_tie").first()["score"] for c in cols]
    return sum(scores) / len(scores)


def evaluate(real: DataFrame, synth: DataFrame, roles: Roles, contract: R.Contract, sensitive: str | None, trees: int = 100) -> dict:
    """All scores of one attempt as a flat dict."""
    keyed = pairs.make_pair(real.withColumn("_key", F.col(roles.key).cast("string")), synth.withColumn("_key", F.lit(None).cast("string")))
    pair = keyed.drop("_key")
    num = pairs.numeric_columns(pair)
    p = utility.privacy(keyed, "_key", sensitive, num).first()
    u = utility.utility(pair, roles.target, contract.modality or "tabular", trees).first()
    c = causal.correlation_fidelity(pair, roles.target).first()
    scores = {
        "privacy": p["privacy"], "mia": p["mia"], "singling": p["singling"], "leak": p["leak"], "utility": u["utility"],
        "realism": compare.realism(pair).first()["realism"], "diversity": profile.diversity(pair).first()["diversity"] if num else 0.5,
        "causal": c["score"], "temporal": None,
    }
    if (contract.is_temporal or contract.modality == "graph") and num:
        t = roles.time if roles.time in num else num[0]
        scores["temporal"] = coherence(pair, t, [c for c in num if c != t] or num)
    return {k: (float(v) if v is not None else None) for k, v in scores.items()}


RUN_SCHEMA = (
    "seq long, run_id long, attempt long, dataset string, model string, epsilon double, n_rows long, n_cols long, sparsity double, imbalance double, modality string, "
    "is_temporal boolean, privacy double, mia double, singling double, leak double, utility double, realism double, diversity double, causal double, temporal double"
)


def release(
    real: DataFrame, contract: R.Contract, key: str, out_dir: str, history: DataFrame | None = None, ledger: DataFrame | None = None,
    n_output: int | None = None, sweep_trials: int = 5, trees: int = 100, publish_forced: bool = False, seed: int = 42,
) -> DataFrame:
    """Generate, judge and (when a gate passes) publish. One row describes the chosen attempt.

    The first passing attempt of the model chain is chosen. When none passes, the best one is reported as forced and
    only published if ``publish_forced`` is set. The ledger and the history of earlier releases into ``out_dir`` count
    unless others are given. Each attempt sweeps epsilon with its own generator. What is published is reserved in the
    ledger first; a release that no longer fits the budget by then is refused and publishes nothing.
    """
    spark = real.sparkSession
    budget = L.require_budget(ledger if ledger is not None else L.load(spark, f"{out_dir}/ledger"))
    history = history if history is not None else logs.load_history(spark, f"{out_dir}/archive")
    roles, cat = roles_of(real, contract, key)
    con = R.contracts_frame(spark, [contract])
    level = L.sensitivity(cat).first()
    look = R.infer_task(cat, con).first()
    sensitive = R.pick_sensitive(cat, con).first()
    meta = profile.profile(real, contract.name, roles.target).select(
        "dataset", "n_rows", F.col("n_cols").cast("long").alias("n_cols"), "sparsity", "imbalance", F.lit(look["modality"]).alias("modality"),
        F.lit(contract.is_temporal).alias("is_temporal"), F.lit(level["epsilon_cap"]).alias("epsilon_cap"))
    meta = cut(meta)
    m = meta.first()
    if history is not None:
        pick = runs.choose_model(meta, history).first()
        model, epsilon = pick["model"], pick["epsilon"]
    else:
        pick = runs.route(meta).first()
        model, epsilon = pick["routed"], pick["epsilon_routed"]
    chain = [r["candidate"] for r in runs.model_chain(meta.withColumn("model", F.lit(model))).orderBy("position").collect()]
    n = n_output or m["n_rows"]
    attempts, tables, start = [], {}, epsilon
    for i, name in enumerate(chain):
        if sweep_trials and roles.numeric:
            trials = sweep(real, key, roles.target, roles.numeric, level["epsilon_cap"], sweep_trials, GENERATORS[name], seed, roles, start)
            epsilon = trials.where("best").first()["epsilon"]
        synth = cut(finish(real, GENERATORS[name](real, roles, epsilon, n, seed), roles))
        scores = evaluate(real, synth, roles, contract, sensitive["sensitive"] if sensitive else None, trees)
        tables[i] = synth
        attempts.append((i, 0, i, contract.name, name, float(epsilon), m["n_rows"], m["n_cols"], m["sparsity"], m["imbalance"], look["modality"], contract.is_temporal,
                         *[scores[k] for k in ("privacy", "mia", "singling", "leak", "utility", "realism", "diversity", "causal", "temporal")]))
        judged = runs.gate(spark.createDataFrame(attempts, RUN_SCHEMA))
        if judged.where(F.col("attempt") == i).first()["released"]:
            break
    table = cut(runs.archive(judged.withColumn("reward", runs.reward())))
    chosen = runs.select_attempt(table)
    row = chosen.first()
    publish = publish_forced or not row["forced"]
    final = table.where(F.col("attempt") == row["attempt"])
    stamp = uuid.uuid4().hex
    path, digest = None, None
    if publish:
        claim = L.reserve(final, f"{out_dir}/ledger")  # releases that run side by side can't spend more than there is
        try:
            path = f"{out_dir}/synthetic_output_{contract.name}_{stamp}"
            T.write_csv(tables[row["attempt"]], path)
            digest = T.table_digest(tables[row["attempt"]]).first()["digest"]
            dressed = final.withColumns({"ts": F.current_timestamp(), "output_path": F.lit(path), "sha256": F.lit(digest), "budget_remaining": F.lit(max(0.0, budget - row["epsilon"]))})
            logs.write_receipts(dressed, f"{out_dir}/receipts")
        except Exception:
            L.withdraw(spark, f"{out_dir}/ledger", claim)
            raise
    logs.append_json(logs.audit_record(final), f"{out_dir}/audit")
    history_rows = table.select(F.col("model").alias("model_key"), "reward", "privacy", "utility", "realism", "diversity", "epsilon", "dataset", "released", "failure_reasons", F.col("n_rows").alias("meta_rows"), F.col("n_cols").alias("meta_cols"),
                                (L.moment() + F.col("attempt")).alias("seq"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    logs.append_json(history_rows, f"{out_dir}/archive")
    logs.append_json(table.select("n_rows", "n_cols", F.col("model").alias("model_key"), "reward"), f"{out_dir}/meta")
    return final.select(
        "dataset", F.lit(look["task"]).alias("task"), F.lit(level["sensitivity"]).alias("sensitivity"), "model", "epsilon", "privacy", "utility", "realism", "diversity",
        "causal", "temporal", "reward", F.lit(row["forced"]).alias("forced"), F.lit(publish).alias("published"), F.lit(row["gate_message"]).alias("gate_message"),
        F.lit(len(attempts)).alias("attempts"), F.lit(digest).cast("string").alias("digest"))


def report(spark: SparkSession, d: str) -> DataFrame:
    """The release of the customer table, judged attempt by attempt, into the shared folder."""
    real = T.load_table(spark, d, "customer")
    contract = R.Contract("customer", "c_mktsegment", "tabular", discrete=("c_mktsegment", "c_nationkey"))
    return release(real, contract, "c_custkey", f"{checkpoint_dir(spark)}/release-{uuid.uuid4().hex}")
