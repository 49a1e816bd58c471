"""Temporal fidelity: Markov transitions over real deciles, and lag-1 autocorrelation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from twinloom.functions import ordered, pairs
from twinloom.functions.pairs import REAL, SIDE, SYNTH
from twinloom.functions.scalars import clip

NEUTRAL_AUTOCORR = 0.7


def decile_edges(pair: DataFrame, col: str, states: int = 10, slices: int | None = None) -> tuple[list[float], float | None]:
    """Distinct real quantiles (exact, interpolated) and the real median; about a dozen numbers reach the driver."""
    real = pairs.numeric_view(pair.where(F.col(SIDE) == REAL), [col])
    probs = {f"q{i}": i / states for i in range(states + 1)}
    row = ordered.exact_quantiles(real, col, {**probs, "median": 0.5}, slices=slices).first()
    if row is None:
        return [], None
    return sorted({row[f"q{i}"] for i in range(states + 1)}), row["median"]


def state_of(x: Column, edges: list[float], median: float) -> Column:
    """How many interior edges lie at or below x; a missing x takes the median."""
    v = F.coalesce(x, F.lit(median))
    inner = F.array(*[F.lit(e) for e in edges[1:-1]])
    return F.size(F.filter(inner, lambda e: e <= v))


def transitions(pair: DataFrame, col: str, order: str, by: list[str] | None = None, states: int = 10, slices: int | None = None, tie: str | None = None) -> DataFrame | None:
    """(state, next_state, r, s, p): counts on both sides and the real probability with one added to every cell.

    Rows of one ``order`` value follow a numeric ``tie``, by which a frequent value is also split. None when there are fewer
    than two states.
    """
    edges, median = decile_edges(pair, col, states, slices)
    n_states = len(edges) - 1
    if n_states < 2:
        return None
    x = pairs.as_double(col, dict(pair.dtypes)[col])
    stated = pair.select(SIDE, order, *([tie] if tie else []), *(by or []), state_of(x, edges, median).alias("state"))
    moves = ordered.with_next(stated, order, ["state"], [SIDE, *(by or [])], slices, tie).where("has_next")
    counts = moves.groupBy("state", "next_state").agg(F.count_if(F.col(SIDE) == REAL).alias("r"), F.count_if(F.col(SIDE) == SYNTH).alias("s"))
    spark = pair.sparkSession
    cells = spark.range(n_states * n_states).select(F.floor(F.col("id") / n_states).cast("int").alias("state"), (F.col("id") % n_states).cast("int").alias("next_state"))
    full = cells.join(counts, ["state", "next_state"], "left").fillna(0, ["r", "s"])
    totals = full.groupBy("state").agg(F.sum("r").alias("row_total"))
    return full.join(totals, "state").select("state", "next_state", "r", "s", ((F.col("r") + 1) / (F.col("row_total") + n_states)).alias("p"))


def markov_score(pair: DataFrame, col: str, order: str, by: list[str] | None = None, states: int = 10, min_rows: int = 50, slices: int | None = None, tie: str | None = None) -> DataFrame:
    """Mean log-likelihood of both sides under the real transitions and how close they are.

    Short or nearly constant series are compared by autocorrelation instead.
    """
    look = pair.where(F.col(SIDE) == REAL).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(col).alias("k")).first()
    enough = look["n"] >= min_rows and look["k"] >= 3
    t = transitions(pair, col, order, by, states, slices, tie) if enough else None
    if t is None:
        a = autocorr(pair, order, [col], by, slices, tie)
        return a.agg(F.coalesce(F.avg("score"), F.lit(NEUTRAL_AUTOCORR)).alias("score")).select(
            F.lit("autocorrelation").alias("method"), F.lit(0.0).alias("real_ll"), F.lit(0.0).alias("synth_ll"), F.lit(0).alias("n_states"), "score")
    ll = F.ln(F.col("p") + 1e-12)
    sums = t.agg(
        F.coalesce(F.sum(F.col("r") * ll) / F.nullif(F.sum("r"), F.lit(0)), F.lit(0.0)).alias("real_ll"),
        F.coalesce(F.sum(F.col("s") * ll) / F.nullif(F.sum("s"), F.lit(0)), F.lit(0.0)).alias("synth_ll"), (F.max("state") + 1).alias("n_states"))
    score = F.when(F.col("real_ll") == 0, F.lit(0.5)).otherwise(clip(1 - F.abs(1 - F.col("synth_ll") / F.nullif(F.col("real_ll"), F.lit(0.0)))))
    return sums.select(F.lit("markov").alias("method"), "real_ll", "synth_ll", "n_states", score.alias("score"))


def autocorr(pair: DataFrame, order: str, cols: list[str] | None = None, by: list[str] | None = None, slices: int | None = None, tie: str | None = None) -> DataFrame:
    """Per column: lag-1 autocorrelation on both sides and 1 - min(|difference|, 1). Missing values are skipped, not lagged over."""
    cols = cols or [c for c in pairs.numeric_columns(pair) if c not in (order, tie)]
    keep = [SIDE, order, *([tie] if tie else []), *(by or [])]
    long = pairs.unpivot(pairs.numeric_view(pair, cols, keep), cols, keep).where(F.col("v").isNotNull())
    lagged = ordered.with_next(long, order, ["v"], ["column", SIDE, *(by or [])], slices, tie)

    def of(side: str) -> Column:
        a, b = F.when((F.col(SIDE) == side) & F.col("has_next"), F.col("v")), F.when((F.col(SIDE) == side) & F.col("has_next"), F.col("next_v"))
        rho = F.corr(a, b)
        return F.coalesce(F.when(~F.isnan(rho), rho), F.lit(0.0))

    g = lagged.groupBy("column").agg(
        of(REAL).alias("ac_real"), of(SYNTH).alias("ac_synth"), F.count_if(F.col(SIDE) == REAL).alias("n_r"), F.count_if(F.col(SIDE) == SYNTH).alias("n_s"))
    kept = g.where((F.col("n_r") >= 4) & (F.col("n_s") >= 4))
    return kept.select("column", "ac_real", "ac_synth", (1 - F.least(F.abs(F.col("ac_real") - F.col("ac_synth")), F.lit(1.0))).alias("score"))
