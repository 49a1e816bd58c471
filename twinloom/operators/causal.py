"""Causal fidelity: correlation edges and the skeleton that conditional independence leaves.

One distributed pass over the rows gives the d x d correlation matrices; the search tests sets of columns against them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from twinloom.functions import pairs
from twinloom.functions.pairs import REAL, SIDE
from twinloom.functions.scalars import clip
from twinloom.operators import compare
from twinloom.session import width

EDGE = 0.15
NORMAL_975 = 1.959963984540054  # two-sided 5 % point of the standard normal
#: Conditioning sets inverted at once.
SETS = 4096


def usable_columns(pair: DataFrame, target: str | None = None, cols: list[str] | None = None, limit: int | None = None) -> list[str]:
    """Numeric columns that vary on the real side and hold more than five synthetic values; with a ``limit`` the target leads."""
    cols = pairs.numeric_columns(pair) if cols is None else cols
    if not cols:
        return []
    view = pairs.numeric_view(pair, cols, [SIDE])
    aggs = []
    for c in cols:
        aggs += [F.stddev_samp(F.when(F.col(SIDE) == REAL, F.col(c))).alias(f"s_{c}"), F.count(F.when(F.col(SIDE) != REAL, F.col(c))).alias(f"n_{c}")]
    row = view.agg(*aggs).first()
    kept = [c for c in cols if (row[f"s_{c}"] or 0.0) > 1e-6 and row[f"n_{c}"] > 5]
    if limit is not None and len(kept) > limit:
        if target in kept:
            kept = [target] + [c for c in kept if c != target]
        kept = kept[:limit]
    return kept


def correlation_fidelity(pair: DataFrame, target: str | None = None, cols: list[str] | None = None) -> DataFrame:
    """Mean correlation agreement, edges |rho| > 0.15 on both sides and the share of real edges kept."""
    cols = usable_columns(pair, target, cols)
    if len(cols) < 3:
        return pair.sparkSession.range(1).select(F.lit(0.8).alias("score"), F.lit(0).cast("long").alias("n_edges_real"), F.lit(0).cast("long").alias("n_edges_synth"), F.lit(0.8).alias("edge_overlap"))
    d = len(cols)
    c = compare.pair_correlations(pair, cols)
    r, s = F.abs(F.col("rho_r")) > EDGE, F.abs(F.col("rho_s")) > EDGE
    one = c.agg(
        clip(1 - F.avg(F.abs(F.col("rho_r") - F.col("rho_s")))).alias("base"), F.greatest(F.count_if(r) - d, F.lit(0)).alias("n_edges_real"),
        F.greatest(F.count_if(s) - d, F.lit(0)).alias("n_edges_synth"), F.greatest(F.count_if(r & s) - d, F.lit(0)).alias("tp"))
    lost = (F.col("n_edges_synth") == 0) & (F.col("n_edges_real") > 0)
    return one.select(
        F.when(lost, clip(0.8 * F.col("base"), 0.4, 0.7)).otherwise(F.col("base")).alias("score"), "n_edges_real", "n_edges_synth",
        F.when(lost, F.lit(0.0)).otherwise(F.col("tp") / F.greatest(F.col("n_edges_real"), F.lit(1))).alias("edge_overlap"))


def partial(corr: np.ndarray, a: int, b: int, sets: np.ndarray) -> np.ndarray:
    """Partial correlation of columns ``a`` and ``b`` given each row of ``sets``, from the inverse of the small matrix; 0 where
    there is none."""
    idx = np.concatenate([np.full((len(sets), 1), a), np.full((len(sets), 1), b), sets], axis=1)
    small = corr[idx[:, :, None], idx[:, None, :]]
    try:
        inverse = np.linalg.inv(small)
    except np.linalg.LinAlgError:  # one of them has no inverse: each on its own
        inverse = np.full_like(small, np.nan)
        for i, m in enumerate(small):
            if np.linalg.matrix_rank(m) == len(m):
                inverse[i] = np.linalg.inv(m)
    with np.errstate(invalid="ignore", divide="ignore"):
        rho = -inverse[:, 0, 1] / np.sqrt(inverse[:, 0, 0] * inverse[:, 1, 1])
    return np.where(np.isfinite(rho), rho, 0.0)


def independent(rho: np.ndarray, n: float, order: int) -> np.ndarray:
    """Fisher z test at the 5 % level."""
    safe = np.clip(rho, -1 + 1e-12, 1 - 1e-12)
    return 0.5 * np.abs(np.log((1 + safe) / (1 - safe))) * np.sqrt(max(n - order - 3, 1)) <= NORMAL_975


def parted(corr: np.ndarray, n: float, a: int, b: int, first: int, others: list[int], order: int) -> bool:
    """Does a set of ``order`` columns that opens with ``first`` and goes on in ``others`` make a and b independent?"""
    rest = combinations(others, order - 1)
    while sets := list(islice(rest, SETS)):
        if independent(partial(corr, a, b, np.array([(first, *s) for s in sets], np.int64)), n, order).any():
            return True
    return False


def skeleton(corr: DataFrame) -> DataFrame:
    """(side, a, b) with a < b: the level-wise search, stable in the order of columns.

    ``corr`` is (side, a, b, rho, n). At each order, a pair still joined is tested given every set of that many other
    neighbours of either column, the neighbours being those at the start of the order; pairs found independent go
    together at its end. The search ends when no column has neighbours enough, so no order is left out. Tests are dealt
    out by (pair, first column of the set): a pair with many sets is many tasks. The driver holds one d x d matrix a side
    and the edges. Where a matrix has no inverse the partial correlation is 0.
    """
    spark = corr.sparkSession
    sides: dict[str, dict] = {}
    for r in corr.select(SIDE, "a", "b", "rho", "n").collect():  # d x d rows a side
        sides.setdefault(r[SIDE], {})[(r["a"], r["b"])] = (r["rho"], r["n"])
    held, edges = {}, set()
    for side, cells in sides.items():
        names = sorted({a for a, _ in cells})
        m = np.eye(len(names))
        for (a, b), (rho, _) in cells.items():
            if a != b:
                m[names.index(a), names.index(b)] = np.nan if rho is None else rho
        n = np.array([[cells.get((a, b), (0, 0))[1] or 0 for b in names] for a in names], float)
        held[side] = (names, m, n)
        for i in range(len(names)):
            for j in range(i + 1, len(names)):
                if not independent(np.nan_to_num(m[i, j]), n[i, j], 0):
                    edges.add((side, i, j))
    sent = {s: (np.nan_to_num(m), n) for s, (_, m, n) in held.items()}
    order = 1
    while True:
        beside: dict[tuple[str, int], set[int]] = {}
        for s, i, j in edges:
            beside.setdefault((s, i), set()).add(j)
            beside.setdefault((s, j), set()).add(i)
        work = []
        for s, i, j in sorted(edges):
            seen = set()
            for own, other in ((i, j), (j, i)):
                near = sorted(beside[s, own] - {other})
                for k in range(len(near) - order + 1):
                    if (job := (near[k], tuple(near[k + 1 :]))) not in seen:
                        seen.add(job)
                        work.append((s, i, j, *job))
        if not work:
            break
        edges -= found_independent(spark, work, sent, order)
        order += 1
    out = [(s, held[s][0][i], held[s][0][j]) for s, i, j in sorted(edges)]
    return spark.createDataFrame(out, f"{SIDE} string, a string, b string")


def found_independent(spark, work: list[tuple], sent: dict, order: int) -> set[tuple[str, int, int]]:
    """The pairs that one of the given tests parts; the tests run in tasks."""
    jobs = spark.createDataFrame([(s, i, j, k, list(rest)) for s, i, j, k, rest in work], "side string, i int, j int, first int, rest array<int>")

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = []
            for s, i, j, first, rest in zip(*[c.to_pylist() for c in b.columns]):
                m, n = sent[s]
                if (s, i, j) not in gone and parted(m, n[i, j], i, j, first, rest, order):
                    gone.append((s, i, j))
            yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in gone], t) for c, t in enumerate((pa.string(), pa.int32(), pa.int32()))], names=["side", "i", "j"])

    dealt = jobs.repartition(width(spark), "side", "i", "j", "first")
    return {(r["side"], r["i"], r["j"]) for r in dealt.mapInArrow(tested, "side string, i int, j int").distinct().collect()}


def causal_skeleton(pair: DataFrame, target: str | None = None, cols: list[str] | None = None) -> DataFrame:
    cols = usable_columns(pair, target, cols)
    return skeleton(compare.correlations(pair, cols, [SIDE]))


def edge_f1(edges: DataFrame) -> DataFrame:
    """Agreement of two edge sets given as (side, a, b): recall, precision and F1; 1.0 or 0.5 when the real graph is empty."""
    seen = edges.groupBy("a", "b").agg(F.max(F.col(SIDE) == REAL).alias("r"), F.max(F.col(SIDE) != REAL).alias("s"))
    c = seen.agg(F.count_if("r").alias("n_real"), F.count_if("s").alias("n_synth"), F.count_if(F.col("r") & F.col("s")).alias("tp"))
    rec = F.col("tp") / F.nullif(F.col("n_real"), F.lit(0))
    prec = F.col("tp") / F.greatest(F.col("n_synth"), F.lit(1))
    empty = F.when(F.col("n_synth") == 0, F.lit(1.0)).otherwise(F.lit(0.5))
    f1 = F.coalesce(2 * rec * prec / F.nullif(rec + prec, F.lit(0.0)), F.lit(0.0))
    return c.select("n_real", "n_synth", F.coalesce(rec, empty).alias("overlap"), prec.alias("precision"), F.when(F.col("n_real") == 0, empty).otherwise(f1).alias("score"))
