"""Distribution fidelity of a real/synthetic pair. All columns share one shuffle per metric family."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from twinloom.functions import ordered, pairs
from twinloom.functions.moments import covariance_at, moments
from twinloom.functions.pairs import REAL, SIDE, SYNTH
from twinloom.functions.scalars import clip

NEUTRAL = 0.5


def cdf_distances(pair: DataFrame, cols: list[str] | None = None, slices: int | None = None) -> DataFrame:
    """Per column: Kolmogorov-Smirnov D, Wasserstein-1, real range, and the real 1st/99th percentiles."""
    cols = cols or pairs.numeric_columns(pair)
    c = pairs.cdf(pair, cols, slices)
    gap = F.abs(F.col("fr") - F.col("fs"))
    before, n = F.col("cr") - F.col("r"), F.col("n_r")

    def at(rank):
        return F.max(F.when((before <= rank) & (rank < F.col("cr")), F.col("v")))

    aggs = [
        F.max(gap).alias("ks"),
        F.coalesce(F.sum(gap * (F.col("next_v") - F.col("v"))), F.lit(0.0)).alias("w1"),
        F.min(F.when(F.col("r") > 0, F.col("v"))).alias("lo"),
        F.max(F.when(F.col("r") > 0, F.col("v"))).alias("hi"),
        F.max("n_r").alias("n_r"),
        F.max("n_s").alias("n_s"),
        F.count_if(F.col("r") > 0).alias("distinct_r"),
    ]
    for name, p in (("p01", 0.01), ("p99", 0.99)):
        h = F.lit(p) * (n - 1)
        aggs += [at(F.floor(h)).alias(f"_lo_{name}"), at(F.ceil(h)).alias(f"_hi_{name}")]
    out = c.groupBy("column").agg(*aggs)
    for name, p in (("p01", 0.01), ("p99", 0.99)):
        h = F.lit(p) * (F.col("n_r") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out = out.withColumn(name, lo + (hi - lo) * (h - F.floor(h))).drop(f"_lo_{name}", f"_hi_{name}")
    return out


def ks(pair: DataFrame, cols: list[str] | None = None, slices: int | None = None) -> DataFrame:
    """Per-column similarity 1 - D over columns with at least two values on both sides."""
    d = cdf_distances(pair, cols, slices).where((F.col("n_r") >= 2) & (F.col("n_s") >= 2))
    return d.select("column", "ks", (1 - F.col("ks")).alias("score"))


def wasserstein(pair: DataFrame, cols: list[str] | None = None, limit: int | None = None, slices: int | None = None) -> DataFrame:
    """Earth-mover distance against the robust real range p99 - p1; id-like and near-constant columns are skipped."""
    cols = (cols or pairs.numeric_columns(pair))[:limit]
    whole = [c for c, t in pair.dtypes if t in pairs.INTEGRAL]
    d = cdf_distances(pair, cols, slices)
    spread = F.col("p99") - F.col("p01")
    id_like = F.col("column").isin(whole) & (F.col("distinct_r") > 0.9 * F.col("n_r"))
    kept = d.where((F.col("n_r") >= 2) & (F.col("n_s") >= 2) & (spread >= 1e-6) & ~id_like)
    return kept.select("column", "w1", spread.alias("spread"), clip(1 - 0.5 * F.col("w1") / spread).alias("score"))


def wasserstein_range(pair: DataFrame, cols: list[str] | None = None, limit: int | None = None, slices: int | None = None) -> DataFrame:
    """Earth-mover distance against the full real range max - min."""
    cols = (cols or pairs.numeric_columns(pair))[:limit]
    d = cdf_distances(pair, cols, slices).where((F.col("n_r") > 0) & (F.col("n_s") > 0))
    width = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6))
    return d.select("column", "w1", width.alias("value_range"), clip(1 - F.col("w1") / width).alias("score"))


def _jsd(p, q):
    """Contribution of one cell to the Jensen-Shannon divergence in nats."""
    m = (p + q) / 2
    return (p * F.ln(p / m) + q * F.ln(q / m)) / 2


def jsd_binned(pair: DataFrame, cols: list[str] | None = None, bins: int = 20, limit: int | None = None) -> DataFrame:
    """1 - sqrt(JSD) over equal-width bins of the combined range; the last bin is closed."""
    cols = (cols or pairs.numeric_columns(pair))[:limit]
    binned = binned_counts(pair, cols, bins)
    seen = binned.groupBy("column").agg(F.sum("r").alias("n_r"), F.sum("s").alias("n_s"))
    cells = seen.where((F.col("n_r") > 0) & (F.col("n_s") > 0)).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = cells.join(binned.select("column", "bin", "r", "s"), ["column", "bin"], "left").fillna(0, ["r", "s"])
    eps, norm = 1e-10, 1 + bins * 1e-10
    p, q = (F.col("r") / F.col("n_r") + eps) / norm, (F.col("s") / F.col("n_s") + eps) / norm
    out = full.groupBy("column").agg(F.sum(_jsd(p, q)).alias("jsd"))
    return out.select("column", F.sqrt(F.greatest("jsd", F.lit(0.0))).alias("distance"), clip(1 - F.sqrt(F.greatest("jsd", F.lit(0.0)))).alias("score"))


def binned_counts(pair: DataFrame, cols: list[str], bins: int) -> DataFrame:
    """(column, bin, lo, width, r, s) over equal-width bins of each column's combined range."""
    view = pairs.numeric_view(pair, cols, [SIDE])
    # two numbers per column reach the driver and come back as literals
    edge = view.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]).first()
    cells = []
    for c in cols:
        lo, hi = edge[f"lo_{c}"], edge[f"hi_{c}"]
        if lo is None:
            continue
        # a constant column gets the unit-wide range around its value
        low, step = (lo - 0.5, 1.0 / bins) if lo == hi else (lo, (hi - lo) / bins)
        at = F.least(F.floor((F.col(c) - low) / step), F.lit(bins - 1)).cast("int")
        cells.append(F.struct(F.lit(c).alias("column"), at.alias("bin"), F.lit(low).alias("lo"), F.lit(step).alias("width")))
    if not cells:
        return pair.sparkSession.createDataFrame([], "column string, bin int, lo double, width double, r bigint, s bigint")
    long = view.select(SIDE, F.inline(F.array(*cells))).where(F.col("bin").isNotNull())
    return long.groupBy("column", "bin", "lo", "width").agg(
        F.count_if(F.col(SIDE) == REAL).alias("r"), F.count_if(F.col(SIDE) == SYNTH).alias("s")
    )


def histogram_compare(pair: DataFrame, cols: list[str] | None = None, bins: int = 25, limit: int = 4) -> DataFrame:
    """Overlaid histograms of the first shared numeric columns."""
    cols = (cols or pairs.numeric_columns(pair))[:limit]
    b = binned_counts(pair, cols, bins)
    return b.select("column", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"), "r", "s")


def category_counts(pair: DataFrame, cols: list[str]) -> DataFrame:
    """(column, v, r, s) for discrete columns as text."""
    view = pair.select(SIDE, *[F.col(c).cast("string").alias(c) for c in cols])
    long = pairs.unpivot(view, cols, [SIDE]).where(F.col("v").isNotNull())
    return long.groupBy("column", "v").agg(F.count_if(F.col(SIDE) == REAL).alias("r"), F.count_if(F.col(SIDE) == SYNTH).alias("s"))


def low_cardinality(df: DataFrame, limit: int = 20) -> list[str]:
    """Text columns, and other columns with at most ``limit`` distinct values, in column order.

    A sketch pass rules out the wide columns, so the exact distinct count only sees narrow ones.
    """
    text = pairs.string_columns(df)
    others = [c for c, t in df.dtypes if c not in text and c != SIDE and not t.startswith(("array", "map", "struct"))]
    narrow = []
    if others:
        guess = df.agg(*[F.approx_count_distinct(c).alias(c) for c in others]).first()
        narrow = [c for c in others if guess[c] <= 3 * limit]
    if narrow:
        exact = df.agg(*[F.count_distinct(c).alias(c) for c in narrow]).first()
        narrow = [c for c in narrow if exact[c] <= limit]
    return [c for c in df.columns if c in text or c in narrow]


def jsd_categorical(pair: DataFrame, cols: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """1 - sqrt(JSD) over category frequencies (1e-8 smoothing, nats).

    Fully disjoint categories score 1 - sqrt(ln 2), about 0.167: the measure's floor.
    """
    if cols is None:
        cols = low_cardinality(pair.where(F.col(SIDE) == REAL).drop(SIDE))
    counts = category_counts(pair, cols[:limit])
    totals = counts.groupBy("column").agg(F.sum("r").alias("n_r"), F.sum("s").alias("n_s"), F.count(F.lit(1)).alias("k"))
    eps = 1e-8
    p = (F.coalesce(F.col("r") / F.nullif("n_r", F.lit(0)), F.lit(0.0)) + eps)
    q = (F.coalesce(F.col("s") / F.nullif("n_s", F.lit(0)), F.lit(0.0)) + eps)
    mass_p = F.when(F.col("n_r") > 0, 1.0).otherwise(0.0) + F.col("k") * eps
    mass_q = F.when(F.col("n_s") > 0, 1.0).otherwise(0.0) + F.col("k") * eps
    cells = counts.join(totals, "column").select("column", (p / mass_p).alias("p"), (q / mass_q).alias("q"))
    out = cells.groupBy("column").agg(F.sum(_jsd(F.col("p"), F.col("q"))).alias("jsd"))
    dist = F.sqrt(F.greatest("jsd", F.lit(0.0)))
    return out.select("column", dist.alias("distance"), (1 - dist).alias("score"))


def chi_square(pair: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """1 / (1 + stat / k) with +1 smoothing, synthetic counts scaled to the real total."""
    cols = cols or pairs.string_columns(pair)
    counts = category_counts(pair, cols).select("column", (F.col("r") + 1).alias("r"), (F.col("s") + 1).alias("s"))
    totals = counts.groupBy("column").agg(F.sum("r").alias("n_r"), F.sum("s").alias("n_s"), F.count(F.lit(1)).alias("k"))
    scaled = F.col("s") * (F.col("n_r") / F.col("n_s"))
    stat = F.sum((scaled - F.col("r")) * (scaled - F.col("r")) / F.col("r"))
    out = counts.join(totals, "column").groupBy("column").agg(stat.alias("stat"), F.max("k").alias("k"))
    return out.select("column", "stat", "k", (1 / (1 + F.col("stat") / F.col("k"))).alias("score"))


def correlations(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every ordered column pair over complete cases: (by..., a, b, rho).

    One pass of partial aggregates whatever the row count; undefined correlations (constant columns) are 0.
    """
    by = by or []
    d = len(cols)
    names = F.array(*[F.lit(c) for c in cols])
    cells = moments(df, cols, by).select("*", F.posexplode("p").alias("at", "pij"))
    cells = cells.withColumns({"i": F.floor(F.col("at") / d).cast("int"), "j": (F.col("at") % d).cast("int")})

    def variance(i: str):
        return F.greatest(covariance_at(F.col(i), F.col(i), d), F.lit(0.0))

    spread = F.sqrt(variance("i") * variance("j"))
    rho = F.coalesce(covariance_at(F.col("i"), F.col("j"), d) / F.nullif(spread, F.lit(0.0)), F.lit(0.0))
    exact = F.when(F.col("flat")[F.col("i")] | F.col("flat")[F.col("j")], F.lit(0.0)).when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(rho)
    return cells.select(*by, "n", names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), exact.alias("rho"))


def pair_correlations(pair: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, rho_r, rho_s, n_r, n_s) from one scan of the pair."""
    c = correlations(pair, cols, [SIDE])
    return c.groupBy("a", "b").agg(
        F.max(F.when(F.col(SIDE) == REAL, F.col("rho"))).alias("rho_r"),
        F.max(F.when(F.col(SIDE) == SYNTH, F.col("rho"))).alias("rho_s"),
        F.max(F.when(F.col(SIDE) == REAL, F.col("n"))).alias("n_r"),
        F.max(F.when(F.col(SIDE) == SYNTH, F.col("n"))).alias("n_s"),
    )


def corr_similarity(pair: DataFrame, cols: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """1 - min(mean |difference of correlation matrices|, 1), diagonal included."""
    cols = (cols or pairs.numeric_columns(pair))[:limit]
    c = pair_correlations(pair, cols).where((F.col("n_r") >= 2) & (F.col("n_s") >= 2))
    return c.agg(F.avg(F.abs(F.col("rho_r") - F.col("rho_s"))).alias("mean_diff")).select(
        "mean_diff", (1 - F.least(F.col("mean_diff"), F.lit(1.0))).alias("score")
    )


def mean_score(scores: DataFrame, name: str) -> DataFrame:
    """One row: the mean of a per-column score, NULL when no column qualified."""
    return scores.agg(F.avg("score").alias(name))


def realism(pair: DataFrame, numeric: list[str] | None = None, text: list[str] | None = None) -> DataFrame:
    """Mean of the available parts {KS, chi-square, correlation}; neutral when none is available."""
    numeric = numeric if numeric is not None else pairs.numeric_columns(pair)
    text = text if text is not None else pairs.string_columns(pair)
    parts = []
    if numeric:
        parts.append(mean_score(ks(pair, numeric), "part"))
    if text:
        parts.append(mean_score(chi_square(pair, text), "part"))
    if len(numeric) >= 2:
        parts.append(corr_similarity(pair, numeric).select(F.col("score").alias("part")))
    return _composite(pair, parts, "realism")


def _composite(pair: DataFrame, parts: list[DataFrame], name: str) -> DataFrame:
    if not parts:
        return pair.agg(F.lit(NEUTRAL).alias(name))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.agg(F.coalesce(F.avg("part"), F.lit(NEUTRAL)).alias(name))


def distributional(pair: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Equal-weight blend of the range-normalised Wasserstein score and the binned JSD score."""
    w = F.coalesce(F.avg(F.when(F.col("kind") == "w", F.col("score"))), F.lit(NEUTRAL))
    j = F.coalesce(F.avg(F.when(F.col("kind") == "j", F.col("score"))), F.lit(NEUTRAL))
    both = (
        wasserstein_range(pair, cols).select(F.lit("w").alias("kind"), "score")
        .unionByName(jsd_binned(pair, cols).select(F.lit("j").alias("kind"), "score"))
    )
    out = both.agg(w.alias("wasserstein_score"), j.alias("jsd_score"))
    return out.withColumn("distributional", 0.5 * F.col("wasserstein_score") + 0.5 * F.col("jsd_score"))
