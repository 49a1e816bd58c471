"""Row synthesis. Every generated cell is a function of (row id, column, seed), so rows are made in parallel,
can be recomputed after a lost task, and do not depend on the number of partitions.

Noise added here is calibrated to epsilon by the stated formulas; it is not a formal privacy guarantee.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from twinloom.functions import ordered, pairs, rng
from twinloom.functions.moments import covariance_at, moments
from twinloom.functions.scalars import clip
from twinloom.operators import compare
from twinloom.session import cut, width

ROW = "row_id"
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", ROW)


def noise_scale(lo, hi, epsilon, n) -> Column:
    """Width of the added Laplace noise: range / (epsilon * n + 1e-6)."""
    lo, hi, epsilon, n = [x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi, epsilon, n)]
    return (hi - lo) / (epsilon * F.greatest(n, F.lit(1.0)) + 1e-6)


def noise_multiplier(epsilon: Column) -> Column:
    return clip(F.lit(1.2) / F.greatest(epsilon, F.lit(0.1)), 0.8, 1.5)


def weight_noise(epsilon: Column) -> Column:
    return F.least(F.lit(1.0) / (epsilon + 1e-6), F.lit(0.05))


def numeric_stats(real: DataFrame, cols: list[str], sample: bool = False) -> dict[str, tuple[float, float, float, float]]:
    """Mean, deviation, minimum, maximum per column; four numbers per column reach the driver."""
    sd = F.stddev_samp if sample else F.stddev_pop
    view = pairs.numeric_view(real, cols)
    row = view.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", sd), ("lo", F.min), ("hi", F.max))]).first()
    return {c: tuple(float(row[f"{n}_{c}"] or 0.0) for n in ("m", "s", "lo", "hi")) for c in cols}


def numeric_column(c: str, stats: tuple[float, float, float, float], epsilon: float, n: int, seed: int = 42) -> Column:
    """Normal draw around the real mean plus Laplace noise, kept inside the real range."""
    mu, sd, lo, hi = stats
    x = F.lit(mu) + F.lit(max(sd, 1e-6)) * rng.normal(ROW, c, seed) + rng.laplace(ROW, f"{c}/noise", noise_scale(lo, hi, epsilon, n), seed)
    return clip(x, lo, hi).alias(c)


def gen_numeric(real: DataFrame, cols: list[str], n: int, epsilon: float = 1.0, seed: int = 42, sample: bool = False) -> DataFrame:
    stats = numeric_stats(real, cols, sample)
    return rows(real.sparkSession, n).select(ROW, *[numeric_column(c, stats[c], epsilon, n, seed) for c in cols])


def gen_gaussian(real: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """The baseline table: for every row of the real one, a standard normal in place of each non-key cell. A missing cell
    stays missing, so the baseline has the real table's gaps."""
    return real.select(key, *[F.when(F.col(c).isNotNull(), rng.normal(key, c, seed)).alias(c) for c in real.columns if c != key])


def interval_table(real: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., column, value, lo, hi, k): each observed value, as text, owns a part of [0, 1) as long as its frequency
    among the ``k`` values of its column.

    Values are laid out in the order of their md5, which is uniform, so the running sum is cut into even slices. All
    columns share one pass.
    """
    by = by or []
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    keys = [*by, "column"]
    counts = real.select(*by, cells).where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n_v"))
    counts = counts.withColumn("_h", F.md5("value")).withColumns({"_u": rng.uniform_of(F.col("_h")), "_one": F.lit(1)})
    cum = ordered.cumulate(ordered.with_hash_slice(counts, "_u"), keys, ["_h"], {"upto": "n_v", "place": "_one"}, totals=True)
    n = F.col("total_upto")
    return cum.select(*keys, "value", ((F.col("upto") - F.col("n_v")) / n).alias("lo"), (F.col("upto") / n).alias("hi"), F.col("total_place").alias("k"))


@dataclass(frozen=True)
class Intervals:
    """Interval tables of several columns, written once, with the number of rows of each."""

    table: DataFrame
    sizes: dict[str, tuple[int, int]]
    types: dict[str, str]
    by: list[str]

    @staticmethod
    def fit(real: DataFrame, cols: list[str], by: list[str] | None = None, below: dict[str, int] | None = None) -> "Intervals":
        """``below`` keeps, for some columns, only the groups with fewer distinct values than stated."""
        table = interval_table(real, cols, by)
        for c, limit in (below or {}).items():
            table = table.where((F.col("column") != c) | (F.col("k") < limit))
        table = cut(table)
        counted = table.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length(F.col("value").cast("string"))).alias("widest")).collect()
        return Intervals(table, {r["column"]: (r["n"], (r["widest"] or 0) + 32) for r in counted}, dict(real.dtypes), by or [])

    def draw(self, rows_: DataFrame, c: str, u: Column, name: str | None = None, how: str = "inner") -> DataFrame:
        """Add column ``name`` drawn from column ``c``; the table is broadcast only below a counted size."""
        name = name or c
        iv = self.table.where(F.col("column") == c).drop("column", "k")
        # an interval is listed in the cells it meets: at most its count and the cells, once if there are no classes
        n, widest = self.sizes.get(c, (0, 0))
        listed = n + 16 * width(rows_.sparkSession)
        small = not self.by and listed <= BROADCAST_ROWS and listed * widest <= BROADCAST_BYTES
        out = draw(rows_, iv, u, "_drawn", self.by, how, small=small)
        return out.select(*rows_.columns, F.col("_drawn").cast(self.types[c]).alias(name))


def draw(draws: DataFrame, intervals: DataFrame, u: Column, name: str, by: list[str] | None = None, how: str = "inner", small: bool = False) -> DataFrame:
    """Look up the value whose interval holds u.

    [0, 1) is cut into cells; an interval is listed in every cell it touches and a draw probes its own cell only. A
    frequent value spans many cells, so its draws are spread over as many keys.
    """
    by = by or []
    cells = 16 * width(draws.sparkSession)
    first = F.floor(F.col("lo") * cells)
    last = F.greatest(F.ceil(F.col("hi") * cells) - 1, first)
    listed = intervals.select(*[F.col(b).alias(f"_k_{b}") for b in by], F.col("value").alias(name), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.explode(F.sequence(first, last)).alias("_cell"))
    probe = draws.withColumn("_u", u).withColumn("_at", F.floor(F.col("_u") * cells))
    cond = (F.col("_at") == F.col("_cell")) & (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))
    for b in by:
        cond = cond & (F.col(b) == F.col(f"_k_{b}"))
    out = probe.join(F.broadcast(listed) if small else listed, cond, how)
    return out.select(*draws.columns, name)


def gen_categorical(real: DataFrame, cols: list[str], n: int, seed: int = 42) -> DataFrame:
    """Each column drawn on its own from its observed frequencies; missing values are not drawn. A column without any
    value stays NULL; there are always n rows."""
    iv = Intervals.fit(real, cols)
    out = rows(real.sparkSession, n)
    for c in cols:
        out = iv.draw(out, c, rng.uniform(ROW, c, seed), how="left")
    return out


def gen_labels(real: DataFrame, target: str, n: int, seed: int = 42) -> DataFrame:
    return gen_categorical(real, [target], n, seed)


def gen_temporal(generated: DataFrame, time_col: str) -> DataFrame:
    """Add ``sequence``: the 1-based position of a generated row when ordered by its time column."""
    return ordered.rank_by_value(generated, time_col, ROW).withColumnRenamed("rn", "sequence")


def indexed(real: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Add ``idx`` 0..n-1 in keyed-hash order."""
    return ordered.rank_by_hash(real, key, "index", seed=seed).withColumn("idx", F.col("rn") - 1).drop("rn")


def gen_bootstrap(real: DataFrame, key: str, numeric: list[str], other: list[str], n: int, seed: int = 42) -> DataFrame:
    """Numbers from a normal fit; every other cell copied from a row of its own choice, missing values included.

    All copied cells go through one join on (column, index).
    """
    spark = real.sparkSession
    n_real = real.count()
    stats = numeric_stats(real, numeric, sample=True) if numeric else {}
    base = rows(spark, n)
    numbers = base.select(ROW, *[(F.lit(stats[c][0]) + F.lit(max(stats[c][1], 1e-6)) * rng.normal(ROW, c, seed)).alias(c) for c in numeric])
    if not other:
        return numbers
    cells = [F.struct(F.lit(c).alias("column"), rng.draw_index(ROW, f"{c}/boot", F.lit(n_real), seed).alias("idx")) for c in other]
    wanted = base.select(ROW, F.inline(F.array(*cells)))
    pool = indexed(real.select(key, *[F.col(c).cast("string").alias(f"v_{c}") for c in other]), key, seed)
    pool = pool.unpivot(["idx"], [f"v_{c}" for c in other], "column", "v").withColumn("column", F.substring("column", 3, 10_000))
    got = wanted.join(pool, ["column", "idx"]).groupBy(ROW).agg(*[F.max(F.when(F.col("column") == c, F.col("v"))).alias(c) for c in other])
    types = dict(real.dtypes)
    return numbers.join(got, ROW).select(ROW, *numeric, *[F.col(c).cast(types[c]).alias(c) for c in other])


def bootstrap_rows(real: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Whole rows with replacement."""
    n_real = real.count()
    wanted = rows(real.sparkSession, n).withColumn("idx", rng.draw_index(ROW, "rows/boot", F.lit(n_real), seed))
    return wanted.join(indexed(real, key, seed), "idx").drop("idx")


def gen_conditional(real: DataFrame, labels: DataFrame, target: str, numeric: list[str], text: list[str], seed: int = 42, narrow: int = 30) -> DataFrame:
    """Columns drawn given the class of each row.

    Text, and numbers with fewer than ``narrow`` distinct values inside the class, follow the class frequencies; other
    numbers are normal draws clipped to the class range.
    """
    out, drawn = labels, []
    if numeric:
        aggs = []
        for c in numeric:
            x = F.col(c).cast("double")
            aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_samp(x).alias(f"s_{c}"), F.min(x).alias(f"lo_{c}"), F.max(x).alias(f"hi_{c}"), F.approx_count_distinct(c).alias(f"d_{c}")]
        stats = cut(real.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("_class")).agg(*aggs))
        # columns that are wide in every class need no frequency table
        widths = stats.agg(*[F.min(f"d_{c}").alias(c) for c in numeric]).first()
        drawn = [c for c in numeric if (widths[c] or 0) <= 2 * narrow]
    if text or drawn:
        iv = Intervals.fit(real.where(F.col(target).isNotNull()), [*text, *drawn], [target], {c: narrow for c in drawn})
    for c in text:
        out = iv.draw(out, c, rng.uniform(ROW, f"{c}/cond", seed), how="left")
    if text:
        out = fall_back(real, labels, out, target, text, seed)
    if numeric:
        out = out.join(stats, F.col(target) == F.col("_class"), "left")
        for c in drawn:
            out = iv.draw(out, c, rng.uniform(ROW, f"{c}/cond", seed), f"_drawn_{c}", "left")
        # a normal draw is a column before it is compared: under a condition Spark would make it anew at every mention
        normal = {c: F.col(f"m_{c}") + F.greatest(F.coalesce(F.col(f"s_{c}"), F.lit(1e-6)), F.lit(1e-6)) * rng.normal(ROW, f"{c}/z", seed) for c in numeric}
        out = out.select("*", *[z.alias(f"_z_{c}") for c, z in normal.items()])
        cols = []
        for c in numeric:
            z = clip(F.col(f"_z_{c}"), F.col(f"lo_{c}"), F.col(f"hi_{c}"))
            cols.append((F.coalesce(f"_drawn_{c}", z) if c in drawn else z).cast("double").alias(c))
        out = out.select(*labels.columns, *text, *cols)
    return out


def fall_back(real: DataFrame, labels: DataFrame, out: DataFrame, target: str, text: list[str], seed: int) -> DataFrame:
    """Rows of a class that has no value in a column draw it from all classes; without any value it stays NULL."""
    held = real.groupBy(F.col(target).alias("_class")).agg(*[F.count(c).alias(f"_n{i}") for i, c in enumerate(text)])
    asked = labels.select(F.col(target).alias("_asked")).distinct().join(held, F.col("_asked") == F.col("_class"), "left")
    least = asked.agg(*[F.min(F.coalesce(f"_n{i}", F.lit(0))).alias(f"_n{i}") for i in range(len(text))]).first()
    short = [c for i, c in enumerate(text) if least[f"_n{i}"] == 0]
    if not short:
        return out
    whole = Intervals.fit(real, short)
    for c in short:
        out = whole.draw(out, c, rng.uniform(ROW, f"{c}/all", seed), f"_all_{c}", "left")
    return out.select(*[F.coalesce(c, f"_all_{c}").alias(c) if c in short else c for c in out.columns if c not in [f"_all_{x}" for x in short]])


def gen_ids(generated: DataFrame, key: str = ROW) -> DataFrame:
    """Synthetic file names from the row number, or from another key."""
    return generated.withColumn("synthetic_id", F.concat(F.lit("synth_"), F.substring(F.md5(F.col(key).cast("string")), 1, 8), F.lit(".png")))


def gen_metadata(real: DataFrame, path_col: str | None, categorical: list[str], numeric: list[str], n: int, epsilon: float = 1.0, seed: int = 42) -> DataFrame:
    """Metadata rows: frequencies for categorical columns, noisy normals for the rest, fresh identifiers for the path column."""
    stats = numeric_stats(real, numeric, sample=True) if numeric else {}
    out = gen_categorical(real, categorical, n, seed)
    out = gen_ids(out).select("*", *[numeric_column(c, stats[c], epsilon, n, seed) for c in numeric])
    if path_col:
        out = out.withColumnRenamed("synthetic_id", path_col)
    return out.select(ROW, *[c for c in real.columns if c in out.columns])


def covariance(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., n, mean array, row-major covariance array) over complete cases in one pass."""
    by = by or []
    r, d = range(len(cols)), len(cols)
    mean = F.array(*[F.col("shift")[i] + F.col("s")[i] / F.col("n") for i in r])
    return moments(df, cols, by).select(*by, "n", mean.alias("mean"), F.array(*[covariance_at(i, j, d) for i in r for j in r]).alias("cov"))


def _factor(flat) -> list[float]:
    """Row-major lower factor of one covariance matrix; directions without variance are left at zero."""
    d = int(round(len(flat) ** 0.5))
    m = np.array(flat, dtype=float).reshape(d, d)
    try:
        low = np.linalg.cholesky(m)
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(m)
        low = np.linalg.qr((vectors * np.sqrt(np.maximum(values, 0.0))).T)[1].T
        low = low * np.where(np.diag(low) < 0, -1.0, 1.0)
    return [float(x) for x in low.ravel()]


@F.pandas_udf(ArrayType(DoubleType()))
def lower_factor(cov: pd.Series) -> pd.Series:
    """One small matrix per class row."""
    return cov.map(_factor)


def _mixed(cols: list[str], mean, low, seed: int) -> list[Column]:
    z = [rng.normal(ROW, f"{c}/z", seed) for c in cols]
    d = len(cols)
    out = []
    for i, c in enumerate(cols):
        x = mean(i)
        for j in range(i + 1):
            x = x + low(i * d + j) * z[j]
        out.append(x.alias(c))
    return out


def correlated_columns(real: DataFrame, cols: list[str], seed: int = 42) -> list[Column]:
    """Joint normal columns over the row id with the real means and covariances; one d x d matrix is factored on the driver."""
    row = covariance(real, cols).first()
    low = _factor(row["cov"])
    return _mixed(cols, lambda i: F.lit(row["mean"][i]), lambda i: F.lit(low[i]), seed)


def gen_correlated(real: DataFrame, cols: list[str], n: int, seed: int = 42) -> DataFrame:
    return rows(real.sparkSession, n).select(ROW, *correlated_columns(real, cols, seed))


def gen_correlated_by_class(real: DataFrame, labels: DataFrame, target: str, cols: list[str], seed: int = 42) -> DataFrame:
    """The same within each class; every class row carries its own factor."""
    fit = covariance(real, cols, [target]).select(F.col(target).alias("_class"), "mean", lower_factor("cov").alias("low"))
    classes = real.agg(F.count_distinct(target)).first()[0]
    small = 8 * classes * len(cols) * (len(cols) + 1) <= BROADCAST_BYTES  # a mean and a factor each
    j = labels.join(F.broadcast(fit) if small else fit, F.col(target) == F.col("_class"))
    return j.select(*labels.columns, *_mixed(cols, lambda i: F.col("mean")[i], lambda i: F.col("low")[i], seed))


def gen_copula(real: DataFrame, cols: list[str], n: int, seed: int = 42) -> DataFrame:
    """Rows with the real marginals and about the real rank correlation.

    Correlated normal scores are drawn, then each column's r-th smallest score is replaced by the value at the same
    relative rank of the real column. Ranks are exact and computed in slices. Columns are taken without missing values.
    """
    real = real.dropna(subset=cols)
    scores = gen_correlated(real, cols, n, seed)
    n_real = real.count()
    base = pairs.sliced_long(scores, cols, [ROW]).withColumn("_one", F.lit(1))
    ranked = ordered.cumulate(base, ["column"], ["v", ROW], {"rn": "_one"}).select(ROW, "column", F.floor((F.col("rn") - 1) * n_real / n).alias("idx"))
    # the real side enters as counts per value, so frequent values are one row each
    counts = pairs.sliced_long(real.select(*cols), cols, []).groupBy("column", ordered.SLICE, "v").agg(F.count(F.lit(1)).alias("n_v"))
    cum = ordered.cumulate(counts, ["column"], ["v"], {"upto": "n_v"}, totals=True)
    iv = cum.select("column", F.col("v").alias("value"), ((F.col("upto") - F.col("n_v")) / F.col("total_upto")).alias("lo"), (F.col("upto") / F.col("total_upto")).alias("hi"))
    j = draw(ranked, iv, (F.col("idx") + 0.5) / n_real, "v", ["column"])
    return j.groupBy(ROW).agg(*[F.max(F.when(F.col("column") == c, F.col("v"))).alias(c) for c in cols])


def blend_numeric(real: DataFrame, first: DataFrame, second: DataFrame, cols: list[str]) -> DataFrame:
    """Row-wise weighted mean of two candidate tables; a column leans to the candidate with the smaller KS distance."""
    weights = {}
    for name, cand in (("a", first), ("b", second)):
        d = compare.cdf_distances(pairs.make_pair(real.select(*cols), cand.select(*cols)), cols).select("column", "ks").collect()
        weights[name] = {r["column"]: 1.0 / (r["ks"] + 1e-6) for r in d}
    j = first.select(ROW, *[F.col(c).alias(f"a_{c}") for c in cols]).join(second.select(ROW, *[F.col(c).alias(f"b_{c}") for c in cols]), ROW)
    out = []
    for c in cols:
        wa, wb = weights["a"][c], weights["b"][c]
        out.append((F.col(f"a_{c}") * F.lit(wa / (wa + wb)) + F.col(f"b_{c}") * F.lit(wb / (wa + wb))).alias(c))
    return j.select(ROW, *out)


def blend_categorical(real: DataFrame, first: DataFrame, second: DataFrame, cols: list[str]) -> DataFrame:
    """Per column, the candidate closer to the real frequencies; the first one on ties."""
    dist = {}
    for name, cand in (("a", first), ("b", second)):
        d = compare.jsd_categorical(pairs.make_pair(real.select(*cols), cand.select(*cols)), cols, limit=len(cols)).collect()
        dist[name] = {r["column"]: r["distance"] for r in d}
    j = first.select(ROW, *[F.col(c).alias(f"a_{c}") for c in cols]).join(second.select(ROW, *[F.col(c).alias(f"b_{c}") for c in cols]), ROW)
    return j.select(ROW, *[F.col(f"a_{c}" if dist["a"][c] <= dist["b"][c] else f"b_{c}").alias(c) for c in cols])
