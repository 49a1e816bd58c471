"""Table profiles: size, sparsity, imbalance, cardinality. All are mergeable aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from twinloom.functions import pairs
from twinloom.functions.pairs import REAL, SIDE, SYNTH
from twinloom.functions.scalars import clip


def sparsity_of(df: DataFrame, numeric: list[str]) -> tuple[Column, Column]:
    """(null fraction of all cells, zero fraction of numeric cells); a missing number is not a zero."""
    k, m = len(df.columns), len(numeric)
    nulls = sum((F.count(F.lit(1)) - F.count(c) for c in df.columns[1:]), F.count(F.lit(1)) - F.count(df.columns[0]))
    null_frac = F.coalesce(nulls / (F.nullif(F.count(F.lit(1)), F.lit(0)) * k), F.lit(0.0))
    if not m:
        return null_frac, F.lit(0.0)
    zeros = sum((F.count_if(F.col(c) == 0) for c in numeric[1:]), F.count_if(F.col(numeric[0]) == 0))
    return null_frac, F.coalesce(zeros / (F.nullif(F.count(F.lit(1)), F.lit(0)) * m), F.lit(0.0))


def sparsity(df: DataFrame) -> DataFrame:
    nulls, zeros = sparsity_of(df, pairs.numeric_columns(df))
    return df.agg(nulls.alias("null_frac"), zeros.alias("zero_frac")).select(
        "null_frac", "zero_frac", F.least(F.col("null_frac") + 0.5 * F.col("zero_frac"), F.lit(1.0)).alias("sparsity"))


def imbalance(df: DataFrame, target: str) -> DataFrame:
    """Largest over smallest class; 1.0 below two classes."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    ratio = F.when(F.count(F.lit(1)) >= 2, F.max("n") / F.min("n")).otherwise(F.lit(1.0))
    return counts.agg(F.count(F.lit(1)).alias("n_classes"), ratio.alias("imbalance"))


def profile(df: DataFrame, name: str, target: str | None = None) -> DataFrame:
    """One row per table."""
    num = pairs.numeric_columns(df)
    has = target is not None and target in df.columns
    nulls, zeros = sparsity_of(df, num)
    base = df.agg(F.count(F.lit(1)).alias("n_rows"), nulls.alias("nf"), zeros.alias("zf"))
    ratio = imbalance(df, target).select("imbalance").scalar() if has else F.lit(1.0)
    return base.select(
        F.lit(name).alias("dataset"), "n_rows", F.lit(len(df.columns)).alias("n_cols"), F.lit(len(num)).alias("n_numeric"),
        F.lit(len(df.columns) - len(num)).alias("n_categorical"), F.least(F.col("nf") + 0.5 * F.col("zf"), F.lit(1.0)).alias("sparsity"),
        ratio.alias("imbalance"), F.lit(has).alias("has_target"), F.col("nf").alias("null_frac"))


def meta_features(df: DataFrame, name: str, target: str | None = None, approximate: bool = False) -> DataFrame:
    """The profile plus a missing-values flag and the mean distinct count of non-numeric columns.

    Long text is compared by digest, so only 16 bytes per value are shuffled.
    """
    num = pairs.numeric_columns(df)
    cats = [(c, t) for c, t in df.dtypes if c not in num]
    p = profile(df, name, target)
    if cats:
        keys = [F.unhex(F.md5(F.col(c))) if t == "string" else F.col(c) for c, t in cats]
        each = [F.approx_count_distinct(k) if approximate else F.count_distinct(k) for k in keys]
        total = sum(each[1:], each[0])
        mean = df.agg((total / len(cats)).alias("m")).scalar()
    else:
        mean = F.lit(0.0)
    return p.select("dataset", "n_rows", "n_cols", "n_numeric", "n_categorical", "sparsity", "imbalance",
                    (F.col("null_frac") > 0.01).cast("double").alias("has_missing"), mean.alias("mean_cardinality"))


def diversity(pair: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Mean synthetic deviation over mean real deviation, in [0, 1]."""
    cols = cols or pairs.numeric_columns(pair)
    view = pairs.numeric_view(pair, cols, [SIDE])

    def mean_sd(side: str) -> Column:
        each = [F.stddev_samp(F.when(F.col(SIDE) == side, F.col(c))) for c in cols]
        seen = sum((F.when(e.isNotNull(), 1).otherwise(0) for e in each[1:]), F.when(each[0].isNotNull(), 1).otherwise(0))
        return sum((F.coalesce(e, F.lit(0.0)) for e in each[1:]), F.coalesce(each[0], F.lit(0.0))) / F.nullif(seen, F.lit(0))

    sds = view.agg(mean_sd(REAL).alias("sd_real"), mean_sd(SYNTH).alias("sd_synth"))
    return sds.select("sd_real", "sd_synth", clip(F.col("sd_synth") / (F.col("sd_real") + 1e-6)).alias("diversity"))


def class_distribution(pair: DataFrame, target: str) -> DataFrame:
    return pair.where(F.col(target).isNotNull()).groupBy(SIDE, F.col(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def size_ratio(pair: DataFrame, model: str) -> DataFrame:
    c = pair.agg(F.count_if(F.col(SIDE) == REAL).alias("n_real"), F.count_if(F.col(SIDE) == SYNTH).alias("n_synth"))
    return c.select("n_real", "n_synth", (F.col("n_synth") / F.nullif(F.col("n_real"), F.lit(0))).alias("ratio"), F.upper(F.lit(model)).alias("model"))
