"""Real/synthetic pairs: one DataFrame with a ``side`` column, so both sides share each scan and shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from twinloom.functions import ordered

SIDE, REAL, SYNTH = "side", "real", "synth"
NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}
INTEGRAL = {"tinyint", "smallint", "int", "bigint"}


def make_pair(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Stack two tables by column name; columns missing from one side become NULL there."""
    shared = [c for c in real.columns if c in synth.columns]
    return real.select(F.lit(REAL).alias(SIDE), *shared).unionByName(synth.select(F.lit(SYNTH).alias(SIDE), *shared))


def is_numeric(dtype: str) -> bool:
    return dtype in NUMERIC or dtype.startswith("decimal")


def numeric_columns(df: DataFrame, limit: int | None = None) -> list[str]:
    cols = [c for c, t in df.dtypes if is_numeric(t) and c != SIDE]
    return cols[:limit] if limit else cols


def string_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string" and c != SIDE]


def as_double(c: str, dtype: str) -> Column:
    """Lenient numeric view: text that is no number and NaN become NULL."""
    x = F.col(c).try_cast("double") if dtype == "string" else F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def numeric_view(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    types = dict(df.dtypes)
    return df.select(*(keep or []), *[as_double(c, types[c]).alias(c) for c in cols])


def unpivot(df: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    """Long form (keep..., column, v); all columns have one type."""
    return df.unpivot(keep, cols, "column", "v")


def sliced_long(pair: DataFrame, cols: list[str], keep: list[str], slices: int | None = None) -> DataFrame:
    """Long form with the value slice of each cell, NULLs dropped."""
    wide = ordered.slice_columns(numeric_view(pair, cols, keep), cols, slices)
    cells = F.inline(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{ordered.SLICE}_{c}").cast("int").alias(ordered.SLICE), F.col(c).alias("v")) for c in cols])
    )
    return wide.select(*keep, cells).where(F.col("v").isNotNull())


def counts_by_value(pair: DataFrame, cols: list[str], slices: int | None = None) -> DataFrame:
    """(column, slice, v, r, s): how often each value occurs on each side; combined map-side before the shuffle."""
    long = sliced_long(pair, cols, [SIDE], slices)
    return long.groupBy("column", ordered.SLICE, "v").agg(
        F.count_if(F.col(SIDE) == REAL).alias("r"), F.count_if(F.col(SIDE) == SYNTH).alias("s")
    )


def cdf(pair: DataFrame, cols: list[str], slices: int | None = None) -> DataFrame:
    """Both empirical CDFs at every value of every column: (column, v, next_v, r, s, fr, fs, n_r, n_s)."""
    cum = ordered.cumulate(counts_by_value(pair, cols, slices), ["column"], ["v"], {"cr": "r", "cs": "s"}, totals=True, next_of="v")
    return cum.select(
        "column", "v", "next_v", "r", "s", "cr", "cs",
        (F.col("cr") / F.col("total_cr")).alias("fr"), (F.col("cs") / F.col("total_cs")).alias("fs"),
        F.col("total_cr").alias("n_r"), F.col("total_cs").alias("n_s"),
    )
