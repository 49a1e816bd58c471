"""Small numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def clip(x: Column, lo=0.0, hi=1.0) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL."""
    lo_c = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi_c = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(x < lo_c, lo_c).when(x > hi_c, hi_c).otherwise(x)


def finite_or(x: Column, fallback: float) -> Column:
    """x when it is a finite number, else the fallback."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(float(fallback))).otherwise(x)


def r6(x: Column) -> Column:
    return F.round(x, 6)


def one_row(df: DataFrame) -> Column:
    """A one-row DataFrame as a struct-valued scalar subquery; Spark runs it once and inlines it."""
    return df.select(F.struct(*df.columns)).scalar()


def safe_div(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))
