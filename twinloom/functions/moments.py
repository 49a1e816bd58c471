"""First and second moments of several columns at once, in one pass of mergeable sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from twinloom.functions import pairs

WIDE = 16


def moments(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., n, s, p, flat, shift) over complete cases, around a common shift (the overall mean of each column):
    sums ``s``, row-major product sums ``p``, and per column whether it holds one value only (``flat``).

    Up to 16 columns the sums are plain aggregates. Beyond, every Arrow batch is reduced to one Gram matrix per group
    inside the task, and those small matrices are summed.
    """
    by = by or []
    view = pairs.numeric_view(df, cols, by).dropna(subset=cols)
    means = view.agg(*[F.avg(c) for c in cols]).first()
    shift = [float(m or 0.0) for m in means]
    centred = view.select(*by, *[(F.col(c) - F.lit(m)).alias(f"x{i}") for i, (c, m) in enumerate(zip(cols, shift))])
    d = len(cols)
    got = _by_aggregates(centred, d, by) if d <= WIDE else _by_blocks(centred, d, by)
    return got.withColumn("shift", F.array(*[F.lit(m) for m in shift]))


def _by_aggregates(centred: DataFrame, d: int, by: list[str]) -> DataFrame:
    x = [F.col(f"x{i}") for i in range(d)]
    aggs = [F.sum(x[i]).alias(f"s{i}") for i in range(d)]
    aggs += [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    aggs += [f(x[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("lo", F.min), ("hi", F.max))]
    row = centred.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs)
    r = range(d)
    return row.select(
        *by, "n", F.array(*[F.col(f"s{i}") for i in r]).alias("s"), F.array(*[F.col(f"p{min(i, j)}_{max(i, j)}") for i in r for j in r]).alias("p"),
        F.array(*[F.col(f"lo{i}") == F.col(f"hi{i}") for i in r]).alias("flat"))


def _by_blocks(centred: DataFrame, d: int, by: list[str]) -> DataFrame:
    names = [f"x{i}" for i in range(d)]

    def reduce(batches):
        for pdf in batches:
            groups = pdf.groupby(by, dropna=False) if by else [((), pdf)]
            for k, g in groups:
                m = g[names].to_numpy(dtype=float)
                if len(m):
                    stats = np.concatenate([m.sum(axis=0), (m.T @ m).ravel()])
                    yield pd.DataFrame([[*(k if isinstance(k, tuple) else (k,)), len(m), stats, m.min(axis=0), m.max(axis=0)]], columns=[*by, "n", "v", "lo", "hi"])

    fields = {c: t for c, t in centred.dtypes}
    schema = ", ".join([*[f"{b} {fields[b]}" for b in by], "n bigint, v array<double>, lo array<double>, hi array<double>"])
    part = centred.mapInPandas(reduce, schema)
    keys = [F.col(b) for b in by]
    n = part.groupBy(*keys).agg(F.sum("n").alias("n"))
    cells = part.select(*by, F.posexplode("v").alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"))
    sums = cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("v"))
    ends = part.select(*by, F.posexplode(F.arrays_zip("lo", "hi")).alias("i", "e")).groupBy(*keys, "i").agg((F.min("e.lo") == F.max("e.hi")).alias("f"))
    flats = ends.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "f"))), lambda c: c["f"]).alias("flat"))
    if by:
        out = n.join(sums, by).join(flats, by)
    else:
        out = n.select("n", sums.select("v").scalar().alias("v"), flats.select("flat").scalar().alias("flat")).where(F.col("n").isNotNull())
    return out.select(*by, "n", F.slice("v", 1, d).alias("s"), F.slice("v", d + 1, d * d).alias("p"), "flat")


def covariance_at(i: int, j: int, d: int):
    """Population covariance of columns i and j from a row of moments."""
    return F.col("p")[i * d + j] / F.col("n") - (F.col("s")[i] / F.col("n")) * (F.col("s")[j] / F.col("n"))
