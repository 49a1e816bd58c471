"""Preparation: scale, encode, invert, clamp, balance, sample, split, compress."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from twinloom.functions import ordered, pairs, rng
from twinloom.functions.blocks import matrix, summed
from twinloom.functions.scalars import clip
from twinloom.session import cut

ONE_HOT_NAME = r"^(.+)_([^_]+)$"
SMALL_VOCABULARY = 100_000


@dataclass(frozen=True)
class Scaler:
    """Column means and population deviations; a zero deviation counts as one."""

    stats: dict[str, tuple[float, float]]

    @staticmethod
    def fit(df: DataFrame, cols: list[str]) -> "Scaler":
        """One aggregate pass; two numbers per column reach the driver."""
        row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        return Scaler({c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in cols})

    def scaled(self, c: str) -> Column:
        mu, sd = self.stats[c]
        return (F.col(c).cast("double") - F.lit(mu)) / F.lit(sd)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.scaled(c).alias(c) if c in self.stats else F.col(c) for c in df.columns])

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.select(*[(F.col(c) * F.lit(self.stats[c][1]) + F.lit(self.stats[c][0])).alias(c) if c in self.stats else F.col(c) for c in df.columns])


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code): codes follow the sorted order of the values as text. A large vocabulary is ranked range by range."""
    values = df.select(F.col(col).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
    size = df.agg(F.approx_count_distinct(col).alias("n")).first()["n"]
    if size <= SMALL_VOCABULARY:
        return values.select("value", (F.row_number().over(Window.orderBy("value")) - 1).cast("long").alias("code"))
    sliced = ordered.with_range_slice(values, "value").withColumn("_one", F.lit(1))
    return ordered.cumulate(sliced, [], ["value"], {"rn": "_one"}).select("value", (F.col("rn") - 1).alias("code"))


def label_encode(df: DataFrame, col: str, codes: DataFrame | None = None) -> DataFrame:
    """Replace a column by its code. The join side is broadcast only if Spark measures it as small."""
    codes = codes if codes is not None else label_codes(df, col)
    names = codes.select(F.col("value").alias("_label"), F.col("code").alias("_code"))
    j = df.join(names, F.col(col).cast("string") == F.col("_label"), "left")
    return j.select(*[F.col("_code").alias(c) if c == col else F.col(c) for c in df.columns])


def label_decode(df: DataFrame, col: str, codes: DataFrame) -> DataFrame:
    """Nearest valid code back to its label: round half to even, clip to the known range."""
    top = codes.agg(F.max("code").alias("k")).scalar()
    near = F.least(F.greatest(F.bround(col, 0).cast("long"), F.lit(0)), top)
    names = codes.select(F.col("code").alias("_near"), F.col("value").alias("_label"))
    j = df.withColumn("_near", near).join(names, "_near", "left")
    return j.select(*[F.col("_label").alias(c) if c == col else F.col(c) for c in df.columns])


def one_hot_groups(df: DataFrame, target: str | None = None) -> DataFrame:
    """(prefix, members): numeric columns sharing a name prefix, at least two, holding only 0 and 1."""
    num = [c for c in pairs.numeric_columns(df) if c != target]
    others = [c for c in df.columns if c not in num and c != target]
    aggs = [F.coalesce(F.bool_and(F.col(c).isin(0, 1)), F.lit(True)).alias(c) for c in num]
    flags = [F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), (F.col(c) if c in num else F.lit(False)).alias("binary")) for i, c in enumerate(df.columns) if c in num or c in others]
    long = df.agg(*aggs).select(F.inline(F.array(*flags)))
    named = long.withColumn("prefix", F.regexp_extract("column", ONE_HOT_NAME, 1)).where(F.col("prefix") != "")
    g = named.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.bool_and("binary").alias("ok"), F.array_sort(F.collect_list(F.struct("ordinal", "column"))).alias("m"))
    return g.where((F.col("n") >= 2) & F.col("ok")).select("prefix", F.transform("m", lambda x: x["column"]).alias("members"))


def one_hot_collapse(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Each group becomes one label column: the member holding the (first) largest value."""
    dropped = {c for m in groups.values() for c in m}
    labels = []
    for prefix, members in groups.items():
        arr = F.array(*[F.col(c).cast("double") for c in members])
        names = F.array(*[F.lit(c[len(prefix) + 1:]) for c in members])
        labels.append(F.element_at(names, F.array_position(arr, F.array_max(arr)).cast("int")).alias(prefix))
    return df.select(*[c for c in df.columns if c not in dropped], *labels)


def decimal_places(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most digits after the point in each column, over all rows (a whole double such as 1.0 has one)."""
    types = dict(df.dtypes)
    aggs = []
    for c in cols:
        if types[c] in pairs.INTEGRAL:
            aggs.append(F.lit(0).alias(c))
        else:
            digits = F.regexp_replace(F.split_part(F.col(c).cast("decimal(38,15)").cast("string"), F.lit("."), F.lit(2)), "0+$", "")
            aggs.append(F.greatest(F.coalesce(F.max(F.length(digits)), F.lit(0)), F.lit(1)).alias(c))
    row = [F.struct(F.lit(c).alias("column"), F.col(c).alias("decimals")) for c in cols]
    return df.agg(*aggs).select(F.inline(F.array(*row)))


@dataclass(frozen=True)
class Ranges:
    """Per numeric column: real minimum, maximum, decimals, integral or not."""

    stats: dict[str, tuple[float, float, int, bool]]

    @staticmethod
    def fit(real: DataFrame, cols: list[str]) -> "Ranges":
        types = dict(real.dtypes)
        row = real.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]).first()
        dec = {r["column"]: r["decimals"] for r in decimal_places(real, cols).collect()}
        return Ranges({c: (row[f"lo_{c}"], row[f"hi_{c}"], dec[c], types[c] in pairs.INTEGRAL) for c in cols if row[f"lo_{c}"] is not None})

    def restore(self, df: DataFrame) -> DataFrame:
        """Clamp to the real range, then whole numbers for integral columns and the real precision for the others."""

        def fix(c: str) -> Column:
            lo, hi, dec, whole = self.stats[c]
            x = clip(F.col(c).cast("double"), lo, hi)
            return (F.bround(x, 0).cast("long") if whole else F.bround(x, dec)).alias(c)

        return df.select(*[fix(c) if c in self.stats else F.col(c) for c in df.columns])


def enforce(df: DataFrame, real: DataFrame) -> DataFrame:
    """Exactly the real table's columns in its order: missing ones filled (0 or ""), extra ones dropped."""
    have = set(df.columns)

    def fill(c: str, t: str) -> Column:
        if c in have:
            return F.col(c).try_cast(t).alias(c)
        if pairs.is_numeric(t):
            return F.lit(0).cast(t).alias(c)
        return (F.lit("") if t == "string" else F.lit(None).cast(t)).alias(c)

    return df.select(*[fill(c, t) for c, t in real.dtypes])


def discrete_to_string(df: DataFrame, cols: list[str]) -> DataFrame:
    """Discrete columns as text; a missing value stays missing."""
    return df.select(*[F.col(c).cast("string").alias(c) if c in cols else F.col(c) for c in df.columns])


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def balance_classes(df: DataFrame, target: str, key: str, seed: int = 42) -> DataFrame:
    """Even out class sizes: each class gives min(N // K, 4 * its size) rows.

    Large classes are thinned without replacement, small ones are drawn with replacement. Ranks inside a class are
    computed over slices of a keyed hash, and draw slots come from the rows themselves (four per row), so a class that
    holds most of the table is still spread over all tasks. Rows without a class belong to none: they are not drawn.
    """
    sizes = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("_n_c"))
    whole = sizes.agg(F.greatest(F.floor(F.sum("_n_c") / F.count(F.lit(1))), F.lit(1)).alias("per")).scalar()
    plan = sizes.select(F.col(target).alias("_class"), "_n_c", F.least(whole, F.col("_n_c") * 4).alias("_draw"))
    ranked = ordered.rank_by_hash(df.where(F.col(target).isNotNull()), key, "balance", [target], seed)
    j = ranked.join(plan, F.col(target) == F.col("_class"))
    thinned = j.where((F.col("_n_c") >= F.col("_draw")) & (F.col("rn") <= F.col("_draw"))).select(*df.columns, F.col("rn").alias("slot"))
    small = F.col("_n_c") < F.col("_draw")
    slots = j.where(small).select("_class", "_n_c", "_draw", F.explode(F.sequence((F.col("rn") - 1) * 4 + 1, F.col("rn") * 4)).alias("slot"))
    slots = slots.where(F.col("slot") <= F.col("_draw"))
    pick = rng.draw_index(F.concat(F.col("_class").cast("string"), F.lit("/"), F.col("slot").cast("string")), "balance-draw", F.col("_n_c"), seed) + 1
    drawn = slots.select(F.col("_class"), pick.alias("rn"), "slot").join(j.where(small).drop("_n_c", "_draw"), ["_class", "rn"]).select(*df.columns, "slot")
    return thinned.unionByName(drawn)


def subsample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement: the n smallest keyed hashes."""
    return df.withColumn("_u", rng.uniform(key, "subsample", seed)).orderBy("_u", key).limit(n).drop("_u")


def split_holdout(df: DataFrame, key: str, train: float = 0.6, seed: int = 42) -> DataFrame:
    """Add ``part`` (train or holdout) by a keyed hash; no shuffle."""
    return df.withColumn("part", F.when(rng.uniform(key, "holdout", seed) < train, "train").otherwise("holdout"))


def split_stratified(df: DataFrame, key: str, target: str, train: float = 0.7, seed: int = 42) -> DataFrame:
    """Add ``part`` so that every class is split in the same proportion."""
    r = ordered.rank_by_hash(df, key, "strata", [target], seed, total="_n_c")
    return r.withColumn("part", F.when((F.col("rn") - 1) / F.col("_n_c") < train, "train").otherwise("holdout")).drop("rn", "_n_c")


#: Directions searched beside twice the wanted ones; gain of captured variance, as a share of it, below which the search ends.
SPARE, GAIN, PASSES = 10, 1e-11, 300


@dataclass(frozen=True)
class Compressor:
    """Principal components of wide numeric tables, by subspace iteration.

    A pass multiplies the covariance with a set of directions inside the tasks, without forming it: only (columns x directions)
    sums leave them. There are twice the wanted directions and ten more; up to so many columns the first pass is exact, beyond
    that passes go on until the captured variance stops growing. The driver holds these directions and a matrix of their
    products, nothing of columns x columns. Each component's largest weight is positive (ties: the first), so signs are
    fixed. NULL counts as 0. Without rows, or without spread, any directions do, and the means are what there is.
    """

    cols: list[str]
    directions: np.ndarray
    means: list[float]

    @staticmethod
    def fit(df: DataFrame, cols: list[str], components: int = 50, seed: int = 42) -> "Compressor":
        view = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(cols)])
        means = [m or 0.0 for m in view.agg(*[F.avg(f"x{i}") for i in range(len(cols))]).first()]
        d, k = len(cols), min(components, len(cols))
        wide = min(d, 2 * k + SPARE)
        rows = view.select(F.array(*[F.col(f"x{i}") - F.lit(m) for i, m in enumerate(means)]).alias("x"))
        rows = rows if wide == d else cut(rows)
        q = np.eye(d) if wide == d else np.linalg.qr(np.random.default_rng(seed).normal(size=(d, wide)))[0]
        before = -1.0
        for _ in range(PASSES):

            def product(batch: pa.RecordBatch, q: np.ndarray = q) -> np.ndarray:
                x = matrix(batch, "x")
                return (x.T @ (x @ q)).ravel()

            z = summed(rows, d * wide, product).reshape(d, wide)
            inner = q.T @ z
            value, turn = np.linalg.eigh((inner + inner.T) / 2)
            best = (q @ turn)[:, ::-1][:, :k]
            captured = value[::-1][:k].sum()
            if wide == d or captured - before <= GAIN * captured:
                break
            before, q = captured, np.linalg.qr(z)[0]
        largest = best[np.abs(best).argmax(axis=0), np.arange(k)]
        return Compressor(cols, best * np.where(largest < 0, -1.0, 1.0), means)

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        directions = self.directions

        @F.pandas_udf("array<double>")
        def projected(x: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(x.to_list()) @ directions) if len(x) else [], dtype=object)

        centred = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(m) for c, m in zip(self.cols, self.means)])
        return df.select(*keep, projected(centred).alias("components"))

    def inverse(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Back to the original columns as one weighted sum per column."""
        cols = []
        for i, c in enumerate(self.cols):
            weights = F.array(*[F.lit(float(x)) for x in self.directions[i]])
            dot = F.aggregate(F.zip_with("components", weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
            cols.append((dot + F.lit(self.means[i])).alias(c))
        return df.select(*keep, *cols)


def compress_wide(df: DataFrame, keep: list[str], trigger: int = 100, components: int = 50) -> DataFrame:
    """Numeric columns as components when there are more than ``trigger`` of them, else unchanged. All others are carried."""
    num = [c for c in pairs.numeric_columns(df) if c not in keep]
    if len(num) <= trigger:
        return df
    return Compressor.fit(df, num, components).transform(df, [*keep, *[c for c in df.columns if c not in num and c not in keep]])
