"""Ordering work that stays parallel: running sums, ranks, neighbours and exact quantiles.

A window over one big group is one task. Here the order is first cut into slices (value ranges found by
an approximate-quantile pass, or ranges of a uniform hash), the window runs inside each slice, and a
table with one row per (group, slice) carries what crosses slice borders. Results are exact whatever the
cut points are.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from twinloom.functions import rng
from twinloom.session import cut, width

SLICE = "_slice"


def cut_points(df: DataFrame, cols: list[str], slices: int) -> dict[str, list[float]]:
    """Approximate quantiles per column from mergeable KLL sketches: one pass, and ``slices - 1`` numbers a column reach
    the driver. Their error only affects how even the slices are. A value that fills several slices is repeated."""
    probs = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    k = min(8192, max(200, 4 * slices))
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.kll_sketch_agg_double(v, k).alias(f"s{i}")]
    cuts = [F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", probs)).alias(c) for i, c in enumerate(cols)]
    row = df.agg(*aggs).select(*cuts).first()
    return {c: sorted(x for x in (row[c] or []) if x is not None) for c in cols}


def edges(cuts: list[float]) -> list[float]:
    """Cut points as Bucketizer splits, which need at least one inner point."""
    return [float("-inf"), *(sorted({c for c in cuts if abs(c) != float("inf")}) or [0.0]), float("inf")]


def slice_columns(df: DataFrame, cols: list[str], slices: int | None = None, prefix: str = SLICE) -> DataFrame:
    """Add ``{prefix}_{col}``: the value range each row of a double column falls in (binary search, JVM side)."""
    slices = slices or width(df.sparkSession)
    cuts = cut_points(df, cols, slices)
    return Bucketizer(
        splitsArray=[edges(cuts[c]) for c in cols], inputCols=cols, outputCols=[f"{prefix}_{c}" for c in cols], handleInvalid="keep"
    ).transform(df)


def with_value_slice(df: DataFrame, order: str, slices: int | None = None, tie: str | None = None) -> DataFrame:
    """Slice by one numeric or timestamp column.

    Equal values cannot be told apart by value. With a numeric ``tie`` column that orders them, the rows of a value
    frequent enough to fill whole slices are sliced further by it. Rows without an order value come first, in tie order.
    """
    slices = slices or width(df.sparkSession)
    held = df.withColumn("_order_d", numeric_order(df, order))
    cols = ["_order_d"]
    if tie:
        held = held.withColumn("_tie_d", numeric_order(df, tie))
        cols.append("_tie_d")
    cuts = cut_points(held, cols, slices)
    placed = Bucketizer(splitsArray=[edges(cuts[c]) for c in cols], inputCols=cols, outputCols=[f"_s{c}" for c in cols], handleInvalid="keep").transform(held)
    at = F.coalesce(F.col("_s_order_d").cast("long"), F.lit(-1))
    if tie:
        # a frequent value opens its slice: its rows come first, in tie order, then the rest of the slice
        often = sorted({v for v, w in zip(cuts["_order_d"], cuts["_order_d"][1:]) if v == w})
        split = F.col("_order_d").isNull() | F.array_contains(F.array(*[F.lit(v) for v in often]).cast("array<double>"), F.col("_order_d"))
        span = slices + 3
        at = at * span + F.when(split, F.coalesce(F.col("_s_tie_d").cast("long") + 1, F.lit(0))).otherwise(F.lit(span - 1))
    return placed.select(*df.columns, at.alias(SLICE))


def numeric_order(df: DataFrame, order: str) -> Column:
    """A double that never decreases as the column grows; used for slicing only, not for the order itself."""
    if dict(df.dtypes)[order] == "timestamp_ntz":
        return F.col(order).cast("timestamp").cast("double")
    return F.col(order).cast("double")


def with_range_slice(df: DataFrame, order: str) -> DataFrame:
    """Slice a column of any type by a range exchange. The slice numbers are fixed by a checkpoint, so a lost
    executor cannot renumber them."""
    n = width(df.sparkSession)
    return cut(df.repartitionByRange(n, order).withColumn(SLICE, F.spark_partition_id()))


def with_hash_slice(df: DataFrame, u: str, slices: int | None = None) -> DataFrame:
    """Slice by a uniform column: balanced without looking at the data."""
    n = slices or width(df.sparkSession)
    return df.withColumn(SLICE, F.floor(F.col(u) * n).cast("int"))


def join_back(rows: DataFrame, borders: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of its (group, slice) in ``borders``. NULL groups and the slice of NULL order values match
    themselves, so no row is lost."""
    held = borders.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], *[c for c in borders.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_j{i}"))
    return rows.join(held, on).drop(*[f"_j{i}" for i in range(len(keys))])


def _group(by: list[str]):
    return [F.col(b) for b in by] if by else [F.lit(0)]


def cumulate(
    df: DataFrame, by: list[str], order: list[str], sums: dict[str, str], totals: bool = False, next_of: str | None = None
) -> DataFrame:
    """Inclusive running sums of ``sums`` (output -> input) in ``order`` within ``by``.

    ``df`` carries the slice column. ``totals`` adds ``total_{output}``; ``next_of`` adds ``next_{col}``,
    the following row's value across slice borders.
    """
    keys = [*by, SLICE]
    per = [F.sum(c).alias(f"_t_{o}") for o, c in sums.items()]
    if next_of:
        per.append(F.min(next_of).alias("_head"))
    slices = df.groupBy(*keys).agg(*per)
    across = Window.partitionBy(*_group(by)).orderBy(SLICE)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*_group(by))
    cols = [*keys]
    cols += [F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums]
    if totals:
        cols += [F.sum(f"_t_{o}").over(whole).alias(f"total_{o}") for o in sums]
    if next_of:
        cols.append(F.lead("_head").over(across).alias("_next_head"))
    borders = slices.select(*cols)
    inside = Window.partitionBy(*keys).orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = [F.sum(c).over(running).alias(f"_l_{o}") for o, c in sums.items()]
    if next_of:
        local.append(F.lead(next_of).over(inside).alias("_next"))
    kept = [c for c in df.columns if c != SLICE]
    out = join_back(df.select(*df.columns, *local), borders, keys)
    final = [*kept, *[(F.col(f"_b_{o}") + F.col(f"_l_{o}")).alias(o) for o in sums]]
    if totals:
        final += [f"total_{o}" for o in sums]
    if next_of:
        final.append(F.coalesce("_next", "_next_head").alias(f"next_{next_of}"))
    return out.select(*final)


def rank_by_hash(df: DataFrame, key: str, tag: str, by: list[str] | None = None, seed: int = 42, total: str | None = None) -> DataFrame:
    """Add ``rn`` (1-based) in the order of a keyed hash within ``by``: a reproducible shuffle."""
    sliced = with_hash_slice(df.withColumn("_u", rng.uniform(key, tag, seed)).withColumn("_one", F.lit(1)), "_u")
    out = cumulate(sliced, by or [], ["_u", key], {"rn": "_one"}, totals=total is not None)
    out = out.withColumnRenamed("total_rn", total) if total else out
    return out.drop("_u", "_one")


def rank_by_value(df: DataFrame, order: str, tie: str, by: list[str] | None = None, slices: int | None = None) -> DataFrame:
    """Add ``rn`` (1-based) in ascending order of a numeric column."""
    sliced = with_value_slice(df, order, slices, tie).withColumn("_one", F.lit(1))
    return cumulate(sliced, by or [], [order, tie], {"rn": "_one"}).drop("_one")


def with_next(df: DataFrame, order: str, carry: list[str], by: list[str] | None = None, slices: int | None = None, tie: str | None = None) -> DataFrame:
    """Add ``next_{c}`` for each carried column: the following row in ``order`` (then ``tie``) within ``by``; NULL at the end."""
    by = by or []
    sliced = with_value_slice(df, order, slices, tie)
    places = [order, tie] if tie else [order]
    keys = [*by, SLICE]
    pack = F.struct(F.lit(True).alias("_is"), *[F.col(c) for c in carry])
    heads = sliced.groupBy(*keys).agg(F.min_by(pack, F.struct(*places)).alias("_head"))
    across = Window.partitionBy(*_group(by)).orderBy(SLICE)
    heads = heads.select(*keys, F.lead("_head").over(across).alias("_next_head"))
    inside = Window.partitionBy(*keys).orderBy(*places)
    out = join_back(sliced.withColumn("_next", F.lead(pack).over(inside)), heads, keys)
    nxt = F.coalesce("_next", "_next_head")
    return out.select(*df.columns, nxt.isNotNull().alias("has_next"), *[nxt[c].alias(f"next_{c}") for c in carry])


def quantiles_of_counts(cum: DataFrame, by: list[str], value: str, count: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles from cumulated value counts (``cum_n``, ``total_cum_n``)."""
    n, upto = F.col("total_cum_n"), F.col("cum_n")
    before = upto - F.col(count)
    aggs, final = [], []
    for name, p in probs.items():
        h = F.lit(float(p)) * (n - 1)
        lo, hi = F.floor(h), F.ceil(h)
        aggs.append(F.max(F.when((before <= lo) & (lo < upto), F.col(value))).alias(f"_lo_{name}"))
        aggs.append(F.max(F.when((before <= hi) & (hi < upto), F.col(value))).alias(f"_hi_{name}"))
        frac = F.lit(float(p)) * (F.col("_n") - 1)
        final.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (frac - F.floor(frac))).alias(name))
    out = cum.groupBy(*by).agg(F.max(n).alias("_n"), *aggs)
    return out.select(*by, *final)


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None, slices: int | None = None) -> DataFrame:
    """Exact quantiles of one column by groups, without gathering a group: counts per value, then ranks."""
    by = by or []
    sliced = with_value_slice(df.select(*by, value).where(F.col(value).isNotNull()), value, slices)
    counts = sliced.groupBy(*by, SLICE, value).agg(F.count(F.lit(1)).alias("_n_v"))
    cum = cumulate(counts, by, [value], {"cum_n": "_n_v"}, totals=True)
    return quantiles_of_counts(cum, by, value, "_n_v", probs)
