"""Privacy attacks on a real/synthetic pair: membership inference, singling-out and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from twinloom.functions import fixed, ordered, pairs, rng
from twinloom.functions.pairs import REAL, SIDE, SYNTH
from twinloom.functions.scalars import clip
from twinloom.operators import proximity
from twinloom.operators.prepare import Scaler
from twinloom.session import cut

NO_NUMBERS_MIA, NO_NUMBERS_FAST = 0.95, 0.8
RADIUS = 0.5


def _numbers(df: DataFrame, cols: list[str], keep: list[str], fill: bool) -> DataFrame:
    view = pairs.numeric_view(df, cols, keep)
    return view.fillna(0.0, cols) if fill else view.dropna(subset=cols)


def nearest_distance(pair: DataFrame, key: str, cols: list[str], fill: bool = False) -> DataFrame:
    """(key, distance) for every real row: how far the nearest synthetic row is, in real standard deviations."""
    view = _numbers(pair.withColumn("_id", F.col(key)), cols, [SIDE, "_id"], fill)
    real, synth = view.where(F.col(SIDE) == REAL), view.where(F.col(SIDE) == SYNTH)
    sc = Scaler.fit(real, cols)
    coords = [sc.scaled(c) for c in cols]
    index = proximity.build(proximity.as_points(synth, coords), len(cols))
    rows = real.select(F.col("_id").alias(key), F.array(*coords).alias("x"))
    if index is None:
        return rows.select(key, F.lit(None).cast("double").alias("distance"))
    found = proximity.nearest(proximity.as_points(real, coords), index)
    return rows.join(found.select("x", "distance"), "x").select(key, "distance")


def split_distances(pair: DataFrame, key: str, cols: list[str], train: float, fill: bool, seed: int = 42, part: str | None = None, split_tag: str = "holdout") -> DataFrame | None:
    """(part, distance, n_train, n_hold): nearest-synthetic distances of train and holdout rows, in train deviations.

    Real rows are split by a keyed hash. One search serves both halves: equal points carry a weight for each.
    """
    keep = [SIDE, "_id", *([part] if part else [])]
    view = _numbers(pair.withColumn("_id", F.col(key)), cols, keep, fill)
    real = view.where(F.col(SIDE) == REAL).withColumn("_train", rng.uniform("_id", split_tag, seed) < train)
    synth = view.where(F.col(SIDE) == SYNTH)
    sc = Scaler.fit(real.where("_train"), cols)
    coords = [sc.scaled(c) for c in cols]
    p = F.col(part) if part else None
    index = proximity.build(proximity.as_points(synth, coords, part=p), len(cols))
    if index is None:
        return None
    points = proximity.as_points(real, coords, {"n_train": F.col("_train").cast("long"), "n_hold": (~F.col("_train")).cast("long")}, p)
    found = proximity.nearest(points, index)
    return cut(found.groupBy("part", "distance").agg(F.sum("n_train").alias("n_train"), F.sum("n_hold").alias("n_hold")))


def weighted_quantiles(dist: DataFrame, weight: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles of distances that occur ``weight`` times, per part."""
    d = ordered.with_value_slice(dist.where(F.col(weight) > 0), "distance")
    cum = ordered.cumulate(d, ["part"], ["distance"], {"cum_n": weight}, totals=True)
    return ordered.quantiles_of_counts(cum, ["part"], "distance", weight, probs)


def mia(pair: DataFrame, key: str, cols: list[str] | None = None, train: float = 0.6, seed: int = 42) -> DataFrame:
    """Membership inference. The threshold is the 5th percentile of holdout distances; the attack succeeds to the extent
    that more train rows than holdout rows lie below it."""
    cols = cols if cols is not None else [c for c in pairs.numeric_columns(pair)]
    dist = split_distances(pair, key, cols, train, False, seed) if cols else None
    if dist is None:
        return pair.sparkSession.range(1).select(
            F.lit(NO_NUMBERS_MIA).alias("privacy_score"), F.lit(0.05).alias("attack_success"), *[F.lit(0.0).alias(c) for c in ("threshold", "train_median", "holdout_median")])
    hold = weighted_quantiles(dist, "n_hold", {"threshold": 0.05, "holdout_median": 0.5})
    tr = weighted_quantiles(dist, "n_train", {"train_median": 0.5})
    below = F.col("distance") < F.col("threshold")
    share = lambda n: F.coalesce(F.sum(F.when(below, F.col(n)).otherwise(0)) / F.nullif(F.sum(n), F.lit(0)), F.lit(0.0))
    hits = dist.join(hold, "part").groupBy("part").agg(share("n_train").alias("attack_success"), share("n_hold").alias("base"), F.max("threshold").alias("threshold"), F.max("holdout_median").alias("holdout_median"))
    gain = F.greatest(F.col("attack_success") - F.col("base"), F.lit(0.0))
    return hits.join(tr, "part").select(clip(1 - gain * 5).alias("privacy_score"), "attack_success", "threshold", "train_median", "holdout_median")


def mia_fast(pair: DataFrame, key: str, cols: list[str] | None = None, train: float = 0.7, seed: int = 42, part: str | None = None) -> DataFrame:
    """Ratio of median holdout to median train distance as a score; missing numbers count as zero."""
    cols = cols if cols is not None else pairs.numeric_columns(pair)
    dist = split_distances(pair, key, cols, train, True, seed, part) if cols else None
    if dist is None:
        return pair.sparkSession.range(1).select(F.lit(0).cast("long").alias("part"), F.lit(None).cast("double").alias("ratio"), F.lit(NO_NUMBERS_FAST).alias("score"))
    m = weighted_quantiles(dist, "n_hold", {"h": 0.5}).join(weighted_quantiles(dist, "n_train", {"t": 0.5}), "part")
    ratio = F.col("h") / (F.col("t") + 1e-8)
    return m.select("part", ratio.alias("ratio"), clip((ratio - 1) / 2 + 0.5).alias("score"))


def singling_out(pair: DataFrame, cols: list[str] | None = None, radius: float = RADIUS) -> DataFrame:
    """Share of synthetic rows with exactly one real row closer than the radius (in real deviations, missing as zero)."""
    cols = cols if cols is not None else pairs.numeric_columns(pair)
    safe = pair.sparkSession.range(1).select(F.lit(1.0).alias("safety_score"), F.lit(0.0).alias("singling_out_rate"), F.lit(0).cast("long").alias("n_singled"), F.lit(0).cast("long").alias("n_checked"))
    if not cols:
        return safe
    view = _numbers(pair, cols, [SIDE], True)
    real, synth = view.where(F.col(SIDE) == REAL), view.where(F.col(SIDE) == SYNTH)
    sc = Scaler.fit(real, cols)
    coords = [sc.scaled(c) for c in cols]
    index = proximity.build(proximity.as_points(real, coords), len(cols))
    if index is None:
        return safe
    counted = proximity.count_within(proximity.as_points(synth, coords, {"n": F.lit(1)}), index, radius)
    one = counted.agg(F.coalesce(F.sum(F.when(F.col("close") == 1, F.col("n"))), F.lit(0)).alias("n_singled"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_checked"))
    rate = F.col("n_singled") / F.greatest(F.col("n_checked"), F.lit(1))
    return one.select(clip(1 - rate).alias("safety_score"), rate.alias("singling_out_rate"), "n_singled", "n_checked")


def leak_curve(accuracy: Column, baseline: Column) -> Column:
    """1 without advantage over the majority guess, 0 from an advantage of 0.25."""
    return clip(1 - F.greatest(accuracy - baseline, F.lit(0.0)) / 0.25)


def leak_baseline(df: DataFrame, col: str) -> DataFrame:
    """Share of the most frequent value: what guessing alone achieves."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("n_classes"), (F.max("n") / F.sum("n")).alias("baseline"))


def epsilon_candidates(cap: float, trials: int = 5, low: float = fixed.EPSILON_RANGE[0], high: float = fixed.EPSILON_RANGE[1]) -> list[float]:
    """Log-spaced candidates from the least epsilon to the smaller of cap and greatest epsilon."""
    top = min(cap, high)
    return [low * (top / low) ** (i / (trials - 1)) for i in range(trials)]
