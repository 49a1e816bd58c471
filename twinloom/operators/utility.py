"""Utility and leakage scores that fit a model: train on synthetic rows, test on real rows.

Forests are those of ``operators/trees.py``, the text classifier is that of ``operators/linear.py``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from twinloom.functions import grams, pairs
from twinloom.functions.pairs import REAL, SIDE, SYNTH
from twinloom.functions.scalars import clip
from twinloom.operators import attacks, compare, linear, trees as forests
from twinloom.operators.prepare import label_codes
from twinloom.operators.text import tokens
from twinloom.session import cut

NEUTRAL = 0.5
WEIGHTS = {"tstr": 0.50, "wasserstein": 0.30, "jsd": 0.20}


def lift_curve(accuracy: Column, baseline: Column) -> Column:
    """Up to 0.4 below the softened baseline, 0.4 to 1 above it."""
    below = clip(accuracy / (baseline + 1e-6) * 0.4, 0.0, 0.4)
    return F.when(accuracy <= baseline, below).otherwise(0.4 + 0.6 * (accuracy - baseline) / (1 - baseline + 1e-6))


def tstr_baseline(real: DataFrame, target: str) -> DataFrame:
    """Half the majority share plus half a uniform guess."""
    counts = real.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("n_classes"), (F.max("n") / F.sum("n")).alias("majority"),
        (0.5 * (F.max("n") / F.sum("n")) + 0.5 / F.count(F.lit(1))).alias("baseline"))


def encode_features(pair: DataFrame, cols: list[str], keep: list[str]) -> tuple[DataFrame, list[str]]:
    """Numbers as they are (missing and NaN as 0), everything else as the code of its text in the joint sorted order of both
    sides; with the names of the new columns."""
    out, feats = pair, []
    for i, (c, t) in enumerate([(c, t) for c, t in pair.dtypes if c in cols]):
        if pairs.is_numeric(t):
            x = F.nanvl(F.col(c).cast("double"), F.lit(0.0))
        else:
            codes = label_codes(pair, c).select(F.col("value").alias("_v"), F.col("code").alias(f"_code_{i}"))
            out = out.join(codes, out[c].cast("string") == F.col("_v"), "left").drop("_v")
            x = F.col(f"_code_{i}").cast("double")
        feats.append(F.coalesce(x, F.lit(0.0)).alias(f"f{i}"))
    return out.select(*keep, *feats), [f"f{i}" for i in range(len(feats))]


def _row(df: DataFrame, **values) -> DataFrame:
    return df.sparkSession.range(1).select(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()])


def _sizes(pair: DataFrame) -> tuple[int, int]:
    r = pair.agg(F.count_if(F.col(SIDE) == REAL), F.count_if(F.col(SIDE) == SYNTH)).first()
    return r[0], r[1]


def is_class_target(pair: DataFrame, target: str) -> bool:
    if dict(pair.dtypes)[target] == "string":
        return True
    return target in compare.low_cardinality(pair.where(F.col(SIDE) == REAL).select(target))


def _labelled(pair: DataFrame, target: str) -> DataFrame:
    # written, so that Spark knows how small the table is and does not deal all rows by their class
    codes = cut(label_codes(pair, target).select(F.col("value").alias("_y"), F.col("code").cast("double").alias("label")))
    return pair.join(codes, pair[target].cast("string") == F.col("_y"), "left").drop("_y")


def forest_accuracy(pair: DataFrame, target: str, cols: list[str], trees: int, depth: int, seed: int = 42) -> float | None:
    """Accuracy on real rows of a forest fitted on synthetic rows; None when the synthetic side has one class only."""
    data, feats = encode_features(_labelled(pair, target), cols, [SIDE, "label"])
    return forests.accuracy(cut(data.withColumn("y", F.col("label").cast("long"))), feats, trees, depth, seed)


def tstr(pair: DataFrame, target: str | None, modality: str = "tabular", trees: int = 100, depth: int = 8) -> DataFrame:
    """One row (method, accuracy or r2, baseline, score)."""
    if target is None or target not in pair.columns:
        return _row(pair, method="none", metric=F.lit(None).cast("double"), baseline=F.lit(None).cast("double"), score=NEUTRAL)
    if modality == "text":
        return tstr_text(pair, target)
    if is_class_target(pair, target):
        return tstr_classification(pair, target, trees, depth)
    return tstr_regression(pair, target, trees, depth)


def tstr_classification(pair: DataFrame, target: str, trees: int = 100, depth: int = 8) -> DataFrame:
    cols = [c for c in pair.columns if c not in (SIDE, target)]
    clean = pair.dropna(subset=[*cols, target])
    n_real, n_synth = _sizes(clean)
    acc = forest_accuracy(clean, target, cols, trees, depth) if cols and n_synth >= 20 and n_real >= 10 else None
    if acc is None:
        return _row(pair, method="classification", metric=F.lit(None).cast("double"), baseline=F.lit(None).cast("double"), score=NEUTRAL)
    base = tstr_baseline(clean.where(F.col(SIDE) == REAL), target)
    return base.select(F.lit("classification").alias("method"), F.lit(acc).alias("metric"), "baseline", lift_curve(F.lit(acc), F.col("baseline")).alias("score"))


def tstr_regression(pair: DataFrame, target: str, trees: int = 100, depth: int = 8) -> DataFrame:
    """(R2 + 1) / 2, clipped: 0.5 for predictions no better than the mean."""
    cols = [c for c in pair.columns if c not in (SIDE, target)]
    clean = pair.dropna(subset=[*cols, target])
    n_real, n_synth = _sizes(clean)
    neutral = _row(pair, method="regression", metric=F.lit(None).cast("double"), baseline=F.lit(None).cast("double"), score=NEUTRAL)
    if not cols or n_synth < 20 or n_real < 10:
        return neutral
    data, feats = encode_features(clean.withColumn("label", F.col(target).cast("double")), cols, [SIDE, "label"])
    r2 = F.lit(forests.r_squared(cut(data), feats, trees, depth)).cast("double")
    return _row(pair, method="regression", metric=r2, baseline=F.lit(None).cast("double"), score=clip((F.coalesce(r2, F.lit(0.0)) + 1) / 2))


def longest_text(real: DataFrame, target: str) -> str | None:
    """The text column with the greatest mean length, if that is at least 20."""
    cols = [c for c in pairs.string_columns(real) if c != target]
    if not cols:
        return None
    row = real.agg(*[F.avg(F.length(c)).alias(c) for c in cols]).first()
    best = max(cols, key=lambda c: row[c] or 0.0)
    return best if (row[best] or 0.0) >= 20 else None


def text_vectors(docs: DataFrame, text: str, keep: list[str], size: int = 500, min_df: int = 2) -> DataFrame:
    """TF-IDF arrays (``features``) over the ``size`` most frequent words and word pairs found in at least ``min_df`` texts.

    Texts are cut into words once and written; the vocabulary is a top-k report (``grams.frequent``).
    """
    said = F.coalesce(F.array_join(tokens(F.col(text)), " "), F.lit(""))
    spoken = cut(docs.select(*keep, said.alias("_said")))
    vocab = grams.frequent(spoken.select("_said"), size, min_df)
    if not vocab:
        return docs.select(*keep, F.array(F.lit(0.0)).alias("features"))
    n = spoken.count()
    return grams.weighted(spoken, keep, "_said", [t for t, _ in vocab], [math.log((1 + n) / (1 + df)) + 1 for _, df in vocab])


def tstr_text(pair: DataFrame, target: str, size: int = 500) -> DataFrame:
    """A linear classifier on TF-IDF features (``size`` terms at most) of the longest text column. Failures are raised, not
    scored as neutral."""
    real = pair.where(F.col(SIDE) == REAL)
    neutral = _row(pair, method="text", metric=F.lit(None).cast("double"), baseline=F.lit(None).cast("double"), score=NEUTRAL)
    text = longest_text(real.drop(SIDE), target)
    if text is None:
        return neutral
    clean = pair.dropna(subset=[text, target])
    n_real, n_synth = _sizes(clean)
    classes = real.select(target).where(F.col(target).isNotNull()).distinct().count()
    if n_synth < 20 or n_real < 10 or classes > 50:
        return neutral
    data = cut(text_vectors(_labelled(clean.select(SIDE, text, target), target), text, [SIDE, "label"], size))
    train, test = data.where(F.col(SIDE) == SYNTH), data.where(F.col(SIDE) == REAL)
    if train.select("label").distinct().count() < 2:
        return neutral
    known = data.agg(F.max("label").alias("label"), F.max(F.size("features")).alias("terms")).first()
    acc = linear.accuracy(test, linear.fit(train, int(known["label"]) + 1, known["terms"]))
    base = tstr_baseline(clean.where(F.col(SIDE) == REAL), target)
    return base.select(F.lit("text").alias("method"), F.lit(acc).alias("metric"), "baseline", lift_curve(F.lit(acc), F.col("baseline")).alias("score"))


def utility(pair: DataFrame, target: str | None, modality: str = "tabular", trees: int = 100, depth: int = 8) -> DataFrame:
    """0.50 TSTR + 0.30 Wasserstein + 0.20 categorical JSD; each part is neutral where it does not apply."""
    num = pairs.numeric_columns(pair)
    cats = compare.low_cardinality(pair.where(F.col(SIDE) == REAL).drop(SIDE))
    t = tstr(pair, target, modality, trees, depth).select("score").first()["score"]
    w = compare.mean_score(compare.wasserstein(pair, num), "w").first()["w"] if num else None
    j = compare.mean_score(compare.jsd_categorical(pair, cats), "j").first()["j"] if cats else None
    parts = {"tstr": t, "wasserstein": NEUTRAL if w is None else w, "jsd": NEUTRAL if j is None else j}
    total = sum(WEIGHTS[k] * v for k, v in parts.items())
    return _row(pair, **{k: float(v) for k, v in parts.items()}, utility=float(min(1.0, max(0.0, total))))


def attribute_leak(pair: DataFrame, sensitive: str | None, trees: int = 50, depth: int = 5) -> DataFrame:
    """How much better than guessing a synthetic-trained forest tells a sensitive attribute of real rows."""
    cols = [c for c in pairs.numeric_columns(pair) if c != sensitive]
    safe = _row(pair, safety_score=1.0, advantage=0.0, accuracy=0.0, baseline=0.0)
    if sensitive is None or not cols:
        return safe
    clean = pair.select(SIDE, sensitive, *cols).dropna()
    n_real, n_synth = _sizes(clean)
    if n_synth < 20 or n_real < 10:
        return safe
    acc = forest_accuracy(clean, sensitive, cols, trees, depth)
    if acc is None:
        return safe
    base = attacks.leak_baseline(clean.where(F.col(SIDE) == REAL), sensitive)
    a, b = F.lit(acc), F.col("baseline")
    return base.select(attacks.leak_curve(a, b).alias("safety_score"), F.greatest(a - b, F.lit(0.0)).alias("advantage"), a.alias("accuracy"), "baseline")


def tstr_fast(pair: DataFrame, target: str | None, trees: int = 20, depth: int = 4) -> DataFrame:
    """Lift over the majority guess as a share of what was possible; real side is the holdout."""
    if target is None or target not in pair.columns:
        return _row(pair, accuracy=F.lit(None).cast("double"), score=NEUTRAL)
    cols = [c for c in pairs.numeric_columns(pair) if c != target]
    clean = pair.select(SIDE, target, *cols).where(F.col(target).isNotNull())
    n_real, n_synth = _sizes(clean)
    acc = forest_accuracy(clean, target, cols, trees, depth) if cols and n_synth >= 10 and n_real >= 5 else None
    if acc is None:
        return _row(pair, accuracy=F.lit(None).cast("double"), score=NEUTRAL)
    base = attacks.leak_baseline(clean.where(F.col(SIDE) == REAL), target)
    a, b = F.lit(acc), F.col("baseline")
    return base.select(a.alias("accuracy"), F.when(a > b, (a - b) / (1 - b + 1e-6)).otherwise(F.lit(0.0)).alias("score"))


def privacy(pair: DataFrame, key: str, sensitive: str | None, cols: list[str] | None = None) -> DataFrame:
    """Mean of membership, singling-out and leakage scores, with the parts."""
    cols = cols if cols is not None else [c for c in pairs.numeric_columns(pair) if c != key]
    m = attacks.mia(pair, key, cols).first()["privacy_score"]
    s = attacks.singling_out(pair, cols).first()["safety_score"]
    a = attribute_leak(pair.drop(key) if key not in cols else pair, sensitive).first()["safety_score"]
    return _row(pair, mia=float(m), singling=float(s), leak=float(a), privacy=float((m + s + a) / 3))
