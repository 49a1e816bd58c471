"""The privacy-budget ledger: an append-only table of (seq, dataset, epsilon, kind); totals are derived, never stored.

Spending is reserved before it is used: a reservation is an entry that counts at once, and a writer looks at the ledger only
after its own entry is there. Of two that do so at the same time at least the later one sees both, so the sum of what is kept
never exceeds the total; a reservation that doesn't fit, or whose work fails, is withdrawn by a further entry. If a driver
dies in between, its reservation stays on record and counts until someone withdraws it.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinloom.functions import fixed, ordered

SPEND, RESET, WITHDRAW = "spend", "reset", "withdraw"
SCHEMA = "seq long, ts timestamp, dataset string, kind string, epsilon double, claim string"
#: Sums of doubles may miss the total by this much.
SLACK = 1e-9


class BudgetExhausted(RuntimeError):
    """Raised by a caller that finds no budget left."""


def moment() -> Column:
    """Place of a new entry: microseconds since the epoch, so later writers follow earlier ones without reading the ledger."""
    return F.unix_micros(F.current_timestamp())


def load(spark: SparkSession, path: str) -> DataFrame:
    """The ledger below a path; no entries where nothing was written yet."""
    try:
        return spark.read.schema(SCHEMA).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def append(entries: DataFrame, path: str) -> None:
    """Write (dataset, epsilon) rows as spending."""
    rows = entries.select(moment().alias("seq"), F.current_timestamp().alias("ts"), "dataset", F.lit(SPEND).alias("kind"), "epsilon")
    rows.write.mode("append").json(path)


def reserve(entries: DataFrame, path: str, total: float = fixed.PRIVACY_BUDGET) -> str:
    """Write (dataset, epsilon) rows as spending under a claim of their own, which is returned. Raises, with the claim
    withdrawn, if they don't fit the total together with all that other writers hold."""
    spark, claim = entries.sparkSession, uuid.uuid4().hex
    rows = entries.select(moment().alias("seq"), F.current_timestamp().alias("ts"), "dataset", F.lit(SPEND).alias("kind"), "epsilon", F.lit(claim).alias("claim"))
    rows.write.mode("append").json(path)
    if remaining(load(spark, path), total).first()["consumed"] > total + SLACK:
        withdraw(spark, path, claim)
        raise BudgetExhausted("Privacy budget exhausted. No further generation permitted.")
    return claim


def withdraw(spark: SparkSession, path: str, claim: str) -> None:
    """Take a reservation back: its entries stay on record and no longer count. A second withdrawal changes nothing."""
    held = load(spark, path)
    gone = held.where((F.col("claim") == claim) & (F.col("kind") == WITHDRAW))
    if gone.isEmpty():
        mine = held.where((F.col("claim") == claim) & (F.col("kind") == SPEND)).groupBy("dataset").agg(F.sum("epsilon").alias("epsilon"))
        mine.select(moment().alias("seq"), F.current_timestamp().alias("ts"), "dataset", F.lit(WITHDRAW).alias("kind"), "epsilon", F.lit(claim).alias("claim")).write.mode("append").json(path)


def reset(spark: SparkSession, path: str) -> None:
    """Write a reset marker: spending before it no longer counts, and stays on record."""
    mark = spark.range(1).select(moment().alias("seq"), F.current_timestamp().alias("ts"), F.lit(None).cast("string").alias("dataset"), F.lit(RESET).alias("kind"), F.lit(0.0).alias("epsilon"))
    mark.write.mode("append").json(path)


def after_reset(ledger: DataFrame) -> DataFrame:
    """Entries that count: those after the last reset marker that were not withdrawn. Tables without claims are fine."""
    last = ledger.where(F.col("kind") == RESET).agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("s"))
    live = ledger.where((F.col("seq") > last.scalar()) & (F.col("kind") == SPEND))
    if "claim" not in ledger.columns:
        return live
    withdrawn = ledger.where(F.col("kind") == WITHDRAW).select(F.col("claim").alias("_gone"))
    return live.join(withdrawn, F.col("claim") == F.col("_gone"), "left_anti")


def remaining(ledger: DataFrame, total: float = fixed.PRIVACY_BUDGET) -> DataFrame:
    """One row: consumed, remaining (never negative) and whether generation must be refused."""
    used = F.coalesce(F.sum("epsilon"), F.lit(0.0))
    out = after_reset(ledger).agg(used.alias("consumed"))
    left = F.greatest(F.lit(total) - F.col("consumed"), F.lit(0.0))
    return out.select("consumed", left.alias("remaining"), (left <= 0).alias("exhausted"))


def require_budget(ledger: DataFrame, total: float = fixed.PRIVACY_BUDGET) -> float:
    row = remaining(ledger, total).first()
    if row["exhausted"]:
        raise BudgetExhausted("Privacy budget exhausted. No further generation permitted.")
    return row["remaining"]


def by_dataset(ledger: DataFrame) -> DataFrame:
    return after_reset(ledger).groupBy("dataset").agg(F.count(F.lit(1)).alias("entries"), F.sum("epsilon").alias("consumed"))


def timeline(ledger: DataFrame, order: str = "seq", slices: int | None = None, tie: str = "seq") -> DataFrame:
    """Running epsilon in ledger order, computed slice by slice; entries of one moment follow ``tie``."""
    sliced = ordered.with_value_slice(ledger, order, slices, tie if tie != order else None)
    return ordered.cumulate(sliced, [], [order] if tie == order else [order, tie], {"cumulative": "epsilon"})


def sensitivity(columns: DataFrame, token: bool = False) -> DataFrame:
    """Per dataset: sensitivity level and epsilon cap from its column names.

    By default a word counts anywhere inside a name (so "age" is found in "image_path"); ``token`` asks for whole
    ``_``-separated words. The level is a maximum, so names need not be gathered per dataset.
    """
    level = None
    for rank, (name, words) in zip((3, 2, 1), fixed.SENSITIVITY_WORDS.items()):
        body = "|".join(words)
        pattern = f"(^|_)({body})(_|$)" if token else f"({body})"
        hit = F.lower("column").rlike(pattern)
        level = F.when(hit, rank) if level is None else level.when(hit, rank)
    per = columns.groupBy("dataset").agg(F.max(level.otherwise(0)).alias("rank"))
    names = F.array(F.lit("low"), F.lit("medium"), F.lit("high"), F.lit("critical"))
    caps = F.create_map(*[F.lit(x) for kv in fixed.EPSILON_CAPS.items() for x in kv])
    return per.select("dataset", F.element_at(names, F.col("rank") + 1).alias("sensitivity")).withColumn("epsilon_cap", caps[F.col("sensitivity")])
