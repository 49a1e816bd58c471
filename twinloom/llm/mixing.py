"""Mixing sources to target weights along a curriculum.

Targets: sources share all words by weight; a target stops at ``MOST`` times its source's words and the excess is shared
again by weight until none is above. That is one level for all sources, found by a few sums over the table of sources.

Within a source, documents stand in a hashed order and are read pass after pass until the target is filled; the document
at the border is taken in part. A copy therefore starts at a known point of its source's demand. Each source has a
weight schedule over training time; its integral says which share of the demand is due by a time, and its inverse gives
the copy its position. Sorting by position by ranges yields the training order.

Running sums are cut into hash slices of about ``SLICE_ROWS`` rows, so a source with a third of all rows is many groups;
only one total per (source, slice) is summed across. Reruns give the same mix: nothing depends on partitions.

NULL and empty texts have size 0 and are taken 0 times; a NULL source comes last. Rows that repeat are separate
documents. Column names that begin with ``_mix`` are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinloom.llm.common import same
from twinloom.session import cut

WEIGHTS = (5, 2, 1)
MOST = 3
SLICE_ROWS = 2_000
SEED = 42
#: Weight over training time in [0, 1], linear between knots, by target weight: heavy sources lead, light ones come late.
Knots = tuple[tuple[float, float], ...]
FLAT: Knots = ((0.0, 1.0), (1.0, 1.0))
SCHEDULES: dict[int, Knots] = {5: ((0.0, 1.5), (1.0, 0.5)), 2: ((0.0, 1.0), (1.0, 1.0)), 1: ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75))}


def due_at(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time by which a share of the demand is due: the inverse of the schedule's integral, piece by piece."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    whole, out, done = sum(areas), F.lit(float(knots[-1][0])), sum(areas)
    for ((t0, w0), (t1, w1)), area in reversed(list(zip(zip(knots, knots[1:]), areas))):
        done -= area
        rest = F.greatest(share * F.lit(whole) - F.lit(done), F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        step = rest / F.lit(w0) if slope == 0 else (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
        out = F.when(share * F.lit(whole) < F.lit(done + area), F.lit(t0) + step).otherwise(out)
    return out


def numbered(sources: DataFrame, source: str) -> DataFrame:
    """Rank of each source by code point, NULL last, from 0: ranges are numbered inside and carry one count each."""
    placed = cut(sources.repartitionByRange(F.col(source).asc_nulls_last()).withColumn("_mix_p", F.spark_partition_id()))
    counts = placed.groupBy("_mix_p").agg(F.count(F.lit(1)).alias("_mix_n"))  # one row per range
    before = F.sum("_mix_n").over(Window.orderBy("_mix_p").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_mix_p", F.coalesce(before, F.lit(0)).alias("_mix_before"))
    inside = F.row_number().over(Window.partitionBy("_mix_p").orderBy(F.col(source).asc_nulls_last()))
    return placed.join(counts, "_mix_p").withColumn("_mix_rank", inside - 1 + F.col("_mix_before")).drop("_mix_p", "_mix_before")


def targets(sized: DataFrame, source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target): one row per source."""
    sums = cut(sized.groupBy(source).agg(F.sum(size).alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_mix_rank") % len(weights) + 1).cast("int"))
    held = cut(numbered(sums, source).withColumn("weight", weight).drop("_mix_rank"))
    cap = F.col("source_size") * most
    first = held.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    total = first["t"] or 0
    level = total / first["w"] if first["w"] else 0.0
    while True:  # the set of capped sources only grows
        full = F.lit(level) * F.col("weight") > cap
        r = held.agg(F.sum(F.when(full, cap)).alias("c"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        new = (total - (r["c"] or 0)) / r["w"] if r["w"] else level
        if new <= level:
            break
        level = new
    return held.select(source, "source_size", "weight", F.least(F.lit(level) * F.col("weight"), cap.cast("double")).alias("target"))


def planned(docs: DataFrame, size: Column, key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, schedules: dict[str, Knots] | None = None) -> DataFrame:
    """``docs`` with ``_mix_size``, ``_mix_source_size``, ``_mix_target``, ``_mix_weight``, ``_mix_taken`` (words) and
    ``_mix_copies``: (words, position) of each copy that the mix reads. ``schedules`` names sources with a schedule of
    their own; others follow the one of their weight."""
    taken = [c for c in docs.columns if c.startswith("_mix")]
    if taken:
        raise ValueError(f"rename the columns {taken}: names that begin with _mix are in use here")
    held = docs.withColumn("_mix_size", size.cast("long"))
    mark = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("-")), F.col("_mix_size"), F.lit(seed)))
    held = held.withColumn("_mix_hash", mark)
    narrow = held.select(source, "_mix_size", "_mix_hash")
    goal = targets(narrow, source, "_mix_size", weights, most)
    slices = docs.count() // SLICE_ROWS + 1
    slice_of = F.shiftright(F.conv(F.substring("_mix_hash", 1, 8), 16, 10).cast("long") * slices, 32)
    sums = narrow.withColumn("_mix_slice", slice_of).groupBy(source, "_mix_slice").agg(F.sum("_mix_size").alias("_mix_sum"))
    before = F.sum("_mix_sum").over(Window.partitionBy(source).orderBy("_mix_slice").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col(source).alias("_mix_s"), "_mix_slice", F.coalesce(before, F.lit(0)).alias("_mix_before"))
    goal = goal.select(F.col(source).alias("_mix_s"), F.col("source_size").alias("_mix_source_size"), F.col("weight").alias("_mix_weight"), F.col("target").alias("_mix_target"))
    borders = cut(sums.join(goal, "_mix_s") if dict(docs.dtypes)[source] == "void" else sums.alias("a").join(goal.alias("b"), same(F.col("a._mix_s"), F.col("b._mix_s"))).drop(F.col("b._mix_s")))
    borders = borders.withColumnRenamed("_mix_slice", "_mix_slice2")
    rows = held.withColumn("_mix_slice", slice_of)
    inside = Window.partitionBy(source, "_mix_slice").orderBy("_mix_hash", key, "_mix_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_mix_c", F.coalesce(F.sum("_mix_size").over(inside), F.lit(0)))
    rows = rows.join(borders, same(F.col(source), F.col("_mix_s")) & (F.col("_mix_slice") == F.col("_mix_slice2")))
    at, n, size_ = F.col("_mix_c") + F.col("_mix_before"), F.col("_mix_source_size"), F.col("_mix_size")
    demand = F.least(F.round("_mix_target").cast("long"), n * most)
    passes = F.when(n > 0, F.floor(demand / n)).otherwise(0).cast("long")
    rest = F.least(F.greatest(demand - passes * n - at, F.lit(0)), size_)
    share = lambda k: (k * n + at) / demand

    def position(k: Column) -> Column:
        own = [F.when(F.col(source) == name, due_at(share(k), knots)) for name, knots in (schedules or {}).items()]
        return F.coalesce(*own, *[F.when(F.col("_mix_weight") == w, due_at(share(k), SCHEDULES.get(w, FLAT))) for w in sorted(set(weights))])

    copies = F.transform(F.sequence(F.lit(0).cast("long"), passes), lambda k: F.struct(F.when(k < passes, size_).otherwise(rest).alias("words"), position(k).alias("position")))
    copies = F.when(demand > 0, F.filter(copies, lambda x: x["words"] > 0)).otherwise(F.array().cast("array<struct<words:bigint,position:double>>"))
    return rows.withColumn("_mix_copies", copies).withColumn("_mix_taken", (passes * size_ + rest).cast("long")).drop("_mix_s", "_mix_slice", "_mix_slice2", "_mix_c", "_mix_before", "_mix_hash")


def ordered(plan: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """The training order of all copies of a plan: a row of its columns for each copy, with ``_mix_pass`` and ``_mix_copy``
    (words, position), sorted by position by ranges; copies due at the same time stand by source, key and pass."""
    copies = plan.select(*[F.col(f"`{c}`") for c in plan.columns if c != "_mix_copies"], F.posexplode("_mix_copies").alias("_mix_pass", "_mix_copy"))
    return copies.orderBy("_mix_copy.position", source, key, "_mix_pass", "_mix_size")


def curriculum(docs: DataFrame, size: Column, key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The training order: a row of ``docs`` for each whole copy (the copy at a source's border counts as whole when at
    least half of its words are taken), sorted by position."""
    plan = planned(docs, size, key, source, **options).select(*[F.col(f"`{c}`") for c in docs.columns], "_mix_size", "_mix_copies")
    whole = plan.withColumn("_mix_copies", F.filter("_mix_copies", lambda x: x["words"] * 2 >= F.col("_mix_size")))
    return ordered(whole, key, source).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(docs: DataFrame, size: Column, key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The plan of each row of ``docs``, with what the written training order holds of it: ``_mix_taken`` (words of its copies there)
    and ``_mix_first`` (position of the first one, NULL if there is none)."""
    plan = cut(planned(docs, size, key, source, **options).withColumn("_mix_row", F.monotonically_increasing_id()))
    narrow = plan.select("_mix_row", key, source, "_mix_size", "_mix_copies")
    order = cut(ordered(narrow, key, source).select("_mix_row", F.col("_mix_copy.words").alias("words"), F.col("_mix_copy.position").alias("position")))
    read = order.groupBy("_mix_row").agg(F.sum("words").alias("_mix_read"), F.min("position").alias("_mix_first"))
    out = plan.drop("_mix_taken", "_mix_copies").join(read, "_mix_row", "left")
    return out.withColumn("_mix_taken", F.coalesce("_mix_read", F.lit(0).cast("long"))).drop("_mix_row", "_mix_read")
