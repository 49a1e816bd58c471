"""The sequence graph: consecutive rows are neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from twinloom.functions import ordered, pairs


def sequence_edges(df: DataFrame, key: str, order: str, by: list[str] | None = None) -> DataFrame:
    """Both directions of every link between a row and its successor. Rows of one order value follow their key; a key that
    is no number is replaced by its hash there, so that a frequent value can be split."""
    slim = df.select(key, *([order] if order != key else []), *(by or []))
    tie = None
    if key != order:
        tie = key if pairs.is_numeric(dict(df.dtypes)[key]) else "_tie"
        slim = slim if tie == key else slim.withColumn(tie, F.xxhash64(key))
    nxt = ordered.with_next(slim, order, [key], by, tie=tie).where("has_next")
    link = F.array(F.struct(F.col(key).alias("src"), F.col(f"next_{key}").alias("dst")), F.struct(F.col(f"next_{key}").alias("src"), F.col(key).alias("dst")))
    return nxt.select(F.inline(link))


def neighbour_mean(features: DataFrame, edges: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Mean of each row's own features and its neighbours'. Missing features count as zero."""
    view = features.select(F.col(key).alias("dst"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    loops = view.select(F.col("dst").alias("src"), *cols)
    near = edges.join(view, "dst").select("src", *cols)
    return loops.unionByName(near).groupBy(F.col("src").alias(key)).agg(F.count(F.lit(1)).alias("degree"), *[F.avg(c).alias(c) for c in cols])
