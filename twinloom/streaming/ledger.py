"""The ledger directory as a stream: spend per dataset, kept up to date as entries arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from twinloom.operators.ledger import SCHEMA, SPEND, WITHDRAW


def entries(spark: SparkSession, path: str) -> DataFrame:
    """New ledger files as they are appended."""
    return spark.readStream.schema(SCHEMA).json(path)


def spend_by_dataset(stream: DataFrame) -> DataFrame:
    """One small state row per dataset; works on a batch ledger as well. What is withdrawn is taken off again."""
    spent = F.col("kind") == SPEND
    amounts = F.sum(F.when(spent, F.col("epsilon")).otherwise(-F.col("epsilon")))
    return stream.where(F.col("kind").isin(SPEND, WITHDRAW)).groupBy("dataset").agg(F.count(F.when(spent, 1)).alias("entries"), amounts.alias("consumed"))


def follow(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the totals in a queryable in-memory table, a row per dataset, for looking at; ``publish`` is for a cluster. The
    checkpoint belongs in the cluster's shared folder."""
    return (
        spend_by_dataset(stream).writeStream.outputMode("complete").format("memory").queryName(name)
        .option("checkpointLocation", checkpoint).start()
    )


def publish(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the totals of each micro-batch as a table of its own, ``batch=<n>`` below ``path``. A batch that is run again
    replaces its own table."""

    def write(totals: DataFrame, batch: int) -> None:
        totals.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return spend_by_dataset(stream).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write).start()
