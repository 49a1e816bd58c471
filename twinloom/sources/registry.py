"""The dataset registry: contracts by name, and which of them have data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from twinloom.functions import fixed, rng
from twinloom.operators.roles import Contract


class Registry:
    """Named contracts. ``get`` raises KeyError for an unknown name; ``get_safe`` answers None."""

    def __init__(self, contracts: list[Contract]):
        self._by_name = {c.name: c for c in contracts}

    def get(self, name: str) -> Contract:
        if name not in self._by_name:
            raise KeyError(f"Dataset '{name}' not found. Available: {self.names()}")
        return self._by_name[name]

    def get_safe(self, name: str) -> Contract | None:
        return self._by_name.get(name)

    def names(self) -> list[str]:
        return list(self._by_name)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c.name, c.target, c.modality, c.is_temporal, c.description, c.sensitivity, c.row_count) for c in self._by_name.values()]
        return spark.createDataFrame(rows, "name string, target string, modality string, is_temporal boolean, description string, sensitivity string, row_count string")

    def available(self, spark: SparkSession, catalogue: DataFrame) -> DataFrame:
        """Registered datasets the catalogue has columns for."""
        return self.frame(spark).join(catalogue, F.col("name") == F.col("dataset"), "left_semi")

    def missing(self, spark: SparkSession, catalogue: DataFrame) -> DataFrame:
        return self.frame(spark).join(catalogue, F.col("name") == F.col("dataset"), "left_anti")


def demo_metadata(ids: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Image-metadata rows, one per id: label, finding, gender, age and a path derived from label and id."""
    k = F.col(key)
    out = ids.select(
        F.format_string("P%04d", k).alias("patient_id"), k.alias("_k"), rng.pick(fixed.DEMO_LABELS, k, "label", seed).alias("label"),
        rng.pick(fixed.DEMO_FINDINGS, k, "finding", seed).alias("finding"), rng.pick(fixed.DEMO_GENDERS, k, "gender", seed).alias("gender"),
        (F.floor(rng.uniform(k, "age", seed) * 68) + 18).cast("int").alias("age"))
    path = F.concat(F.lit("images/"), F.replace(F.lower("label"), F.lit(" "), F.lit("_")), F.lit("_"), F.format_string("%04d", "_k"), F.lit(".png"))
    return out.withColumn("image_path", path).drop("_k")
