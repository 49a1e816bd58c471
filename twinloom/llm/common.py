"""What several of these operators share: table scans and the two word splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space that ends a word: space and the five ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def same(a: Column, b: Column) -> Column:
    """Equality that also holds for two NULLs; Spark still joins on it by hash."""
    return a.eqNullSafe(b)


def whole(df: DataFrame) -> Column:
    """A row as one struct; ``select("row.*")`` gives the columns back."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns])
