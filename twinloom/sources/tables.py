"""Table scans and sinks. Missing values are NULL on the inside: NaN is turned into NULL at the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

FRACTIONAL = ("float", "double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """pandas has one missing value; Spark has NaN and NULL. One projection makes them the same."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in FRACTIONAL else F.col(c) for c, t in df.dtypes])


def load_table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """Parquet scan. ``spread`` is for row-wise heavy work (text): a scan with fewer splits than half the cores, which
    only a small file has, is dealt out to all of them; a large table is left as it is."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and 2 * df.rdd.getNumPartitions() <= cores:
        df = df.repartition(cores)
    return nan_to_null(df)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None, header: bool = True) -> DataFrame:
    """CSV scan with a declared schema, or with ``schema=None`` inferred types. Rows that do not parse raise; blank lines
    are skipped; quoted cells may hold line ends and doubled quotes.

    A file without a header row needs ``header=False``: otherwise its first record is lost.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("inferSchema", True)
    reader = reader.option("header", header).option("escape", '"').option("mode", "FAILFAST").option("multiLine", True)
    return nan_to_null(reader.csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    """Released table as CSV part files with a header; nothing is pulled to the driver."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def preview(df: DataFrame, key: str, k: int = 8) -> DataFrame:
    """The first k rows in key order."""
    return df.orderBy(key).limit(k)


def table_digest(df: DataFrame) -> DataFrame:
    """Order-independent content digest: row count and the summed words of each row's SHA-256.

    Sums combine map-side, so no group of rows is ever gathered. Equal rows count every time they occur.
    Fractions enter with all their digits, timestamps as epoch microseconds; each cell is led by its length, and NULL by ``-``.
    """
    cells = []
    for c, t in df.dtypes:
        if t == "timestamp_ntz":
            text = F.unix_micros(F.col(c).cast("timestamp")).cast("string")
        elif t == "timestamp":
            text = F.unix_micros(c).cast("string")
        else:
            text = F.col(c).cast("string")  # a fraction has the digits that tell it from its neighbours
        cells.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    row = F.sha2(F.concat(*cells), 256)
    words = [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = df.select(*[w.alias(f"w{i}") for i, w in enumerate(words)]).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(4)]
    )
    parts = [F.coalesce(F.col(f"w{i}").cast("string"), F.lit("0")) for i in range(4)]
    return sums.select(F.col("n").alias("n_rows"), F.sha2(F.concat_ws(":", F.col("n").cast("string"), *parts), 256).alias("digest"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file below a path; empty when there is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def column_info(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column: ordinal, type, non-null count and distinct count."""
    if approximate:
        aggs = []
        for i, c in enumerate(df.columns):
            aggs += [F.count(c).alias(f"n{i}"), F.approx_count_distinct(c).alias(f"d{i}")]
        rows = [
            F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"n{i}").alias("n_nonnull"), F.col(f"d{i}").alias("n_distinct"))
            for i, (c, t) in enumerate(df.dtypes)
        ]
        return df.agg(*aggs).select(F.inline(F.array(*rows)))
    # every cell as (ordinal, narrow key): equal cells of a task become one row before the shuffle
    cells = [F.struct(F.lit(i).alias("ordinal"), *narrow_key(F.col(c), t)) for i, (c, t) in enumerate(df.dtypes)]
    counts = df.select(F.inline(F.array(*cells))).where(F.col("whole").isNotNull() | F.col("part").isNotNull() | F.col("other").isNotNull())
    per = counts.groupBy("ordinal", "whole", "part", "other").agg(F.count(F.lit(1)).alias("n")).groupBy("ordinal").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"))
    listed = df.sparkSession.createDataFrame([(i, c, t) for i, (c, t) in enumerate(df.dtypes)], "ordinal int, column string, type string")
    zero = F.lit(0).cast("long")
    return listed.join(per, "ordinal", "left").select("ordinal", "column", "type", F.coalesce("n", zero).alias("n_nonnull"), F.coalesce("d", zero).alias("n_distinct"))


def narrow_key(c: Column, dtype: str) -> list[Column]:
    """A cell as one of three narrow columns, equal exactly where the cells are: a long, a double, or 16 bytes of digest."""
    whole, part, other = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("binary")
    if dtype in ("tinyint", "smallint", "int", "bigint", "boolean"):
        whole = c.cast("long")
    elif dtype in ("timestamp", "timestamp_ntz"):
        whole = F.unix_micros(c.cast("timestamp"))
    elif dtype in FRACTIONAL:
        part = c.cast("double")
    elif dtype in ("string", "binary"):
        other = F.unhex(F.md5(c))
    else:
        text = F.to_json(F.array(c)) if "<" in dtype else c.cast("string")
        other = F.when(c.isNotNull(), F.unhex(F.md5(text)))
    return [whole.alias("whole"), part.alias("part"), other.alias("other")]
