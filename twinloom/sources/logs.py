"""Records a run leaves behind: audit lines, archive and meta history, receipts. JSON lines, append-only."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinloom.functions.scalars import finite_or

ARCHIVE_SCHEMA = (
    "model_key string, reward double, privacy double, utility double, realism double, diversity double, epsilon double, "
    "dataset string, released boolean, failure_reasons array<string>, timestamp string, meta_rows long, meta_cols long, seq long"
)
META_SCHEMA = "n_rows long, n_cols long, model_key string, reward double"


def parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    """JSON lines to rows; lines that are not JSON objects are skipped. Bare NaN and Infinity are accepted."""
    bad = "_corrupt string"
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowNonNumericNumbers": "true"}
    # inlined from a one-element array, so each line is parsed once however many fields are read
    parsed = lines.where(~F.trim("value").isin("", "null")).select(F.inline(F.array(F.from_json("value", f"{schema}, {bad}", opts))))
    return parsed.where(F.col("_corrupt").isNull()).drop("_corrupt")


def archive_rows(lines: DataFrame) -> DataFrame:
    """History lines with missing fields defaulted and a non-finite reward set to 0."""
    a = parse_lines(lines, ARCHIVE_SCHEMA)
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("privacy", "utility", "realism", "diversity", "epsilon")]
    return a.select(
        F.coalesce("model_key", F.lit("")).alias("model_key"), finite_or(F.col("reward"), 0.0).alias("reward"), *zero,
        F.coalesce("dataset", F.lit("")).alias("dataset"), F.coalesce("released", F.lit(False)).alias("released"),
        F.coalesce("failure_reasons", F.array().cast("array<string>")).alias("failure_reasons"), F.coalesce("timestamp", F.lit("")).alias("timestamp"),
        "meta_rows", "meta_cols", F.coalesce("seq", F.unix_micros(F.try_to_timestamp("timestamp")), F.lit(0).cast("long")).alias("seq"),
    )


def meta_rows(lines: DataFrame) -> DataFrame:
    """Size/model/reward lines; a line without all four fields is skipped."""
    return parse_lines(lines, META_SCHEMA).dropna()


def history(archive: DataFrame) -> DataFrame:
    """Archive rows under the names that routing, avoidance and model choice read."""
    return archive.withColumnsRenamed({"model_key": "model", "meta_rows": "n_rows", "meta_cols": "n_cols"})


def load_history(spark: SparkSession, path: str) -> DataFrame | None:
    """The runs below a path in that form; None where nothing was written yet."""
    try:
        return history(load_archive(spark, path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_archive(spark: SparkSession, path: str) -> DataFrame:
    return archive_rows(spark.read.text(path))


def load_meta(spark: SparkSession, path: str) -> DataFrame:
    return meta_rows(spark.read.text(path))


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def round4(c: str) -> Column:
    return F.round(finite_or(F.col(c), 0.0), 4)


def audit_record(runs: DataFrame) -> DataFrame:
    """One audit row per run; a temporal score is NULL only where it does not apply."""
    scores = ["epsilon", "privacy", "utility", "diversity", "realism"]
    temporal = F.when(F.col("is_temporal"), F.round("temporal", 4))
    return runs.select(
        "seq", "dataset", "model", *[F.round(c, 4).alias(c) for c in scores], F.round("causal", 4).alias("causal_fidelity"),
        temporal.alias("temporal"), F.round("reward", 4).alias("reward"), "released", "gate_message", "failure_reasons",
    )


def receipts(runs: DataFrame) -> DataFrame:
    """(file_name, receipt): a nested JSON-LD document per released run; scores to four places, 0 where not finite.

    The mechanism is named as calibrated noise: no formal privacy guarantee is claimed.
    """
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    doc = F.struct(
        F.lit("https://schema.org/").alias("@context"), F.lit("Dataset").alias("@type"), F.concat(F.lit("synthetic_"), F.col("dataset")).alias("name"),
        stamp.alias("dateCreated"),
        F.struct(F.lit("SoftwareApplication").alias("@type"), F.lit("twinloom").alias("name"), F.lit("1.0").alias("version")).alias("generator"),
        F.struct(F.lit("Calibrated noise").alias("name"), round4("epsilon").alias("epsilon"), round4("budget_remaining").alias("budgetRemaining")).alias("privacyMechanism"),
        F.upper("model").alias("synthesisModel"),
        F.struct(*[round4(c).alias(c) for c in ("privacy", "utility", "diversity", "realism", "reward")]).alias("qualityMetrics"),
        F.lit("APPROVED").alias("releaseDecision"),
        F.struct(F.col("output_path").alias("path"), F.col("sha256")).alias("outputFile"),
    )
    safe = F.regexp_replace("dataset", r"[/\\]", "_")
    name = F.concat(F.lit("receipt_"), safe, F.lit("_"), F.date_format("ts", "yyyy-MM-dd_HH-mm-ss"), F.lit(".json"))
    return runs.select(name.alias("file_name"), F.to_json(doc).alias("receipt"))


def write_receipts(runs: DataFrame, path: str) -> None:
    receipts(runs).select(F.col("receipt").alias("value")).write.mode("append").text(path)
