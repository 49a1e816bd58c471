"""Column roles. One catalogue of per-column statistics feeds every rule, for any number of tables at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinloom.functions import fixed
from twinloom.functions.pairs import INTEGRAL, is_numeric

CATALOGUE_SCHEMA = (
    "dataset string, ordinal int, column string, kind string, n_rows long, n_nonnull long, n_distinct long, "
    "avg_len double, lo double, hi double, off_whole long"
)
NARROW = 60


@dataclass(frozen=True)
class Contract:
    """What a caller states about a table."""

    name: str
    target: str | None = None
    modality: str = ""
    is_temporal: bool = False
    discrete: tuple[str, ...] | None = None
    description: str = ""
    sensitivity: str = "medium"
    row_count: str = ""


def kind_of(dtype: str) -> str:
    if dtype in INTEGRAL:
        return "int"
    if is_numeric(dtype):
        return "float"
    if dtype.startswith("timestamp") or dtype == "date":
        return "timestamp"
    return "string" if dtype == "string" else dtype.split("<")[0]


def catalogue(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Per-column statistics of several tables.

    The first pass is one mergeable aggregate per table with sketched distinct counts. Columns the sketch calls narrow
    get an exact distinct count in a second pass; for the rest the sketch stands, since every role rule only asks
    whether a column has few distinct values. Two jobs in all, and one row per column reaches the driver.
    """
    first = None
    for name, df in tables.items():
        aggs, rows = [F.count(F.lit(1)).alias("n")], []
        for i, (c, t) in enumerate(df.dtypes):
            k = kind_of(t)
            num = k in ("int", "float")
            nul = F.lit(None).cast("double")
            aggs += [
                F.count(c).alias(f"c{i}"), F.approx_count_distinct(c).alias(f"d{i}"),
                (F.avg(F.length(c)) if k == "string" else F.max(nul)).alias(f"l{i}"),
                (F.min(F.col(c).cast("double")) if num else F.max(nul)).alias(f"lo{i}"),
                (F.max(F.col(c).cast("double")) if num else F.max(nul)).alias(f"hi{i}"),
                (F.count_if(F.abs(F.col(c) - F.round(c, 0)) >= 0.01) if num else F.max(F.lit(None).cast("long"))).alias(f"g{i}"),
            ]
            rows.append(F.struct(
                F.lit(name).alias("dataset"), F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col("n").alias("n_rows"),
                F.col(f"c{i}").alias("n_nonnull"), F.col(f"d{i}").alias("n_distinct"), F.col(f"l{i}").alias("avg_len"),
                F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"), F.col(f"g{i}").alias("off_whole")))
        one = df.agg(*aggs).select(F.inline(F.array(*rows)))
        first = one if first is None else first.unionAll(one)
    stats = [r.asDict() for r in first.collect()]
    second = None
    for name, df in tables.items():
        narrow = [s["column"] for s in stats if s["dataset"] == name and s["n_distinct"] <= NARROW]
        if narrow:
            rows = [F.struct(F.lit(name).alias("dataset"), F.lit(c).alias("column"), F.col(f"d{i}").alias("n")) for i, c in enumerate(narrow)]
            one = df.agg(*[F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(narrow)]).select(F.inline(F.array(*rows)))
            second = one if second is None else second.unionAll(one)
    exact = {(r["dataset"], r["column"]): r["n"] for r in second.collect()} if second is not None else {}
    for s in stats:
        s["n_distinct"] = exact.get((s["dataset"], s["column"]), s["n_distinct"])
    return spark.createDataFrame([tuple(s.values()) for s in stats], CATALOGUE_SCHEMA)


def schema_catalogue(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Names and kinds of the columns of several tables, for the rules that ask no more than that. No table is scanned;
    the statistics are NULL."""
    held = [(name, i, c, kind_of(t)) for name, df in tables.items() for i, (c, t) in enumerate(df.dtypes)]
    rest = [f.split() for f in CATALOGUE_SCHEMA.split(", ")[4:]]
    return spark.createDataFrame(held, ", ".join(CATALOGUE_SCHEMA.split(", ")[:4])).select("*", *[F.lit(None).cast(t).alias(c) for c, t in rest])


def contracts_frame(spark: SparkSession, contracts: list[Contract]) -> DataFrame:
    rows = [(c.name, c.target, c.modality, c.is_temporal, list(c.discrete) if c.discrete is not None else None) for c in contracts]
    return spark.createDataFrame(rows, "dataset string, target string, modality string, is_temporal boolean, discrete array<string>")


def target_present(cat: DataFrame, contracts: DataFrame) -> DataFrame:
    """Per contract: does the target column exist, and how many feature columns remain."""
    is_target = F.col("column") == F.col("target")
    j = contracts.join(cat.select("dataset", "column"), "dataset")
    return j.groupBy("dataset", "target").agg(
        F.coalesce(F.max(is_target), F.lit(False)).alias("has_target"), F.count_if(~F.coalesce(is_target, F.lit(False))).alias("n_features"))


def is_numeric_kind() -> Column:
    return F.col("kind").isin("int", "float")


def discrete_columns(cat: DataFrame, contracts: DataFrame, limit: int = 20) -> DataFrame:
    """Explicitly declared discrete columns where a contract lists them, else text and narrow integer columns."""
    j = cat.join(contracts.select("dataset", "discrete"), "dataset", "left")
    auto = (F.col("kind") == "string") | ((F.col("kind") == "int") & (F.col("n_distinct") <= limit))
    return j.where(F.when(F.col("discrete").isNotNull(), F.array_contains("discrete", F.col("column"))).otherwise(auto)).select("dataset", "ordinal", "column")


def infer_modality(cat: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    """A valid declared modality wins; long text makes text; many pixel-like numeric columns (the median cell is a whole number) make image; else tabular."""
    num = is_numeric_kind()
    per = cat.groupBy("dataset").agg(
        F.max(F.coalesce(F.col("avg_len") > 50, F.lit(False)) & (F.col("kind") == "string")).alias("long_text"),
        F.count(F.lit(1)).alias("n_cols"), F.count_if(num).alias("n_num"),
        F.min(F.when(num, F.col("lo"))).alias("lo"), F.max(F.when(num, F.col("hi"))).alias("hi"), (F.sum(F.when(num, F.col("n_nonnull") - 2 * F.col("off_whole"))) > 0).alias("whole"))
    pixel = (F.col("n_cols") > 200) & (F.col("n_num") / F.col("n_cols") > 0.95) & (F.col("lo") >= 0) & (F.col("hi") <= 255) & F.col("whole")
    guess = F.when(F.col("long_text"), "text").when(pixel, "image").otherwise("tabular")
    if contracts is None:
        return per.select("dataset", guess.alias("modality"))
    j = per.join(contracts.select("dataset", F.col("modality").alias("declared")), "dataset", "left")
    return j.select("dataset", F.when(F.col("declared").isin("tabular", "text", "image", "graph"), F.col("declared")).otherwise(guess).alias("modality"))


def infer_task(cat: DataFrame, contracts: DataFrame, limit: int = 20) -> DataFrame:
    t = cat.select("dataset", F.col("column").alias("target"), "n_distinct")
    j = infer_modality(cat, contracts).join(contracts.select("dataset", "target"), "dataset", "left").join(t, ["dataset", "target"], "left")
    task = F.when(F.col("modality").isin("text", "image") | F.col("n_distinct").isNull(), "generation").when(F.col("n_distinct") <= limit, "classification").otherwise("regression")
    return j.select("dataset", "modality", task.alias("task"))


def suggest_target(cat: DataFrame, limit: int = 20) -> DataFrame:
    """The last narrow column, else the last column."""
    narrow = F.when(F.col("n_distinct") <= limit, F.col("ordinal"))
    return cat.groupBy("dataset").agg(F.coalesce(F.max_by("column", narrow), F.max_by("column", F.col("ordinal"))).alias("suggested"))


def named_like(words: list[str]) -> Column:
    return F.lower("column").rlike("|".join(words))


def _first(cond: Column) -> Column:
    at = F.when(cond, F.col("ordinal"))
    return F.min_by(F.when(cond, F.col("column")), at)


def detect_time_column(cat: DataFrame, words: list[str] | None = None, fallback: bool = True) -> DataFrame:
    """The first column named like a time; else (optionally) the first numeric one."""
    named = _first(named_like(words or fixed.TIME_WORDS) & F.col("kind").isin("int", "float", "string", "timestamp"))
    col = F.coalesce(named, _first(is_numeric_kind())) if fallback else named
    return cat.groupBy("dataset").agg(col.alias("time_col"))


def detect_entity_column(cat: DataFrame) -> DataFrame:
    """The first column named like an entity, other than the time column."""
    j = cat.join(detect_time_column(cat), "dataset")
    other = ~F.coalesce(F.col("column") == F.col("time_col"), F.lit(False))
    return j.groupBy("dataset").agg(F.max("time_col").alias("time_col"), _first(named_like(fixed.ENTITY_WORDS) & other).alias("entity_col"))


def detect_text_column(cat: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    """The longest text column (mean length at least 20), and the first one with mean length above 50."""
    is_text = F.col("kind") == "string"
    if contracts is not None:
        cat = cat.join(contracts.select("dataset", "target"), "dataset", "left")
        longest = is_text & ~F.coalesce(F.col("column") == F.col("target"), F.lit(False))
    else:
        longest = is_text
    best = F.max_by(F.when(longest, F.col("column")), F.when(longest, F.struct("avg_len", -F.col("ordinal"))))
    size = F.max(F.when(longest, F.col("avg_len")))
    out = cat.groupBy("dataset").agg(best.alias("b"), size.alias("s"), _first(is_text & (F.col("avg_len") > 50)).alias("first_long"))
    return out.select("dataset", F.when(F.col("s") >= 20, F.col("b")).alias("longest"), "first_long")


def detect_path_column(cat: DataFrame) -> DataFrame:
    return cat.groupBy("dataset").agg(_first(named_like(fixed.PATH_WORDS)).alias("path_col"))


def pick_sensitive(cat: DataFrame, contracts: DataFrame) -> DataFrame:
    """The column a leakage attack tries to learn.

    Candidates: text with 2-10 values, then numbers with 2-5, never the target. The first one named like a demographic
    wins, else the one with the fewest values.
    """
    j = cat.join(contracts.select("dataset", "target"), "dataset", "left").where(~F.coalesce(F.col("column") == F.col("target"), F.lit(False)))
    text = (F.col("kind") == "string") & F.col("n_distinct").between(2, 10)
    num = is_numeric_kind() & F.col("n_distinct").between(2, 5)
    place = F.struct(F.when(text, 0).otherwise(1).alias("g"), F.col("ordinal"))
    c = j.where(text | num)
    hint = named_like(fixed.DEMOGRAPHIC_WORDS)
    out = c.groupBy("dataset").agg(
        F.min_by(F.when(hint, F.col("column")), F.when(hint, place)).alias("h"), F.min_by("column", F.struct(F.col("n_distinct"), place)).alias("f"))
    return out.select("dataset", F.coalesce("h", "f").alias("sensitive"))
