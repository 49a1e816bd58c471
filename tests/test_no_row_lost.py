"""Rows with NULL classes, NULL order values or empty columns stay, and digests see every digit."""

from pyspark.sql import functions as F

from twinloom.functions import ordered
from twinloom.operators import generate, prepare
from twinloom.sources import tables


def test_null_class_is_split_like_any_other(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"c{i % 3}") for i in range(30)], "k long, y string")
    got = prepare.split_stratified(df, "k", "y", 0.7)
    assert got.count() == 30
    assert got.where("y is null and part = 'train'").count() == 7


def test_null_order_values_keep_their_rows(spark):
    df = spark.createDataFrame([(i, float(i) if i % 5 else None) for i in range(20)], "k long, t double")
    assert ordered.with_next(df, "t", ["k"], tie="k").count() == 20


def test_empty_column_stays_empty(spark):
    df = spark.createDataFrame([(i, None, "a") for i in range(30)], "k long, x string, y string")
    got = generate.gen_categorical(df, ["x", "y"], 30)
    assert (got.count(), got.where("x is null").count(), got.where("y = 'a'").count()) == (30, 30, 30)


def test_class_without_values_draws_from_all(spark):
    df = spark.createDataFrame([(i, None if i % 2 else f"w{i % 4}", float(i), "odd" if i % 2 else "even") for i in range(40)], "k long, w string, v double, y string")
    labels = generate.gen_labels(df, "y", 40)
    got = generate.gen_conditional(df, labels, "y", ["v"], ["w"])
    assert got.count() == 40
    assert got.where("w is null or v is null").count() == 0


def test_digest_sees_small_fractions_and_borders(spark):
    digest = lambda rows, kind: tables.table_digest(spark.createDataFrame(rows, kind)).first()["digest"]
    assert digest([(0.00001,)], "x double") != digest([(0.00002,)], "x double")
    assert digest([("a|b", "c")], "x string, y string") != digest([("a", "b|c")], "x string, y string")
    assert digest([(None,)], "x string") != digest([("\\N",)], "x string")
    assert digest([(1e40,)], "x double") != digest([(1e41,)], "x double")


def test_csv_keeps_line_ends_and_quotes(spark, tmp_path):
    rows = [(1, 'two\nlines, "quoted" \\ and more'), (2, "plain")]
    df = spark.createDataFrame(rows, "k long, t string")
    tables.write_csv(df.coalesce(1), str(tmp_path / "out"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "out"), "k long, t string").collect())) == rows
    assert tables.read_csv(spark, str(tmp_path / "out"), None).dtypes[0][1] == "int"


def test_tokens_of_any_script(spark):
    from twinloom.operators.text import tokens

    got = spark.createDataFrame([("Élève naïve Привет",)], "t string").select(tokens(F.col("t")).alias("w")).first()["w"]
    assert got == ["élève", "naïve", "привет"]
