import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as X


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "column, text, want",
    [
        (X.clean, " a \n b ( 12 ) c ", "a b (12) c"), (X.fold, "Coördinatór Één", "coordinator een"), (X.slug, "Lid 1, punt A)", "lid-1-punt-a"), (X.slug, "—", ""), (X.slug, "(14)", "14"),
        (lambda c: X.clip(c, 20, 12), "kort", "kort"), (lambda c: X.clip(c, 20, 5), "een twee drie vier vijf zes", "een twee drie vier…"), (lambda c: X.clip(c, 20, 19), "een twee drie vier vijf zes", "een twee drie vier …"),
        (lambda c: X.clip(c, 10), "aaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaa…"), (lambda c: X.highlight(c, ["reg", "register", "a"]), "Het Register", "Het <mark>Register</mark>"), (lambda c: X.highlight(c, []), "a", "a"),
        (X.csv_cell, 'a"b', '"a""b"'), (X.csv_cell, "a;b", '"a;b"'), (X.csv_cell, "a\rb", "a\rb"), (X.csv_cell, None, ""), (X.plain_cell, " a\t\nb ", "a b"),
    ],
)
def test_columns(spark, column, text, want):
    assert one(spark, column, text) == want


def test_tokens_and_terms(spark):
    df = spark.createDataFrame([("Één artikel-6, de x!",)], "t string").select(X.tokens(F.col("t")).alias("w"))
    assert df.first()["w"] == ["een", "artikel", "6", "de", "x"]
    kept = df.select(F.filter("w", X.is_searchable).alias("w")).first()["w"]
    assert kept == ["artikel", "6"]


def test_roman_both_ways(spark):
    df = spark.range(1, 4000).withColumn("r", X.to_roman(F.col("id")))
    assert df.filter(X.from_roman(F.col("r")) != F.col("id")).count() == 0
    assert {r["r"]: r["n"] for r in spark.createDataFrame([("IIII",), ("iv",), ("",), ("abc",), (None,), ("MMXXIV",)], "r string").withColumn("n", X.from_roman(F.col("r"))).collect()} == {"IIII": None, "iv": 4, "": None, "abc": None, None: None, "MMXXIV": 2024}


def test_csv_round_trip(spark):
    rnd = random.Random(1)
    rows = [tuple("".join(rnd.choice('ab",;\n ') for _ in range(rnd.randrange(5))) for _ in range(3)) for _ in range(200)]
    lines = [r["l"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, c string").orderBy("i").select(X.csv_line(F.col("a"), F.col("b"), F.col("c")).alias("l")).collect()]
    assert [tuple(r) for r in csv.reader(io.StringIO("\r\n".join(lines), newline=""))] == rows


def test_markdown_table_and_rounding(spark):
    df = spark.createDataFrame([([["a|b", "c\nd"], ["1", None]],)], "t array<array<string>>")
    assert df.select(X.markdown_table(F.col("t")).alias("m")).first()["m"] == "| a\\|b | c d |\n| --- | --- |\n| 1 |  |"
    assert [r["h"] for r in spark.createDataFrame([(0.5,), (1.5,), (2.4,), (-0.5,)], "x double").select(X.half_up(F.col("x")).alias("h")).collect()] == [1, 2, 2, 0]
