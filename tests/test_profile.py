from datetime import date

from pyspark.sql import functions as F

from lexweave.functions.codes import is_blank, is_euid, is_iso_date, is_lei
from lexweave.operators import profile as P
from tests.conftest import rows


def lei_ok(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def test_codes(spark):
    base = "5493001KJTIIGC8Y1R"
    good = next(f"{base}{n:02d}" for n in range(100) if lei_ok(f"{base}{n:02d}"))
    texts = [good, good.lower(), good + "\n", good[:-1], good[:-2] + "00", "NLKVK.12345678", "nlKVK.1234", "2024-02-29", "2023-02-29", "2024-1-01", "2024-01-01\n", " ", "", " ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", is_lei(F.col("t")).alias("lei"), is_euid(F.col("t")).alias("euid"), is_iso_date(F.col("t")).alias("day"), is_blank(F.col("t")).alias("blank"))
    got = {r["t"]: r for r in df.collect()}
    assert [t for t in texts if got[t]["lei"]] == [good]
    assert [t for t in texts if got[t]["euid"]] == ["NLKVK.12345678"]
    assert [t for t in texts if got[t]["day"]] == ["2024-02-29"]
    assert {t for t in texts if got[t]["blank"]} >= {" ", "", None}


def test_lei_against_integers(spark):
    import random

    rnd = random.Random(3)
    texts = ["".join(rnd.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(18)) + f"{rnd.randrange(100):02d}" for _ in range(3000)]
    texts += [t[:18] + f"{n:02d}" for t in texts[:30] for n in range(100) if lei_ok(t[:18] + f"{n:02d}")]
    got = {r["t"] for r in spark.createDataFrame([(t,) for t in texts], "t string").filter(is_lei(F.col("t"))).collect()}
    assert got == {t for t in texts if lei_ok(t)}


SCHEMA = "load_no int, value string, cls string, n string"


def counted(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    return df, [P.category_field("f", F.col("value")), P.pattern_field("g", F.col("value"), r"\A[A-Z]{2}\z")]


def test_drift_of_loads_with_gaps_nulls_and_clashing_names(spark):
    data = [(1, "NL", "x", "x")] * 8 + [(1, None, None, None)] * 2 + [(4, "NL", "", "")] * 3 + [(4, "be", "", "")] * 7 + [(None, "NL", "", "")] * 50
    df, fields = counted(spark, data)
    got = {(r["field_name"], r["load_no"]): r for r in P.drift(P.class_counts(df, "load_no", fields)).collect()}
    assert set(got) == {("f", 4), ("g", 4)}
    assert got["f", 4]["before_load"] == 1 and abs(got["f", 4]["total_variation"] - 0.7) < 1e-9
    table = [(8, 3), (0, 7), (2, 0)]
    total = 20
    chi = sum((o - r * c / total) ** 2 / (r * c / total) for pair in table for o, r, c in [(pair[0], sum(pair), 10), (pair[1], sum(pair), 10)])
    assert abs(got["f", 4]["chi_square"] - chi) < 1e-9


def test_profile_counts(spark):
    df, fields = counted(spark, [(1, "NL", "", ""), (1, "NL", "", ""), (1, "BE", "", ""), (1, "", "", ""), (1, "nl", "", "")])
    got = {r["field_name"]: r for r in P.profile(P.value_counts(df, "load_no", fields)).collect()}
    g = got["g"]
    assert (g["n_rows"], g["n_blank"], g["n_distinct"], g["min_value"], g["max_value"], g["n_violations"], g["top_count"]) == (5, 1, 3, "BE", "nl", 1, 2)


def test_empty_table_and_single_load(spark):
    df, fields = counted(spark, [])
    assert rows(P.drift(P.class_counts(df, "load_no", fields))) == [] and rows(P.profile(P.value_counts(df, "load_no", fields))) == []
    df, fields = counted(spark, [(1, "a", "", "")])
    assert rows(P.drift(P.class_counts(df, "load_no", fields))) == []


def test_magnitude_and_date_fields(spark):
    df = spark.createDataFrame([(1, t) for t in ("12", "12.50", "1234567", "12,5", "", None, "12.", "2024-02-30")], "load_no int, value string")
    fields = [P.magnitude_field("m", F.col("value")), P.date_field("d", F.col("value")), P.boolean_field("b", F.col("value").isNull())]
    got = {(r["field_name"], r["cls"]): r["n"] for r in P.class_counts(df, "load_no", fields).collect()}
    assert got["m", "digits:2"] == 2 and got["m", "digits:7"] == 1 and got["m", "blank"] == 2 and got["m", "other"] == 3
    assert got["d", "other"] == 6 and got["b", "true"] == 1


def test_every_key_of_a_map_is_profiled(spark):
    data = [(1, {"a": "NL", "new": "x"}), (1, {"a": "be", "new": None}), (1, None), (2, {"a": "NL"}), (2, {"new": "x"}), (None, {"gone": "x"})]
    df = spark.createDataFrame(data, "load_no int, m map<string,string>")
    declared = [P.pattern_field("m.a", F.col("value"), r"\A[A-Z]{2}\z"), P.category_field("m.b", F.col("value"))]
    got = P.profile(P.map_value_counts(df, "load_no", "m", "m.", declared))
    assert rows(got, "field_name", "load_no", "n_rows", "n_blank", "n_distinct", "n_violations") == [
        ("m.a", 1, 3, 1, 2, 1), ("m.a", 2, 2, 1, 1, 0), ("m.b", 1, 3, 3, 0, 0), ("m.b", 2, 2, 2, 0, 0), ("m.new", 1, 3, 2, 1, 0), ("m.new", 2, 2, 1, 1, 0),
    ]
    broken = {r["field_name"]: r["total_variation"] for r in P.drift(P.map_class_counts(df, "load_no", "m", "m.", declared)).collect()}
    assert set(broken) == {"m.a", "m.b", "m.new"} and abs(broken["m.new"] - 1 / 6) < 1e-9
    assert rows(P.map_value_counts(df.limit(0), "load_no", "m", "m.", declared)) == []


def test_answers_beyond_the_declared_ten(spark, tmp_path):
    from lexweave.queries import training

    spark.createDataFrame([(1, {"s99.1": "x"}), (1, {})], "load_no int, answers map<string,string>").write.parquet(f"{tmp_path}/arrangements.parquet")
    spark.createDataFrame([], "load_no int, provider_code string").write.parquet(f"{tmp_path}/chain_rows.parquet")
    spark.createDataFrame([], "load_no int, mandatory boolean").write.parquet(f"{tmp_path}/roi_columns.parquet")
    got = {r["field_name"]: r for r in training.QUERIES["p1_profile"](spark, str(tmp_path)).collect()}
    assert len(got) == 11 and (got["answers.s99.1"]["n_rows"], got["answers.s99.1"]["n_blank"]) == (2, 1)


def test_numeric_range_beside_the_text_range(spark, tmp_path):
    from lexweave.queries import training

    spark.createDataFrame([(1, {"s7.2": t}) for t in ("1584", "10001", "9999.50", "volgt")], "load_no int, answers map<string,string>").write.parquet(f"{tmp_path}/arrangements.parquet")
    spark.createDataFrame([], "load_no int, provider_code string").write.parquet(f"{tmp_path}/chain_rows.parquet")
    spark.createDataFrame([], "load_no int, mandatory boolean").write.parquet(f"{tmp_path}/roi_columns.parquet")
    got = training.QUERIES["p1_profile"](spark, str(tmp_path)).filter("field_name = 'answers.s7.2'").first()
    assert (got["min_value"], got["max_value"], got["min_number"], got["max_number"]) == ("10001", "volgt", 1584.0, 10001.0)


def test_range_of_days(spark):
    df = spark.createDataFrame([(1, t) for t in ("2024-02-01", "2023-12-31", "2024-02-30", "x", "", None)] + [(2, "x")], "load_no int, value string")
    got = rows(P.profile(P.value_counts(df, "load_no", [P.date_field("d", F.col("value"))])), "load_no", "min_day", "max_day")
    assert got == [(1, date(2023, 12, 31), date(2024, 2, 1)), (2, None, None)]
