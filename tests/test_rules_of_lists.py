"""Small cases of list constraints, imports, marks and several queries at once."""

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.operators import register as G
from lexweave.operators import rules as R
from lexweave.operators import search as S
from lexweave.operators import state as K
from lexweave.plans import quality as Q
from tests.conftest import rows


def test_not_exactly_once_and_off_list(spark):
    things = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1)], "act string, no int")
    listed = spark.createDataFrame([("a", 1), ("b", 1), ("b", 1), ("c", 9)], "act string, no int")
    assert rows(Q.not_exactly_once(listed, things, ["act", "no"])) == [("a", 2, True, 0), ("b", 1, True, 2), ("c", 9, False, 1)]
    assert rows(Q.not_exactly_once(listed.limit(0), things.limit(0), ["act", "no"])) == []
    r = spark.createDataFrame([(1, True), (2, None), (3, False), (4, True)], "id int, flat boolean")
    assert rows(Q.off_list(r, "id", F.col("flat"), spark.createDataFrame([(1,), (3,), (7,)], "id int"))) == [(3, "does not meet"), (4, "not listed"), (7, "does not meet")]


def test_imported(spark):
    raw = [
        (1, '{"v":1,"arrangements":[{"id":"a","name":"n","answers":{"q":"x"}},{"id":"b","name":null,"answers":{}},{"id":"c","name":"n","answers":[]},"x",null]}'),
        (2, '{"v":2,"arrangements":[]}'), (3, '{"v":1,"arrangements":'), (4, '{"v":1,"arrangements":{}}'), (5, '{"v":1,"arrangements":[]}'), (6, None), (7, "[]"), (8, '{"arrangements":[]}'), (9, ""),
    ]
    got = {r["k"]: (r["n_imported"], [x for x in r["records"]]) for r in K.imported(spark.createDataFrame(raw, "k int, raw string"), "raw").collect()}
    assert {k: n for k, (n, _) in got.items()} == {1: 1, 2: -1, 3: -1, 4: -1, 5: 0, 6: -1, 7: -1, 8: -1, 9: -1}
    assert len(got[1][1]) == 1 and '"id":"a"' in got[1][1][0]


def test_marks_names_and_zeros(spark):
    df = spark.createDataFrame([("►C1 B_06.01.0050 ◄", "Één contract / 2", 7), (" x ", "a-b_c", 123), (None, None, None)], "a string, b string, n int")
    assert [tuple(r) for r in df.select(X.without_corrigendum(F.col("a")), X.file_name(F.col("b")), X.zero_padded(F.col("n"))).collect()] == [("B_06.01.0050", "_n_contract_2", "07"), ("x", "a-b_c", "123"), (None, None, None)]


def test_several_queries_are_the_single_ones(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"kop {w}", f"{w} en {v} van het register") for i, (w, v) in enumerate([("plan", "lijst"), ("lijst", "plan"), ("keten", "keten keten"), ("uitwijk", "plannen")])], "doc_id long, heading string, text string")
    built = S.build_index(docs)
    built.save(str(tmp_path / "index"))
    loaded = S.Index.load(spark, str(tmp_path / "index"))
    queries = {3: "plan", 5: "keten lijst", 8: "x", 9: "zzz"}
    for options in (S.TYPEAHEAD, S.PRECISION, S.Options(prefix_from=None, fuzzy_from=None)):
        many = {(r["query_id"], r["rank"]): (r["doc_id"], r["coverage"], r["score"]) for r in S.search_many(loaded, queries, 2, options).collect()}
        single = {(k, i + 1): (r["doc_id"], r["coverage"], r["score"]) for k, q in queries.items() for i, r in enumerate(S.search(built, q, 2, options).collect())}
        assert many == single and (9, 1) not in many
    assert rows(S.search_many(loaded, {1: "a"}, 5)) == []


def test_completeness_in_the_row_is_that_of_the_fields(spark):
    columns = spark.createDataFrame(
        [("T1", "c1", "assessment:q1", True), ("T1", "c2", "manual", True), ("T1", "c3", None, False), ("T2", "c4", "auto", True), ("T3", "c5", "manual", False)], "template_code string, code string, fill_source string, mandatory boolean"
    )
    lists = spark.createDataFrame([("c1", 1, "1. Een")], "column_code string, item_no int, official_text string")
    records = spark.createDataFrame([(1, {"q1": "1", "d": "x"}, {"c2": " "}), (2, {"q1": " "}, {"c1": "", "c2": "y"}), (3, None, None), (4, {"q1": "ja"}, {"c1": "  "})], "arr_row long, answers map<string,string>, manual map<string,string>")
    derived = {"c4": F.col("answers")["d"]}
    fields = G.resolved(records, columns, lists, derived)
    assert rows(G.completeness_of_records(records, columns, derived)) == rows(G.completeness(fields, ["arr_row", "template_code"]))
    assert rows(G.resolved(records, columns, lists, derived, templates=["T2"])) == rows(fields.filter("template_code = 'T2'"))
    assert G.resolved(records, columns, lists, templates=["none"]).count() == 0 and G.completeness_of_records(records, columns.limit(0)).count() == 0
    assert rows(G.template_heads(columns.withColumn("label", F.upper("code"))), "template_code", "line") == [("T1", "C1,C2,C3"), ("T1", "c1,c2,c3"), ("T2", "C4"), ("T2", "c4"), ("T3", "C5"), ("T3", "c5")]


def test_matrices_of_many_cells_and_lists_over_the_bound(spark):
    wide = ["B_99.01.R1", *[""] * 1500, "ver weg"]
    matrix = [("m1", 1, ["B_99.01.R1", "B_01.02.0020", "x", "1. A"]), ("m1", 2, wide[:1] + [""] + wide[2:1502]), ("m2", 1, ["B_99.01.R1", "los"]), ("m2", 2, ["B_99.01.R1", "B_02.01.0010", "y", "1. ►C2 C ◄"])]
    got = G.lists_from_matrix(spark.createDataFrame(matrix, "matrix_id string, row_no int, cells array<string>"))
    assert rows(got, "matrix_id", "column_code", "official_text") == [("m1", "B_01.02.0020", "1. A"), ("m1", "B_01.02.0020", "ver weg"), ("m2", "B_02.01.0010", "1.  C")]
    many = spark.range(G.MAX_COLUMNS + 1).select(F.lit("c").alias("column_code"), F.col("id").cast("int").alias("item_no"), F.lit("x").alias("official_text"))
    with pytest.raises(ValueError, match="closed lists"):
        G.list_map(many)


def test_column_answers(spark):
    modules = (R.Module("m", (R.Question("a", column_code="c1"), R.Question("b"), R.Question("c", show_if={"answer": {"q": "a", "is": "ja"}}, column_code="c2"))),)
    df = spark.createDataFrame([(1, {"a": "ja", "c": "x"}), (2, {"a": "nee", "c": "x"}), (3, None)], "k long, answers map<string,string>")
    assert rows(R.column_answers(R.evaluated(df, modules), modules, "k")) == [(1, "a", "c1", "ja"), (1, "c", "c2", "x"), (2, "a", "c1", "nee"), (3, "a", "c1", None)]
    assert R.column_answers(R.evaluated(df, modules), (R.Module("m", ()),), "k").count() == 0
