import json

from pyspark.sql import functions as F

from lexweave.operators import nested as N
from tests.conftest import rows


def test_list_items_at_any_depth_and_in_any_shape(spark):
    deep = {"type": "list", "items": [{"marker": "i)", "content": json.dumps([{"type": "list", "items": {"marker": "x"}}])}]}
    content = [{"type": "text", "text": "a"}, None, {"type": "list", "items": [{"marker": "a)", "content": deep}, None, "text", {"content": "{broken"}, {}]}, {"type": "table", "items": [{"marker": "no"}]}]
    articles = spark.createDataFrame(
        [
            (1, [(1, json.dumps(content)), (2, None), (3, "[{"), (4, json.dumps(json.dumps({"type": "list", "items": [{"opmerking": {"items": 2}}]})))]),
            (2, None),
            (3, []),
            (None, [(1, json.dumps(content))]),
        ],
        "article_id long, paragraphs array<struct<para_no int, content string>>",
    )
    got = rows(N.child_table(N.article_items(articles), "articles", 2), "record_id", "child_path", "parent_path")
    p = "paragraphs[0].content[2].items"
    assert got == sorted(
        [
            (1, f"{p}[0]", "paragraphs[0]"),
            (1, f"{p}[0].content[0].items[0]", f"{p}[0]"),
            (1, f"{p}[0].content[0].items[0].content[0].items[0]", f"{p}[0].content[0].items[0]"),
            (1, f"{p}[3]", "paragraphs[0]"),
            (1, f"{p}[4]", "paragraphs[0]"),
            (1, "paragraphs[3].content[0].items[0]", "paragraphs[3]"),
        ],
        key=repr,
    )


def test_options(spark):
    q = {"modules": [None, {"questions": json.dumps([{"options": {"value": 1}}, {"options": None}, None, {"options": "[null, {\"value\": 2}]"}])}, {"questions": 7}]}
    df = spark.createDataFrame([(1, json.dumps(q)), (2, "{"), (3, None), (4, "[]")], "quest_id long, raw_json string")
    got = rows(N.child_table(N.questionnaire_options(df), "questionnaires", 1), "record_id", "child_path", "parent_path", "position", "schema_path")
    assert got == [
        (1, "modules[1].questions[0].options[0]", "modules[1].questions[0]", 0, "modules.questions.options"),
        (1, "modules[1].questions[3].options[1]", "modules[1].questions[3]", 1, "modules.questions.options"),
    ]


def test_chain_keeps_places_of_null_elements(spark):
    df = spark.createDataFrame([(1, [None, ("a",)], "x"), (1, [None, ("a",)], "x"), (2, None, "x"), (3, [], "x")], "arr_row long, chain array<struct<id string>>, label string")
    got = rows(N.child_table(N.chain_elements(df), "arrangements", 1), "record_id", "child_path", "parent_path")
    assert got == [(1, "chain[1]", "")] * 2


def test_very_deep_and_very_long(spark):
    content = "[]"
    for _ in range(60):
        content = json.dumps([{"type": "list", "items": [{"content": json.loads(content)}]}])
    long = json.dumps([{"type": "list", "items": [{"marker": str(i)} for i in range(20000)]}])
    df = spark.createDataFrame([(1, [(1, content)]), (2, [(1, long)])], "article_id long, paragraphs array<struct<para_no int, content string>>")
    assert dict(rows(N.article_items(df).groupBy("record_id").agg(F.count("*").alias("n")))) == {1: 60, 2: 20000}
