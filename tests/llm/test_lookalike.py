import random
import unicodedata

import regex
from pyspark.sql import functions as F

from lexweave.llm import lookalike as L
from tests.conftest import rows

SCHEMA = "record_id long, text string, script string, is_marker boolean, normal_key string"


def brute(text, script, marker):
    """The same form by whole-string normalisation instead of joined code points."""
    decomposed = "".join(unicodedata.normalize("NFD", L._plain(c)) for c in text)
    home = regex.compile(rf"\p{{{script}}}")
    out = []
    for word in regex.findall(r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+", decomposed):
        out.append("".join(L.look_alikes()[script].get(c, c) for c in word) if marker or home.search(word) else word)
    return unicodedata.normalize("NFC", "".join(out))


def forms(spark, texts):
    df = spark.createDataFrame([(i, t, s, m, "clash") for i, (t, s, m) in enumerate(texts)], SCHEMA)
    return {r["record_id"]: r["normal"] for r in L.with_normal_form(df).collect()}, {r["record_id"] for r in L.changed(df).collect()}


def test_cases(spark):
    cases = [
        ("De instelling", "De instelling", False), ("coo\u0308rdinator", "co\u00f6rdinator", True), ("a b c d e‑f", "a b c d e-f", True),
        ("ｖａｓｔ，１", "vast,1", True), ("in​ge­vuld﻿", "ingevuld", True), ("ﬁnancieel afzonderlĳk Ⅳ ⅳ", "financieel afzonderlijk IV iv", True),
        ("m² ½ ™ № „x” ’s – …", "m² ½ ™ № „x” ’s – …", False), ("zоndеr", "zonder", True), ("term σύμβαση en λ", "term σύμβαση en λ", False), ("a  b", "a  b", False), ("", "", False),
        ("cafẹ́", "cafẹ́", True),
    ]
    normal, changed = forms(spark, [(t, "Latin", False) for t, _, _ in cases])
    assert [normal[i] for i in range(len(cases))] == [n for _, n, _ in cases]
    assert changed == {i for i, c in enumerate(cases) if c[2]}


def test_scripts_and_markers(spark):
    cases = [
        ("а)", "Latin", True, "a)"), ("а)", "Latin", False, "а)"), ("а)", "Cyrillic", True, "а)"), ("a)", "Cyrillic", True, "а)"), ("κατάλoγο artikel", "Greek", False, "κατάλογο artikel"),
        ("ά", "Greek", False, "ά"), ("Venquimer", "Cyrillic", False, "Venquimer"), ("іі)", "Latin", True, "ii)"),
    ]
    normal, changed = forms(spark, [c[:3] for c in cases])
    assert [normal[i] for i in range(len(cases))] == [c[3] for c in cases]
    assert changed == {i for i, c in enumerate(cases) if c[0] != c[3]}


def test_random_texts_against_brute_force(spark):
    rnd = random.Random(6)
    pool = "abceopxyABC éëö ̧̣́̈ аеорсух ΑΟοενρ άόά ａ１．ﬁĳⅣ​­ ‑ -½™λσ йЙѕі"
    texts = [("".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 25))), rnd.choice(L.SCRIPTS), rnd.random() < 0.3) for _ in range(1500)]
    texts.append(("zоnder ẹ́ " * 4000, "Latin", False))
    normal, changed = forms(spark, texts)
    want = {i: brute(*t) for i, t in enumerate(texts)}
    assert [(texts[i], normal[i], want[i]) for i in want if normal[i] != want[i]] == []
    assert changed == {i for i, t in enumerate(texts) if want[i] != t[0]}


def test_hangul_and_marks_without_a_class_against_brute_force(spark):
    rnd = random.Random(9)
    jamo = "\u1100\u1112\u1161\u1175\u11a8\u11c2\uac00\uac01\ud7a3\uac1c a"
    marks = "aeo\u0301\u0323\u0327\u20dd\u0903\u0308c "
    texts = [("".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 14))), "Latin", False) for pool in (jamo, marks) for _ in range(400)]
    texts += [("\u1112\u1161\u11ab\u1100\u1173\u11af", "Latin", False), ("\uac00\u11a8", "Greek", False), ("\ud55c\uae00", "Latin", False)]
    normal, changed = forms(spark, texts)
    want = {i: brute(*t) for i, t in enumerate(texts)}
    assert [(texts[i], normal[i], want[i]) for i in want if normal[i] != want[i]] == []
    assert changed == {i for i, t in enumerate(texts) if want[i] != t[0]} and normal[800] == "\ud55c\uae00" and 802 not in changed


def test_forms_are_final(spark):
    rnd = random.Random(7)
    texts = [("".join(rnd.choice("aоеé́ｂ  ﬁ") for _ in range(8)), "Latin", False) for _ in range(100)]
    normal, _ = forms(spark, texts)
    again, changed = forms(spark, [(normal[i], "Latin", False) for i in range(len(texts))])
    assert changed == set() and again == normal


def test_nulls_repeats_and_empty_tables(spark):
    nodes = spark.createDataFrame([(1, "nl", "а)", None), (1, "nl", "а)", None), (2, None, None, "zоnder"), (None, "EL", "α)", "")], "node_id long, lang string, marker string, body string")
    labels = spark.createDataFrame([(5, "nl", None), (6, "nl", "Nааm")], "col_row long, lang string, label string")
    got = L.changed(L.register_texts(nodes, labels))
    assert rows(got, "table_name", "field_name", "record_id") == [("content_nodes", "body", 2), ("content_nodes", "marker", 1), ("content_nodes", "marker", 1), ("roi_columns", "label", 6)]
    assert L.changed(L.register_texts(nodes.limit(0), labels.limit(0))).count() == 0
    assert L.with_normal_form(L.register_texts(nodes, labels)).filter(F.col("normal").isNull()).count() == 0
