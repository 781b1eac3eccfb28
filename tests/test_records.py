import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexweave import api
from lexweave.operators import register as G
from lexweave.operators import rules as R
from lexweave.operators import search as S
from lexweave.operators import state as K
from lexweave.sources import corpus
from lexweave.streaming import keyed
from tests.conftest import rows

Q = R.Question
MODULES = (
    R.Module("a", (Q("q1", effects=((("ja", "x"), "f"),)), Q("q2", show_if={"flag": "f"}, effects=((("ja",), "g"),), obligation=True))),
    R.Module("b", (Q("q3", obligation=True), Q("q4", show_if={"any": []})), {"all": [{"flag": "f"}, {"not": {"flag": "g"}}]}),
    R.Module("c", (Q("q5", show_if={"answer": {"q": "q1", "is": "nee"}}, obligation=True), Q("q6", show_if={"all": []}), Q("q7", show_if={})), {"any": [{"flag": "g"}, {"answer": {"q": "q1", "is": ["nee", ""]}}]}),
)


def by_hand(answers):
    """The forward pass, one question at a time."""

    def holds(t, flags):
        if "all" in t:
            return all(holds(x, flags) for x in t["all"])
        if "any" in t:
            return any(holds(x, flags) for x in t["any"])
        if "not" in t:
            return not holds(t["not"], flags)
        if "flag" in t:
            return t["flag"] in flags
        if "answer" in t:
            w = t["answer"]["is"]
            return answers.get(t["answer"]["q"]) in (w if isinstance(w, list) else [w])
        return True

    flags, shown = set(), []
    for m in MODULES:
        on = not m.show_if or holds(m.show_if, flags)
        for q in m.questions:
            if on and (not q.show_if or holds(q.show_if, flags)):
                shown.append(q.id)
                for wanted, flag in q.effects:
                    if answers.get(q.id) and answers[q.id] in wanted:
                        flags.add(flag)
    return sorted(flags), shown


def test_questionnaires_against_the_forward_pass(spark):
    rnd = random.Random(1)
    sets = [{q: rnd.choice(["ja", "nee", "nvt", "x", "", None]) for q in ("q1", "q2", "q3", "q4", "q5") if rnd.random() < 0.7} for _ in range(200)]
    ev = R.evaluated(spark.createDataFrame(list(enumerate(sets)), "id long, answers map<string,string>"), MODULES)
    got = {r["id"]: r for r in ev.collect()}
    for i, a in enumerate(sets):
        assert (got[i]["flags"], got[i]["visible_questions"]) == by_hand(a)
    status = {"ja": "voldaan", "nee": "actie", "nvt": "nvt"}
    want = sorted((i, q, status.get(a.get(q), "open")) for i, a in enumerate(sets) for q in by_hand(a)[1] if q in ("q2", "q3", "q5"))
    assert rows(R.obligations(ev, MODULES, "id"), "id", "question_id", "status") == sorted(want, key=repr)
    assert rows(R.progress(ev, MODULES, "id")) == sorted(((i, sum(bool(a.get(q)) for q in by_hand(a)[1]), len(by_hand(a)[1])) for i, a in enumerate(sets)), key=repr)


def test_derived_flags_labels_and_dates(spark):
    df = spark.createDataFrame([(1, {"q1": "ja", "q2": "2"})], "id long, answers map<string,string>")
    ev = R.evaluated(df, MODULES, derive=lambda flags: {"both": flags.get("f", F.lit(False)) & ~flags.get("g", F.lit(False))})
    assert ev.first()["flags"] == ["both", "f"]
    labels = df.select(R.answer_label(Q("x", options=(("2", "Twee"),)), F.col("answers")["q2"]).alias("a"), R.answer_label(Q("y"), F.col("answers")["q1"]).alias("b"), R.answer_label(Q("z"), F.col("answers")["no"]).alias("c"))
    assert rows(labels) == [("Twee", "Ja", "")]
    assert rows(R.timeline(ev, [("2025-01-02", "late", None), ("2024-01-01", "with f", "f"), ("2023-01-01", "with g", "g")], "id"), "place", "label") == [(0, "with f"), (1, "late")]


COLUMNS = [
    ("T1", "T1.0010", "Referentie", "Alfanumeriek", "", "Verplicht", True, "assessment:s1", False), ("T1", "T1.0020", "LEI van de entiteit", "Alfanumeriek", "", "Verplicht", True, "auto", False),
    ("T1", "T1.0030", "Land", "Land", "", "Facultatief", False, "supplier", True), ("T1", "T1.0040", "Vorm", "Gesloten lijst", "", "Verplicht", True, "assessment:s2", True), ("T2", "T2.0010", "Bedrag", "Monetair", "", None, None, None, None),
]
SCHEMA = "template_code string, code string, label string, soort string, instruction string, mandatory_raw string, mandatory boolean, fill_source string, ask_supplier boolean"


def test_register(spark):
    columns = spark.createDataFrame(COLUMNS, SCHEMA)
    lists = spark.createDataFrame([("T1.0040", 1, "1. Los"), ("T1.0040", 2, "2. Raam")], "column_code string, item_no int, official_text string")
    records = spark.createDataFrame([(1, {"s1": "C-1", "s2": "2"}, {"T1.0040": "9", "T2.0010": "12,50"}), (2, {"s1": "", "s2": "S17"}, None), (3, None, {"T1.0010": "hand", "T1.0030": "XX"})], "arr_row long, answers map<string,string>, manual map<string,string>")
    f = G.resolved(records, columns, lists, {"T1.0020": F.when(F.col("arr_row") == 1, "5493001KJTIIGC8Y1R12").otherwise("5493001KJTIIGC8Y1R13")})
    got = {(r["arr_row"], r["code"]): (r["value"], r["origin"], r["overridden"]) for r in f.collect()}
    assert got[1, "T1.0010"] == ("C-1", "assessment", False) and got[1, "T1.0040"] == ("9", "manual", True) and got[2, "T1.0040"] == ("S17", "assessment", False)
    assert got[2, "T1.0010"] == ("", "leeg", False) and got[3, "T1.0010"] == ("hand", "manual", False) and got[1, "T1.0020"][1] == "auto" and len(got) == 15
    issues = {(r["arr_row"], r["code"]): r["issue"] for r in G.validated(f, lists).collect() if r["issue"]}
    assert issues == {(1, "T1.0040"): "fout:lijst", (2, "T1.0010"): "ontbreekt", (2, "T1.0020"): "fout:lei", (2, "T1.0040"): "fout:lijst", (3, "T1.0020"): "fout:lei", (3, "T1.0030"): "fout:land", (3, "T1.0040"): "ontbreekt"}
    assert rows(G.completeness(f, ["arr_row", "template_code"])) == [(1, "T1", 3, 3), (1, "T2", 0, 0), (2, "T1", 2, 3), (2, "T2", 0, 0), (3, "T1", 2, 3), (3, "T2", 0, 0)]
    assert rows(G.supplier_requests(f), "arr_row", "code") == [(1, "T1.0030"), (2, "T1.0030"), (3, "T1.0040")]
    lines = {(r["part"], r["arr_row"]): r["line"] for r in G.template_lines(f, "T1").collect()}
    assert lines[1, None] == "T1.0010,T1.0020,T1.0030,T1.0040" and lines[3, 1] == "C-1,5493001KJTIIGC8Y1R12,,9" and len(lines) == 5
    assert G.csv_file(G.template_lines(f, "T1"), ["part", "arr_row"]).first()["csv"].count("\r\n") == 4
    with pytest.raises(ValueError):
        G.bounded_schema(columns, 2)


def test_values_against_their_form(spark):
    cases = [("2025-02-30", "Datum", "fout:datum"), ("2025-02-28", "Datum", None), ("el", "Land", None), ("XX", "Land", "fout:land"), ("12.5", "Monetair", None), ("12.", "Monetair", "fout:monetair"), (" ", "Tekst", "ontbreekt"), ("x", "Tekst", None), (None, "Datum", "ontbreekt")]
    df = spark.createDataFrame(cases, "v string, s string, want string").select("*", G.issue(F.col("v"), F.lit("Veld"), F.col("s"), F.lit(True)).alias("got"))
    assert df.filter("NOT (want <=> got)").count() == 0
    lei = spark.createDataFrame([("LEI-code", "5493001KJTIIGC8Y1R13", "fout:lei"), ("leiding", "5493001KJTIIGC8Y1R13", None), ("LEI-code", "kort", None), ("LEI-code", "5493001kjtiigc8y1r12", None)], "l string, v string, want string")
    assert lei.filter(~G.issue(F.col("v"), F.col("l"), F.lit("Alfanumeriek"), F.lit(False)).eqNullSafe(F.col("want"))).count() == 0


def test_chain_and_schema_derivation(spark):
    records = spark.createDataFrame([(1, {"s1.1": "C;1"}, [("S1", "P", "euid", "1", None), None, ("S2", "Q", None, "2", "P")]), (2, {}, None)], "arr_row long, answers map<string,string>, chain array<struct<service_type string, provider_code string, code_type string, chain_rank string, recipient_code string>>")
    assert rows(G.chain_lines(records)) == [(1, 0, '"C;1",S1,P,EUID,1,'), (1, 2, '"C;1",S2,Q,LEI,2,P')]
    tables = spark.createDataFrame([([["Code kolom", "x"], ["B_01.02.0010", " Naam ", "Tekst", "Vul in", "Verplicht"], ["los"], ["B_01.02.0020", "Land"]],), ([["Anders"]],)], "cells array<array<string>>")
    derived = G.schema_from_tables(tables)
    assert rows(derived, "template_code", "code", "label", "mandatory") == [("B_01.02", "B_01.02.0010", "Naam", True), ("B_01.02", "B_01.02.0020", "Land", False)]
    matrix = spark.createDataFrame([(1, ["kop"]), (2, ["B_99.01.R1", "B_01.02.0020", "Land", "1. A"]), (3, ["B_99.01.R2", "", "2. B"]), (4, ["B_99.01.R3", "B_02.01.0010", "x", "1. C"])], "row_no int, cells array<string>")
    assert rows(G.lists_from_matrix(matrix), "column_code", "official_text") == [("B_01.02.0020", "1. A"), ("B_01.02.0020", "2. B"), ("B_02.01.0010", "1. C")]
    questions = spark.createDataFrame([("s9", "B_01.02.0010", 1), ("s8", "B_02.01", 2)], "question_id string, column_code string, pos int")
    assert rows(G.overlay_source(derived, questions, ["B_01.02.0020"], ["B_01.02.0010"]), "code", "fill_source", "ask_supplier") == [("B_01.02.0010", "assessment:s9", True), ("B_01.02.0020", "auto", False)]


T0 = datetime(2024, 1, 1)


def moves(n, seed):
    rnd = random.Random(seed)
    return [(i, T0 + timedelta(seconds=i), rnd.randrange(3), f"t{rnd.randrange(14)}", rnd.random() < 0.15) for i in range(n)]


def list_by_hand(events, size):
    lists = {}
    for _, at, owner, item, closed in events:
        items = lists.setdefault(owner, [])
        here = next((x for x in items if x[0] == item), None)
        if closed:
            items[:] = [x for x in items if x[0] != item]
        elif here:
            here[1] = at
        else:
            if len(items) >= size:
                items.remove(min(items, key=lambda x: x[1]))
            items.append([item, at])
    return {o: [x[0] for x in v] for o, v in lists.items()}


EVENTS = "event_id long, ts timestamp, owner long, item string, closed boolean"


def test_bounded_lists(spark):
    events = moves(400, 1)
    df = spark.createDataFrame(events, EVENTS)
    got = {}
    for r in K.bounded_lists(df, "owner", "item", "ts", F.col("closed"), "event_id").orderBy("owner", "place").collect():
        got.setdefault(r["owner"], []).append(r["item"])
    assert got == list_by_hand(events, 8)
    opened = [e[:4] + (False,) for e in events]
    recent = K.most_recent(spark.createDataFrame(opened, EVENTS), "owner", "item", "ts")
    assert {(r["owner"], r["item"]) for r in recent.collect()} == {(o, i) for o, items in list_by_hand(opened, 8).items() for i in items}


def test_streams_equal_batches(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    for k in range(3):
        spark.createDataFrame(moves(300, 2)[k * 100 : k * 100 + 100], EVENTS).coalesce(1).write.mode("append").parquet(path)
    batch = spark.read.parquet(path)
    stream = lambda: keyed.file_stream(spark, path)
    assert rows(keyed.run_available(keyed.latest(stream(), ["owner"], "item", ["ts", "event_id"]))) == rows(K.latest(batch, ["owner"], "item", ["ts", "event_id"]))
    assert rows(keyed.run_available(keyed.toggled(stream(), ["owner", "item"], "ts"))) == rows(K.toggled(batch, ["owner", "item"], "ts"))
    counted = keyed.run_available(keyed.windowed_counts(stream(), "ts", "owner", "1 minute", "0 seconds"), "append")
    assert counted.agg(F.sum("n")).first()[0] <= 300
    one = str(tmp_path / "one.parquet")
    batch.coalesce(1).write.parquet(one)
    lists = keyed.run_available(keyed.bounded_lists(keyed.file_stream(spark, one), "owner", "item", "ts", "closed"), "append")
    assert rows(lists, "owner", "place", "item") == rows(K.bounded_lists(batch, "owner", "item", "ts", F.col("closed"), "event_id"), "owner", "place", "item")


def test_bounded_lists_of_several_files(spark, tmp_path):
    from lexweave.queries import records

    events = [(i, at, owner, "view", 1.0, f'{{"k":"{item}"}}') for i, at, owner, item, closed in moves(300, 4) if not closed]
    # owner 7 is listed in the first file and emptied in the last, owner 8 only ever in the first
    events = [(1000, T0, 7, "view", 1.0, '{"k":"a"}'), (1001, T0, 8, "view", 1.0, '{"k":"b"}'), *events, (2000, T0 + timedelta(days=1), 7, "error", 1.0, '{"k":"a"}')]
    for k in range(0, len(events), 90):
        spark.createDataFrame(events[k : k + 90], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = rows(records.QUERIES["stream_bounded_lists"](spark, str(tmp_path)))
    assert got == rows(records.QUERIES["lru8_with_closes"](spark, str(tmp_path)))
    assert {r[0] for r in got} == {0, 1, 2, 8}


def test_keyed_state(spark):
    df = spark.createDataFrame([("k", "a", 1), ("k", None, 2), ("m", " ", 3), ("n", "b", 4), ("n", "c", 4)], "k string, v string, o int")
    last = K.latest(df, ["k"], "v", ["o", "v"])
    assert rows(K.without_blank(last, "v"), "k", "v") == [("n", "c")]
    current = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    news = spark.createDataFrame([("b", 9), (None, 9), ("c", None), ("d", 4)], "id string, v int")
    assert rows(K.merged(current, news, "id", F.col("v").isNotNull())) == [("a", 1), ("b", 9), ("d", 4)]
    raw = spark.createDataFrame([('{"v":1,"x":2}',), ('{"v":2,"x":3}',), ("{",), (None,)], "raw string")
    assert [r["state"]["x"] for r in K.with_version(raw, "raw", "v int, x int").collect()] == [2]
    assert rows(K.reset(current, news, ["id"])) == [("a", 1)]
    assert rows(K.alive(df, ["k"], ["o"], F.col("v") == " "), "k") == [("k",), ("n",)]


ARTICLES = '[{"number":2,"title":"Register","chapter":"I","chapterTitle":"Algemeen","section":null,"sectionTitle":null,"paragraphs":[{"number":1,"anchor":"lid-1","content":[{"type":"text","text":"De entiteit houdt een register bij."},{"type":"list","items":[{"marker":"a)","content":[{"type":"text","text":"punt"}]}]}]},{"number":null,"anchor":"alinea-2","content":[]}],"footnotes":[]}]'
RECITALS = '[{"number":4,"paragraphs":[{"text":"Overwegende het register.","refs":[{"start":0,"end":3,"href":"/x"}]},{"text":"Tweede."}]}]'
ANNEXES = '[{"roman":"III","ordinal":3,"title":"Modellen","content":[{"type":"table","rows":[["a","b"]]}],"footnotes":[]}]'


@pytest.fixture(scope="module")
def corpus_tables(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("acts")
    for act in ("reg", "sub"):
        (base / act).mkdir()
        for name, text in (("articles", ARTICLES), ("recitals", RECITALS), ("annexes", ANNEXES)):
            (base / act / f"{name}.json").write_text(text)
    (base / "bad").mkdir()
    (base / "bad" / "articles.json").write_text("{")
    articles, recitals, annexes = corpus.read_articles(spark, f"{base}/*/articles.json"), corpus.read_recitals(spark, f"{base}/*/recitals.json"), corpus.read_annexes(spark, f"{base}/*/annexes.json")
    acts = spark.createDataFrame([("reg", "Reg", "Verordening X", "/reg"), ("sub", "Sub", "Verordening Y", "/sub")], "act string, label string, citation string, route_prefix string")
    docs = corpus.search_documents(articles, recitals, acts)
    steps = spark.createDataFrame([("s1", "entiteit", "f1", "Stap", 1), ("s2", "entiteit", "f2", "Stap 2", 1)], "step_id string, playbook string, fase string, title string, pos int")
    return api.Corpus(
        articles, recitals, annexes, acts, docs, S.build_index(docs),
        recital_pairs=spark.createDataFrame([("reg:4", "reg:2", 1)], "recital_key string, article_key string, pos int"), links=spark.createDataFrame([("reg:2", "sub:2", "art. 2", "/sub/artikel/2", 1)], "source string, target string, label string, href string, pos int"),
        steps=steps, step_documents=spark.createDataFrame([("s1", "d1")], "step_id string, document_id string"), catalogue=spark.createDataFrame([("d1", "beleid", "Beleid"), ("d2", "plan", "Plan")], "document_id string, category string, name string"),
        coverage=spark.createDataFrame([("reg", 2, "lid-1", "stap", ["s1"], None)], "act string, article_no int, anchor string, disposition string, steps array<string>, note string"),
    )


def test_read_functions(corpus_tables):
    c = corpus_tables
    hit = api.search_corpus(c, "register", kind="artikel", act="reg").collect()
    assert [(h["doc_id"], h["url"]) for h in hit] == [("reg-art-2-lid-1", "/reg/artikel/2#lid-1"), ("reg-art-2-alinea-2", "/reg/artikel/2#alinea-2")] and hit[0]["quotation"] == "De entiteit houdt een register bij. a) punt"
    article = api.get_article(c, "Artikel 2 ", "reg").first()
    assert article["markdown"].startswith("1. De entiteit houdt") and article["recitals"] == ["reg:4"] and article["implemented_by"] == ["/sub/artikel/2"] and article["based_on"] == [] and article["error"] is None
    assert api.get_article(c, "2", "sub").first()["based_on"] == ["reg:2"]
    assert api.get_article(c, "9", "reg").first()["error"] == 'Artikel "9" niet gevonden (bereik: 2–2).' and "geen" in api.get_article(c, "x", "none").first()["error"]
    assert api.get_recital(c, 4, "reg").first()["text"] == "Overwegende het register.\n\nTweede." and api.get_recital(c, 4, "reg").first()["articles"] == ["reg:2"] and "1–4" in api.get_recital(c, 5, "reg").first()["error"]
    assert api.get_annex(c, "Bijlage iii", "reg").first()["markdown"] == "| a | b |\n| --- | --- |" and "Beschikbaar: III" in api.get_annex(c, "IV", "reg").first()["error"]
    toc = {r["act"]: r for r in api.get_structure(c).collect()}
    assert toc["reg"]["n_recitals"] == 1 and toc["reg"]["chapters"][0]["sections"][0]["articles"][0]["article_no"] == 2
    assert [r["documents"] for r in api.get_playbook(c, "entiteit").collect()] == [["d1"], []] and "f1, f2" in api.get_playbook(c, "entiteit", "f9").first()["error"]
    assert [(r["anchor"], r["covered"], r["n_covered"], r["total"]) for r in api.get_coverage(c, "2", "reg").orderBy("pos").collect()] == [("lid-1", True, 1, 2), ("alinea-2", False, 1, 2)]
    assert rows(api.get_documents(c), "document_id", "steps") == [("d1", ["s1"]), ("d2", [])] and rows(api.get_documents(c, "plan"), "document_id") == [("d2",)] and "beleid, plan" in api.get_documents(c, "x").first()["error"]
    assert rows(api.category_shares(c.catalogue)) == [("beleid", 1, 0.5), ("plan", 1, 0.5)] and rows(api.playbook_counts(c.steps)) == [("entiteit", "f1", 1), ("entiteit", "f2", 1), ("entiteit", None, 2), (None, None, 2)]


def test_corpus_sinks(spark, corpus_tables, tmp_path):
    corpus.write_json(corpus_tables.documents, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == corpus_tables.documents.count()
    more = corpus.appended(corpus_tables.documents, corpus_tables.documents.limit(1), str(tmp_path / "more"))
    assert more.count() == corpus_tables.documents.count() + 1


def test_requests_remaps_and_names(spark):
    requests = spark.createDataFrame([(1, "B", "Land", "", "Verplicht"), (1, "A", "Naam; vol", None, None)], "arr_row long, code string, label string, instruction string, mandatory_raw string")
    records = spark.createDataFrame([(1, "Eigen", {"s1.1": "C-1", "s1.2": "  "}), (2, "Ander", None)], "arr_row long, arr_name string, answers map<string,string>")
    doc = G.request_documents(requests, records).first()
    assert doc["markdown"].endswith("| A | Naam; vol |  |\n| B | Land | Verplicht |") and doc["csv"] == 'Veld,Omschrijving,Instructie,Verplicht,Waarde\r\nA,"Naam; vol",,,\r\nB,Land,,Verplicht,'
    lists = spark.createDataFrame([("OLD", 1, "x"), ("KEPT", 1, "y"), ("GONE", 1, "z")], "column_code string, item_no int, official_text string")
    columns = spark.createDataFrame([("NEW",), ("KEPT",)], "code string")
    assert rows(G.remapped(lists, columns, {"OLD": "NEW", "KEPT": "NEW", "GONE": "NOWHERE"}), "column_code") == [("GONE",), ("KEPT",), ("NEW",)]
    answers = spark.createDataFrame([(1, "s1.2", " Nieuw "), (2, "s1.2", " "), (1, "s1.3", "x")], "arr_row long, question_id string, value string")
    assert rows(K.renamed(records, answers, "arr_row", "arr_name", "s1.2"), "arr_row", "arr_name") == [(1, "Nieuw"), (2, "Ander")]


def test_derived_templates_and_ladders(spark):
    tables = spark.createDataFrame([([["Code model", "Naam"], ["B_01.02", " Groep ", "Lijst"], ["los"]],), ([["Code kolom"], ["B_01.02.0010", "a"], ["B_09.09.0010", "b"]],)], "cells array<array<string>>")
    templates = G.templates_from_tables(tables)
    assert rows(templates) == [("B_01.02", "Groep", "Lijst")] and rows(G.schema_of_templates(G.schema_from_tables(tables), templates), "code") == [("B_01.02.0010",)]
    codes = spark.createDataFrame([([["Code", "Naam"], ["S01", "1. Hosting", "Uitleg"], ["S02", "Beheer"]],), ([],)], "cells array<array<string>>")
    assert rows(G.service_codes(codes)) == [("S01", "Hosting", "Uitleg"), ("S02", "Beheer", "")]
    df = spark.createDataFrame([(1, {"q1": "ja"}), (2, {"q1": "nee"}), (3, {"q1": "ja", "q2": "ja"})], "id long, answers map<string,string>")
    out = R.ladder(R.evaluated(df, MODULES), [({"flag": "g"}, "both"), ({"all": [{"flag": "f"}, {"not": {"flag": "g"}}]}, "first")], "none")
    assert rows(out, "id", "outcome") == [(1, "first"), (2, "none"), (3, "both")]


def test_all_templates_are_exported(spark):
    fields = spark.createDataFrame([(1, "T2", "b", "B", "x"), (1, "T1", "a", "A", "y;"), (2, "T1", "a", "A", "")], "arr_row long, template_code string, code string, label string, value string")
    assert rows(G.lines_of_templates(fields), "template_code", "part", "arr_row", "line") == [("T1", 1, None, "a"), ("T1", 2, None, "A"), ("T1", 3, 1, '"y;"'), ("T1", 3, 2, ""), ("T2", 1, None, "b"), ("T2", 2, None, "B"), ("T2", 3, 1, "x")]
    lines = spark.createDataFrame([("T1", "a", "1"), ("T1", "b", "2"), ("T2", "c", "3")], "template_code string, code string, line string")
    assert rows(G.csv_file(lines, ["code"], ["template_code"])) == [("T1", "1\r\n2"), ("T2", "3")]


def test_closed_lists_beyond_the_bound_are_an_error(spark):
    lists = spark.range(G.MAX_COLUMNS + 1).select(F.lit("c").alias("column_code"), F.col("id").alias("item_no"), F.lit("1. x").alias("official_text"))
    with pytest.raises(ValueError, match="closed lists"):
        G.list_map(lists)
