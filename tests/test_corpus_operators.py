import json

import pytest
from pyspark.sql import functions as F

from lexweave.operators import citations as C
from lexweave.operators import maps as M
from lexweave.operators import tree as T
from lexweave.plans import quality as Q
from lexweave.sources import html as H
from tests.conftest import rows

ACTS = [C.Act("main", "Verordening (EU) 2022/2554", ""), C.Act("form", "Uitvoeringsverordening (EU) 2024/2956", "/form"), C.Act("sub", "Gedelegeerde Verordening (EU) 2025/532", "/sub"), C.Act("cls", "Gedelegeerde Verordening (EU) 2024/1772", "/cls")]
MAIN = "van Verordening (EU) 2022/2554"


@pytest.mark.parametrize(
    "text, want",
    [
        (f"artikel 28, lid 3, {MAIN}", [("artikel 28, lid 3", "/artikel/28#lid-3")]),
        ("bijlage I tot en met IV", [("bijlage I", "/sub/bijlage/i"), ("IV", "/sub/bijlage/iv")]),
        (f"hoofdstuk V, afdeling II, {MAIN}", [("hoofdstuk V, afdeling II", "/#hoofdstuk-v")]),
        (f"artikel 30, lid 3, punt c), {MAIN}", [("artikel 30, lid 3, punt c)", "/artikel/30#lid-3-c")]),
        ("artikel 6 van deze verordening", [("artikel 6", "/sub/artikel/6")]),
        ("artikelen 2 tot en met 5", [("artikelen 2", "/sub/artikel/2"), ("5", "/sub/artikel/5")]),
        (f"artikel 35, lid 6, artikel 37, lid 1, en artikel 39, lid 6, {MAIN}", [("artikel 35, lid 6", "/artikel/35#lid-6"), ("artikel 37, lid 1", "/artikel/37#lid-1"), ("artikel 39, lid 6", "/artikel/39#lid-6")]),
        (f"artikel 19, lid 4, punten a), b) en met c), {MAIN}", [("artikel 19, lid 4, punten a)", "/artikel/19#lid-4-a"), ("b)", "/artikel/19#lid-4-b"), ("c)", "/artikel/19#lid-4-c")]),
        ("artikelen 1 tot en met 8 van Gedelegeerde Verordening (EU) 2024/1772", [("artikelen 1", "/cls/artikel/1"), ("8", "/cls/artikel/8")]),
        (f"artikel 2, lid 1, punt g), h), i) of j), {MAIN}", [("artikel 2, lid 1, punt g)", "/artikel/2#lid-1-g")]),  # the qualifier behind the nested points counts
        (f"artikel 30, lid 2, en (3), {MAIN}", [("artikel 30, lid 2", "/artikel/30#lid-2"), ("3)", "/artikel/30#lid-3")]),
        ("artikel 53, 55 en 56", [("artikel 53", "/sub/artikel/53"), ("55", "/sub/artikel/55"), ("56", "/sub/artikel/56")]),
        ("overwegingen 3 en 4", [("overwegingen 3", "/sub/overweging/3"), ("4", "/sub/overweging/4")]),
        ("artikel 3, leden 1 en 2", [("artikel 3, leden 1", "/sub/artikel/3#lid-1"), ("2", "/sub/artikel/3#lid-2")]),
        ("artikel 6 van Verordening (EU) 2016/679", []), ("artikel 4 van Richtlijn 2013/36/EU", []), ("artikel 290 VWEU", []), ("artikel 4 van die verordening", []), ("artikel 6, lid 4, en artikel 9, lid 2, van Verordening (EU) 2016/679", []),
        ("artikel 12/3", []), ("Bijlage IVa", []), ("partikel 3", []), ("", []),
    ],
)
def test_citations(text, want):
    assert [(text[s:e], h) for s, e, h in C.CitationReader(ACTS).find(text, "sub")] == want


def test_self_links_and_bare_references():
    r = C.CitationReader(ACTS)
    assert r.find("artikel 6 en artikel 7", "sub", "artikel", "6") == [(13, 22, "/sub/artikel/7")]
    assert r.find("artikel 6, lid 1", "sub", "artikel", "6") == [(0, 16, "/sub/artikel/6#lid-1")]
    assert r.find("artikel 6", "sub", bare=False) == [] and r.find(f"artikel 6 {MAIN}", "sub", bare=False) == [(0, 9, "/artikel/6")]


def test_citations_of_rows_and_resolution(spark):
    texts = spark.createDataFrame([(1, "zie artikel 3, lid 1, en artikel 9", "a", "/a", "artikel", "1"), (2, None, "a", "/a", None, None), (3, "niets", None, None, None, None), (4, "artikel 3", None, None, None, None)], "row_id long, body string, act string, route_prefix string, self_kind string, self_ref string")
    found = C.find_citations(texts)
    assert rows(found, "row_id", "href") == [(1, "/a/artikel/3#lid-1"), (1, "/a/artikel/9"), (4, "/artikel/3")]
    pages = spark.createDataFrame([("/a/artikel/3",), ("/a/artikel/3",)], "page string")
    anchors = spark.createDataFrame([("/a/artikel/3", "lid-1", 2)], "page string, anchor string, n long")
    assert rows(C.resolve(found.select("row_id", "href"), pages, anchors), "href", "state", "resolved_href") == [("/a/artikel/3#lid-1", "stripped", "/a/artikel/3"), ("/a/artikel/9", "missing", None), ("/artikel/3", "missing", None)]
    assert rows(C.counts(found, "row_id")) == [(1, 2), (4, 1), (None, 3)]


TREE = [
    {"type": "heading", "text": "Kop"}, {"type": "text", "text": "Begin", "refs": [{"start": 0, "end": 5, "href": "/x"}, {"start": 3, "end": 9, "href": "/y"}]},
    {"type": "list", "items": [{"marker": "a)", "content": [{"type": "text", "text": "een"}, {"type": "list", "items": [{"marker": "i)", "content": [{"type": "text", "text": "diep"}]}]}]}, {"marker": "—", "content": []}]},
    {"type": "table", "rows": [["h|1", "h2"], ["c", "d"]]}, {"type": "figure", "src": "data:,", "alt": ""},
]


def test_flat_text_and_markdown(spark):
    assert T.flat_text(TREE) == "Kop Begin a) een i) diep —  h|1 h2 c d" and T.flat_text("{") == ""
    md = T.markdown(TREE)
    assert md.startswith("### Kop\n\n[Begin](/x)\n\n- **a)** een\n  \n  - **i)** diep".replace("\n  \n", "\n\n")) and "| h\\|1 | h2 |\n| --- | --- |\n| c | d |" in md and md.endswith("*[afbeelding]*")
    df = spark.createDataFrame([("k", json.dumps(TREE)), ("n", None), ("bad", "[{")], "doc_key string, content string")
    assert rows(df.select("doc_key", T.flattened(F.col("content")).alias("t"))) == [("bad", ""), ("k", T.flat_text(TREE)), ("n", None)]
    edges = T.edge_list(df)
    assert rows(edges, "path", "node_type") == [([0], "heading"), ([1], "text"), ([2, 0, 0], "text"), ([2, 0, 1, 0, 0], "text"), ([2, 0, 1, 0], "item"), ([2, 0], "item"), ([2, 1], "item"), ([3], "table"), ([4], "figure")]
    assert rows(T.flat_documents(edges), "doc_key", "flat_text") == [("k", "Kop Begin a) een i) diep — h|1 h2 c d")]


def test_anchors_and_chunks(spark):
    nodes = spark.createDataFrame(
        [
            ("d", 1, [0], 1, "heading", None, None, "Kop", None), ("d", 2, [1], 1, "paragraph", None, "lid-1", None, None), ("d", 3, [1, 0], 2, "text", None, None, "tekst", None),
            ("d", 4, [1, 1, 0], 3, "item", "a)", "lid-1-a", None, None), ("d", 5, [1, 1, 0, 0], 4, "text", None, None, "punt", None), ("d", 6, [1, 1, 1], 3, "item", "—", None, None, None),
            ("d", 7, [1, 2], 2, "text", None, None, "slot", None), ("d", 8, [2], 1, "paragraph", None, "lid-1", None, None), ("d", 9, [2, 0], 2, "table", None, None, None, [["x", "y"]]),
        ],
        "doc_key string, node_id long, path array<int>, depth int, node_type string, marker string, anchor string, body string, cells array<array<string>>",
    )
    assert rows(T.unique_anchors(nodes)) == [("d", "lid-1-a")]
    assert [r[-1] for r in rows(T.numbered_anchors(nodes.filter("anchor = 'lid-1'").select("doc_key", "node_id", "anchor"), ["doc_key"], "anchor", ["node_id"]))] == ["lid-1", "lid-1-bis"]
    assert rows(T.item_anchors(nodes), "marker", "expected_anchor") == [("a)", "lid-1-a"), ("—", None)]
    assert rows(T.chunks(nodes), "chunk_no", "heading", "kind", "anchor", "chunk_text") == [(1, "Kop", "text", None, "tekst"), (2, "Kop", "item", "lid-1-a", "a) punt"), (3, "Kop", "item", None, "—"), (4, "Kop", "text", None, "slot"), (5, "Kop", "table", None, "x y")]


CONSOLIDATED = """<html><script>if (a < b) "</div>"</script><body>
<div id="cpt_I"><p class="title-division-2">Algemeen</p><div id="cpt_I.sct_II"><p class="title-division-2">Deel</p>
<div class="eli-subdivision" id="art_3"><p class="title-article-norm">Artikel 3</p><div class="eli-title"><p class="stitle-article-norm">Register</p></div>
<div class="norm"><span class="no-parag">1.</span><div class="norm inline-element">De entiteit&nbsp;houdt <a id="src.E1" href="#E1">( 1 )</a> bij: <span class="no-parag">2.</span></div>
<div class="grid-container grid-list"><div class="grid-list-column-1">a)</div><div class="grid-list-column-2"><p class="norm">een</p></div></div>
<div class="grid-container grid-list"><div class="grid-list-column-1">—</div><div class="grid-list-column-2">twee</div></div></div>
<p class="norm">Vervolg.</p><div class="norm"><span class="no-parag">1.</span>Weer een.</div>
<table><tr><td>k</td><td>w<table><tr><td>binnen</td></tr></table></td></tr><tr><td> </td><td></td></tr></table></div></div></div>
<div id="anx_IV"><p class="title-annex-2">Modellen</p><div class="grid-container"><div class="grid-list-column-1">1.</div><div class="grid-list-column-2">Punt</div></div></div>
<p class="footnote"><a id="E1">(1)</a> Noot één.</p></body>"""

JOURNAL = """<div class="eli-subdivision" id="rct_2"><table><tr><td>(2)</td><td><p>Overwegende <b>dat</b></p><p></p><p>en ook</p></td></tr></table></div>
<div class="eli-subdivision" id="art_1"><p class="oj-ti-art">Artikel 1</p><div class="eli-title"><p class="oj-sti-art">Begrippen</p></div>
<div id="001.001"><p class="oj-normal">1. In deze verordening:</p><table><tbody><tr><td><p>(a)</p></td><td><p>punt</p></td></tr></tbody></table><table><tr><td>(b)</td><td><p>nog een</p></td></tr></table></div>
<p class="oj-normal">Slot.</p><div class="oj-enumeration-spacing"><p>1.</p><p>genummerd</p></div></div>
<div id="anx_1"><p class="oj-doc-ti">BIJLAGE</p><p class="oj-doc-ti">Criteria</p><p class="oj-ti-grseq-1">DEEL A</p><table><tr><td>x</td><td>y</td></tr></table><p><img src=""><figure><img src="data:,1" alt="formule"></figure><p class="oj-note"><a id="x-E7">(1)</a> Verordening</p></div>"""


def test_consolidated_pages(spark):
    pages = spark.createDataFrame([("x", "consolidated", CONSOLIDATED), ("y", "journal", JOURNAL), ("z", "journal", None), ("e", "journal", "")], "instrument string, layout string, html string")
    out = {(r["instrument"], r["kind"]): r for r in H.parse_pages(pages).collect()}
    assert len(out) == 5
    a = out["x", "artikel"]
    assert (a["number"], a["title"], a["chapter"], a["chapter_title"], a["section"], a["section_title"]) == (3, "Register", "I", "Algemeen", "II", "Deel")
    assert [(p["para_no"], p["anchor"]) for p in a["paragraphs"]] == [(1, "lid-1"), (1, "lid-1-bis")]
    first, second = (json.loads(p["content"]) for p in a["paragraphs"])
    assert first[0] == {"type": "text", "text": "De entiteit houdt (1) bij: 2."} and [i["marker"] for i in first[1]["items"]] == ["a)", "—"] and first[1]["items"][0]["anchor"] == "lid-1-a" and "anchor" not in first[1]["items"][1]
    assert first[2]["text"] == "Vervolg." and second[-1] == {"type": "table", "rows": [["k", "wbinnen"]]}
    assert [(f["note_id"], f["note_label"], f["note_text"]) for f in a["footnotes"]] == [("E1", "((1))", "Noot één.")]
    x = out["x", "bijlage"]
    assert (x["roman"], x["number"], x["title"]) == ("IV", 4, "Modellen") and json.loads(x["paragraphs"][0]["content"])[0]["items"][0]["anchor"] == "punt-1"


def test_journal_pages():
    out = {p["kind"]: p for p in H.provisions(JOURNAL, "journal")}
    assert [p["content"][0]["text"] for p in out["overweging"]["paragraphs"]] == ["Overwegende dat", "en ook"]
    lid = out["artikel"]["paragraphs"]
    assert [p["para_no"] for p in lid] == [1] and lid[0]["content"][0]["text"] == "In deze verordening:" and [i["marker"] for i in lid[0]["content"][1]["items"]] == ["(a)", "(b)"]
    assert lid[0]["content"][2]["text"] == "Slot." and lid[0]["content"][3]["items"][0]["marker"] == "1."
    annex = out["bijlage"]
    kinds = [n["type"] for n in annex["paragraphs"][0]["content"]]
    assert annex["title"] == "Criteria" and annex["roman"] == "I" and kinds == ["heading", "table", "figure"] and annex["footnotes"] == [{"note_id": "E7", "note_label": "(1)", "note_text": "Verordening"}]


def test_broken_pages():
    assert H.provisions("<div class='eli-subdivision' id='art_2'><p>open<div id='002.001'><p>1. x", "journal")[0]["paragraphs"][-1]["para_no"] == 1
    assert H.provisions("<script>var a = '<div id=\"anx_I\">';</script>", "consolidated") == []


def test_maps(spark):
    pairs = spark.createDataFrame([("r1", "a2", 2), ("r1", "a1", 1), ("r1", "a2", 5), ("r2", "a1", 3)], "r string, a string, pos int")
    ahead, back = M.grouped(pairs, "r", "a", "pos"), M.grouped(pairs, "a", "r", "pos")
    assert rows(ahead) == [("r1", ["a1", "a2"], 2), ("r2", ["a1"], 1)] and rows(M.inverse_mismatches(ahead, back, "r", "a")) == []
    assert rows(M.inverse_mismatches(ahead, back.filter("a = 'a1'"), "r", "a")) == [("r1", "a2", "inverse")]
    reviewed = spark.createDataFrame([("r1", ["a1"], True), ("r2", [], True), ("r3", None, False)], "k string, t array<string>, reviewed boolean")
    assert rows(M.reviewed_pairs(reviewed, "k", "t", "reviewed"), "k", "target", "state") == [("r1", "a1", "mapped"), ("r2", None, "none_relevant"), ("r3", None, "unreviewed")]
    acts = spark.createDataFrame([("main", ""), ("sub", "/sub"), ("longer", "/sub/x")], "act string, route_prefix string")
    paths = spark.createDataFrame([("/artikel/1",), ("/sub/artikel/2",), ("/subx/artikel/2",), ("/sub",), ("/sub/x/y",)], "p string")
    assert rows(M.split_route(paths, acts, "p", "main"), "p", "act", "local_path") == [("/artikel/1", "main", "/artikel/1"), ("/sub", "sub", "/"), ("/sub/artikel/2", "sub", "/artikel/2"), ("/sub/x/y", "longer", "/y"), ("/subx/artikel/2", "main", "/subx/artikel/2")]
    hrefs = spark.createDataFrame([("its:3", "/its"), ("its:bijlage:III", "/its"), ("its", "/its")], "t string, p string").select(M.target_href(F.col("t"), F.col("p")).alias("h"))
    assert rows(hrefs) == [("/its",), ("/its/artikel/3",), ("/its/bijlage/iii",)]
    numbers = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4)], "g string, n int")
    assert rows(M.neighbours_by_number(numbers, ["g"], "n")) == [("a", 1, None, 2), ("a", 2, 1, None), ("a", 4, None, None)]
    assert rows(M.neighbours_by_position(numbers, ["g"], ["n"], "n")) == [("a", 1, None, 2), ("a", 2, 1, 4), ("a", 4, 2, None)]


def test_previews_coverage_and_patches(spark):
    paragraphs = spark.createDataFrame([("/p", 0, "lid-1", "Artikel 1", "1", "eerste"), ("/p", 1, "lid-2", "Artikel 1", "2", "tweede")], "page string, para_pos int, anchor string, title string, para_no string, body string")
    hrefs = spark.createDataFrame([("/p",), ("/p#lid-2-a",), ("/p#lid-2",), ("/p#lid-22",), ("/q",), (None,), ("/p",)], "href string")
    assert rows(M.previews(hrefs, paragraphs)) == [("/p#lid-2", "Artikel 1, lid 2", "tweede"), ("/p#lid-2-a", "Artikel 1, lid 2", "tweede"), ("/p#lid-22", "Artikel 1", "eerste"), ("/p", "Artikel 1", "eerste")]
    universe = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3)], "act string, k int")
    entries = spark.createDataFrame([(1, "stap"), (2, "definitie"), (9, "stap")], "k int, disposition string")
    assert rows(M.coverage_tally(M.coverage(universe, entries, ["k"]), ["act"])) == [("x", 3, 2, 1, 1, 1)]
    out, unknown = M.patched(universe, spark.createDataFrame([(2, "y"), (7, "z")], "k int, act string"), "k", "act")
    assert rows(out, "k", "act") == [(1, "x"), (2, "y"), (3, "x")] and rows(unknown, "k") == [(7,)]


def test_constraints_return_the_broken_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 1), ("b", 2), ("b", 2), ("c", None)], "g string, n int")
    assert rows(Q.repeated(df, ["g", "n"])) == [("b", 2, 2)]
    assert rows(Q.misnumbered(df.distinct(), ["g"], "n")) == [("a", 3, 2), ("c", None, 1)]
    assert rows(Q.dangling(df, spark.createDataFrame([(1,), (2,)], "k int"), "n", "k"), "g", "n") == [("a", 3)]
    assert rows(Q.different_keys(df, spark.createDataFrame([("a",), ("z",)], "g string"), "g")) == [("b", "left"), ("c", "left"), ("z", "right")]
    deps = spark.createDataFrame([("s2", "s1"), ("s1", "s2"), ("s3", "gone")], "k string, needs string")
    places = spark.createDataFrame([("s1", 1), ("s2", 2), ("s3", 3)], "k string, p int")
    assert rows(Q.backward(deps, places, "k", "needs", "p"), "k", "needs") == [("s1", "s2"), ("s3", "gone")]
    pins = spark.createDataFrame([("a", 5), ("b", 3), ("d", 1)], "g string, pin long")
    counts = df.groupBy("g").agg(F.count("*").alias("n"))
    assert rows(Q.off_pins(counts, pins, "g")) == [("a", 2, 5), ("c", 1, 0), ("d", 0, 1)] and rows(Q.off_pins(counts, pins, "g", complete=False)) == [("c", 1, 0)]
    texts = spark.createDataFrame([("1", "een register"), ("2", None)], "k string, t string")
    assert rows(Q.without_text(texts, "k", "t", {"1": "register", "2": "x"}), "k") == [("2",)]
    assert rows(Q.outside(df, "g", ["a", "b"]), "g") == [("c",)] and rows(Q.report({"x": df, "y": df.limit(0)})) == [("x", 6), ("y", 0)]
    assert rows(Q.changed_between_runs(df, df)) == [] and rows(Q.unused(places, deps, "k")) == []


def test_manifest_and_dependencies(spark, tmp_path):
    (tmp_path / "a.html").write_text(CONSOLIDATED)
    (tmp_path / "b.html").write_text(JOURNAL)
    pages = H.read_manifest(spark, [("main", f"{tmp_path}/a.html", "consolidated"), ("sub", f"{tmp_path}/b.html", "journal")])
    assert rows(H.parse_pages(pages), "instrument", "kind") == [("main", "artikel"), ("main", "bijlage"), ("sub", "artikel"), ("sub", "bijlage"), ("sub", "overweging")]
    assert rows(H.read_pages(spark, f"{tmp_path}/b.html", "journal"), "instrument", "layout") == [("b", "journal")]
    steps = spark.createDataFrame([("s1", "f1"), ("s2", "f2")], "step_id string, fase string")
    needs = spark.createDataFrame([("s2", "s1"), ("s1", "s9")], "step_id string, needs string")
    assert rows(M.placed_dependencies(steps, needs), "step_id", "needed_in", "elsewhere") == [("s1", None, True), ("s2", "f1", True)]


def test_split_route_with_prefixes_of_many_steps(spark):
    from lexweave.operators import maps

    acts = spark.createDataFrame([("short", "/a"), ("long", "/a/b/c/d")], "act string, route_prefix string")
    paths = spark.createDataFrame([("/a/b/c/d/artikel/1",), ("/a/b/c/x",), ("/z/b/c/d/e",)], "path string")
    assert rows(maps.split_route(paths, acts, "path", "main")) == [("/a/b/c/d/artikel/1", "long", "/artikel/1"), ("/a/b/c/x", "short", "/b/c/x"), ("/z/b/c/d/e", "main", "/z/b/c/d/e")]
