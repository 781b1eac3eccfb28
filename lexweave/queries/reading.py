"""Queries of the read functions, of pages in HTML and of files, over a corpus made of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave import api as A
from lexweave.functions import text as X
from lexweave.operators import citations as C
from lexweave.operators import maps as M
from lexweave.operators import search as S
from lexweave.operators import tree as T
from lexweave.sources import corpus as K
from lexweave.sources import html as H
from lexweave.sources.tables import heavy_table, shared_dir, table

_PAGE_OF = r"\A/(.+)-rts/artikel/([0-9]+)"


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of the edge list: paragraphs in order, their own texts as content."""
    nodes = table(spark, sf_dir, "content_nodes").withColumn("top", F.get("path", F.lit(0)))
    heads = nodes.filter("node_type = 'paragraph'").groupBy("instrument", "doc_key", "top").agg(F.min("anchor").alias("anchor"))
    texts = nodes.filter("node_type = 'text' AND depth = 2 AND body IS NOT NULL").groupBy("doc_key", "top", "path").agg(F.max_by("body", "node_id").alias("text"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: F.struct(F.lit("text").alias("type"), x["text"].alias("text")))
    content = texts.groupBy("doc_key", "top").agg(F.to_json(body).alias("content"))
    number = F.regexp_extract("anchor", "lid-([0-9]+)", 1).try_cast("int").alias("para_no")
    rows = heads.join(content, ["doc_key", "top"]).select("instrument", "doc_key", F.struct("top", number, "anchor", "content").alias("p"))
    paragraphs = F.transform(F.array_sort(F.collect_list("p")), lambda p: F.struct(p["para_no"].alias("para_no"), p["anchor"].alias("anchor"), p["content"].alias("content")))
    no = F.split_part("doc_key", F.lit(":"), F.lit(3)).try_cast("int")
    return rows.groupBy(F.col("instrument").alias("act"), no.alias("article_no")).agg(paragraphs.alias("paragraphs")).withColumn("title", F.concat(F.lit("Over artikel "), "article_no"))


def _recitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "recitals").filter("paragraphs IS NOT NULL").groupBy(F.col("instrument").alias("act"), "recital_no").agg(F.max_by("paragraphs", "recital_id").alias("p"))
    return rows.select("act", "recital_no", F.transform("p", lambda p: F.struct(p["body"].alias("text"), p["refs"].alias("refs"))).alias("paragraphs"))


def _acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "anchor_index").groupBy(F.col("instrument").alias("act")).agg(F.min("route_prefix").alias("route_prefix")).withColumn("label", F.upper("act")).withColumn("citation", F.concat(F.lit("Verordening "), "act"))


def _annexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "anchor_index").filter("target_kind = 'bijlage'").select(F.col("instrument").alias("act"), F.upper("target_no").alias("roman")).distinct()
    text = F.concat(F.lit("Tekst van bijlage "), "roman", F.lit(" bij "), "act")
    return rows.select("act", "roman", X.from_roman(F.col("roman")).alias("ordinal"), F.concat(F.lit("Bijlage "), "roman").alias("title"), F.to_json(F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))).alias("content"))


def _recital_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hrefs = F.flatten(F.transform("paragraphs", lambda p: F.coalesce(p["refs"]["href"], F.array().cast("array<string>"))))
    rows = _recitals(spark, sf_dir).select(F.concat_ws(":", "act", "recital_no").alias("recital_key"), F.posexplode(hrefs).alias("pos", "href"))
    act, no = F.regexp_extract("href", _PAGE_OF, 1), F.regexp_extract("href", _PAGE_OF, 2)
    return rows.filter(act != "").select("recital_key", F.concat_ws(":", act, no).alias("article_key"), "pos")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from articles to articles of other acts, each once."""
    rows = table(spark, sf_dir, "content_nodes").select("instrument", F.concat_ws(":", "instrument", F.split_part("doc_key", F.lit(":"), F.lit(3))).alias("source"), "node_id", F.explode("refs.href").alias("href"))
    act, no = F.regexp_extract("href", _PAGE_OF, 1), F.regexp_extract("href", _PAGE_OF, 2)
    rows = rows.filter((act != "") & (act != F.col("instrument"))).withColumn("target", F.concat_ws(":", act, no))
    return rows.groupBy("source", "target", F.split_part("href", F.lit("#"), F.lit(1)).alias("href")).agg(F.min("node_id").alias("pos"))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("st"), "o_orderkey").alias("step_id"), F.col("o_orderstatus").alias("playbook"), F.col("o_orderpriority").alias("fase"), F.concat(F.lit("Stap "), "o_orderkey").alias("title"), F.col("o_orderkey").alias("pos"),
        F.lit("Doel").alias("goal"), F.array(F.lit("doe"), F.col("o_orderpriority")).alias("actions"), F.array("o_orderstatus").alias("applies_to"),
    )


def _step_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("st"), "l_orderkey").alias("step_id"), F.concat(F.lit("doc"), "l_partkey").alias("document_id")).distinct()


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("doc"), "p_partkey").alias("document_id"), F.col("p_type").alias("category"), F.col("p_name").alias("name"), F.col("p_brand").alias("description"))


def _coverage_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that are cited, as covered."""
    hrefs = table(spark, sf_dir, "content_nodes").select("node_id", F.explode("refs.href").alias("href"))
    part = lambda i: F.regexp_extract("href", _PAGE_OF + "#(.+)", i)
    cited = hrefs.filter(part(3) != "").groupBy(part(1).alias("act"), part(2).cast("int").alias("article_no"), part(3).alias("anchor"))
    return cited.agg(F.lit("stap").alias("disposition"), F.count("*").alias("n_steps"))


def _corpus(spark: SparkSession, sf_dir: str, index: S.Index | None = None) -> A.Corpus:
    articles, recitals, acts = _articles(spark, sf_dir), _recitals(spark, sf_dir), _acts(spark, sf_dir)
    return A.Corpus(
        articles, recitals, _annexes(spark, sf_dir), acts, K.search_documents(articles, recitals, acts), index, _recital_pairs(spark, sf_dir), _links(spark, sf_dir), _steps(spark, sf_dir), _step_documents(spark, sf_dir),
        _catalogue(spark, sf_dir), _coverage_entries(spark, sf_dir),
    )


def _first_act(spark: SparkSession, sf_dir: str) -> str:
    return table(spark, sf_dir, "content_nodes").agg(F.min("instrument").alias("a")).first()["a"] or ""


def read_article(spark, sf_dir):
    """An article as Markdown with its recitals and the articles it links to and from; one that does not exist gives the range."""
    c, act = _corpus(spark, sf_dir), _first_act(spark, sf_dir)
    both = A.get_article(c, "Artikel 1 ", act).unionByName(A.get_article(c, "9999", act))
    return both.select("act", "article_no", "title", "markdown", *[F.array_join(n, ",").alias(n) for n in ("recitals", "implemented_by", "based_on")], "error")


def read_recital(spark, sf_dir):
    """A recital with the articles it explains; one that does not exist gives the range."""
    c = _corpus(spark, sf_dir)
    first = table(spark, sf_dir, "recitals").filter("paragraphs IS NOT NULL").agg(F.min(F.struct("instrument", "recital_no")).alias("x")).first()["x"]
    act, number = first or ("", 1)
    both = A.get_recital(c, number, act).unionByName(A.get_recital(c, 9999, act))
    return both.select("act", "recital_no", "text", F.array_join("articles", ",").alias("articles"), "error")


def read_annex(spark, sf_dir):
    """An annex by its numeral in any case; one that does not exist gives those that do."""
    c = _corpus(spark, sf_dir)
    act = c.annexes.agg(F.min("act").alias("a")).first()["a"] or ""
    return A.get_annex(c, "Bijlage i", act).unionByName(A.get_annex(c, "XL", act))


def read_structure(spark, sf_dir):
    """Contents of all acts, in one line each."""
    articles = table(spark, sf_dir, "articles").withColumnRenamed("instrument", "act")
    acts = articles.select("act").distinct().withColumn("label", F.upper("act"))
    acts = acts.unionByName(_acts(spark, sf_dir).select("act", "label"))
    c = A.Corpus(articles, _recitals(spark, sf_dir), _annexes(spark, sf_dir), acts, acts, None)
    titles = F.array_join(F.transform("chapters", lambda x: F.concat(F.coalesce(x["chapter"], F.lit("-")), F.lit(":"), F.size(F.flatten(x["sections"]["articles"])))), ",")
    return A.get_structure(c).select("act", "label", titles.alias("chapters"), F.array_join(F.col("annexes")["roman"], ",").alias("annexes"), "n_recitals")


def read_playbook(spark, sf_dir):
    """Steps of a phase with the documents they produce; a phase that does not exist gives those that do."""
    c = _corpus(spark, sf_dir)
    both = A.get_playbook(c, "F", "1-URGENT").unionByName(A.get_playbook(c, "F", "geen"))
    return both.select("step_id", "playbook", "fase", "title", "pos", F.array_join("documents", ",").alias("documents"), "error")


def read_coverage(spark, sf_dir):
    """Paragraphs of an article with what covers them; an article that does not exist gives the range."""
    c, act = _corpus(spark, sf_dir), _first_act(spark, sf_dir)
    both = A.get_coverage(c, "artikel 1", act).unionByName(A.get_coverage(c, "x", act))
    return both.select("act", "article_no", "anchor", "pos", "disposition", "n_steps", "covered", "total", "n_covered", "error")


def read_documents(spark, sf_dir):
    """Documents of a category with the steps that produce them; a category that does not exist gives those that do."""
    c = _corpus(spark, sf_dir)
    both = A.get_documents(c, "PROMO").unionByName(A.get_documents(c, "GEEN"))
    return both.select("document_id", "category", "name", F.array_join("steps", ",").alias("steps"), "error")


def _search_docs(spark, sf_dir):
    return _corpus(spark, sf_dir).documents


def read_search(spark, sf_dir):
    """The best articles for a query: the kind filters the fifty candidates found."""
    from lexweave.queries.retrieval import saved_index

    index = saved_index(spark, sf_dir, "content_nodes", _search_docs, "corpus")
    c = _corpus(spark, sf_dir, index)
    return A.search_corpus(c, "exitstrategie herzien", 10, "artikel").select("doc_id", "type", "act", "heading", "url", "coverage", "score")


def corpus_documents(spark, sf_dir):
    """One search document a paragraph and a recital."""
    return _search_docs(spark, sf_dir).filter("doc_id IS NOT NULL")


def step_documents(spark, sf_dir):
    """Search documents of steps and of the catalogue."""
    return A.documents_of_steps(_steps(spark, sf_dir)).unionByName(A.documents_of_catalogue(_catalogue(spark, sf_dir)))


def playbook_counts(spark, sf_dir):
    """Steps per playbook and phase, per playbook, and in all."""
    return A.playbook_counts(_steps(spark, sf_dir))


def category_shares(spark, sf_dir):
    """Documents per category and their share."""
    return A.category_shares(_catalogue(spark, sf_dir))


def steps_in_regime(spark, sf_dir):
    """Steps of a regime, and all steps for a regime of another kind."""
    steps = _steps(spark, sf_dir)
    one, other = A.steps_in_regime(steps, "F", ["F", "O"]), A.steps_in_regime(steps, "P", ["F", "O"])
    return one.agg(F.lit("F").alias("regime"), F.count("*").alias("n")).unionByName(other.agg(F.lit("P").alias("regime"), F.count("*").alias("n")))


def placed_dependencies(spark, sf_dir):
    """Steps a step needs, with the phase they stand in."""
    needs = table(spark, sf_dir, "orders").select(F.concat(F.lit("st"), "o_orderkey").alias("step_id"), F.concat(F.lit("st"), "o_custkey").alias("needs"))
    return M.placed_dependencies(_steps(spark, sf_dir).select("step_id", "fase"), needs)


def target_hrefs(spark, sf_dir):
    """Pages of articles, annexes and acts from their qualified keys."""
    i = table(spark, sf_dir, "anchor_index").select("instrument", "route_prefix", "target_kind", "target_no").distinct()
    plain = F.when(F.col("target_kind") == "bijlage", F.concat(F.lit("bijlage:"), F.upper("target_no"))).when(F.col("target_kind") == "artikel", F.col("target_no"))
    keyed = i.withColumn("target", F.when(F.col("target_kind") == "overweging", F.col("instrument")).when(F.col("target_kind") == "bijlage", F.concat_ws(":", "instrument", plain)).otherwise(M.qualified(plain, F.col("instrument"))))
    return keyed.select("target", M.target_href(F.col("target"), F.col("route_prefix")).alias("href")).distinct()


def neighbours_annexes(spark, sf_dir):
    """Annexes before and after, by ordinal."""
    return M.neighbours_by_position(_annexes(spark, sf_dir).select("act", "roman", "ordinal"), ["act"], ["ordinal"], "roman")


def refs_spliced(spark, sf_dir):
    """Bodies with their stored links put in."""
    n = table(spark, sf_dir, "content_nodes").filter("body IS NOT NULL AND size(refs) > 0 AND node_type = 'text'")
    refs = F.transform(F.filter("refs", lambda r: r.isNotNull()), lambda r: F.struct(r["start_pos"].alias("start"), r["end_pos"].alias("end"), r["href"].alias("href")))
    content = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("body").alias("text"), refs.alias("refs"))))
    return n.select("node_id", T.rendered(content).alias("markdown"))


def text_marks(spark, sf_dir):
    """Marks of corrections off, names of files, numbers with zeros."""
    c = table(spark, sf_dir, "roi_columns")
    return c.select("col_row", X.without_corrigendum(F.concat(F.lit("►C1 "), "code", F.lit(" ◄"))).alias("code"), X.file_name(F.col("label")).alias("file_name"), X.zero_padded(F.col("load_no")).alias("load"), X.zero_padded(F.col("col_row")).alias("row_text"))


#: sentences with every form of citation, and where which links stand: ``text|href`` of each
_MAIN = "van Verordening (EU) 2022/2554"
SENTENCES = (
    (f"Zie artikel 28, lid 3, {_MAIN}.", "artikel 28, lid 3|/artikel/28#lid-3"),
    ("Zie bijlage I tot en met IV.", "bijlage I|/sub/bijlage/i", "IV|/sub/bijlage/iv"),
    (f"Onverminderd hoofdstuk V, afdeling II, {_MAIN} geldt dit.", "hoofdstuk V, afdeling II|/#hoofdstuk-v"),
    (f"Artikel 30, lid 3, punt c), {_MAIN}", "Artikel 30, lid 3, punt c)|/artikel/30#lid-3-c"),
    ("als bedoeld in artikel 6 van deze verordening", "artikel 6|/sub/artikel/6"),
    ("de artikelen 2 tot en met 5", "artikelen 2|/sub/artikel/2", "5|/sub/artikel/5"),
    (f"artikel 35, lid 6, artikel 37, lid 1, en artikel 39, lid 6, {_MAIN}", "artikel 35, lid 6|/artikel/35#lid-6", "artikel 37, lid 1|/artikel/37#lid-1", "artikel 39, lid 6|/artikel/39#lid-6"),
    (f"artikel 19, lid 4, punten a), b) en met c), {_MAIN}", "artikel 19, lid 4, punten a)|/artikel/19#lid-4-a", "b)|/artikel/19#lid-4-b", "c)|/artikel/19#lid-4-c"),
    ("artikelen 1 tot en met 8 van Gedelegeerde Verordening (EU) 2024/1772", "artikelen 1|/cls/artikel/1", "8|/cls/artikel/8"),
    (f"artikel 30, lid 2, en (3), {_MAIN}", "artikel 30, lid 2|/artikel/30#lid-2", "3)|/artikel/30#lid-3"),
    ("artikel 53, 55 en 56", "artikel 53|/sub/artikel/53", "55|/sub/artikel/55", "56|/sub/artikel/56"),
    ("de overwegingen 3 en 4", "overwegingen 3|/sub/overweging/3", "4|/sub/overweging/4"),
    ("overweging 12 van deze uitvoeringsverordening", "overweging 12|/sub/overweging/12"),
    ("artikel 3, leden 1 en 2", "artikel 3, leden 1|/sub/artikel/3#lid-1", "2|/sub/artikel/3#lid-2"),
    ("artikel 3, leden 1, 2 en 4, en artikel 5", "artikel 3, leden 1|/sub/artikel/3#lid-1", "2|/sub/artikel/3#lid-2", "4|/sub/artikel/3#lid-4", "artikel 5|/sub/artikel/5"),
    ("bijlage III, punt 1.2", "bijlage III, punt 1.2|/sub/bijlage/iii#punt-1-2"),
    ("bijlage II, afdeling B", "bijlage II, afdeling B|/sub/bijlage/ii"),
    ("de bijlagen I, II en IV", "bijlagen I|/sub/bijlage/i", "II|/sub/bijlage/ii", "IV|/sub/bijlage/iv"),
    ("de hoofdstukken II en III", "hoofdstukken II|/sub/#hoofdstuk-ii", "III|/sub/#hoofdstuk-iii"),
    ("artikel 5, eerste alinea, en artikel 7", "artikel 5|/sub/artikel/5", "artikel 7|/sub/artikel/7"),
    ("artikel 4, punt 3)", "artikel 4, punt 3)|/sub/artikel/4#punt-3"),
    ("artikel 8, lid 2, respectievelijk punt b)", "artikel 8, lid 2, respectievelijk punt b)|/sub/artikel/8#lid-2"),
    ("artikel 9, lid 1, b) en c)", "artikel 9, lid 1, b) en c)|/sub/artikel/9#lid-1"),
    ("artikel 9, lid 1, of d)", "artikel 9, lid 1, of d)|/sub/artikel/9#lid-1"),
    ("artikel 2, lid 3, van de onderhavige gedelegeerde verordening", "artikel 2, lid 3|/sub/artikel/2#lid-3"),
    ("artikel 2 en artikel 3 van Uitvoeringsverordening (EU) 2024/2956", "artikel 2|/form/artikel/2", "artikel 3|/form/artikel/3"),
    ("artikel 5bis", "artikel 5|/sub/artikel/5"),
    (f"artikel 11 of onverminderd artikel 12, lid 1, {_MAIN}", "artikel 11|/artikel/11", "artikel 12, lid 1|/artikel/12#lid-1"),
    ("artikel 11. Artikel 12 van Richtlijn 2013/36/EU", "artikel 11|/sub/artikel/11"),
    ("artikel 6 van Verordening (EU) 2016/679",), ("artikel 4 van Richtlijn 2013/36/EU",), ("artikel 290 VWEU",), ("artikel 4 van die verordening",), ("artikel 6, lid 4, en artikel 9, lid 2, van Verordening (EU) 2016/679",),
    ("artikel 12/3",), ("artikel 12.3",), ("Bijlage IVa",), ("partikel 3",), ("artikel\n5",), ("",),
)
_ACTS = [C.Act("main", "Verordening (EU) 2022/2554", ""), C.Act("form", "Uitvoeringsverordening (EU) 2024/2956", "/form"), C.Act("sub", "Gedelegeerde Verordening (EU) 2025/532", "/sub"), C.Act("cls", "Gedelegeerde Verordening (EU) 2024/1772", "/cls")]


def ref_sentences(spark, sf_dir):
    """Every form of citation in a table of sentences: the words of each link and its target."""
    rows = [(i, text, "sub", "/sub", "artikel", "99") for i, (text, *_) in enumerate(SENTENCES)]
    texts = spark.createDataFrame(rows, "row_id long, body string, act string, route_prefix string, self_kind string, self_ref string")
    found = C.find_citations(texts, _ACTS).join(texts.select("row_id", "body"), "row_id")
    return found.select("row_id", "ord", F.substring("body", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos")).alias("words"), "href")


def ref_self_pages(spark, sf_dir):
    """Links of a page to itself fall out where they have no fragment; acts in which bare citations mean nothing are read with a reader of their own."""
    rows = [(1, "artikel 6 en artikel 7, lid 1", "6"), (2, "artikel 6, lid 1, en artikel 6", "6"), (3, "artikel 6", "7"), (4, None, "6")]
    texts = spark.createDataFrame([(i, t, "sub", "/sub", "artikel", n) for i, t, n in rows], "row_id long, body string, act string, route_prefix string, self_kind string, self_ref string")
    named = spark.createDataFrame([(10, f"artikel 6 en artikel 7 {_MAIN}"), (11, "artikel 6")], "row_id long, body string").select("row_id", "body", F.lit("sub").alias("act"), F.lit("/sub").alias("route_prefix"), F.lit("").alias("self_kind"), F.lit("").alias("self_ref"))
    return C.find_citations(texts, _ACTS).unionByName(C.find_citations(named, _ACTS, bare=False)).select("row_id", "ord", "href")


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _item_rows(spark, sf_dir):
    """Paragraphs of the edge list with their texts and their items of the first level, each item with its own text."""
    nodes = table(spark, sf_dir, "content_nodes").filter("path IS NOT NULL").withColumn("top", F.get("path", F.lit(0)))
    texts = nodes.filter("node_type = 'text' AND depth = 2 AND body IS NOT NULL").groupBy("doc_key", "top", "path").agg(F.max_by("body", "node_id").alias("t"))
    markers = nodes.filter("node_type = 'item' AND depth = 3 AND marker IS NOT NULL").groupBy("doc_key", "top", F.col("path").alias("item")).agg(F.max_by("marker", "node_id").alias("marker"))
    own = nodes.filter("node_type = 'text' AND depth = 4 AND body IS NOT NULL").groupBy("doc_key", F.slice("path", 1, 3).alias("item")).agg(F.max_by("body", F.struct("path", "node_id")).alias("t"))
    return texts, markers.join(own, ["doc_key", "item"])


def html_consolidated(spark, sf_dir):
    """Acts put into consolidated pages and read back: paragraphs, texts and points."""
    texts, items = _item_rows(spark, sf_dir)
    t = texts.select("doc_key", "top", F.struct(F.lit(0).alias("k"), F.col("path").alias("at"), F.concat(F.lit('<p class="norm">'), _escaped(F.col("t")), F.lit("</p>")).alias("h")).alias("x"))
    point = F.concat(F.lit('<div class="grid-container grid-list"><div class="list grid-list-column-1"><span>'), _escaped(F.col("marker")), F.lit('</span></div><div class="grid-list-column-2"><p class="norm">'), _escaped(F.col("t")), F.lit("</p></div></div>"))
    i = items.select("doc_key", "top", F.struct(F.lit(1).alias("k"), F.col("item").alias("at"), point.alias("h")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), "")
    paragraphs = t.unionByName(i).groupBy("doc_key", "top").agg(body.alias("h")).select("doc_key", F.struct("top", F.concat(F.lit('<div class="norm"><span class="no-parag">'), "top", F.lit('.  </span><div class="inline-element">'), "h", F.lit("</div></div>")).alias("h")).alias("x"))
    pages = paragraphs.groupBy("doc_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), "\n").alias("h"))
    head = '<html><head><style>p { color: "</div>"; }</style></head><body><div class="eli-subdivision" id="art_7"><p class="title-article-norm">Artikel 7</p><div class="eli-title"><p class="stitle-article-norm">Kop &amp; titel</p></div>'
    html = pages.select(F.col("doc_key").alias("instrument"), F.lit("consolidated").alias("layout"), F.concat(F.lit(head), "h", F.lit("</div></body></html>")).alias("html"))
    read = H.parse_pages(html).select(F.col("instrument").alias("doc_key"), "number", "title", F.explode("paragraphs").alias("p"))
    nodes = F.from_json("p.content", "array<struct<type:string,text:string,items:array<struct<marker:string,anchor:string,content:array<struct<type:string,text:string>>>>>>")
    flat = read.select("doc_key", "number", "title", "p.para_no", F.col("p.anchor").alias("para_anchor"), F.posexplode(nodes).alias("pos", "n"))
    plain = flat.filter("n.type = 'text'").select("doc_key", "number", "title", "para_no", "para_anchor", "pos", F.lit(None).cast("string").alias("marker"), F.lit(None).cast("string").alias("anchor"), "n.text")
    points = flat.filter("n.type = 'list'").select("doc_key", "number", "title", "para_no", "para_anchor", F.posexplode("n.items").alias("pos", "i"))
    return plain.unionByName(points.select("doc_key", "number", "title", "para_no", "para_anchor", "pos", "i.marker", "i.anchor", F.col("i.content")[0]["text"].alias("text")))


def html_recitals(spark, sf_dir):
    """Recitals put into journal pages and read back."""
    rows = table(spark, sf_dir, "recitals").filter("paragraphs IS NOT NULL AND recital_no IS NOT NULL")
    texts = F.array_join(F.transform("paragraphs", lambda p: F.concat(F.lit('<p class="oj-normal">'), _escaped(F.coalesce(p["body"], F.lit(""))), F.lit("</p>"))), "\n")
    html = F.concat(F.lit('<div class="eli-subdivision" id="rct_'), "recital_no", F.lit('"><table><tbody><tr><td><p>('), "recital_no", F.lit(")</p></td><td>"), texts, F.lit("</td></tr></tbody></table></div>"))
    read = H.parse_pages(rows.select(F.col("recital_id").cast("string").alias("instrument"), F.lit("journal").alias("layout"), html.alias("html")))
    out = read.select(F.col("instrument").cast("long").alias("recital_id"), "kind", "number", F.explode("paragraphs").alias("p"))
    return out.select("recital_id", "kind", "number", "p.para_no", "p.anchor", F.from_json("p.content", "array<struct<text:string>>")[0]["text"].alias("text"))


def html_tables(spark, sf_dir):
    """Tables put into annexes of journal pages and read back, cell by cell."""
    rows = table(spark, sf_dir, "content_nodes").filter("node_type = 'table' AND cells IS NOT NULL")
    cells = F.array_join(F.transform("cells", lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td><p>"), _escaped(F.coalesce(c, F.lit(""))), F.lit("</p></td>"))), ""), F.lit("</tr>"))), "")
    html = F.concat(F.lit('<div id="anx_IV"><p class="oj-doc-ti">BIJLAGE IV</p><p class="oj-doc-ti">Overzicht</p><p class="oj-ti-grseq-1">Deel A</p><table class="oj-table"><tbody>'), cells, F.lit("</tbody></table></div>"))
    read = H.parse_pages(rows.select(F.col("node_id").cast("string").alias("instrument"), F.lit("journal").alias("layout"), html.alias("html")))
    nodes = F.from_json(F.col("paragraphs")[0]["content"], "array<struct<type:string,text:string,rows:array<array<string>>>>")
    tables = read.select(F.col("instrument").cast("long").alias("node_id"), "kind", "roman", "number", "title", F.explode(nodes).alias("n")).filter("n.type = 'table'")
    flat = tables.select("node_id", "kind", "roman", "number", "title", F.posexplode("n.rows").alias("row_no", "r"))
    return flat.select("node_id", "kind", "roman", "number", "title", "row_no", F.posexplode("r").alias("column_no", "cell"))


def html_notes_divisions(spark, sf_dir):
    """Articles put into chapters and sections of consolidated pages with their footnotes, and read back."""
    a = table(spark, sf_dir, "articles").filter("article_no IS NOT NULL")
    notes = F.coalesce(F.filter("footnotes", lambda n: n.isNotNull() & (F.coalesce(n["note_text"], F.lit("")) != "")), F.array().cast(a.schema["footnotes"].dataType))
    marks = F.array_join(F.transform(notes, lambda n, i: F.concat(F.lit('<a id="src.E'), i, F.lit('" href="#E'), i, F.lit('">'), i, F.lit("</a>"))), " en ")
    texts = F.array_join(F.transform(notes, lambda n, i: F.concat(F.lit('<p class="footnote"><a id="E'), i, F.lit('" href="#src.E'), i, F.lit('">('), i, F.lit(")</a> "), _escaped(n["note_text"]), F.lit("</p>"))), "")
    article = F.concat(F.lit('<div class="eli-subdivision" id="art_'), "article_no", F.lit('"><div class="eli-title"><p class="stitle-article-norm">'), _escaped(F.coalesce("title", F.lit(""))), F.lit('</p></div><p class="norm">Tekst '), marks, F.lit("</p></div>"))
    section = F.concat(F.lit('<div id="cpt_'), "chapter", F.lit(".sct_"), "section_roman", F.lit('"><p class="title-division-2">'), _escaped(F.coalesce("section_title", F.lit(""))), F.lit("</p>"), article, F.lit("</div>"))
    chapter = F.concat(F.lit('<div id="cpt_'), "chapter", F.lit('"><p class="title-division-1">HOOFDSTUK</p><p class="title-division-2">'), _escaped(F.coalesce("chapter_title", F.lit(""))), F.lit("</p>"), F.coalesce(section, article), F.lit("</div>"))
    pages = a.select(F.col("article_id").cast("string").alias("instrument"), F.lit("consolidated").alias("layout"), F.concat(F.coalesce(chapter, article), texts).alias("html"))
    read = H.parse_pages(pages)
    return read.select(F.col("instrument").cast("long").alias("article_id"), "number", "title", "chapter", "chapter_title", "section", "section_title", F.array_join(F.transform("footnotes", lambda n: F.concat(n["note_label"], n["note_text"])), "|").alias("notes"))


def html_manifest(spark, sf_dir):
    """Pages written as files, one read for each layout of a manifest, and their provisions."""
    base = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    acts = [r["act"] for r in _acts(spark, sf_dir).select("act").orderBy("act").limit(4).collect()]  # the manifest is a short list by itself
    manifest = []
    for k, act in enumerate(acts):
        layout = ("journal", "consolidated")[k % 2]
        css = "oj-sti-art" if layout == "journal" else "stitle-article-norm"
        page = f'<div class="eli-subdivision" id="art_{k + 1}"><div class="eli-title"><p class="{css}">Over {act}</p></div><p>Tekst.</p></div>'
        spark.createDataFrame([(page,)], "value string").coalesce(1).write.text(f"{base}/{k}")
        manifest += [(act, f, layout) for f in spark.read.text(f"{base}/{k}").inputFiles()]
    return H.parse_pages(H.read_manifest(spark, manifest)).select("instrument", "kind", "number", "title")


def corpus_files(spark, sf_dir):
    """Articles and recitals written as nested JSON files, one folder an act, and read back."""
    base = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    a, r = _articles(spark, sf_dir), _recitals(spark, sf_dir)
    paragraphs = F.transform("paragraphs", lambda p: F.struct(p["para_no"].alias("number"), p["anchor"].alias("anchor"), F.array(F.lit(1)).alias("content")))
    article = F.to_json(F.struct(F.col("article_no").alias("number"), "title", paragraphs.alias("paragraphs")))
    recital = F.to_json(F.struct(F.col("recital_no").alias("number"), F.transform("paragraphs", lambda p: F.struct(p["text"].alias("text"))).alias("paragraphs")))
    for name, rows, one in (("articles", a, article), ("recitals", r, recital)):
        files = rows.select("act", one.alias("j")).groupBy("act").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value"))
        files.repartition("act").write.partitionBy("act").text(f"{base}/{name}")
    act = F.regexp_replace("act", r"\Aact=", "")
    back = K.read_articles(spark, f"{base}/articles/*/*").select(F.lit("artikel").alias("kind"), act.alias("act"), F.col("article_no").alias("number"), "title", F.array_join(F.col("paragraphs")["anchor"], ",").alias("inside"))
    also = K.read_recitals(spark, f"{base}/recitals/*/*").select(F.lit("overweging").alias("kind"), act.alias("act"), F.col("recital_no").alias("number"), F.lit(None).cast("string").alias("title"), F.array_join(F.transform("paragraphs", lambda p: p["text"]), " ").alias("inside"))
    return back.unionByName(also)


def corpus_annex_toc_files(spark, sf_dir):
    """Annexes and contents written as nested JSON files and read back."""
    base = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    annexes = _annexes(spark, sf_dir)
    one = F.to_json(F.struct("roman", "ordinal", "title"))
    files = annexes.select("act", one.alias("j")).groupBy("act").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value"))
    files.repartition("act").write.partitionBy("act").text(f"{base}/annexes")
    listed = F.array_sort(F.collect_list(F.struct(F.col("ordinal").alias("o"), "roman", "title")))
    toc = annexes.groupBy("act").agg(F.to_json(F.struct(F.array().cast("array<string>").alias("chapters"), F.transform(listed, lambda x: F.struct(x["roman"].alias("roman"), x["title"].alias("title"))).alias("annexes"), F.count("*").alias("recitalCount"))).alias("value"))
    toc.repartition("act").write.partitionBy("act").text(f"{base}/toc")
    act = F.regexp_replace("act", r"\Aact=", "")
    back = K.read_annexes(spark, f"{base}/annexes/*/*").select(act.alias("act"), "roman", "ordinal", "title")
    contents = K.read_toc(spark, f"{base}/toc/*/*").select(act.alias("act"), F.array_join(F.col("annexes")["roman"], ",").alias("roman"), F.col("recitalCount").alias("ordinal"), F.lit("inhoud").alias("title"))
    return back.unionByName(contents)


def appended_rows(spark, sf_dir):
    """Recitals of half the acts with the others appended to a new place, and JSON lines by act read again."""
    r = table(spark, sf_dir, "recitals").select("recital_id", "instrument", "recital_no")
    half = F.pmod(F.crc32(F.col("instrument").cast("binary")), F.lit(2)) == 0
    base = f"{shared_dir(spark)}/appended-{uuid.uuid4().hex}"
    whole = K.appended(r.filter(half), r.filter(~half), f"{base}/parquet")
    K.write_json(whole, f"{base}/json", "instrument")
    lines = spark.read.schema("recital_id long, recital_no int, instrument string").json(f"{base}/json")
    return lines.groupBy("instrument").agg(F.count("*").alias("n"), F.sum("recital_id").alias("sum_id"), F.max("recital_no").alias("last_no"))


QUERIES = {
    f.__name__: f
    for f in (
        read_article, read_recital, read_annex, read_structure, read_playbook, read_coverage, read_documents, read_search, corpus_documents, step_documents, playbook_counts, category_shares, steps_in_regime, placed_dependencies,
        target_hrefs, neighbours_annexes, refs_spliced, text_marks, ref_sentences, ref_self_pages, html_consolidated, html_recitals, html_tables, html_notes_divisions, html_manifest, corpus_files, corpus_annex_toc_files, appended_rows,
    )
}

_NL = "chr(10) || chr(10)"
_ARTICLES = """nodes AS (SELECT *, path[1] AS top, split_part(doc_key, ':', 3) AS no FROM content_nodes),
heads AS (SELECT instrument AS act, doc_key, no, top, min(anchor) AS anchor FROM nodes WHERE node_type = 'paragraph' GROUP BY ALL),
texts AS (SELECT doc_key, top, path, arg_max(body, node_id) AS t FROM nodes WHERE node_type = 'text' AND depth = 2 AND body IS NOT NULL GROUP BY ALL),
paras AS (SELECT act, CAST(no AS INTEGER) AS article_no, h.top, anchor, TRY_CAST(nullif(regexp_extract(anchor, 'lid-([0-9]+)', 1), '') AS INTEGER) AS para_no,
  (SELECT string_agg(t, chr(10) || chr(10) ORDER BY path) FROM texts x WHERE x.doc_key = h.doc_key AND x.top = h.top) AS md, (SELECT trim(string_agg(t, ' ' ORDER BY path), ' ') FROM texts x WHERE x.doc_key = h.doc_key AND x.top = h.top) AS flat
  FROM heads h WHERE EXISTS (SELECT 1 FROM texts x WHERE x.doc_key = h.doc_key AND x.top = h.top))"""
_RECITALS = """rct AS (SELECT instrument AS act, recital_no, arg_max(paragraphs, recital_id) AS p FROM recitals WHERE paragraphs IS NOT NULL GROUP BY ALL)"""
_PAGE_SQL = "regexp_extract({h}, '^/(.+)-rts/artikel/([0-9]+)', {i})"
_RPAIRS = _RECITALS + f""",
rhref AS (SELECT act || ':' || recital_no AS recital_key, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS pos FROM (SELECT act, recital_no, flatten(list_transform(p, lambda x: coalesce(list_transform(x.refs, lambda r: r.href), []))) AS hrefs FROM rct)),
rpairs AS (SELECT recital_key, {_PAGE_SQL.format(h='href', i=1)} || ':' || {_PAGE_SQL.format(h='href', i=2)} AS article_key, pos FROM rhref WHERE {_PAGE_SQL.format(h='href', i=1)} <> '')"""
_LINKED = f"""ahref AS (SELECT instrument, instrument || ':' || split_part(doc_key, ':', 3) AS source, node_id, unnest(list_transform(refs, lambda r: r.href)) AS href FROM content_nodes),
links AS (SELECT source, {_PAGE_SQL.format(h='href', i=1)} || ':' || {_PAGE_SQL.format(h='href', i=2)} AS target, split_part(href, '#', 1) AS href, min(node_id) AS pos FROM ahref WHERE {_PAGE_SQL.format(h='href', i=1)} NOT IN ('', instrument) GROUP BY ALL)"""
_ANNEXES = "anx AS (SELECT DISTINCT instrument AS act, upper(target_no) AS roman, CASE upper(target_no) WHEN 'I' THEN 1 WHEN 'II' THEN 2 WHEN 'III' THEN 3 WHEN 'IV' THEN 4 WHEN 'V' THEN 5 WHEN 'VI' THEN 6 WHEN 'VII' THEN 7 WHEN 'VIII' THEN 8 WHEN 'IX' THEN 9 WHEN 'X' THEN 10 END AS ordinal FROM anchor_index WHERE target_kind = 'bijlage')"
_SDOCS = f"""{_ARTICLES}, {_RECITALS},
acts AS (SELECT instrument AS act, min(route_prefix) AS route_prefix FROM anchor_index GROUP BY 1),
sdocs AS (SELECT act || '-art-' || article_no || '-' || anchor AS doc_id, 'artikel' AS type, act, 'Artikel ' || article_no || coalesce(', lid ' || para_no, '') AS ref, 'Artikel ' || article_no || coalesce(', lid ' || para_no, '') || ' — Over artikel ' || article_no AS heading,
    route_prefix || '/artikel/' || article_no || '#' || anchor AS url, flat AS text FROM paras JOIN acts USING (act)
  UNION ALL SELECT act || '-rct-' || recital_no, 'overweging', act, 'Overweging ' || recital_no, 'Overweging ' || recital_no, route_prefix || '/overweging/' || recital_no, array_to_string(list_transform(p, lambda x: x.body), ' ') FROM rct JOIN acts USING (act))"""
_SPACED = "trim(regexp_replace(regexp_replace({c}, '[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+', ' ', 'g'), '\\( (\\*?[0-9]+) \\)', '(\\1)', 'g'), ' ')"
_SLUG = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-')"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _expected_spans() -> str:
    rows = [(i, k, *span.split("|")) for i, (_, *spans) in enumerate(SENTENCES) for k, span in enumerate(spans)]
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, {k}, {_quoted(words)}, {_quoted(href)})" for i, k, words, href in rows) + ") t(row_id, ord, words, href)"


def _search_sql() -> str:
    from lexweave.queries.retrieval import _exact, _prefix, _sql_expanded

    inner = _sql_expanded([_prefix(g, t) if len(t) >= 5 else _exact(g, t) for t, g in S.term_groups("exitstrategie herzien", S.PRECISION).items()], 2.0).lstrip()
    docs = "SELECT doc_id, title AS heading, text, source, lang FROM documents"
    return f"WITH {_SDOCS}, " + inner.removeprefix("WITH ").replace(docs, "SELECT doc_id, heading, text FROM sdocs") + """
SELECT doc_id, type, act, heading, url, coverage, score FROM (SELECT * FROM scored ORDER BY coverage DESC, score DESC, doc_id LIMIT 50) JOIN sdocs USING (doc_id) WHERE type = 'artikel' ORDER BY coverage DESC, score DESC, doc_id LIMIT 10"""


SQL = {
    "read_article": f"""WITH {_ARTICLES}, {_RPAIRS}, {_LINKED}, one AS (SELECT min(instrument) AS act FROM content_nodes),
art AS (SELECT act, article_no, string_agg(concat_ws('. ', para_no, md), {_NL} ORDER BY top) AS markdown, act || ':' || article_no AS k FROM paras GROUP BY ALL),
r AS (SELECT article_key, string_agg(recital_key, ',' ORDER BY p, recital_key) AS recitals FROM (SELECT article_key, recital_key, min(pos) AS p FROM rpairs GROUP BY ALL) GROUP BY 1)
SELECT act, article_no, 'Over artikel ' || article_no AS title, markdown, r.recitals, coalesce((SELECT string_agg(href, ',' ORDER BY pos, href) FROM links WHERE source = k), '') AS implemented_by, coalesce((SELECT string_agg(source, ',' ORDER BY pos, source) FROM links WHERE target = k), '') AS based_on, CAST(NULL AS VARCHAR) AS error
FROM art JOIN one USING (act) LEFT JOIN r ON r.article_key = k WHERE article_no = 1
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Artikel "9999" niet gevonden (bereik: ' || coalesce(CAST(min(article_no) AS VARCHAR), 'geen') || '–' || coalesce(CAST(max(article_no) AS VARCHAR), 'geen') || ').' FROM art JOIN one USING (act)""",
    "read_recital": f"""WITH {_RPAIRS}, one AS (SELECT act, min(recital_no) AS recital_no FROM rct GROUP BY act ORDER BY act LIMIT 1),
a AS (SELECT recital_key, string_agg(article_key, ',' ORDER BY p, article_key) AS articles FROM (SELECT recital_key, article_key, min(pos) AS p FROM rpairs GROUP BY ALL) GROUP BY 1)
SELECT act, recital_no, array_to_string(list_transform(p, lambda x: x.body), {_NL}) AS text, articles, CAST(NULL AS VARCHAR) AS error FROM rct JOIN one USING (act, recital_no) LEFT JOIN a ON recital_key = act || ':' || recital_no
UNION ALL SELECT NULL, NULL, NULL, NULL, 'Overweging 9999 niet gevonden (bereik: 1–' || coalesce(CAST(max(rct.recital_no) AS VARCHAR), '0') || ').' FROM rct JOIN one USING (act)""",
    "read_annex": f"""WITH {_ANNEXES}, one AS (SELECT min(act) AS act FROM anx)
SELECT act, roman, 'Bijlage ' || roman AS title, 'Tekst van bijlage ' || roman || ' bij ' || act AS markdown, CAST(NULL AS VARCHAR) AS error FROM anx JOIN one USING (act) WHERE roman = 'I'
UNION ALL SELECT NULL, NULL, NULL, NULL, 'Bijlage "XL" niet gevonden. Beschikbaar: ' || coalesce(string_agg(roman, ', ' ORDER BY roman), 'geen') || '.' FROM anx JOIN one USING (act)""",
    "read_structure": f"""WITH {_RECITALS}, {_ANNEXES},
c AS (SELECT instrument AS act, chapter, chapter_title, count(*) AS n, min(article_no) AS f FROM articles GROUP BY ALL)
SELECT act, upper(act) AS label, (SELECT string_agg(coalesce(chapter, '-') || ':' || n, ',' ORDER BY f, chapter NULLS FIRST, chapter_title NULLS FIRST) FROM c WHERE c.act = a.act) AS chapters,
  (SELECT string_agg(roman, ',' ORDER BY ordinal, roman) FROM anx WHERE anx.act = a.act) AS annexes, coalesce((SELECT count(*) FROM rct WHERE rct.act = a.act), 0) AS n_recitals
FROM (SELECT DISTINCT instrument AS act FROM articles UNION ALL SELECT DISTINCT instrument FROM anchor_index) a""",
    "read_playbook": """WITH d AS (SELECT l_orderkey AS k, string_agg(x, ',' ORDER BY x) AS documents FROM (SELECT DISTINCT l_orderkey, 'doc' || l_partkey AS x FROM lineitem) GROUP BY 1)
SELECT 'st' || o_orderkey AS step_id, o_orderstatus AS playbook, o_orderpriority AS fase, 'Stap ' || o_orderkey AS title, o_orderkey AS pos, coalesce(documents, '') AS documents, CAST(NULL AS VARCHAR) AS error FROM orders LEFT JOIN d ON k = o_orderkey WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, 'Fase "geen" niet gevonden. Beschikbaar: ' || string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) || '.' FROM orders WHERE o_orderstatus = 'F'""",
    "read_coverage": f"""WITH {_ARTICLES}, one AS (SELECT min(instrument) AS act FROM content_nodes),
h AS (SELECT unnest(list_transform(refs, lambda r: r.href)) AS href FROM content_nodes),
e AS (SELECT regexp_extract(href, '^/(.+)-rts/artikel/([0-9]+)#(.+)', 1) AS act, CAST(regexp_extract(href, '^/(.+)-rts/artikel/([0-9]+)#(.+)', 2) AS INTEGER) AS article_no, regexp_extract(href, '^/(.+)-rts/artikel/([0-9]+)#(.+)', 3) AS anchor, count(*) AS n_steps FROM h WHERE regexp_matches(href, '^/(.+)-rts/artikel/([0-9]+)#(.+)') GROUP BY ALL),
u AS (SELECT act, article_no, anchor, CAST(row_number() OVER (ORDER BY top) - 1 AS INTEGER) AS pos FROM paras JOIN one USING (act) WHERE article_no = 1)
SELECT act, article_no, anchor, pos, CASE WHEN n_steps IS NOT NULL THEN 'stap' END AS disposition, n_steps, n_steps IS NOT NULL AS covered, count(*) OVER () AS total, count(n_steps) OVER () AS n_covered, CAST(NULL AS VARCHAR) AS error FROM u LEFT JOIN e USING (act, article_no, anchor)
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Artikel "x" niet gevonden (bereik: 1–' || coalesce(CAST(max(article_no) AS VARCHAR), '0') || ').' FROM paras JOIN one USING (act)""",
    "read_documents": """WITH d AS (SELECT l_partkey AS k, string_agg(x, ',' ORDER BY x) AS steps FROM (SELECT DISTINCT l_partkey, 'st' || l_orderkey AS x FROM lineitem) GROUP BY 1)
SELECT 'doc' || p_partkey AS document_id, p_type AS category, p_name AS name, coalesce(steps, '') AS steps, CAST(NULL AS VARCHAR) AS error FROM part LEFT JOIN d ON k = p_partkey WHERE p_type = 'PROMO'
UNION ALL SELECT NULL, NULL, NULL, NULL, 'Geen documenten. Categorieën: ' || string_agg(DISTINCT p_type, ', ' ORDER BY p_type) || '.' FROM part""",
    "read_search": _search_sql(),
    "corpus_documents": f"WITH {_SDOCS} SELECT * FROM sdocs WHERE doc_id IS NOT NULL",
    "step_documents": """SELECT 'stap-st' || o_orderkey AS doc_id, 'stap' AS type, o_orderstatus AS act, 'st' || o_orderkey AS ref, 'Stap ' || o_orderkey AS heading, '/playbook/' || o_orderstatus || '/' || o_orderpriority || '#st' || o_orderkey AS url, 'Doel doe ' || o_orderpriority AS text FROM orders
UNION ALL SELECT 'document-doc' || p_partkey, 'document', 'document', 'doc' || p_partkey, p_name, '/documenten#doc' || p_partkey, coalesce(p_brand, '') FROM part""",
    "playbook_counts": "SELECT o_orderstatus AS playbook, o_orderpriority AS fase, count(*) AS n_steps FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "category_shares": "SELECT p_type AS category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY 1",
    "steps_in_regime": "SELECT 'F' AS regime, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'P', count(*) FROM orders",
    "placed_dependencies": "SELECT 'st' || o.o_custkey AS needs, 'st' || o.o_orderkey AS step_id, o.o_orderpriority AS fase, n.o_orderpriority AS needed_in, o.o_orderpriority IS DISTINCT FROM n.o_orderpriority AS elsewhere FROM orders o LEFT JOIN orders n ON n.o_orderkey = o.o_custkey",
    "target_hrefs": """SELECT DISTINCT CASE target_kind WHEN 'artikel' THEN instrument || ':' || target_no WHEN 'bijlage' THEN instrument || ':bijlage:' || upper(target_no) ELSE instrument END AS target,
  CASE target_kind WHEN 'artikel' THEN route_prefix || '/artikel/' || target_no WHEN 'bijlage' THEN route_prefix || '/bijlage/' || lower(target_no) ELSE route_prefix END AS href FROM anchor_index""",
    "neighbours_annexes": f"WITH {_ANNEXES} SELECT act, roman, ordinal, lag(roman) OVER w AS previous, lead(roman) OVER w AS next FROM anx WINDOW w AS (PARTITION BY act ORDER BY ordinal)",
    "refs_spliced": """WITH RECURSIVE n AS (SELECT node_id, body, list_filter(refs, lambda r: r IS NOT NULL) AS refs FROM content_nodes WHERE body IS NOT NULL AND len(refs) > 0 AND node_type = 'text'),
x AS (SELECT node_id, body, unnest(refs) AS r FROM n),
k AS (SELECT node_id, r, row_number() OVER (PARTITION BY node_id ORDER BY r.start_pos DESC) AS i FROM x),
s(node_id, i, t, lim) AS (SELECT node_id, 0::BIGINT, body, length(body) FROM n
  UNION ALL SELECT s.node_id, s.i + 1, CASE WHEN ok THEN substring(t, 1, a) || '[' || substring(t, a + 1, b - a) || '](' || h || ')' || substring(t, b + 1) ELSE t END, CASE WHEN ok THEN a ELSE lim END
    FROM (SELECT s.*, k.r.start_pos AS a, k.r.end_pos AS b, k.r.href AS h, coalesce(k.r.start_pos >= 0 AND k.r.start_pos < k.r.end_pos AND k.r.end_pos <= s.lim, false) AS ok FROM s JOIN k ON k.node_id = s.node_id AND k.i = s.i + 1) s)
SELECT node_id, arg_max(t, i) AS markdown FROM s GROUP BY node_id""",
    "text_marks": "SELECT col_row, code, regexp_replace(label, '[^A-Za-z0-9_-]+', '_', 'g') AS file_name, CASE WHEN load_no < 10 THEN '0' || load_no ELSE CAST(load_no AS VARCHAR) END AS load, CASE WHEN col_row < 10 THEN '0' || col_row ELSE CAST(col_row AS VARCHAR) END AS row_text FROM roi_columns",
    "ref_sentences": _expected_spans(),
    "ref_self_pages": "SELECT * FROM (VALUES (1, 0, '/sub/artikel/7#lid-1'), (2, 0, '/sub/artikel/6#lid-1'), (3, 0, '/sub/artikel/6'), (10, 0, '/artikel/6'), (10, 1, '/artikel/7')) t(row_id, ord, href)",
    "html_consolidated": f"""WITH nodes AS (SELECT *, path[1] AS top FROM content_nodes WHERE path IS NOT NULL),
t AS (SELECT doc_key, top, path, {_SPACED.format(c='arg_max(body, node_id)')} AS text FROM nodes WHERE node_type = 'text' AND depth = 2 AND body IS NOT NULL GROUP BY ALL),
m AS (SELECT doc_key, top, path AS item, arg_max(marker, node_id) AS marker FROM nodes WHERE node_type = 'item' AND depth = 3 AND marker IS NOT NULL GROUP BY ALL),
o AS (SELECT doc_key, path[:3] AS item, arg_max(body, (path, node_id)) AS body FROM nodes WHERE node_type = 'text' AND depth = 4 AND body IS NOT NULL GROUP BY ALL),
i AS (SELECT m.*, {_SPACED.format(c='marker')} AS mark, {_SPACED.format(c='body')} AS text FROM m JOIN o USING (doc_key, item))
SELECT doc_key, 7 AS number, 'Kop & titel' AS title, top AS para_no, 'lid-' || top AS para_anchor, CAST(row_number() OVER (PARTITION BY doc_key, top ORDER BY path) - 1 AS INTEGER) AS pos, CAST(NULL AS VARCHAR) AS marker, CAST(NULL AS VARCHAR) AS anchor, text FROM t WHERE text <> ''
UNION ALL SELECT doc_key, 7, 'Kop & titel', top, 'lid-' || top, CAST(row_number() OVER (PARTITION BY doc_key, top ORDER BY item) - 1 AS INTEGER), mark, CASE WHEN {_SLUG.format(c='mark')} <> '' THEN 'lid-' || top || '-' || {_SLUG.format(c='mark')} END, text FROM i""",
    "html_recitals": f"""WITH p AS (SELECT recital_id, recital_no, unnest(paragraphs) AS x, generate_subscripts(paragraphs, 1) AS k FROM recitals WHERE recital_no IS NOT NULL), t AS (SELECT recital_id, recital_no, k, {_SPACED.format(c="coalesce(x.body, '')")} AS text FROM p),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY recital_id ORDER BY k) AS INTEGER) AS para_no FROM t WHERE text <> '') SELECT recital_id, 'overweging' AS kind, recital_no AS number, para_no, 'alinea-' || para_no AS anchor, text FROM n""",
    "html_tables": f"""WITH r AS (SELECT node_id, unnest(list_filter(list_transform(cells, lambda r: list_transform(r, lambda c: {_SPACED.format(c="coalesce(c, '')")})), lambda r: len(list_filter(r, lambda c: c <> '')) > 0)) AS r, generate_subscripts(list_filter(list_transform(cells, lambda r: list_transform(r, lambda c: {_SPACED.format(c="coalesce(c, '')")})), lambda r: len(list_filter(r, lambda c: c <> '')) > 0), 1) AS i FROM content_nodes WHERE node_type = 'table' AND cells IS NOT NULL)
SELECT node_id, 'bijlage' AS kind, 'IV' AS roman, 4 AS number, 'Overzicht' AS title, CAST(i - 1 AS INTEGER) AS row_no, unnest(range(0, len(r)))::INTEGER AS column_no, unnest(r) AS cell FROM r""",
    "html_notes_divisions": f"""SELECT article_id, article_no AS number, {_SPACED.format(c="coalesce(title, '')")} AS title, CASE WHEN chapter IS NULL OR NOT regexp_full_match(chapter, '[IVXLC]+') THEN '' ELSE chapter END AS chapter, CASE WHEN chapter IS NULL OR NOT regexp_full_match(chapter, '[IVXLC]+') THEN '' ELSE {_SPACED.format(c="coalesce(chapter_title, '')")} END AS chapter_title,
  CASE WHEN chapter IS NOT NULL THEN section_roman END AS section, CASE WHEN chapter IS NOT NULL AND section_roman IS NOT NULL THEN nullif({_SPACED.format(c="coalesce(section_title, '')")}, '') END AS section_title,
  coalesce((SELECT string_agg('(' || (k - 1) || ')' || {_SPACED.format(c='x.note_text')}, '|' ORDER BY k) FROM (SELECT unnest(f) AS x, generate_subscripts(f, 1) AS k FROM (SELECT list_filter(a.footnotes, lambda n: n IS NOT NULL AND coalesce(n.note_text, '') <> '') AS f))), '') AS notes FROM articles a WHERE article_no IS NOT NULL""",
    "html_manifest": "SELECT act AS instrument, 'artikel' AS kind, CAST(k AS INTEGER) AS number, 'Over ' || act AS title FROM (SELECT act, row_number() OVER (ORDER BY act) AS k FROM (SELECT DISTINCT instrument AS act FROM anchor_index)) WHERE k <= 4",
    "corpus_files": f"""WITH {_ARTICLES}, {_RECITALS} SELECT 'artikel' AS kind, act, article_no AS number, 'Over artikel ' || article_no AS title, string_agg(anchor, ',' ORDER BY top) AS inside FROM paras GROUP BY ALL
UNION ALL SELECT 'overweging', act, recital_no, NULL, array_to_string(list_transform(p, lambda x: x.body), ' ') FROM rct""",
    "corpus_annex_toc_files": f"WITH {_ANNEXES} SELECT act, roman, ordinal, 'Bijlage ' || roman AS title FROM anx UNION ALL SELECT act, string_agg(roman, ',' ORDER BY ordinal), CAST(count(*) AS INTEGER), 'inhoud' FROM anx GROUP BY act",
    "appended_rows": "SELECT instrument, count(*) AS n, CAST(sum(recital_id) AS BIGINT) AS sum_id, max(recital_no) AS last_no FROM recitals GROUP BY 1",
}
