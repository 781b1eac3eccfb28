"""Queries over the corpus: trees, citations, maps, coverage, contents, constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import clip
from lexweave.operators import citations as C
from lexweave.operators import maps as M
from lexweave.operators import tree as T
from lexweave.plans import quality as Q
from lexweave.sources import html as H
from lexweave.sources.tables import heavy_table, table


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "content_nodes")


def tree_flatten(spark, sf_dir):
    """Each act's article as flat text in document order."""
    return T.flat_documents(_nodes(spark, sf_dir))


def tree_flatten_json(spark, sf_dir):
    """Paragraphs of nested JSON as flat text."""
    flat = table(spark, sf_dir, "articles").select("article_id", F.posexplode("paragraphs").alias("pos", "p"))
    return flat.select("article_id", "pos", T.flattened(F.col("p.content")).alias("flat_text"))


def tree_edges(spark, sf_dir):
    """Nested JSON as an edge list, counted per type and depth."""
    flat = table(spark, sf_dir, "articles").select(F.col("article_id").cast("string").alias("doc_key"), F.explode("paragraphs").alias("p")).filter("p.content IS NOT NULL").select("doc_key", F.col("p.content").alias("content"))
    return T.edge_list(flat).groupBy("node_type", "depth").agg(F.count("*").alias("n_nodes"))


def tree_markdown(spark, sf_dir):
    """Paragraphs as Markdown with their links spliced in."""
    flat = table(spark, sf_dir, "articles").select("article_id", F.posexplode("paragraphs").alias("pos", "p"))
    return flat.select("article_id", "pos", T.rendered(F.col("p.content")).alias("markdown"))


def tree_tables(spark, sf_dir):
    """Tables of the edge list with their size and as Markdown."""
    return T.tables(_nodes(spark, sf_dir)).select("doc_key", F.array_join("path", ".").alias("place"), "n_rows", "n_columns", "markdown")


def anchor_counts(spark, sf_dir):
    """How often each anchor stands in its document."""
    return T.anchors(_nodes(spark, sf_dir))


def unique_anchor(spark, sf_dir):
    """Anchors that can be linked to."""
    return T.unique_anchors(_nodes(spark, sf_dir))


def duplicate_ordinal(spark, sf_dir):
    """Repeated anchors told apart."""
    rows = _nodes(spark, sf_dir).filter("anchor IS NOT NULL").select("doc_key", "node_id", "anchor")
    return T.numbered_anchors(rows, ["doc_key"], "anchor", ["node_id"])


def item_anchor_check(spark, sf_dir):
    """Items whose anchor is not what paragraph and marker give, per document."""
    wrong = T.item_anchors(_nodes(spark, sf_dir)).filter("NOT (expected_anchor <=> anchor)")
    return wrong.groupBy("doc_key").agg(F.count("*").alias("n_items"))


def heading_carry_forward(spark, sf_dir):
    """Nodes with the heading they stand under."""
    return T.carried_heading(_nodes(spark, sf_dir)).select("node_id", "under_heading")


def html_list_items_chunks(spark, sf_dir):
    """Searchable pieces of each document."""
    return T.chunks(_nodes(spark, sf_dir))


_PAGE = "concat('<html><head><script>var p = \"</p>\";</script></head><body><div class=\"eli-subdivision\" id=\"art_1\"><div class=\"eli-title\"><p class=\"oj-sti-art\">', replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '</p></div><p class=\"oj-normal\">', replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '\n', '</p>\n<p class=\"oj-normal\">'), '</p></div></body>')"


def html_block_nodes(spark, sf_dir):
    """Documents put into pages and read back: one text node a line."""
    pages = heavy_table(spark, sf_dir, "documents", "doc_id", "title", "text").select(F.col("doc_id").cast("string").alias("instrument"), F.lit("journal").alias("layout"), F.expr(_PAGE).alias("html"))
    read = H.parse_pages(pages).select(F.col("instrument").cast("long").alias("doc_id"), F.explode("paragraphs.content").alias("content"))
    texts = F.from_json("content", "array<struct<type:string,text:string>>")
    return read.select("doc_id", F.posexplode(texts).alias("pos", "n")).select("doc_id", "pos", "n.type", "n.text")


def _texts(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return nodes.select(F.col("node_id").alias("row_id"), "body", F.col("instrument").alias("act"), F.concat(F.lit("/"), "instrument", F.lit("-rts")).alias("route_prefix"), F.lit("artikel").alias("self_kind"), F.split_part("doc_key", F.lit(":"), F.lit(3)).alias("self_ref"))


def ref_spans(spark, sf_dir):
    """Citations found in the bodies, with their places."""
    return C.find_citations(_texts(spark, sf_dir))


def ref_hrefs(spark, sf_dir):
    """Citations with a number that the bodies hold, per row and target."""
    return C.find_citations(_texts(spark, sf_dir).withColumn("self_ref", F.lit(""))).groupBy("row_id", "href").agg(F.count("*").alias("n"))


def _links(spark, sf_dir):
    return _nodes(spark, sf_dir).select("node_id", "doc_key", "instrument", F.explode("refs.href").alias("href")).filter("href IS NOT NULL")


def ref_resolution(spark, sf_dir):
    """Stored links against pages and unique anchors: entries still alive, an anchor entered twice being no target."""
    index = table(spark, sf_dir, "anchor_index").filter("deleted_at IS NULL").select(F.concat_ws("/", "route_prefix", "target_kind", "target_no").alias("page"), "anchor")
    anchors = index.filter("anchor IS NOT NULL").groupBy("page", "anchor").agg(F.count("*").alias("n"))
    return C.resolve(_links(spark, sf_dir).select("node_id", "href").distinct(), index, anchors)


def ref_counts(spark, sf_dir):
    """Links per act and in all."""
    return C.counts(_links(spark, sf_dir), "instrument")


def ref_audit(spark, sf_dir):
    """Where each target is cited, first places first."""
    return _links(spark, sf_dir).groupBy("href").agg(F.count("*").alias("n_refs"), F.count_distinct("doc_key").alias("n_documents"), F.min("node_id").alias("first_node"))


def _pairs(spark, sf_dir):
    links = _links(spark, sf_dir).select("doc_key", F.lower(F.trim(F.regexp_extract("href", "^([^#?]*)", 1))).alias("page"), F.col("node_id").alias("pos"))
    return links.filter("page <> ''")


def map_forward(spark, sf_dir):
    """Pages each article cites, in order."""
    return M.grouped(_pairs(spark, sf_dir), "doc_key", "page", "pos", "pages")


def map_inverse(spark, sf_dir):
    """Articles that cite each page."""
    return M.grouped(_pairs(spark, sf_dir), "page", "doc_key", "pos", "documents")


def map_inverse_consistency(spark, sf_dir):
    """Pairs that one of two maps has and the other lacks: the inverse lacks every 97th citation, the forward map every 89th."""
    pairs = _pairs(spark, sf_dir)
    forward, inverse = M.grouped(pairs.filter("pos % 89 <> 0"), "doc_key", "page", "pos"), M.grouped(pairs.filter("pos % 97 <> 0"), "page", "doc_key", "pos")
    return M.inverse_mismatches(forward, inverse, "doc_key", "page")


def map_reviewed(spark, sf_dir):
    """Recitals mapped, reviewed without a target, or not reviewed."""
    rows = table(spark, sf_dir, "recitals").select("recital_id", F.flatten(F.transform(F.filter("paragraphs", lambda p: p["refs"].isNotNull()), lambda p: p["refs"]["href"])).alias("targets"), F.col("paragraphs").isNotNull().alias("reviewed"))
    return M.reviewed_pairs(rows, "recital_id", "targets", "reviewed").groupBy("state").agg(F.count("*").alias("n_rows"), F.count_distinct("recital_id").alias("n_recitals"))


def related_articles(spark, sf_dir):
    """Cited articles with the opening of their title text."""
    pairs = _pairs(spark, sf_dir).select("doc_key", "page").distinct()
    nodes = _nodes(spark, sf_dir).filter("node_type = 'text' AND body IS NOT NULL")
    page = F.concat(F.lit("/"), "instrument", F.lit("-rts/artikel/"), F.split_part("doc_key", F.lit(":"), F.lit(3)))
    first = nodes.groupBy(page.alias("page")).agg(F.min_by("body", F.struct("path", "node_id")).alias("body"))
    return M.related(pairs, first, "doc_key", "page", "body")


def split_routes(spark, sf_dir):
    """The act of every cited page by its longest prefix."""
    acts = table(spark, sf_dir, "anchor_index").select(F.col("instrument").alias("act"), "route_prefix").distinct()
    pages = _pairs(spark, sf_dir).select("page").distinct()
    return M.split_route(pages, acts, "page", "hoofdakte")


def _coverage(spark, sf_dir):
    universe = table(spark, sf_dir, "anchor_index").filter("anchor IS NULL").select("instrument", F.concat_ws("/", "route_prefix", "target_kind", "target_no").alias("page"), "target_kind").distinct()
    cited = _pairs(spark, sf_dir).groupBy("page").agg(F.when(F.count("*") > 2, "stap").otherwise("context").alias("disposition"))
    return M.coverage(universe, cited, ["page"])


def coverage_matrix(spark, sf_dir):
    """Every page of the index with its disposition or none."""
    return _coverage(spark, sf_dir).select("instrument", "page", "disposition", "covered")


def coverage_summary(spark, sf_dir):
    """Covered and open pages per act."""
    return M.coverage_tally(_coverage(spark, sf_dir), ["instrument"])


def disposition_histogram(spark, sf_dir):
    """Pages per disposition with their share."""
    from pyspark.sql import Window

    counted = _coverage(spark, sf_dir).groupBy(F.coalesce("disposition", F.lit("open")).alias("disposition")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def toc_nested(spark, sf_dir):
    """Chapters with their sections and articles, flattened again for comparison."""
    toc = M.contents(table(spark, sf_dir, "articles"))
    return toc.select("instrument", "chapter", "chapter_title", "n_articles", F.size("sections").alias("n_sections"), F.array_join(F.transform(F.flatten("sections.articles"), lambda a: a["article_no"].cast("string")), ",").alias("article_nos"))


def article_ranges(spark, sf_dir):
    """First and last article of each chapter."""
    return M.number_ranges(table(spark, sf_dir, "articles"))


def neighbours_position(spark, sf_dir):
    """Articles before and after, by place."""
    rows = table(spark, sf_dir, "articles").select("instrument", "article_no", "article_id")
    return M.neighbours_by_position(rows, ["instrument"], ["article_no", "article_id"], "article_id")


def neighbours_number(spark, sf_dir):
    """Recitals numbered one less and one more."""
    return M.neighbours_by_number(table(spark, sf_dir, "recitals").select("recital_id", "instrument", "recital_no"), ["instrument"], "recital_no")


def previews(spark, sf_dir):
    """Title and opening behind every cited article, recital and annex."""
    nodes = _nodes(spark, sf_dir)
    index = table(spark, sf_dir, "anchor_index").filter("target_kind = 'bijlage' AND anchor IS NULL")
    annexes = index.select(F.concat_ws("/", "route_prefix", "target_kind", "target_no").alias("page"), F.lit(1).alias("para_pos"), F.lit(None).cast("string").alias("anchor"), F.concat(F.lit("Bijlage "), F.upper("target_no")).alias("title"), F.lit("").alias("para_no"), F.concat(F.lit("Bijlage bij "), "instrument").alias("body")).distinct()
    r = table(spark, sf_dir, "recitals").filter("paragraphs IS NOT NULL").groupBy("instrument", "recital_no").agg(F.max_by("paragraphs", "recital_id").alias("p"))
    recitals = r.select(F.concat(F.lit("/"), "instrument", F.lit("-rts/overweging/"), "recital_no").alias("page"), F.concat(F.lit("Overweging "), "recital_no").alias("title"), F.posexplode("p").alias("para_pos", "p")).select("page", "para_pos", F.lit(None).cast("string").alias("anchor"), "title", F.lit("").alias("para_no"), F.col("p.body").alias("body"))
    number = F.split_part("doc_key", F.lit(":"), F.lit(3))
    first = nodes.filter("node_type = 'text' AND depth = 2 AND body IS NOT NULL").groupBy("doc_key", F.element_at("path", 1).alias("para_pos")).agg(F.min_by("body", F.struct("path", "node_id")).alias("body"))
    heads = nodes.filter("node_type = 'paragraph'").groupBy("doc_key", "instrument", F.element_at("path", 1).alias("para_pos")).agg(F.min("anchor").alias("anchor"))
    paragraphs = heads.join(first, ["doc_key", "para_pos"]).select(
        F.concat(F.lit("/"), "instrument", F.lit("-rts/artikel/"), number).alias("page"), "para_pos", "anchor", F.concat(F.lit("Artikel "), number).alias("title"), F.regexp_extract("anchor", r"lid-(\d+)", 1).alias("para_no"), "body"
    )
    return M.previews(_links(spark, sf_dir), paragraphs.unionByName(recitals).unionByName(annexes))


def priority_buckets(spark, sf_dir):
    """Orders per priority, unknown ones in a bucket of their own."""
    rows = M.in_buckets(table(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])
    return rows.groupBy("bucket", "bucket_no").agg(F.count("*").alias("n"))


def progress_pct_half_up(spark, sf_dir):
    """Share of filled-in answers per register, in whole percent."""
    a = table(spark, sf_dir, "arrangements").filter("answers IS NOT NULL")
    filled = F.size(F.filter(F.map_values("answers"), lambda v: F.coalesce(v, F.lit("")) != ""))
    return a.groupBy("register_id").agg(F.sum(filled).alias("done"), F.sum(F.size("answers")).alias("total")).select("register_id", "done", "total", M.percent(F.col("done"), F.col("total")).alias("pct"))


def bulk_patch(spark, sf_dir):
    """Columns corrected by key, and corrections of unknown columns."""
    columns = table(spark, sf_dir, "roi_columns").select("col_row", "code", "soort")
    changes = table(spark, sf_dir, "closed_lists").select(F.col("column_code").alias("code"), F.lit("Gesloten lijst").alias("soort")).distinct()
    out, unknown = M.patched(columns, changes, "code", "soort")
    return out.groupBy("soort").agg(F.count("*").alias("n")).unionByName(unknown.select(F.concat(F.lit("unknown "), "code").alias("soort"), F.lit(1).cast("long").alias("n")))


def orphans(spark, sf_dir):
    """Pages of the index that nothing cites."""
    pages = table(spark, sf_dir, "anchor_index").select(F.lower(F.concat_ws("/", "route_prefix", "target_kind", "target_no")).alias("page"), "target_kind").distinct()
    return Q.unused(pages, _pairs(spark, sf_dir), "page")


def referential_integrity(spark, sf_dir):
    """Dangling references of each kind."""
    l, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    return Q.report(
        {
            "lineitem_orders": Q.dangling(l, o, "l_orderkey", "o_orderkey"), "orders_customer": Q.dangling(o, c, "o_custkey", "c_custkey"), "customer_nation": Q.dangling(c, n, "c_nationkey", "n_nationkey"),
            "nodes_index": Q.dangling(table(spark, sf_dir, "content_nodes"), table(spark, sf_dir, "anchor_index"), "instrument", "instrument"),
            "articles_index": Q.dangling(table(spark, sf_dir, "articles"), table(spark, sf_dir, "anchor_index"), "instrument", "instrument"),
            "pages_index": Q.dangling(_pairs(spark, sf_dir), table(spark, sf_dir, "anchor_index").select(F.lower(F.concat_ws("/", "route_prefix", "target_kind", "target_no")).alias("page")), "page", "page"),
        }
    )


def keyset_equality(spark, sf_dir):
    """Pages that only citations or only the index know."""
    pages = table(spark, sf_dir, "anchor_index").select(F.lower(F.concat_ws("/", "route_prefix", "target_kind", "target_no")).alias("page"))
    return Q.different_keys(_pairs(spark, sf_dir), pages, "page")


def contiguous_numbering(spark, sf_dir):
    """Articles whose number is not their place in the act."""
    rows = table(spark, sf_dir, "articles").select("instrument", "article_no").distinct()
    return Q.misnumbered(rows, ["instrument"], "article_no")


def repeated_keys(spark, sf_dir):
    """Deliveries that repeat an arrangement."""
    return Q.repeated(table(spark, sf_dir, "arrangements"), ["arrangement_id"])


def forward_ordering(spark, sf_dir):
    """Nodes whose parent does not come before them."""
    n = table(spark, sf_dir, "content_nodes").withColumn("place", F.concat_ws("|", "doc_key", F.array_join("path", ".")))
    positions = n.groupBy("place").agg(F.min("node_id").alias("node_id"))
    needs = n.filter("depth > 1").select("place", F.concat_ws("|", "doc_key", F.array_join(F.slice("path", F.lit(1), F.when(F.col("node_type") == "item", F.size("path") - 2).otherwise(F.size("path") - 1)), ".")).alias("above")).distinct()
    return Q.backward(needs, positions, "place", "above", "node_id").agg(F.count("*").alias("n_backward"))


def domain_checks(spark, sf_dir):
    """Values outside their domain, per check."""
    r, n = table(spark, sf_dir, "roi_columns"), table(spark, sf_dir, "content_nodes")
    return Q.report(
        {
            "soort": Q.outside(r, "soort", ["Alfanumeriek", "Datum", "Land", "Monetair", "Gesloten lijst"]), "mandatory_raw": Q.outside(r, "mandatory_raw", ["Verplicht", "Facultatief"]),
            "lang": Q.outside(n, "lang", ["nl", "de", "fr", "en"]), "node_type": Q.outside(n, "node_type", ["heading", "paragraph", "text", "item", "table", "figure"]),
        }
    )


def count_pins(spark, sf_dir):
    """Pages per kind against pins."""
    counts = table(spark, sf_dir, "anchor_index").groupBy("target_kind").agg(F.count("*").alias("n"))
    pins = spark.createDataFrame([("artikel", 100), ("bijlage", 100), ("hoofdstuk", 7)], "target_kind string, pin long")
    return Q.off_pins(counts, pins, "target_kind")


def determinism(spark, sf_dir):
    """A map built over rows that lie otherwise is the same; built without the rows of one act it differs in that act's articles."""
    shuffled = _pairs(spark, sf_dir).repartition(7, "pos").sortWithinPartitions(F.desc("pos"))
    again = M.grouped(shuffled, "doc_key", "page", "pos", "pages")
    first_act = F.split_part("doc_key", F.lit(":"), F.lit(1))
    less = again.filter(F.pmod(F.length(first_act), F.lit(2)) == 0)
    same, other = Q.changed_between_runs(map_forward(spark, sf_dir), again), Q.changed_between_runs(map_forward(spark, sf_dir), less)
    return same.agg(F.lit("whole").alias("run"), F.count("*").alias("n_different")).unionByName(other.agg(F.lit("without some acts").alias("run"), F.count("*").alias("n_different")))


def contents_exact_cover(spark, sf_dir):
    """Articles a list of contents lacks, has twice, or invents: every 7th is left out, every 11th stands twice, every 13th number is wrong."""
    articles = table(spark, sf_dir, "articles").select("instrument", "article_no", "article_id")
    kept = articles.filter("article_id % 7 <> 0")
    listed = kept.unionByName(articles.filter("article_id % 11 = 0")).withColumn("article_no", F.when(F.col("article_id") % 13 == 0, F.col("article_no") + 1000).otherwise(F.col("article_no")))
    return Q.not_exactly_once(listed, articles, ["instrument", "article_no"])


def conditional_lists(spark, sf_dir):
    """Articles without numbered paragraphs against the list pinned for them."""
    a = table(spark, sf_dir, "articles")
    flat = F.coalesce(~F.exists("paragraphs", lambda p: p["para_no"].isNotNull()), F.lit(True))
    return Q.off_list(a, "article_id", flat, a.filter("article_id % 5 = 0"))


def substring_pins(spark, sf_dir):
    """Articles whose title lacks the phrase pinned for them."""
    return Q.without_text(table(spark, sf_dir, "articles"), "article_id", "title", {"1": "uitwijk", "2": "logboek", "3": "onvindbaar", "4": "e", "999999": "x"})


def two_regime_pins(spark, sf_dir):
    """Counts against pins where the corpus is complete, and where it may be incomplete."""
    counts = table(spark, sf_dir, "content_nodes").groupBy("node_type").agg(F.count("*").alias("n"))
    pins = spark.createDataFrame([("table", 5), ("item", 100_000_000), ("figure", 0), ("sectie", 3)], "node_type string, pin long")
    whole = Q.off_pins(counts, pins, "node_type").withColumn("regime", F.lit("complete"))
    return whole.unionByName(Q.off_pins(counts, pins, "node_type", complete=False).withColumn("regime", F.lit("incomplete")))


def clip_openings(spark, sf_dir):
    """Openings of recitals, clipped short (a cut inside a word when the limit is small)."""
    return table(spark, sf_dir, "recitals").select("recital_id", clip(F.get("paragraphs", F.lit(0))["body"], 100).alias("opening"))


QUERIES = {
    f.__name__: f
    for f in (
        tree_flatten, tree_flatten_json, tree_edges, tree_markdown, tree_tables, anchor_counts, unique_anchor, duplicate_ordinal, item_anchor_check, heading_carry_forward, html_list_items_chunks, html_block_nodes,
        ref_spans, ref_hrefs, ref_resolution, ref_counts, ref_audit, map_forward, map_inverse, map_inverse_consistency, map_reviewed, related_articles, split_routes, coverage_matrix, coverage_summary,
        disposition_histogram, toc_nested, article_ranges, neighbours_position, neighbours_number, previews, priority_buckets, progress_pct_half_up, bulk_patch, orphans, referential_integrity, keyset_equality,
        contiguous_numbering, repeated_keys, forward_ordering, domain_checks, count_pins, determinism, contents_exact_cover, conditional_lists, substring_pins, two_regime_pins, clip_openings,
    )
}

_NODE_TEXT = "CASE WHEN node_type = 'item' THEN coalesce(marker, '') WHEN node_type = 'table' THEN array_to_string(list_transform(cells, lambda r: array_to_string(r, ' ')), ' ') ELSE coalesce(body, '') END"
_LINKS = "links AS (SELECT node_id, doc_key, instrument, href FROM (SELECT node_id, doc_key, instrument, unnest(list_transform(refs, lambda r: r.href)) AS href FROM content_nodes) WHERE href IS NOT NULL)"
_PAIRS = _LINKS + ", pairs AS (SELECT doc_key, lower(trim(regexp_extract(href, '^([^#?]*)', 1), ' ')) AS page, node_id AS pos FROM links WHERE lower(trim(regexp_extract(href, '^([^#?]*)', 1), ' ')) <> '')"
_COVERAGE = f"""WITH {_PAIRS},
u AS (SELECT DISTINCT instrument, route_prefix || '/' || target_kind || '/' || target_no AS page, target_kind FROM anchor_index WHERE anchor IS NULL),
e AS (SELECT page, CASE WHEN count(*) > 2 THEN 'stap' ELSE 'context' END AS disposition FROM pairs GROUP BY page),
m AS (SELECT u.*, e.disposition FROM u LEFT JOIN e USING (page))
"""
_CLIP = "CASE WHEN length(trim({c}, ' ')) <= {n} THEN trim({c}, ' ') ELSE substring(substring(trim({c}, ' '), 1, {n}), 1, CASE WHEN contains(substring(trim({c}, ' '), 1, {n}), ' ') THEN greatest({n} - instr(reverse(substring(trim({c}, ' '), 1, {n})), ' '), 120) ELSE 120 END) || '…' END"
_SQL_REFS = """WITH b AS (SELECT node_id AS row_id, '/' || instrument || '-rts' AS p, unnest(regexp_extract_all(body, '\\b(?:[Aa]rtikel [0-9]+(?:, lid [0-9]+)?|[Bb]ijlage [IVX]+|[Oo]verweging [0-9]+)')) AS x FROM content_nodes),
h AS (SELECT row_id, CASE WHEN lower(x) LIKE 'artikel%' THEN p || '/artikel/' || regexp_extract(x, '[0-9]+') || CASE WHEN x LIKE '%, lid %' THEN '#lid-' || regexp_extract(x, 'lid ([0-9]+)', 1) ELSE '' END
  WHEN lower(x) LIKE 'bijlage%' THEN p || '/bijlage/' || lower(regexp_extract(x, '[IVX]+$')) ELSE p || '/overweging/' || regexp_extract(x, '[0-9]+') END AS href FROM b)
SELECT row_id, href, count(*) AS n FROM h GROUP BY ALL"""

SQL = {
    "tree_flatten": f"SELECT doc_key, count(*) AS n_nodes, coalesce(string_agg(t, ' ' ORDER BY path, t) FILTER (t <> ''), '') AS flat_text FROM (SELECT doc_key, path, {_NODE_TEXT} AS t FROM content_nodes) GROUP BY doc_key",
    "tree_tables": "SELECT doc_key, array_to_string(path, '.') AS place, CAST(len(cells) AS INTEGER) AS n_rows, CAST(len(cells[1]) AS INTEGER) AS n_columns, array_to_string(list_concat(['| ' || array_to_string(cells[1], ' | ') || ' |', '|' || repeat(' --- |', len(cells[1]))], list_transform(cells[2:], lambda r: '| ' || array_to_string(r, ' | ') || ' |')), chr(10)) AS markdown FROM content_nodes WHERE node_type = 'table' AND cells IS NOT NULL",
    "anchor_counts": "SELECT doc_key, anchor, count(*) AS n FROM content_nodes WHERE anchor IS NOT NULL GROUP BY ALL",
    "unique_anchor": "SELECT doc_key, anchor FROM content_nodes WHERE anchor IS NOT NULL GROUP BY ALL HAVING count(*) = 1",
    "duplicate_ordinal": "SELECT doc_key, node_id, anchor, CASE WHEN n = 1 THEN anchor WHEN n = 2 THEN anchor || '-bis' ELSE anchor || '-bis-' || n END AS unique_anchor FROM (SELECT *, row_number() OVER (PARTITION BY doc_key, anchor ORDER BY node_id) AS n FROM content_nodes WHERE anchor IS NOT NULL)",
    "heading_carry_forward": "SELECT node_id, last_value(CASE WHEN node_type = 'heading' THEN body END IGNORE NULLS) OVER (PARTITION BY doc_key ORDER BY path, node_id ROWS UNBOUNDED PRECEDING) AS under_heading FROM content_nodes",
    "html_block_nodes": "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS pos, 'text' AS type, t AS text FROM (SELECT doc_id, k, trim(regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '\\( (\\*?[0-9]+) \\)', '(\\1)', 'g'), ' ') AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)) WHERE t <> ''",
    "ref_hrefs": _SQL_REFS,
    "ref_resolution": f"""WITH {_LINKS}, l AS (SELECT DISTINCT node_id, href, split_part(href, '#', 1) AS page, CASE WHEN contains(href, '#') THEN string_split(href, '#')[-1] END AS anchor FROM links),
i AS (SELECT route_prefix || '/' || target_kind || '/' || target_no AS page, anchor FROM anchor_index WHERE deleted_at IS NULL),
s AS (SELECT node_id, href, page, CASE WHEN page NOT IN (SELECT page FROM i) THEN 'missing' WHEN anchor IS NOT NULL AND (SELECT count(*) FROM i WHERE i.page = l.page AND i.anchor = l.anchor) <> 1 THEN 'stripped' ELSE 'linked' END AS state FROM l)
SELECT node_id, href, state, CASE state WHEN 'linked' THEN href WHEN 'stripped' THEN page END AS resolved_href FROM s""",
    "ref_counts": f"WITH {_LINKS} SELECT instrument, count(*) AS n_refs FROM links GROUP BY ROLLUP (instrument)",
    "ref_audit": f"WITH {_LINKS} SELECT href, count(*) AS n_refs, count(DISTINCT doc_key) AS n_documents, min(node_id) AS first_node FROM links GROUP BY href",
    "map_forward": f"WITH {_PAIRS}, f AS (SELECT doc_key, page, min(pos) AS p FROM pairs GROUP BY ALL) SELECT doc_key, list(page ORDER BY p, page) AS pages, count(*) AS n FROM f GROUP BY doc_key",
    "map_inverse": f"WITH {_PAIRS}, f AS (SELECT doc_key, page, min(pos) AS p FROM pairs GROUP BY ALL) SELECT page, list(doc_key ORDER BY p, doc_key) AS documents, count(*) AS n FROM f GROUP BY page",
    "map_inverse_consistency": f"""WITH {_PAIRS}, a AS (SELECT DISTINCT doc_key, page FROM pairs WHERE pos % 89 <> 0), b AS (SELECT DISTINCT doc_key, page FROM pairs WHERE pos % 97 <> 0)
SELECT *, 'inverse' AS missing_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'forward' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "map_reviewed": """WITH r AS (SELECT recital_id, paragraphs IS NOT NULL AS reviewed, flatten(list_transform(list_filter(paragraphs, lambda p: p.refs IS NOT NULL), lambda p: list_transform(p.refs, lambda r: r.href))) AS t FROM recitals),
x AS (SELECT recital_id, reviewed, unnest(CASE WHEN t IS NULL OR len(t) = 0 THEN [NULL] ELSE t END) AS target FROM r)
SELECT CASE WHEN target IS NOT NULL THEN 'mapped' WHEN reviewed THEN 'none_relevant' ELSE 'unreviewed' END AS state, count(*) AS n_rows, count(DISTINCT recital_id) AS n_recitals FROM x GROUP BY 1""",
    "related_articles": f"""WITH {_PAIRS}, b AS (SELECT '/' || instrument || '-rts/artikel/' || split_part(doc_key, ':', 3) AS page, body, row_number() OVER (PARTITION BY instrument, split_part(doc_key, ':', 3) ORDER BY path, node_id) AS k FROM content_nodes WHERE node_type = 'text' AND body IS NOT NULL)
SELECT DISTINCT page, doc_key, {_CLIP.format(c='body', n=100)} AS opening FROM pairs JOIN b USING (page) WHERE k = 1""",
    "split_routes": f"""WITH {_PAIRS}, a AS (SELECT DISTINCT instrument AS act, route_prefix FROM anchor_index), p AS (SELECT DISTINCT page FROM pairs),
x AS (SELECT page, act, route_prefix, row_number() OVER (PARTITION BY page ORDER BY length(route_prefix) DESC) AS k FROM p JOIN a ON page = route_prefix OR starts_with(page, route_prefix || '/'))
SELECT p.page, coalesce(act, 'hoofdakte') AS act, CASE WHEN act IS NULL THEN p.page WHEN p.page = route_prefix THEN '/' ELSE substring(p.page, length(route_prefix) + 1) END AS local_path FROM p LEFT JOIN x ON x.page = p.page AND k = 1""",
    "coverage_matrix": _COVERAGE + "SELECT instrument, page, disposition, disposition IS NOT NULL AS covered FROM m",
    "coverage_summary": _COVERAGE + "SELECT instrument, count(*) AS universe, count(disposition) AS covered, count(*) FILTER (disposition = 'stap') AS steps, count(*) FILTER (disposition <> 'stap') AS context, count(*) FILTER (disposition IS NULL) AS open FROM m GROUP BY instrument",
    "disposition_histogram": _COVERAGE + "SELECT coalesce(disposition, 'open') AS disposition, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM m GROUP BY 1",
    "toc_nested": """WITH s AS (SELECT instrument, chapter, chapter_title, section_roman, min(article_no) AS f, count(*) AS n FROM articles GROUP BY ALL),
a AS (SELECT a.*, s.f FROM articles a JOIN s ON a.instrument = s.instrument AND a.chapter IS NOT DISTINCT FROM s.chapter AND a.chapter_title IS NOT DISTINCT FROM s.chapter_title AND a.section_roman IS NOT DISTINCT FROM s.section_roman)
SELECT instrument, chapter, chapter_title, count(*) AS n_articles, CAST(count(DISTINCT coalesce(section_roman, '~')) AS INTEGER) AS n_sections, string_agg(CAST(article_no AS VARCHAR), ',' ORDER BY f, section_roman NULLS FIRST, article_no) AS article_nos FROM a GROUP BY instrument, chapter, chapter_title""",
    "article_ranges": "SELECT instrument, chapter, min(article_no) AS first_no, max(article_no) AS last_no, count(*) AS n_articles, CASE WHEN count(*) > 1 THEN 'Artikelen ' || min(article_no) || ' tot en met ' || max(article_no) ELSE 'Artikel ' || min(article_no) END AS range_text FROM articles GROUP BY instrument, chapter",
    "neighbours_position": "SELECT instrument, article_no, article_id, lag(article_id) OVER w AS previous, lead(article_id) OVER w AS next FROM articles WINDOW w AS (PARTITION BY instrument ORDER BY article_no, article_id)",
    "neighbours_number": "WITH n AS (SELECT DISTINCT instrument, recital_no FROM recitals) SELECT r.recital_id, r.instrument, r.recital_no, a.recital_no AS previous, b.recital_no AS next FROM recitals r LEFT JOIN n a ON a.instrument = r.instrument AND a.recital_no = r.recital_no - 1 LEFT JOIN n b ON b.instrument = r.instrument AND b.recital_no = r.recital_no + 1",
    "priority_buckets": "SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderpriority ELSE 'overig' END AS bucket, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS bucket_no, count(*) AS n FROM orders GROUP BY 1, 2",
    "progress_pct_half_up": "SELECT register_id, CAST(sum(d) AS BIGINT) AS done, CAST(sum(t) AS BIGINT) AS total, CASE WHEN sum(t) > 0 THEN CAST(floor(100.0::DOUBLE * sum(d) / sum(t) + 0.5) AS BIGINT) ELSE 0 END AS pct FROM (SELECT register_id, len(list_filter(map_values(answers), lambda v: coalesce(v, '') <> '')) AS d, cardinality(answers) AS t FROM arrangements WHERE answers IS NOT NULL) GROUP BY register_id",
    "bulk_patch": "WITH c AS (SELECT DISTINCT column_code AS code FROM closed_lists) SELECT CASE WHEN code IN (SELECT code FROM c) THEN 'Gesloten lijst' ELSE soort END AS soort, count(*) AS n FROM roi_columns GROUP BY 1 UNION ALL SELECT 'unknown ' || code, 1 FROM c WHERE code NOT IN (SELECT code FROM roi_columns WHERE code IS NOT NULL)",
    "orphans": f"WITH {_PAIRS} SELECT DISTINCT lower(route_prefix || '/' || target_kind || '/' || target_no) AS page, target_kind FROM anchor_index WHERE lower(route_prefix || '/' || target_kind || '/' || target_no) NOT IN (SELECT page FROM pairs)",
    "referential_integrity": f"""WITH {_PAIRS} SELECT 'lineitem_orders' AS check_name, count(*) AS n_violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orders_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'customer_nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'nodes_index', count(*) FROM content_nodes WHERE instrument NOT IN (SELECT instrument FROM anchor_index) UNION ALL SELECT 'articles_index', count(*) FROM articles WHERE instrument NOT IN (SELECT instrument FROM anchor_index)
UNION ALL SELECT 'pages_index', count(*) FROM pairs WHERE page NOT IN (SELECT lower(route_prefix || '/' || target_kind || '/' || target_no) FROM anchor_index)""",
    "keyset_equality": f"""WITH {_PAIRS}, i AS (SELECT DISTINCT lower(route_prefix || '/' || target_kind || '/' || target_no) AS page FROM anchor_index), c AS (SELECT DISTINCT page FROM pairs)
SELECT page, 'left' AS only_in FROM c WHERE page NOT IN (SELECT page FROM i) UNION ALL SELECT page, 'right' FROM i WHERE page NOT IN (SELECT page FROM c)""",
    "item_anchor_check": """WITH p AS (SELECT doc_key, path[1] AS top, anchor AS prefix FROM content_nodes WHERE node_type = 'paragraph'), i AS (SELECT c.doc_key, c.anchor, prefix, trim(regexp_replace(lower(marker), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM content_nodes c LEFT JOIN p ON p.doc_key = c.doc_key AND p.top = c.path[1] WHERE node_type = 'item' AND depth = 3)
SELECT doc_key, count(*) AS n_items FROM i WHERE (CASE WHEN s <> '' THEN coalesce(prefix, 'punt') || '-' || s END) IS DISTINCT FROM anchor GROUP BY 1""",
    "forward_ordering": """WITH n AS (SELECT *, doc_key || '|' || array_to_string(path, '.') AS place FROM content_nodes), p AS (SELECT place, min(node_id) AS node_id FROM n GROUP BY 1),
d AS (SELECT DISTINCT place, doc_key || '|' || array_to_string(path[:len(path) - CASE WHEN node_type = 'item' THEN 2 ELSE 1 END], '.') AS above FROM n WHERE depth > 1)
SELECT count(*) AS n_backward FROM d JOIN p USING (place) LEFT JOIN p q ON q.place = d.above WHERE q.node_id IS NULL OR q.node_id >= p.node_id""",
    "html_list_items_chunks": f"""WITH n AS (SELECT *, {_NODE_TEXT} AS t, CASE WHEN node_type IN ('heading', 'table', 'item') THEN node_type ELSE 'text' END AS kind, count(*) OVER (PARTITION BY doc_key, anchor) AS same FROM content_nodes),
m AS (SELECT *, lag(kind) OVER w AS bk, lag(depth) OVER w AS bd FROM n WINDOW w AS (PARTITION BY doc_key ORDER BY path, node_id)),
b AS (SELECT *, coalesce(node_type IN ('heading', 'table', 'figure') OR (node_type = 'item' AND depth = 3) OR (depth <= 2 AND bd > 2) OR bk IN ('table', 'heading'), true) OR bk IS NULL AS begins FROM m),
c AS (SELECT *, sum(begins::INT) OVER w AS k, last_value(CASE WHEN node_type = 'heading' THEN body END IGNORE NULLS) OVER w AS h FROM b WINDOW w AS (PARTITION BY doc_key ORDER BY path, node_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT doc_key, k, first(kind ORDER BY path, node_id) AS kind, first(CASE WHEN same = 1 THEN anchor END ORDER BY path, node_id) AS anchor, first(h ORDER BY path, node_id) AS heading, coalesce(string_agg(t, ' ' ORDER BY path, node_id) FILTER (t <> ''), '') AS chunk_text FROM c GROUP BY doc_key, k)
SELECT doc_key, CAST(row_number() OVER (PARTITION BY doc_key ORDER BY k) AS INTEGER) AS chunk_no, heading, kind, anchor, chunk_text FROM g WHERE kind <> 'heading' AND chunk_text <> ''""",
    "previews": f"""WITH {_LINKS}, w AS (SELECT DISTINCT href, split_part(href, '#', 1) AS page, CASE WHEN contains(href, '#') THEN string_split(href, '#')[-1] END AS fragment FROM links),
f AS (SELECT doc_key, path[1] AS pos, arg_min(body, (path, node_id)) AS body FROM content_nodes WHERE node_type = 'text' AND depth = 2 AND body IS NOT NULL GROUP BY ALL),
h AS (SELECT doc_key, instrument, path[1] AS pos, min(anchor) AS anchor FROM content_nodes WHERE node_type = 'paragraph' GROUP BY ALL),
r AS (SELECT instrument, recital_no, arg_max(paragraphs, recital_id) AS p FROM recitals WHERE paragraphs IS NOT NULL GROUP BY ALL),
p AS (SELECT '/' || instrument || '-rts/artikel/' || split_part(doc_key, ':', 3) AS page, pos, anchor, 'Artikel ' || split_part(doc_key, ':', 3) AS title, regexp_extract(anchor, 'lid-([0-9]+)', 1) AS para_no, body FROM h JOIN f USING (doc_key, pos)
  UNION ALL SELECT '/' || instrument || '-rts/overweging/' || recital_no, k, NULL, 'Overweging ' || recital_no, '', x.body FROM (SELECT instrument, recital_no, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS k FROM r)
  UNION ALL SELECT DISTINCT route_prefix || '/bijlage/' || target_no, 1, NULL, 'Bijlage ' || upper(target_no), '', 'Bijlage bij ' || instrument FROM anchor_index WHERE target_kind = 'bijlage' AND anchor IS NULL),
j AS (SELECT href, p.*, coalesce(fragment = anchor OR starts_with(fragment, anchor || '-'), false) AS hit FROM w JOIN p USING (page)),
b AS (SELECT *, row_number() OVER (PARTITION BY href ORDER BY hit DESC, pos) AS k FROM j)
SELECT href, title || CASE WHEN hit AND para_no IS NOT NULL THEN ', lid ' || para_no ELSE '' END AS title, {_CLIP.format(c='body', n=200)} AS snippet FROM b WHERE k = 1""",
    "contiguous_numbering": "SELECT instrument, article_no, CAST(k AS INTEGER) AS expected FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY article_no) AS k FROM (SELECT DISTINCT instrument, article_no FROM articles)) WHERE article_no IS DISTINCT FROM k",
    "repeated_keys": "SELECT arrangement_id, count(*) AS n_rows FROM arrangements GROUP BY 1 HAVING count(*) > 1",
    "domain_checks": """SELECT 'soort' AS check_name, count(*) AS n_violations FROM roi_columns WHERE soort NOT IN ('Alfanumeriek', 'Datum', 'Land', 'Monetair', 'Gesloten lijst') UNION ALL SELECT 'mandatory_raw', count(*) FROM roi_columns WHERE mandatory_raw NOT IN ('Verplicht', 'Facultatief')
UNION ALL SELECT 'lang', count(*) FROM content_nodes WHERE lang NOT IN ('nl', 'de', 'fr', 'en') UNION ALL SELECT 'node_type', count(*) FROM content_nodes WHERE node_type NOT IN ('heading', 'paragraph', 'text', 'item', 'table', 'figure')""",
    "count_pins": "SELECT coalesce(c.k, p.k) AS target_kind, coalesce(n, 0) AS n, coalesce(pin, 0) AS pin FROM (SELECT target_kind AS k, count(*) AS n FROM anchor_index GROUP BY 1) c FULL JOIN (VALUES ('artikel', 100::BIGINT), ('bijlage', 100), ('hoofdstuk', 7)) p(k, pin) ON c.k = p.k WHERE coalesce(n, 0) <> coalesce(pin, 0)",
    "determinism": f"WITH {_PAIRS} SELECT 'whole' AS run, CAST(0 AS BIGINT) AS n_different UNION ALL SELECT 'without some acts', count(DISTINCT doc_key) FROM pairs WHERE length(split_part(doc_key, ':', 1)) % 2 <> 0",
    "contents_exact_cover": """WITH l AS (SELECT instrument, article_no + CASE WHEN article_id % 13 = 0 THEN 1000 ELSE 0 END AS article_no FROM articles WHERE article_id % 7 <> 0 UNION ALL SELECT instrument, article_no + CASE WHEN article_id % 13 = 0 THEN 1000 ELSE 0 END FROM articles WHERE article_id % 11 = 0),
c AS (SELECT instrument, article_no, count(*) AS n FROM l GROUP BY ALL), t AS (SELECT DISTINCT instrument, article_no, true AS yes FROM articles)
SELECT instrument, article_no, coalesce(yes, false) AS is_thing, coalesce(n, 0) AS n_listed FROM t FULL JOIN c USING (instrument, article_no) WHERE yes IS NULL OR coalesce(n, 0) <> 1""",
    "conditional_lists": "WITH f AS (SELECT article_id, coalesce(len(list_filter(paragraphs, lambda p: p.para_no IS NOT NULL)) = 0, true) AS flat FROM articles) SELECT article_id, CASE WHEN flat THEN 'not listed' ELSE 'does not meet' END AS problem FROM f WHERE flat <> (article_id % 5 = 0)",
    "substring_pins": "SELECT article_id, phrase, contains(title, phrase) AS found FROM articles JOIN (VALUES (1, 'uitwijk'), (2, 'logboek'), (3, 'onvindbaar'), (4, 'e')) p(id, phrase) ON id = article_id WHERE NOT coalesce(contains(title, phrase), false)",
    "two_regime_pins": """WITH c AS (SELECT node_type, count(*) AS n FROM content_nodes GROUP BY 1), j AS (SELECT node_type, coalesce(n, 0) AS n, coalesce(pin, 0) AS pin FROM c FULL JOIN (VALUES ('table', 5::BIGINT), ('item', 100000000), ('figure', 0), ('sectie', 3)) p(node_type, pin) USING (node_type))
SELECT *, 'complete' AS regime FROM j WHERE n <> pin UNION ALL SELECT *, 'incomplete' FROM j WHERE n > pin""",
    "clip_openings": f"SELECT recital_id, {_CLIP.format(c='paragraphs[1].body', n=100)} AS opening FROM recitals",
}
