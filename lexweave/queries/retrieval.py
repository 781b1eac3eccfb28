"""Queries of the text functions and of full-text retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.operators import search as S
from lexweave.sources.tables import heavy_table, shared_dir, table

QUERY = "exitstrategie van het testverslag"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_table(spark, sf_dir, "documents", "doc_id", F.col("title").alias("heading"), "text", "source", "lang")


def _index(spark: SparkSession, sf_dir: str) -> S.Index:
    return S.build_index(_docs(spark, sf_dir))


_saved: dict[tuple, str] = {}


def saved_index(spark: SparkSession, sf_dir: str, name: str, docs, kind: str = "") -> S.Index:
    """The stored index over the tables of a folder: built by the first query of a session, loaded by all others.

    A table that was written anew since has an index of its own.
    """
    stamp = table(spark, sf_dir, name).select(F.max("_metadata.file_modification_time").alias("t"), F.max("_metadata.file_size").alias("n")).first()
    key = (spark.sparkContext.applicationId, sf_dir, name, kind, stamp["t"], stamp["n"])
    if key not in _saved:
        path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        S.build_index(docs(spark, sf_dir)).save(path)
        _saved[key] = path
    return S.Index.load(spark, _saved[key])


def text_clean(spark, sf_dir):
    """White space, no-break spaces and bracketed numbers cleaned."""
    return table(spark, sf_dir, "documents").select("doc_id", X.clean(F.concat(F.col("text"), F.lit(" ( 1 ) x "))).alias("cleaned"))


def text_fold_tokens(spark, sf_dir):
    """Tokens of each document, folded."""
    return heavy_table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def slug(spark, sf_dir):
    """Slugs of article titles and list markers."""
    a = table(spark, sf_dir, "articles").select(F.col("article_id").alias("row_id"), X.slug(F.col("title")).alias("slug"))
    return a.unionByName(table(spark, sf_dir, "content_nodes").filter("marker IS NOT NULL").select(F.col("node_id").alias("row_id"), X.slug(F.col("marker")).alias("slug")))


def clip_snippet(spark, sf_dir):
    """Texts clipped at a blank."""
    return table(spark, sf_dir, "documents").select("doc_id", X.clip(F.col("text")).alias("clipped"))


def highlight_terms(spark, sf_dir):
    """Query terms marked in titles."""
    return table(spark, sf_dir, "documents").filter("title IS NOT NULL").select("doc_id", X.highlight(F.col("title"), ["lijst", "de", "register", "x"]).alias("marked"))


def roman_numbers(spark, sf_dir):
    """Chapter numerals as numbers and back."""
    n = X.from_roman(F.col("chapter"))
    return table(spark, sf_dir, "articles").select("article_id", n.alias("chapter_no"), X.to_roman(n).alias("chapter_again"))


def csv_encode(spark, sf_dir):
    """Register columns as CSV lines."""
    return table(spark, sf_dir, "roi_columns").select("col_row", X.csv_line(F.col("code"), F.col("label"), F.col("instruction"), F.col("mandatory_raw")).alias("line"))


def tsv_encode(spark, sf_dir):
    """Documents' titles and first characters as TSV lines."""
    return table(spark, sf_dir, "documents").select("doc_id", X.tsv_line(F.col("title"), F.col("text")).alias("line"))


def search_postings(spark, sf_dir):
    """The inverted index."""
    return _index(spark, sf_dir).postings.drop("size")


def search_vocabulary(spark, sf_dir):
    """Document frequency of every term and the length of every field."""
    return _index(spark, sf_dir).vocabulary


def search_field_lengths(spark, sf_dir):
    """Documents, terms and mean length per field."""
    return _index(spark, sf_dir).lengths.groupBy("field").agg(F.count("*").alias("n_docs"), F.sum("size").alias("n_terms"), F.round(F.avg("size"), 6).alias("mean_size"))


def _hits(spark, sf_dir, query, limit=20, options=None):
    return S.search(saved_index(spark, sf_dir, "documents", _docs), query, limit, options or S.Options(prefix_from=None, fuzzy_from=None, synonyms=()))


def search_bm25_topk(spark, sf_dir):
    """Best documents for a query: exact terms, coverage, score, id."""
    return _hits(spark, sf_dir, QUERY).select("doc_id", "coverage", "score")


def search_coverage_rank(spark, sf_dir):
    """Documents per number of query terms covered."""
    scored = S.scored(saved_index(spark, sf_dir, "documents", _docs), QUERY, S.Options(prefix_from=None, fuzzy_from=None, synonyms=()))
    return scored.groupBy("coverage").agg(F.count("*").alias("n_docs"), F.max("score").alias("best_score"))


def search_prefix_expand(spark, sf_dir):
    """Vocabulary terms a prefix reaches."""
    return S.expand(_index(spark, sf_dir).vocabulary, "onder test", S.Options(fuzzy_from=None, synonyms=(), prefix_from=4)).select("term", "query_group", F.round("weight", 6).alias("weight"))


def search_fuzzy_expand(spark, sf_dir):
    """Vocabulary terms within the edit budget."""
    return S.expand(_index(spark, sf_dir).vocabulary, "exitstrategei overeenkomstn", S.Options(prefix_from=None, synonyms=())).select("term", "query_group", F.round("weight", 6).alias("weight"))


def search_synonym_expand(spark, sf_dir):
    """Vocabulary terms a query term's group reaches."""
    return S.expand(_index(spark, sf_dir).vocabulary, "informatieregister keten", S.Options(prefix_from=None, fuzzy_from=None)).select("term", "query_group", "weight")


def search_multi_field_boost(spark, sf_dir):
    """Headings weigh more than texts."""
    return _hits(spark, sf_dir, "lijst kritieke diensten", options=S.Options(boosts={"heading": 5.0, "text": 1.0}, prefix_from=None, fuzzy_from=None, synonyms=())).select("doc_id", "coverage", "score")


def search_typeahead(spark, sf_dir):
    """The typeahead preset: prefixes, edit distance and synonyms together."""
    return _hits(spark, sf_dir, "exitstrategi regist", 24, S.TYPEAHEAD).select("doc_id", "coverage", "score")


def search_precision(spark, sf_dir):
    """The precision preset: long prefixes only."""
    return _hits(spark, sf_dir, "uitbesteding keten", 10, S.PRECISION).select("doc_id", "coverage", "score")


def _provisions(spark, sf_dir):
    """Paragraphs of articles as search documents with readable ids."""
    a = table(spark, sf_dir, "content_nodes").filter("body IS NOT NULL AND node_type = 'text'")
    parts = F.split("doc_key", ":")
    first = F.row_number().over(S.Window.partitionBy("doc_key").orderBy("path", "node_id"))
    kind = F.when(parts[1] == "rct", "rct").otherwise(parts[1])
    return a.select(F.concat(F.lit("hoofdakte-"), kind, F.lit("-"), parts[2], F.lit("-"), first.cast("string"), F.lit("-"), parts[0]).alias("doc_id"), F.lit("").alias("heading"), F.col("body").alias("text"))


def search_pinned_reference(spark, sf_dir):
    """A direct reference puts the provisions it names first."""
    hits = S.search(saved_index(spark, sf_dir, "content_nodes", _provisions), "artikel 4", 15, S.Options(prefix_from=None, fuzzy_from=None, synonyms=()))
    return hits.select("doc_id", "pinned", "coverage", "score")


def search_filter_after_limit(spark, sf_dir):
    """The language filter acts on the candidates found."""
    docs = _docs(spark, sf_dir)
    return S.filtered_after_limit(_hits(spark, sf_dir, QUERY, 50), docs.select("doc_id", "lang"), F.col("lang") == "nl").select("doc_id", "coverage", "score")


def hits_grouped_by_type(spark, sf_dir):
    """Hits listed per source."""
    return S.grouped_hits(_hits(spark, sf_dir, QUERY, 50), _docs(spark, sf_dir), "source")


def snippet_best_window(spark, sf_dir):
    """The place of the best window of every document that matches."""
    return S.best_window(_docs(spark, sf_dir), ["exitstrategie", "testverslag", "register"])


def snippet_text(spark, sf_dir):
    """The snippets of the best hits."""
    hits = _hits(spark, sf_dir, QUERY)
    return hits.join(_docs(spark, sf_dir), "doc_id").select("doc_id", S.quoted(F.col("text"), ["exitstrategie", "testverslag"]).alias("snippet"))


#: queries whose ranks are pinned: names of things, several terms, terms of both fields, references, one that finds nothing
GOLDEN = dict(
    enumerate(
        (
            "exitstrategie", "uitwijkplan", "testverslag", "logboek van storingen", "register van overeenkomsten", "kritieke diensten", "back-upkopieen", "toegangsrechten herzien", "drempelwaarden", "herstelprocedure documenteren",
            "continuiteit", "evenredigheid", "risicoanalyse", "penetratieproef uitkomsten", "meldformulier", "langdurige uitval scenario", "contractuele waarborgen", "ketenoverzicht", "bedrijfsmiddelen geinventariseerde", "indeling storing",
            "exit strategy", "outage log", "chain overview", "test report", "access rights", "backup copies", "thresholds", "Ausweichplan", "Zugriffsrechte", "Kettenubersicht",
            "rapport d'essai", "droits d'acces", "sous-traitant", "toezichthouder schriftelijk", "kosten vermeld drempel euro", "zzzonbestaand",
        )
    )
)
_EXACT = S.Options(prefix_from=None, fuzzy_from=None, synonyms=())


def search_golden(spark, sf_dir):
    """The first three documents of 36 pinned queries, all in one pass over the index."""
    hits = S.search_many(saved_index(spark, sf_dir, "documents", _docs), GOLDEN, 3, _EXACT)
    return hits.select("query_id", "rank", "doc_id", "coverage", "score")


def search_golden_provisions(spark, sf_dir):
    """The first five provisions of pinned references to articles, one of them to none."""
    queries = {1: "artikel 1", 2: "Artikel 12", 3: "artikel 3, lid 2", 4: "artikel 4", 5: "artikel 7 exitstrategie"}
    hits = S.search_many(saved_index(spark, sf_dir, "content_nodes", _provisions), queries, 5, _EXACT)
    return hits.select("query_id", "rank", "doc_id", "pinned", "coverage", "score")


def search_saved_index(spark, sf_dir):
    """An index written and loaded again: terms, postings and documents per field."""
    index = saved_index(spark, sf_dir, "documents", _docs)
    per_field = index.postings.groupBy("field").agg(F.count("*").alias("n_postings"), F.count_distinct("term").alias("n_terms"), F.sum("tf").alias("n_words"))
    return per_field.join(index.means(), "field").select("field", "n_postings", "n_terms", "n_words", "n_docs", F.round("mean_size", 6).alias("mean_size"))


def search_reference_patterns(spark, sf_dir):
    """Documents that references name by their whole id or by its start, instruments before articles."""
    queries = ("artikel 28 lid 3", "Overweging 58", "artikel 5", "its artikel 2", "rts bijlage iii punt a", "bijlage iv", "its overweging 7", "artikel", "artikel 5 exit", "its-rts artikel 2")
    rows = [(q, *(S.reference_pattern(q, ("its", "rts", "its-rts"), "hoofdakte") or (None, None))) for q in queries]
    return spark.createDataFrame(rows, "query string, named string, whole boolean")


QUERIES = {
    f.__name__: f
    for f in (
        search_bm25_topk, text_clean, text_fold_tokens, slug, clip_snippet, highlight_terms, roman_numbers, csv_encode, tsv_encode, search_postings, search_vocabulary, search_field_lengths,
        search_coverage_rank, search_prefix_expand, search_fuzzy_expand, search_synonym_expand, search_multi_field_boost, search_typeahead, search_precision, search_pinned_reference,
        search_golden, search_golden_provisions, search_saved_index, search_reference_patterns, search_filter_after_limit, hits_grouped_by_type, snippet_best_window, snippet_text,
    )
}

_FOLD = f"translate(lower({{c}}), '{X.FOLD_FROM}', '{X.FOLD_TO}')"
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_KEEP = f"term NOT IN ({_STOP}) AND (length(term) > 1 OR regexp_full_match(term, '[0-9]'))"


def _sql_index(docs: str) -> str:
    return f"""
WITH docs AS ({docs}),
f AS (SELECT doc_id, 'heading' AS field, coalesce(heading, '') AS body FROM docs UNION ALL SELECT doc_id, 'text', coalesce(text, '') FROM docs),
w AS (SELECT doc_id, field, unnest(regexp_split_to_array({_FOLD.format(c="body")}, '[^\\p{{L}}\\p{{N}}]+')) AS term FROM f),
t AS (SELECT * FROM w WHERE term <> '' AND {_KEEP}),
postings AS (SELECT term, field, doc_id, count(*) AS tf FROM t GROUP BY ALL),
vocabulary AS (SELECT term, count(DISTINCT doc_id) AS df FROM postings GROUP BY term),
lengths AS (SELECT f.doc_id, f.field, count(t.term) AS size FROM (SELECT DISTINCT doc_id, field FROM f) f LEFT JOIN t USING (doc_id, field) GROUP BY ALL),
means AS (SELECT field, avg(size) AS mean_size, count(*) AS n_docs FROM lengths GROUP BY field)
"""


_DOCS = "SELECT doc_id, title AS heading, text, source, lang FROM documents"


def _sql_scored(docs: str, terms: dict[str, int], heading: float = 3.0) -> str:
    wanted = ", ".join(f"('{t}', {g})" for t, g in terms.items())
    return _sql_index(docs) + f""",
q AS (SELECT * FROM (VALUES {wanted}) AS v(term, query_group)),
hits AS (SELECT p.*, query_group FROM postings p JOIN q USING (term)),
dfs AS (SELECT term, field, count(DISTINCT doc_id) AS field_df FROM hits GROUP BY ALL),
scored AS (SELECT doc_id, count(DISTINCT query_group) AS coverage,
  round(sum(CASE field WHEN 'heading' THEN {heading} ELSE 1.0::DOUBLE END * ln(1 + (n_docs - field_df + 0.5::DOUBLE) / (field_df + 0.5::DOUBLE)) * (0.5::DOUBLE + tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * size / mean_size)))), 6) AS score
  FROM hits JOIN dfs USING (term, field) JOIN lengths USING (doc_id, field) JOIN means USING (field) GROUP BY doc_id)
"""


def _sql_expanded(conditions: list[tuple[int, str, str]], heading: float) -> str:
    """SQL: scores of a query whose terms were expanded, each term with its best weight per group."""
    parts = " UNION ALL ".join(f"SELECT term, {g} AS query_group, {w} AS weight FROM vocabulary WHERE {c}" for g, c, w in conditions)
    return _sql_index(_DOCS) + f""",
q AS (SELECT term, query_group, max(weight) AS weight FROM ({parts}) GROUP BY ALL),
freq AS (SELECT term, field, count(*) AS field_df FROM postings GROUP BY ALL),
scored AS (SELECT doc_id, count(DISTINCT query_group) AS coverage,
  round(sum(weight * CASE field WHEN 'heading' THEN {heading} ELSE 1.0::DOUBLE END * ln(1 + (n_docs - field_df + 0.5::DOUBLE) / (field_df + 0.5::DOUBLE)) * (0.5::DOUBLE + tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * size / mean_size)))), 6) AS score
  FROM postings JOIN q USING (term) JOIN freq USING (term, field) JOIN lengths USING (doc_id, field) JOIN means USING (field) GROUP BY doc_id)
"""


_TERMS = {t: g for t, g in S.term_groups(QUERY, S.Options(synonyms=())).items()}
_BEST = "ORDER BY coverage DESC, score DESC, doc_id"


def _sql_expand(conditions: list[tuple[int, str, str]]) -> str:
    parts = " UNION ALL ".join(f"SELECT term, {g} AS query_group, {w} AS weight FROM vocabulary WHERE {c}" for g, c, w in conditions)
    return _sql_index(_DOCS) + f"SELECT term, query_group, round(max(weight), 6) AS weight FROM ({parts}) GROUP BY ALL"


def _prefix(g: int, t: str) -> tuple[int, str, str]:
    return g, f"starts_with(term, '{t}')", f"CASE WHEN term = '{t}' THEN 1.0::DOUBLE ELSE 0.375::DOUBLE * {len(t)} / ({len(t)} + 0.3::DOUBLE * (length(term) - {len(t)})) END"


def _near(g: int, t: str) -> tuple[int, str, str]:
    k = max(1, round(0.2 * len(t)))
    return g, f"levenshtein(term, '{t}') <= {k}", f"CASE WHEN term = '{t}' THEN 1.0::DOUBLE ELSE 0.45::DOUBLE * {len(t)} / ({len(t)} + levenshtein(term, '{t}')) END"


def _exact(g: int, t: str) -> tuple[int, str, str]:
    return g, f"term = '{t}'", "1.0::DOUBLE"


_PROVISIONS = """SELECT 'hoofdakte-' || split_part(doc_key, ':', 2) || '-' || split_part(doc_key, ':', 3) || '-' || CAST(row_number() OVER (PARTITION BY doc_key ORDER BY path, node_id) AS VARCHAR) || '-' || split_part(doc_key, ':', 1) AS doc_id, '' AS heading, body AS text
FROM content_nodes WHERE body IS NOT NULL AND node_type = 'text'"""
_CELL = "CASE WHEN regexp_matches(coalesce({c}, ''), '[\",\\n;]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE coalesce({c}, '') END"
_SPOT = "SELECT doc_id, unnest(list_filter(range(0, length(f)), lambda i: substring(f, i + 1, {n}) = '{t}')) AS position, '{t}' AS term FROM d"

SQL = {
    "text_clean": "SELECT doc_id, trim(regexp_replace(regexp_replace(text || ' ( 1 )' || chr(160) || 'x ', '[\\s\\x{00A0}]+', ' ', 'g'), '\\( ([0-9]+) \\)', '(\\1)', 'g')) AS cleaned FROM documents",
    "text_fold_tokens": f"SELECT doc_id, term AS token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array({_FOLD.format(c='text')}, '[^\\p{{L}}\\p{{N}}]+')) AS term FROM documents) WHERE term <> '' GROUP BY ALL",
    "slug": "SELECT row_id, regexp_replace(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM (SELECT article_id AS row_id, title AS s FROM articles UNION ALL SELECT node_id, marker FROM content_nodes WHERE marker IS NOT NULL)",
    "clip_snippet": "SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE substring(h, 1, CASE WHEN contains(h, ' ') THEN greatest(length(h) - instr(reverse(h), ' '), 120) ELSE 120 END) || '…' END AS clipped FROM (SELECT doc_id, trim(text, ' ') AS t, substring(trim(text, ' '), 1, 200) AS h FROM documents)",
    "highlight_terms": "SELECT doc_id, regexp_replace(title, '(?i)(register|lijst|de)', '<mark>\\1</mark>', 'g') AS marked FROM documents WHERE title IS NOT NULL",
    "csv_encode": f"SELECT col_row, {_CELL.format(c='code')} || ',' || {_CELL.format(c='label')} || ',' || {_CELL.format(c='instruction')} || ',' || {_CELL.format(c='mandatory_raw')} AS line FROM roi_columns",
    "tsv_encode": "SELECT doc_id, trim(regexp_replace(coalesce(title, ''), '[\\t\\r\\n]+', ' ', 'g'), ' ') || chr(9) || trim(regexp_replace(coalesce(text, ''), '[\\t\\r\\n]+', ' ', 'g'), ' ') AS line FROM documents",
    "search_postings": _sql_index(_DOCS) + "SELECT * FROM postings",
    "search_vocabulary": _sql_index(_DOCS) + "SELECT * FROM vocabulary",
    "search_field_lengths": _sql_index(_DOCS) + "SELECT field, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS n_terms, round(avg(size), 6) AS mean_size FROM lengths GROUP BY field",
    "search_bm25_topk": _sql_scored(_DOCS, _TERMS) + f"SELECT * FROM scored {_BEST} LIMIT 20",
    "search_coverage_rank": _sql_scored(_DOCS, _TERMS) + "SELECT coverage, count(*) AS n_docs, max(score) AS best_score FROM scored GROUP BY coverage",
    "search_prefix_expand": _sql_expand([_prefix(0, "onder"), _prefix(1, "test")]),
    "search_fuzzy_expand": _sql_expand([_near(0, "exitstrategei"), _near(1, "overeenkomstn")]),
    "search_synonym_expand": _sql_expand([_exact(g, t) for t, g in S.term_groups("informatieregister keten").items()]),
    "search_multi_field_boost": _sql_scored(_DOCS, {"lijst": 0, "kritieke": 1, "diensten": 2}, 5.0) + f"SELECT * FROM scored {_BEST} LIMIT 20",
    "search_typeahead": _sql_expanded([f(g, t) for g, t in enumerate(("exitstrategi", "regist")) for f in (_prefix, _near)], 3.0) + f"SELECT * FROM scored {_BEST} LIMIT 24",
    "search_precision": _sql_expanded([_prefix(g, t) if len(t) >= 5 else _exact(g, t) for t, g in S.term_groups("uitbesteding keten", S.PRECISION).items()], 2.0) + f"SELECT * FROM scored {_BEST} LIMIT 10",
    "search_pinned_reference": _sql_scored(_PROVISIONS, {"artikel": 0, "4": 1}) + "SELECT doc_id, starts_with(doc_id, 'hoofdakte-art-4-') AS pinned, coverage, score FROM scored ORDER BY pinned DESC, coverage DESC, score DESC, doc_id LIMIT 15",
    "search_filter_after_limit": _sql_scored(_DOCS, _TERMS) + f"SELECT s.* FROM (SELECT * FROM scored {_BEST} LIMIT 50) s JOIN docs USING (doc_id) WHERE lang = 'nl' {_BEST} LIMIT 10",
    "hits_grouped_by_type": _sql_scored(_DOCS, _TERMS) + f"SELECT source, count(*) AS n_hits, list(doc_id {_BEST}) AS doc_ids FROM (SELECT * FROM scored {_BEST} LIMIT 50) s JOIN docs USING (doc_id) GROUP BY source",
    "snippet_best_window": f"""WITH d AS (SELECT doc_id, {_FOLD.format(c='text')} AS f FROM documents),
s AS ({' UNION ALL '.join(_SPOT.format(t=t, n=len(t)) for t in ('exitstrategie', 'testverslag', 'register'))}),
r AS (SELECT a.doc_id, a.position, a.term, count(DISTINCT b.term) AS n_distinct, count(*) AS n_matches FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.position BETWEEN a.position AND a.position + 240 GROUP BY ALL)
SELECT doc_id, position, CAST(n_distinct AS INTEGER) AS n_distinct, n_matches FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_distinct DESC, n_matches DESC, position) AS k FROM r) WHERE k = 1""",
}


def _sql_many(docs: str, queries: dict[int, str]) -> str:
    """SQL: scores of several queries of whole terms."""
    wanted = ", ".join(f"({k}, '{t}', {g})" for k, q in queries.items() for t, g in S.term_groups(q, _EXACT).items())
    return _sql_index(docs) + f""",
q AS (SELECT * FROM (VALUES {wanted}) AS v(query_id, term, query_group)),
freq AS (SELECT term, field, count(*) AS field_df FROM postings GROUP BY ALL),
scored AS (SELECT query_id, doc_id, count(DISTINCT query_group) AS coverage,
  round(sum(CASE field WHEN 'heading' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END * ln(1 + (n_docs - field_df + 0.5::DOUBLE) / (field_df + 0.5::DOUBLE)) * (0.5::DOUBLE + tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * size / mean_size)))), 6) AS score
  FROM postings JOIN q USING (term) JOIN freq USING (term, field) JOIN lengths USING (doc_id, field) JOIN means USING (field) GROUP BY query_id, doc_id)
"""


SQL |= {
    "search_golden": _sql_many(_DOCS, GOLDEN) + "SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, score DESC, doc_id) AS INTEGER) AS rank, doc_id, coverage, score FROM scored) WHERE rank <= 3",
    "search_golden_provisions": _sql_many(_PROVISIONS, {1: "artikel 1", 2: "Artikel 12", 3: "artikel 3, lid 2", 4: "artikel 4", 5: "artikel 7 exitstrategie"}) + """,
p AS (SELECT *, CASE query_id WHEN 1 THEN starts_with(doc_id, 'hoofdakte-art-1-') WHEN 2 THEN starts_with(doc_id, 'hoofdakte-art-12-') WHEN 3 THEN doc_id = 'hoofdakte-art-3-lid-2' WHEN 4 THEN starts_with(doc_id, 'hoofdakte-art-4-') ELSE false END AS pinned FROM scored)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, coverage DESC, score DESC, doc_id) AS INTEGER) AS rank, doc_id, pinned, coverage, score FROM p) WHERE rank <= 5""",
    "search_saved_index": _sql_index(_DOCS) + "SELECT field, n_postings, n_terms, n_words, n_docs, round(mean_size, 6) AS mean_size FROM (SELECT field, count(*) AS n_postings, count(DISTINCT term) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_words FROM postings GROUP BY field) JOIN means USING (field)",
    "search_reference_patterns": """SELECT * FROM (VALUES ('artikel 28 lid 3', 'hoofdakte-art-28-lid-3', true), ('Overweging 58', 'hoofdakte-rct-58', true), ('artikel 5', 'hoofdakte-art-5-', false), ('its artikel 2', 'its-art-2-', false), ('rts bijlage iii punt a', 'rts-anx-iii-punt-a', true),
  ('bijlage iv', 'hoofdakte-anx-iv-', false), ('its overweging 7', 'its-rct-7', true), ('artikel', NULL, NULL), ('artikel 5 exit', NULL, NULL), ('its-rts artikel 2', 'its-rts-art-2-', false)) t(query, named, whole)""",
}
SQL["roman_numbers"] = """WITH r AS (SELECT n, ['', 'M', 'MM', 'MMM'][n // 1000 + 1] || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] AS sign FROM (SELECT unnest(range(1, 4000)) AS n))
SELECT article_id, CAST(n AS INTEGER) AS chapter_no, sign AS chapter_again FROM articles LEFT JOIN r ON sign = upper(trim(chapter, ' '))"""
_SNIPPET_TERMS = ("exitstrategie", "testverslag")
SQL["snippet_text"] = _sql_scored(_DOCS, _TERMS) + f""", h AS (SELECT doc_id, text FROM (SELECT * FROM scored {_BEST} LIMIT 20) s JOIN documents USING (doc_id)),
d AS (SELECT doc_id, text, {_FOLD.format(c='text')} AS f FROM h),
s AS ({' UNION ALL '.join(_SPOT.format(t=t, n=len(t)) for t in _SNIPPET_TERMS)}),
r AS (SELECT a.doc_id, a.position, a.term, count(DISTINCT b.term) AS n_distinct, count(*) AS n_matches FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.position BETWEEN a.position AND a.position + 240 GROUP BY ALL),
b AS (SELECT doc_id, greatest(position - 40, 0) AS st FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_distinct DESC, n_matches DESC, position) AS k FROM r) WHERE k = 1)
SELECT doc_id, CASE WHEN length(text) <= 600 THEN text WHEN st IS NULL THEN substring(text, 1, 400) || '…' ELSE CASE WHEN st > 0 THEN '…' ELSE '' END || trim(substring(text, st + 1, 400), E' \\n\\t\\r') || CASE WHEN st + 400 < length(text) THEN '…' ELSE '' END END AS snippet FROM d LEFT JOIN b USING (doc_id)""".replace("+ 240", "+ 400")
