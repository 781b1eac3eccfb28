"""Queries of the general training-data problems (1, 2, 5, 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import hierarchy as H
from lexweave.operators import nested as N
from lexweave.operators import orphans as O
from lexweave.operators import profile as P
from lexweave.sources.tables import heavy_table, table

CATEGORY_QUESTIONS = ("s2.1", "s3.1", "s4.2", "s5.1", "s9.1", "s11.1")


_FIELD_SOURCES = {"chain_rows": ("provider_code",), "arrangements": ("answers",), "roi_columns": ("mandatory",)}


def _answer_fields(answer) -> list[P.Field]:
    return [
        P.code_field("answers.s1.3", answer("s1.3")),
        P.date_field("answers.s1.6", answer("s1.6")),
        P.pattern_field("answers.s12.1", answer("s12.1"), r"\A[A-Z]{2}\z"),
        P.magnitude_field("answers.s7.2", answer("s7.2")),
        *[P.category_field(f"answers.{q}", answer(q)) for q in CATEGORY_QUESTIONS],
    ]


def _profiled() -> list[tuple[str, list[P.Field]]]:
    return [
        ("chain_rows", [P.code_field("provider_code", F.col("provider_code"))]),
        ("arrangements", _answer_fields(lambda q: F.col("answers").getItem(q))),
        ("roi_columns", [P.boolean_field("mandatory", F.col("mandatory"))]),
    ]


def _counts(spark: SparkSession, sf_dir: str, count, count_map=None) -> DataFrame:
    """Counts of the profiled fields; with ``count_map`` of every answer, not the declared ones only."""
    out = None
    for name, fields in _profiled():
        rows = heavy_table(spark, sf_dir, name, "load_no", *_FIELD_SOURCES[name])
        if count_map and name == "arrangements":
            part = count_map(rows, "load_no", "answers", "answers.", _answer_fields(lambda q: F.col("value")))
        else:
            part = count(rows, "load_no", fields)
        part = part.withColumn("field_name", F.concat(F.lit(f"{name}|"), F.col("field_name")))
        out = part if out is None else out.unionByName(part)
    return out


def _split_name(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "field_name"]
    return df.select(F.split_part("field_name", F.lit("|"), F.lit(1)).alias("table_name"), F.split_part("field_name", F.lit("|"), F.lit(2)).alias("field_name"), *rest)


def p1_found(spark: SparkSession, sf_dir: str, threshold: float = 0.2) -> DataFrame:
    """Loads whose class shares break with the next lower load."""
    breaks = P.drift(_counts(spark, sf_dir, P.class_counts)).filter(F.col("total_variation") > threshold)
    return _split_name(breaks).select("table_name", "field_name", "load_no")


def p1_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, blanks, exact distincts, ranges as text, as numbers and as days, and violations per field and load, for every answer id that occurs."""
    out = _split_name(P.profile(_counts(spark, sf_dir, P.value_counts, P.map_value_counts)))
    return out.select("table_name", "field_name", "load_no", "n_rows", "n_blank", "n_distinct", "min_value", "max_value", "min_number", "max_number", "min_day", "max_day", "n_violations", "top_count")


def p1_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total variation, chi-square and stability index of every load, for every answer id that occurs."""
    out = _split_name(P.drift(_counts(spark, sf_dir, P.class_counts, P.map_class_counts)))
    return out.select("table_name", "field_name", "load_no", "before_load", "degrees", *[F.round(c, 6).alias(c) for c in ("total_variation", "chi_square", "stability_index")])


def _nested(spark: SparkSession, sf_dir: str, with_body: bool = False) -> DataFrame:
    return N.nested_tables(table(spark, sf_dir, "arrangements"), heavy_table(spark, sf_dir, "articles", "article_id", "paragraphs"), heavy_table(spark, sf_dir, "questionnaires", "quest_id", "raw_json"), with_body)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nested object with its place and its parent's."""
    return _nested(spark, sf_dir).select("table_name", "record_id", "child_path", "parent_path")


def p2_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat child tables in one form; each with its own columns are ``p2_chain_links``, ``p2_list_items`` and ``p2_options``."""
    return _nested(spark, sf_dir, True).select(
        "table_name", "record_id", "child_path", "parent_path", "position", "schema_path",
        F.coalesce(F.get_json_object("body", "$.id"), F.get_json_object("body", "$.value"), F.get_json_object("body", "$.marker")).alias("own_key"),
        F.coalesce(F.get_json_object("body", "$.provider_code"), F.get_json_object("body", "$.label"), F.get_json_object("body", "$.anchor")).alias("own_text"),
    )


def p2_chain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of ``arrangements.chain``."""
    return N.own_columns(N.child_table(N.chain_elements(table(spark, sf_dir, "arrangements")), "arrangements", 1), N.CHAIN_FIELDS)


def p2_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of list items below ``articles.paragraphs.content``."""
    return N.own_columns(N.child_table(N.article_items(heavy_table(spark, sf_dir, "articles", "article_id", "paragraphs")), "articles", 2), N.ITEM_FIELDS)


def p2_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of options of ``questionnaires``."""
    return N.own_columns(N.child_table(N.questionnaire_options(heavy_table(spark, sf_dir, "questionnaires", "quest_id", "raw_json")), "questionnaires", 1), N.OPTION_FIELDS)


def p2_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, records and depth of each flat table (schema path)."""
    return _nested(spark, sf_dir).groupBy("table_name", "schema_path").agg(F.count("*").alias("n_rows"), F.max("depth").alias("max_depth"))


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = O.citations(table(spark, sf_dir, "content_nodes"), "content_nodes", "node_id", F.col("refs.href"), "cited_at")
    hrefs = F.flatten(F.transform(F.filter("paragraphs", lambda p: p["refs"].isNotNull()), lambda p: p["refs"]["href"]))
    return nodes.unionByName(O.citations(table(spark, sf_dir, "recitals"), "recitals", "recital_id", hrefs, "cited_at"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.orphans(_citations(spark, sf_dir), O.lives(table(spark, sf_dir, "anchor_index")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hrefs without a living target at the time of citing."""
    return _orphans(spark, sf_dir).select("table_name", "record_id", "href", "period")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table and month."""
    return O.orphan_counts(_orphans(spark, sf_dir))


def _tree(spark: SparkSession, sf_dir: str, with_path: bool) -> DataFrame:
    return H.hierarchy(table(spark, sf_dir, "chain_rows"), "contract_ref", "provider_code", "recipient_code", "chain_rank", ["loaded_at", "row_id"], with_path)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of each provider of each contract."""
    return _tree(spark, sf_dir, False).select(
        F.col("group_key").alias("contract_ref"), F.col("node").alias("node_code"), F.col("root").alias("root_code"), F.col("depth").alias("node_depth")
    )


def p6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full path from the root to each provider, with its rank beside its depth."""
    rank = F.expr("try_cast(regexp_extract(rank, '[0-9]+', 0) AS int)")
    return _tree(spark, sf_dir, True).select(
        F.col("group_key").alias("contract_ref"), F.col("node").alias("node_code"), F.array_join("path", ">").alias("full_path"), F.col("depth").alias("node_depth"), "on_loop",
        F.when(F.col("depth") < 0, "loop").when(rank.isNull(), "missing").when(rank == F.col("depth") + 1, "agrees").otherwise("differs").alias("rank_state"),
    )


def p6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every provider below every provider of a contract."""
    return H.ancestor_pairs(_tree(spark, sf_dir, True)).select(F.col("group_key").alias("contract_ref"), "ancestor", "descendant", "distance")


QUERIES = {f.__name__: f for f in (p1_found, p1_profile, p1_drift, p2_found, p2_children, p2_chain_links, p2_list_items, p2_options, p2_tables, p5_found, p5_counts, p6_found, p6_paths, p6_descendants)}

_LEI_DIGITS = "list_aggregate(list_transform(regexp_split_to_array({c}, ''), lambda x: CASE WHEN x BETWEEN 'A' AND 'Z' THEN CAST(ascii(x) - 55 AS VARCHAR) ELSE x END), 'string_agg', '')"


def _sql_code(c: str) -> str:
    lei = f"CASE WHEN regexp_full_match({c}, '[A-Z0-9]{{18}}[0-9]{{2}}') THEN CAST({_LEI_DIGITS.format(c=c)} AS HUGEINT) % 97 = 1 ELSE false END"
    return f"CASE WHEN {c} IS NULL OR regexp_full_match({c}, '\\s*') THEN 'blank' WHEN {lei} OR regexp_full_match({c}, '[A-Z]{{2}}[A-Z0-9]{{2,8}}\\.[A-Z0-9]{{4,12}}') THEN 'valid' ELSE 'other' END"


def _sql_class(kind: str, c: str) -> str:
    blank = f"WHEN {c} IS NULL OR regexp_full_match({c}, '\\s*') THEN 'blank'"
    if kind == "code":
        return _sql_code(c)
    if kind == "date":
        return f"CASE {blank} WHEN regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND TRY_CAST({c} AS DATE) IS NOT NULL THEN 'valid' ELSE 'other' END"
    if kind == "country":
        return f"CASE {blank} WHEN regexp_full_match({c}, '[A-Z]{{2}}') THEN 'valid' ELSE 'other' END"
    if kind == "amount":
        return f"CASE {blank} WHEN regexp_full_match({c}, '[0-9]+(\\.[0-9]+)?') THEN 'digits:' || CAST(length(split_part({c}, '.', 1)) AS VARCHAR) ELSE 'other' END"
    return f"CASE {blank} ELSE '=' || {c} END"


def _sql_values() -> str:
    kinds = {"s1.3": "code", "s1.6": "date", "s12.1": "country", "s7.2": "amount"} | {q: "category" for q in CATEGORY_QUESTIONS}
    parts = [f"SELECT 'chain_rows' AS table_name, 'provider_code' AS field_name, load_no, provider_code AS value, {_sql_code('provider_code')} AS cls, true AS formed FROM chain_rows"]
    for q, kind in kinds.items():
        c = f"answers['{q}']"
        parts.append(f"SELECT 'arrangements', 'answers.{q}', load_no, {c}, {_sql_class(kind, c)}, {str(kind != 'category').lower()} FROM arrangements")
    parts.append("SELECT 'roi_columns', 'mandatory', load_no, CAST(mandatory AS VARCHAR), coalesce(CAST(mandatory AS VARCHAR), 'blank'), false FROM roi_columns")
    return " UNION ALL ".join(parts)


_SQL_DRIFT = f"""
WITH v AS ({_sql_values()}),
c AS (SELECT table_name, field_name, load_no, cls, count(*) AS n FROM v WHERE load_no IS NOT NULL GROUP BY ALL),
t AS (SELECT table_name, field_name, load_no, sum(n) AS total FROM c GROUP BY ALL),
l AS (SELECT *, lag(load_no) OVER w AS before_load, lag(total) OVER w AS before_total FROM t WINDOW w AS (PARTITION BY table_name, field_name ORDER BY load_no)),
k AS (SELECT DISTINCT l.table_name, l.field_name, l.load_no, l.before_load, l.total, l.before_total, c.cls FROM l JOIN c ON c.table_name = l.table_name AND c.field_name = l.field_name AND c.load_no IN (l.load_no, l.before_load) WHERE l.before_load IS NOT NULL),
x AS (SELECT k.*, coalesce(a.n, 0)::DOUBLE AS n1, coalesce(b.n, 0)::DOUBLE AS n0 FROM k
  LEFT JOIN c a ON a.table_name = k.table_name AND a.field_name = k.field_name AND a.load_no = k.load_no AND a.cls = k.cls
  LEFT JOIN c b ON b.table_name = k.table_name AND b.field_name = k.field_name AND b.load_no = k.before_load AND b.cls = k.cls),
d AS (SELECT table_name, field_name, load_no, before_load, count(*) - 1 AS degrees,
  sum(abs(n1 / total - n0 / before_total)) / 2 AS total_variation,
  sum(pow(sqrt(before_total::DOUBLE / total) * n1 - sqrt(total::DOUBLE / before_total) * n0, 2) / (n1 + n0)) AS chi_square,
  sum(((n1 + 0.5) / (total + 0.5) - (n0 + 0.5) / (before_total + 0.5)) * ln(((n1 + 0.5) / (total + 0.5)) / ((n0 + 0.5) / (before_total + 0.5)))) AS stability_index
  FROM x GROUP BY ALL)
"""

_SQL_CITES = """
WITH c AS (
  SELECT DISTINCT 'content_nodes' AS table_name, node_id AS record_id, cited_at, unnest(list_distinct(list_transform(refs, lambda r: r.href))) AS href, node_id AS row_no FROM content_nodes
  UNION ALL
  SELECT 'recitals', recital_id, cited_at, unnest(list_distinct(flatten(list_transform(paragraphs, lambda p: coalesce(list_transform(p.refs, lambda r: r.href), [])))))  AS href, recital_id FROM recitals),
k AS (SELECT table_name, record_id, cited_at, href, trim(href, E' \\t\\r\\n') AS h FROM c WHERE href IS NOT NULL AND cited_at IS NOT NULL),
p AS (SELECT *, regexp_replace(lower(url_decode(regexp_extract(h, '^([^#?]*)', 1))), '/+$', '') || '#' || lower(url_decode(regexp_extract(h, '^[^#]*#(.*)$', 1))) AS parent_key FROM k),
i AS (SELECT regexp_replace(lower(url_decode(trim(route_prefix) || '/' || target_kind || '/' || target_no)), '/+$', '') || '#' || lower(coalesce(anchor, '')) AS parent_key, indexed_at, deleted_at FROM anchor_index),
n AS (SELECT *, split_part(parent_key, '#', 1) || '#' AS page_key FROM p),
o AS (SELECT table_name, record_id, href, strftime(cited_at, '%Y-%m') AS period,
    EXISTS (SELECT 1 FROM i WHERE i.parent_key = n.page_key) AND EXISTS (SELECT 1 FROM i WHERE i.parent_key = n.parent_key) AS known_once FROM n
  WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.parent_key = n.page_key AND i.indexed_at <= n.cited_at AND (i.deleted_at IS NULL OR n.cited_at < i.deleted_at))
    OR NOT EXISTS (SELECT 1 FROM i WHERE i.parent_key = n.parent_key AND i.indexed_at <= n.cited_at AND (i.deleted_at IS NULL OR n.cited_at < i.deleted_at)))
"""

_SQL_TREE = """
WITH RECURSIVE r AS (
  SELECT contract_ref, upper(trim(provider_code, E' \\t\\r\\n')) AS node, coalesce(upper(trim(recipient_code, E' \\t\\r\\n')), '') AS parent, chain_rank, loaded_at, row_id FROM chain_rows),
n AS (SELECT contract_ref, node, parent, chain_rank FROM r WHERE node <> '' AND contract_ref IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY contract_ref, node ORDER BY loaded_at DESC NULLS LAST, row_id DESC NULLS LAST) = 1),
e AS (SELECT n.*, m.node IS NULL OR n.parent = n.node OR n.parent = '' AS is_root FROM n LEFT JOIN n m ON m.contract_ref = n.contract_ref AND m.node = n.parent),
t AS (SELECT contract_ref, node, node AS root, 0 AS depth, [node] AS path FROM e WHERE is_root
  UNION ALL SELECT e.contract_ref, e.node, t.root, t.depth + 1, list_append(t.path, e.node) FROM e JOIN t ON e.contract_ref = t.contract_ref AND e.parent = t.node WHERE NOT e.is_root)
"""

def _elements(x: str) -> str:
    """SQL: what stands where an array belongs, as a list, quoted up to three times."""
    out = f"[{x}]"
    for _ in range(3):
        out = f"list_transform({out}, lambda v: CASE WHEN json_type(v) = 'VARCHAR' THEN CASE WHEN json_valid(v ->> '$') THEN CAST(v ->> '$' AS JSON) END ELSE v END)"
    return f"list_transform({out}, lambda v: CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[*]') WHEN 'OBJECT' THEN [v] END)[1]"


_SQL_NESTED = f"""
WITH RECURSIVE c AS (SELECT 'arrangements' AS table_name, arr_row AS record_id, 'chain[' || (k - 1) || ']' AS child_path, '' AS parent_path FROM (SELECT arr_row, unnest(chain) AS e, generate_subscripts(chain, 1) AS k FROM arrangements) WHERE e IS NOT NULL AND arr_row IS NOT NULL),
p AS (SELECT article_id, 'paragraphs[' || (k - 1) || ']' AS path, to_json(x.content) AS content FROM (SELECT article_id, unnest(paragraphs) AS x, generate_subscripts(paragraphs, 1) AS k FROM articles) WHERE x.content IS NOT NULL AND article_id IS NOT NULL),
t(record_id, parent_path, child_path, content) AS (
  SELECT article_id, CAST(NULL AS VARCHAR), path, content FROM p
  UNION ALL
  SELECT record_id, above, above || '.content[' || (i - 1) || '].items[' || (k - 1) || ']', json_extract(item, '$.content') FROM (
    SELECT record_id, above, i, unnest(items) AS item, generate_subscripts(items, 1) AS k FROM (
      SELECT record_id, above, i, {_elements("json_extract(node, '$.items')")} AS items FROM (
        SELECT record_id, child_path AS above, unnest(nodes) AS node, generate_subscripts(nodes, 1) AS i FROM (SELECT record_id, child_path, {_elements("content")} AS nodes FROM t WHERE content IS NOT NULL))
      WHERE json_type(node) = 'OBJECT' AND json_extract_string(node, '$.type') = 'list'))
  WHERE json_type(item) = 'OBJECT'),
q AS (SELECT quest_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (SELECT quest_id, {_elements("json_extract(CAST(raw_json AS JSON), '$.modules')")} AS ms FROM questionnaires WHERE json_valid(raw_json) AND quest_id IS NOT NULL)),
q2 AS (SELECT quest_id, i, unnest(qs) AS z, generate_subscripts(qs, 1) AS j FROM (SELECT quest_id, i, {_elements("json_extract(m, '$.questions')")} AS qs FROM q WHERE json_type(m) = 'OBJECT')),
q3 AS (SELECT quest_id, i, j, unnest(os) AS o, generate_subscripts(os, 1) AS k FROM (SELECT quest_id, i, j, {_elements("json_extract(z, '$.options')")} AS os FROM q2 WHERE json_type(z) = 'OBJECT')),
n AS (SELECT table_name, record_id, child_path, parent_path FROM c
  UNION ALL SELECT 'articles', record_id, child_path, parent_path FROM t WHERE parent_path IS NOT NULL
  UNION ALL SELECT 'questionnaires', quest_id, 'modules[' || (i - 1) || '].questions[' || (j - 1) || '].options[' || (k - 1) || ']', 'modules[' || (i - 1) || '].questions[' || (j - 1) || ']' FROM q3 WHERE json_type(o) = 'OBJECT')
"""

SQL: dict[str, str] = {
    "p2_found": _SQL_NESTED + "SELECT * FROM n",
    "p2_tables": _SQL_NESTED + "SELECT table_name, regexp_replace(child_path, '\\[[0-9]+\\]', '', 'g') AS schema_path, count(*) AS n_rows, max(length(child_path) - length(replace(child_path, '.', '')) + 1)::INTEGER AS max_depth FROM n GROUP BY 1, 2",
    "p1_found": _SQL_DRIFT + "SELECT table_name, field_name, load_no FROM d WHERE total_variation > 0.2",
    "p1_drift": _SQL_DRIFT + "SELECT table_name, field_name, load_no, before_load, degrees, round(total_variation, 6) AS total_variation, round(chi_square, 6) AS chi_square, round(stability_index, 6) AS stability_index FROM d",
    "p1_profile": f"""
WITH v AS ({_sql_values()}),
c AS (SELECT table_name, field_name, load_no, value, cls, formed, count(*) AS n FROM v WHERE load_no IS NOT NULL GROUP BY ALL)
SELECT table_name, field_name, load_no, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (cls = 'blank'), 0) AS BIGINT) AS n_blank,
  count(*) FILTER (cls <> 'blank') AS n_distinct, min(value) FILTER (cls <> 'blank') AS min_value, max(value) FILTER (cls <> 'blank') AS max_value,
  CAST(coalesce(sum(n) FILTER (cls = 'other' AND formed), 0) AS BIGINT) AS n_violations, max(n) FILTER (cls <> 'blank') AS top_count
FROM c GROUP BY table_name, field_name, load_no""",
    "p5_found": _SQL_CITES + "SELECT table_name, record_id, href, period FROM o",
    "p5_counts": _SQL_CITES + "SELECT table_name, period, count(*) AS n_orphans, count(*) FILTER (NOT known_once) AS n_never_known, count(*) FILTER (known_once) AS n_not_alive FROM o GROUP BY ALL",
    "p6_found": _SQL_TREE + "SELECT e.contract_ref, e.node AS node_code, coalesce(t.root, '') AS root_code, coalesce(t.depth, -1) AS node_depth FROM e LEFT JOIN t ON t.contract_ref = e.contract_ref AND t.node = e.node",
    "p6_descendants": _SQL_TREE + "SELECT contract_ref, a AS ancestor, node AS descendant, CAST(depth - k + 1 AS INTEGER) AS distance FROM (SELECT contract_ref, node, depth, unnest(path[:depth]) AS a, unnest(range(1, depth + 1)) AS k FROM t WHERE depth > 0)",
}

_KINDS = {"s1.3": "code", "s1.6": "date", "s12.1": "country", "s7.2": "amount"}
_SQL_ANSWERS = f"""SELECT 'arrangements', 'answers.' || k, load_no, v, CASE {" ".join(f"WHEN k = '{q}' THEN {_sql_class(kind, 'v')}" for q, kind in _KINDS.items())} ELSE {_sql_class("category", "v")} END, k IN ({", ".join(f"'{q}'" for q in _KINDS)})
FROM (SELECT load_no, k, answers[k] AS v FROM arrangements CROSS JOIN (SELECT unnest(map_keys(answers)) AS k FROM arrangements WHERE load_no IS NOT NULL UNION SELECT unnest([{", ".join(f"'{q}'" for q in (*_KINDS, *CATEGORY_QUESTIONS))}])))"""


def _with_all_answers(sql: str) -> str:
    """The SQL of a profile query over every answer id in place of the declared ten."""
    parts = _sql_values().split(" UNION ALL ")
    return sql.replace(_sql_values(), " UNION ALL ".join([parts[0], _SQL_ANSWERS, parts[-1]]))


SQL |= {name: _with_all_answers(SQL[name]) for name in ("p1_profile", "p1_drift")}
_DAY = "CASE WHEN regexp_full_match(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(value AS DATE) END"
SQL["p1_profile"] = SQL["p1_profile"].replace(
    "AS max_value,", f"AS max_value, min(TRY_CAST(value AS DOUBLE)) FILTER (cls <> 'blank') AS min_number, max(TRY_CAST(value AS DOUBLE)) FILTER (cls <> 'blank') AS max_number, min({_DAY}) FILTER (cls <> 'blank') AS min_day, max({_DAY}) FILTER (cls <> 'blank') AS max_day,"
)
SQL["p6_paths"] = _SQL_TREE + """, u AS (SELECT contract_ref, node, parent FROM e WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.contract_ref = e.contract_ref AND t.node = e.node)),
c AS (SELECT contract_ref, node, node AS here, 0 AS k FROM u UNION ALL SELECT c.contract_ref, c.node, u.parent, k + 1 FROM c JOIN u ON u.contract_ref = c.contract_ref AND u.node = c.here WHERE k < 1000 AND (k = 0 OR c.here <> c.node)),
l AS (SELECT DISTINCT contract_ref, node FROM c WHERE k > 0 AND here = node),
x AS (SELECT e.contract_ref, e.node, t.path, coalesce(t.depth, -1) AS depth, l.node IS NOT NULL AS on_loop, TRY_CAST(nullif(regexp_extract(chain_rank, '[0-9]+'), '') AS INTEGER) AS rank FROM e LEFT JOIN t ON t.contract_ref = e.contract_ref AND t.node = e.node LEFT JOIN l ON l.contract_ref = e.contract_ref AND l.node = e.node)
SELECT contract_ref, node AS node_code, coalesce(array_to_string(path, '>'), '') AS full_path, depth AS node_depth, on_loop, CASE WHEN depth < 0 THEN 'loop' WHEN rank IS NULL THEN 'missing' WHEN rank = depth + 1 THEN 'agrees' ELSE 'differs' END AS rank_state FROM x"""
# the tables of each schema path: as the nested rows, with the node's own fields
_AT = "CAST(regexp_extract(child_path, '\\[([0-9]+)\\]$', 1) AS INTEGER) AS position"
SQL["p2_chain_links"] = "SELECT arr_row AS record_id, 'chain[' || (k - 1) || ']' AS child_path, '' AS parent_path, CAST(k - 1 AS INTEGER) AS position, e.id, e.service_type, e.provider_code, e.code_type, e.chain_rank, e.recipient_code FROM (SELECT arr_row, unnest(chain) AS e, generate_subscripts(chain, 1) AS k FROM arrangements) WHERE e IS NOT NULL AND arr_row IS NOT NULL"
SQL["p2_list_items"] = (
    _SQL_NESTED.replace("t(record_id, parent_path, child_path, content)", "t(record_id, parent_path, child_path, content, marker, anchor)").replace("path, content FROM p\n", "path, content, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM p\n").replace("json_extract(item, '$.content') FROM (", "json_extract(item, '$.content'), json_extract_string(item, '$.marker'), json_extract_string(item, '$.anchor') FROM (")
    + f"SELECT record_id, child_path, parent_path, {_AT}, marker, anchor FROM t WHERE parent_path IS NOT NULL"
)
SQL["p2_options"] = _SQL_NESTED + "SELECT quest_id AS record_id, 'modules[' || (i - 1) || '].questions[' || (j - 1) || '].options[' || (k - 1) || ']' AS child_path, 'modules[' || (i - 1) || '].questions[' || (j - 1) || ']' AS parent_path, CAST(k - 1 AS INTEGER) AS position, json_extract_string(o, '$.value') AS value, json_extract_string(o, '$.label') AS label FROM q3 WHERE json_type(o) = 'OBJECT'"
