"""Queries of the problems on documents and free text (3, 4, 7, 8, 9) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import canonical, lookalike, mixing, packing, prose, tokens
from lexweave.sources.tables import heavy_table, table


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonical_items(canonical.manual_entries(heavy_table(spark, sf_dir, "arrangements", "arr_row", "manual")), table(spark, sf_dir, "closed_lists"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every free entry of a closed-list column with the item it means, or 0."""
    return _mapped(spark, sf_dir).select(F.col("row_key").alias("arr_row"), "column_code", "item_no")


def p3_how(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the entries of each column were mapped."""
    return _mapped(spark, sf_dir).groupBy("column_code", "how").agg(F.count("*").alias("n_entries"))


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries meaning no item, reported per column."""
    return canonical.unmatched(_mapped(spark, sf_dir))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.register_texts(heavy_table(spark, sf_dir, "content_nodes", "node_id", "lang", "marker", "body"), heavy_table(spark, sf_dir, "roi_columns", "col_row", "lang", "label"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text only looks like its consistent form."""
    return lookalike.changed(_texts(spark, sf_dir)).select("table_name", "field_name", "record_id")


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its consistent form."""
    return lookalike.with_normal_form(_texts(spark, sf_dir)).select("table_name", "field_name", "record_id", "normal")


def _vocabulary(spark: SparkSession) -> str:
    """The vocabulary file that sizes texts: the session's ``spark.lexweave.vocabulary``, else the one of this machine."""
    return spark.conf.get("spark.lexweave.vocabulary", tokens.VOCABULARY)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.staged_sizes(heavy_table(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"], _vocabulary(spark))
    return packing.packed_items(sizes, table(spark, sf_dir, "pack_sizes"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content and fill of every container of every capacity."""
    return packing.containers(_packed(spark, sf_dir))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, fill and the least possible number of containers per capacity."""
    return packing.packing_report(packing.containers(_packed(spark, sf_dir)))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.staged_sizes(heavy_table(spark, sf_dir, "documents", "doc_id", "source", "text"), ["doc_id", "source"], _vocabulary(spark))
    return mixing.mix(sizes, table(spark, sf_dir, "source_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of the mix with its shard and place."""
    return _mixed(spark, sf_dir)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.reached_shares(_mixed(spark, sf_dir), table(spark, sf_dir, "source_targets"))


def p8_shard_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source in each shard."""
    return mixing.shard_shares(_mixed(spark, sf_dir), table(spark, sf_dir, "source_targets"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.line_labels(heavy_table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "common_words"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with fewer than half of their characters in complete sentences."""
    return prose.not_prose(_labels(spark, sf_dir)).select("doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of characters in prose, lists, tables and junk per document."""
    n = F.col("n_line_chars")
    shares = [F.when(n > 0, F.round(F.col(f"{s}_chars") / n, 6)).otherwise(0.0).alias(f"{s}_share") for s in ("prose", "list", "table", "junk", "sentence")]
    return _labels(spark, sf_dir).select("doc_id", "n_lines", *shares)


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and ratios of every text."""
    return prose.text_statistics(heavy_table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "common_words"))


QUERIES = {f.__name__: f for f in (p3_found, p3_how, p3_unmatched, p4_found, p4_forms, p7_containers, p7_report, p8_mix, p8_shares, p8_shard_shares, p9_found, p9_shares, p9_statistics)}

SQL: dict[str, str] = {
    "p9_statistics": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, t, regexp_extract_all(lower(t), '\\p{L}+') AS w, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l,
  (SELECT list(DISTINCT lower(word)) FROM common_words WHERE word <> '') AS cw FROM d)
SELECT doc_id, length(t) AS n_characters, len(w) AS n_words, len(l) AS n_lines,
  CASE WHEN len(w) > 0 THEN round(length(array_to_string(w, '')) / len(w), 6) END AS mean_word_length,
  CASE WHEN length(t) > 0 THEN round(length(regexp_replace(t, '[\\p{L}\\p{N}\\s]', '', 'g')) / length(t), 6) END AS symbol_ratio,
  CASE WHEN len(l) > 0 THEN round(len(list_filter(l, lambda x: regexp_matches(x, '[.!?;:]$'))) / len(l), 6) END AS ended_line_share,
  CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: list_contains(cw, x))) / len(w), 6) END AS common_word_share
FROM p""",
}
