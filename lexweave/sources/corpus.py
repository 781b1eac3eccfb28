"""The corpus as files: nested JSON per act in, partitioned JSON or parquet out.

Schemas are explicit; trees of content stay JSON text, as no fixed struct holds
them.  One read covers all acts, the act being taken from the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators.tree import flattened

_FOOTNOTES = "array<struct<id:string,label:string,text:string>>"
_REFS = "array<struct<start:int,end:int,href:string>>"
TOC_SCHEMA = "chapters array<struct<roman:string,title:string,sections:array<struct<roman:string,title:string,articles:array<struct<number:int,title:string>>>>,articles:array<struct<number:int,title:string>>>>, annexes array<struct<roman:string,title:string>>, recitalCount int"


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """``act, raw`` of JSON files laid out as ``…/{act}/{file}``."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("raw"))
    return files.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("act"), "raw")


def _elements(files: DataFrame) -> DataFrame:
    """One row an element of a top-level array, as a variant."""
    return files.select("act", F.posexplode(F.expr("CAST(try_parse_json(raw) AS ARRAY<VARIANT>)")).alias("pos", "v"))


def _get(path: str, kind: str) -> Column:
    return F.expr(f"try_variant_get(v, '$.{path}', '{kind}')")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles with their paragraphs; the content of a paragraph is JSON."""
    v = _elements(json_files(spark, path))
    paragraphs = F.expr("transform(try_variant_get(v, '$.paragraphs', 'array<variant>'), p -> struct(try_variant_get(p, '$.number', 'int') AS para_no, try_variant_get(p, '$.anchor', 'string') AS anchor, to_json(variant_get(p, '$.content', 'variant')) AS content))")
    return v.select(
        "act", "pos", _get("number", "int").alias("article_no"), _get("title", "string").alias("title"), _get("chapter", "string").alias("chapter"), _get("chapterTitle", "string").alias("chapter_title"),
        _get("section", "string").alias("section_roman"), _get("sectionTitle", "string").alias("section_title"), paragraphs.alias("paragraphs"), _get("footnotes", _FOOTNOTES).alias("footnotes"),
    )


def read_recitals(spark: SparkSession, path: str) -> DataFrame:
    """Recitals with the texts and links of their paragraphs."""
    return _elements(json_files(spark, path)).select("act", "pos", _get("number", "int").alias("recital_no"), _get("paragraphs", f"array<struct<text:string,refs:{_REFS}>>").alias("paragraphs"))


def read_annexes(spark: SparkSession, path: str) -> DataFrame:
    """Annexes with their content as JSON."""
    content = F.expr("to_json(try_variant_get(v, '$.content', 'variant'))")
    return _elements(json_files(spark, path)).select("act", "pos", _get("roman", "string").alias("roman"), _get("ordinal", "int").alias("ordinal"), _get("title", "string").alias("title"), content.alias("content"), _get("footnotes", _FOOTNOTES).alias("footnotes"))


def read_toc(spark: SparkSession, path: str) -> DataFrame:
    return json_files(spark, path).select("act", F.from_json("raw", TOC_SCHEMA).alias("toc")).select("act", "toc.*")


def search_documents(articles: DataFrame, recitals: DataFrame, acts: DataFrame) -> DataFrame:
    """One search document a paragraph and a recital: id, type, heading, url and text."""
    known = acts.select("act", "route_prefix", "citation")
    p = articles.select("act", "article_no", "title", F.explode("paragraphs").alias("p")).join(known, "act")
    lid = F.when(F.col("p.para_no").isNotNull(), F.concat(F.lit(", lid "), F.col("p.para_no"))).otherwise("")
    from_articles = p.select(
        F.concat_ws("-", "act", F.lit("art"), "article_no", "p.anchor").alias("doc_id"), F.lit("artikel").alias("type"), "act", F.concat(F.lit("Artikel "), "article_no", lid).alias("ref"),
        F.concat(F.lit("Artikel "), "article_no", lid, F.lit(" — "), "title").alias("heading"), F.concat("route_prefix", F.lit("/artikel/"), "article_no", F.lit("#"), "p.anchor").alias("url"), flattened(F.col("p.content")).alias("text"),
    )
    r = recitals.join(known, "act")
    from_recitals = r.select(
        F.concat_ws("-", "act", F.lit("rct"), "recital_no").alias("doc_id"), F.lit("overweging").alias("type"), "act", F.concat(F.lit("Overweging "), "recital_no").alias("ref"), F.concat(F.lit("Overweging "), "recital_no").alias("heading"),
        F.concat("route_prefix", F.lit("/overweging/"), "recital_no").alias("url"), F.array_join(F.transform("paragraphs", lambda x: x["text"]), " ").alias("text"),
    )
    return from_articles.unionByName(from_recitals)


def write_json(df: DataFrame, path: str, partition: str = "act") -> None:
    """One folder of JSON lines for each act."""
    df.write.partitionBy(partition).json(path)


def appended(existing: DataFrame, news: DataFrame, path: str) -> DataFrame:
    """An existing dataset and new rows written to a new place, and read from there: readers of the old place are left alone."""
    existing.unionByName(news).write.parquet(path)
    return existing.sparkSession.read.parquet(path)
