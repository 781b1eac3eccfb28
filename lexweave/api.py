"""Read functions over a corpus, each returning a DataFrame.

A request for something that does not exist gives one row with an ``error`` that
names the range that does, never an exception.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.operators import maps as M
from lexweave.operators import search as S
from lexweave.operators.tree import rendered


@dataclass(frozen=True)
class Corpus:
    """The tables behind the functions.

    ``articles(act, article_no, title, chapter, …, paragraphs)``,
    ``recitals(act, recital_no, paragraphs)``, ``annexes(act, roman, ordinal, title, content)``,
    ``acts(act, label, citation, route_prefix)``, ``documents`` as built by
    ``search_documents``, ``recital_pairs(recital_key, article_key, pos)``,
    ``links(source, target, label, href, pos)``, ``steps(step_id, playbook, fase, title, pos)``,
    ``step_documents(step_id, document_id)``, ``catalogue(document_id, category, name)``,
    ``coverage(act, article_no, anchor, disposition, steps, note)``.
    """

    articles: DataFrame
    recitals: DataFrame
    annexes: DataFrame
    acts: DataFrame
    documents: DataFrame
    index: S.Index
    recital_pairs: DataFrame | None = None
    links: DataFrame | None = None
    steps: DataFrame | None = None
    step_documents: DataFrame | None = None
    catalogue: DataFrame | None = None
    coverage: DataFrame | None = None


def article_number(value: str) -> str:
    """``Artikel 6 `` is ``6``."""
    return re.sub(r"^artikel\s*", "", value.strip().lower())


def _or_error(found: DataFrame, known: DataFrame, message: Column) -> DataFrame:
    """Rows found with an empty error; where there are none, one row with the message made from what is known."""
    n = found.agg(F.count("*").alias("_n"))
    failed = known.agg(message.alias("error")).join(F.broadcast(n), F.col("_n") == 0).drop("_n")
    return found.withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)


def search_corpus(c: Corpus, query: str, limit: int = 10, kind: str | None = None, act: str | None = None) -> DataFrame:
    """Best documents with a quotation; kind and act filter the fifty candidates found."""
    hits = S.search(c.index, query, 50, S.PRECISION)
    wanted = F.lit(True)
    if kind:
        wanted = wanted & (F.col("type") == kind)
    if act:
        wanted = wanted & (F.col("act") == act)
    kept = S.filtered_after_limit(hits, c.documents, wanted, min(50, max(1, limit)))
    return kept.select("doc_id", "type", "act", "heading", "url", "coverage", "score", S.quoted(F.col("text"), S.query_terms(query)).alias("quotation"))


def get_article(c: Corpus, number: str, act: str) -> DataFrame:
    """An article as Markdown with its recitals and its links to other acts."""
    key = article_number(number)
    own = c.articles.filter((F.col("act") == act) & (F.col("article_no") == (int(key) if key.isdigit() else -1)))
    body = own.select("act", "article_no", "title", F.posexplode("paragraphs").alias("pos", "p")).select("act", "article_no", "title", "pos", F.concat_ws(". ", F.col("p.para_no").cast("string"), rendered(F.col("p.content"))).alias("t"))
    out = body.groupBy("act", "article_no", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "\n\n").alias("markdown"))
    me = F.concat_ws(":", "act", "article_no")
    if c.recital_pairs is not None:
        related = M.grouped(c.recital_pairs, "article_key", "recital_key", "pos", "recitals").select("article_key", "recitals")
        out = out.withColumn("article_key", me).join(related, "article_key", "left").drop("article_key")
    if c.links is not None:
        ahead = c.links.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "href"))), lambda x: x["href"]).alias("implemented_by"))
        back = c.links.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"]).alias("based_on"))
        out = out.withColumn("source", me).join(ahead, "source", "left").withColumnRenamed("source", "target").join(back, "target", "left").drop("target")
        out = out.withColumns({n: F.coalesce(n, F.array().cast("array<string>")) for n in ("implemented_by", "based_on")})
    known = c.articles.filter(F.col("act") == act)
    return _or_error(out, known, F.concat(F.lit(f'Artikel "{number}" niet gevonden (bereik: '), F.coalesce(F.min("article_no").cast("string"), F.lit("geen")), F.lit("–"), F.coalesce(F.max("article_no").cast("string"), F.lit("geen")), F.lit(").")))


def get_recital(c: Corpus, number: int, act: str) -> DataFrame:
    """A recital's text and the articles it explains."""
    own = c.recitals.filter((F.col("act") == act) & (F.col("recital_no") == number)).select("act", "recital_no", F.array_join(F.transform("paragraphs", lambda p: p["text"]), "\n\n").alias("text"))
    if c.recital_pairs is not None:
        related = M.grouped(c.recital_pairs, "recital_key", "article_key", "pos", "articles").select("recital_key", "articles")
        own = own.withColumn("recital_key", F.concat_ws(":", "act", "recital_no")).join(related, "recital_key", "left").drop("recital_key")
    return _or_error(own, c.recitals.filter(F.col("act") == act), F.concat(F.lit(f"Overweging {number} niet gevonden (bereik: 1–"), F.coalesce(F.max("recital_no").cast("string"), F.lit("0")), F.lit(").")))


def get_annex(c: Corpus, roman: str, act: str) -> DataFrame:
    """An annex as Markdown; the numeral in any case."""
    key = re.sub(r"^bijlage\s*", "", roman.strip(), flags=re.I).lower()
    own = c.annexes.filter((F.col("act") == act) & (F.lower("roman") == key)).select("act", "roman", "title", rendered(F.col("content")).alias("markdown"))
    known = c.annexes.filter(F.col("act") == act)
    return _or_error(own, known, F.concat(F.lit(f'Bijlage "{roman}" niet gevonden. Beschikbaar: '), F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set("roman")), ", "), F.lit("")), F.lit("geen")), F.lit(".")))


def get_structure(c: Corpus) -> DataFrame:
    """Contents of all acts: chapters and sections with their articles, annexes, number of recitals."""
    toc = M.contents(c.articles.withColumnRenamed("act", "instrument")).withColumnRenamed("instrument", "act")
    chapters = toc.groupBy("act").agg(F.array_sort(F.collect_list(F.struct("first_no", "chapter", "chapter_title", "sections"))).alias("chapters"))
    annexes = c.annexes.groupBy("act").agg(F.array_sort(F.collect_list(F.struct("ordinal", "roman", "title"))).alias("annexes"))
    recitals = c.recitals.groupBy("act").agg(F.count("*").alias("n_recitals"))
    return c.acts.join(chapters, "act", "left").join(annexes, "act", "left").join(recitals, "act", "left").withColumn("n_recitals", F.coalesce("n_recitals", F.lit(0)))


def get_playbook(c: Corpus, playbook: str, fase: str | None = None) -> DataFrame:
    """Steps of a playbook in order, with the documents they produce."""
    steps = c.steps.filter(F.col("playbook") == playbook)
    own = steps.filter(F.col("fase") == fase) if fase else steps
    made = c.step_documents.groupBy("step_id").agg(F.array_sort(F.collect_set("document_id")).alias("documents"))
    out = own.join(made, "step_id", "left").withColumn("documents", F.coalesce("documents", F.array().cast("array<string>"))).orderBy("fase", "pos")
    return _or_error(out, steps, F.concat(F.lit(f'Fase "{fase}" niet gevonden. Beschikbaar: '), F.array_join(F.array_sort(F.collect_set("fase")), ", "), F.lit(".")))


def get_coverage(c: Corpus, number: str, act: str) -> DataFrame:
    """Paragraphs of an article with their disposition and implementing steps, and how many are covered."""
    key = article_number(number)
    own = c.articles.filter((F.col("act") == act) & (F.col("article_no") == (int(key) if key.isdigit() else -1))).select("act", "article_no", F.posexplode("paragraphs").alias("pos", "p")).select("act", "article_no", "pos", F.col("p.anchor").alias("anchor"))
    matrix = M.coverage(own, c.coverage, ["act", "article_no", "anchor"])
    totals = matrix.groupBy("act", "article_no").agg(F.count("*").alias("total"), F.count_if("covered").alias("n_covered"))
    known = c.articles.filter(F.col("act") == act)
    return _or_error(matrix.join(totals, ["act", "article_no"]), known, F.concat(F.lit(f'Artikel "{number}" niet gevonden (bereik: 1–'), F.coalesce(F.max("article_no").cast("string"), F.lit("0")), F.lit(").")))


def get_documents(c: Corpus, category: str | None = None) -> DataFrame:
    """The catalogue of documents with the steps that produce them; documents without a step stay."""
    own = c.catalogue.filter(F.col("category") == category) if category else c.catalogue
    made = c.step_documents.groupBy("document_id").agg(F.array_sort(F.collect_set("step_id")).alias("steps"))
    out = own.join(made, "document_id", "left").withColumn("steps", F.coalesce("steps", F.array().cast("array<string>")))
    return _or_error(out, c.catalogue, F.concat(F.lit("Geen documenten. Categorieën: "), F.array_join(F.array_sort(F.collect_set("category")), ", "), F.lit(".")))


def category_shares(catalogue: DataFrame) -> DataFrame:
    """Documents per category and their share of all."""
    counted = catalogue.groupBy("category").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(counted.agg(F.sum("n").alias("total")))).select("category", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def playbook_counts(steps: DataFrame) -> DataFrame:
    """Steps per playbook and phase, per playbook, and in all."""
    return steps.rollup("playbook", "fase").agg(F.count("*").alias("n_steps"))


def steps_in_regime(steps: DataFrame, regime: str | None, known: list[str]) -> DataFrame:
    """Steps that apply to a regime; a regime of another kind filters nothing."""
    return steps.filter(F.array_contains("applies_to", regime)) if regime in known else steps


def documents_of_steps(steps: DataFrame) -> DataFrame:
    """Search documents of playbook steps."""
    return steps.select(F.concat(F.lit("stap-"), "step_id").alias("doc_id"), F.lit("stap").alias("type"), F.col("playbook").alias("act"), F.col("step_id").alias("ref"), F.col("title").alias("heading"), F.concat(F.lit("/playbook/"), "playbook", F.lit("/"), "fase", F.lit("#"), "step_id").alias("url"), F.concat_ws(" ", "goal", F.array_join("actions", " ")).alias("text"))


def documents_of_catalogue(catalogue: DataFrame) -> DataFrame:
    """Search documents of the document catalogue."""
    return catalogue.select(F.concat(F.lit("document-"), "document_id").alias("doc_id"), F.lit("document").alias("type"), F.lit("document").alias("act"), F.col("document_id").alias("ref"), F.col("name").alias("heading"), F.concat(F.lit("/documenten#"), "document_id").alias("url"), F.coalesce("description", F.lit("")).alias("text"))
