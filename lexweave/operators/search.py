"""Ranked full-text retrieval over DataFrames.

The index is four tables – postings, lengths, frequencies and the vocabulary –
that a large corpus writes once, sorted by term.  A query is expanded against
the vocabulary (exact, synonym, prefix, edit distance); the few terms it reaches
bring their frequencies along, so the postings are met once, by an equi-join on
terms, and grouped once, by document.  Scores are BM25 with a lower bound per
match, ranked by the number of query terms covered first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import FOLD_FROM, FOLD_TO, STOPWORDS, is_searchable, tokens
from lexweave.sources.tables import stage

# fixed values: groups of words of the legal vocabulary that stand for each other
SYNONYM_GROUPS = (
    ("informatieregister", "register"),
    ("uitbesteding", "uitbesteden", "onderaannemer", "onderaannemers", "onderaanneming"),
    ("incident", "incidenten"),
    ("cyberdreiging", "cyberdreigingen", "dreiging", "dreigingen"),
    ("penetratietests", "penetratietest", "tlpt"),
    ("weerbaarheid", "veerkracht"),
    ("exitstrategie", "exitstrategieen", "exit"),
    ("kritieke", "kritiek", "belangrijke"),
    ("toeleveringsketen", "keten", "ranking"),
    ("melding", "meldingen", "rapportage"),
)


@dataclass(frozen=True)
class Options:
    """How a query is expanded and scored."""

    boosts: dict[str, float] = field(default_factory=lambda: {"heading": 3.0, "text": 1.0})
    prefix_from: int | None = 1  # terms of this length or more match as a prefix
    fuzzy_from: int | None = 5  # terms of this length or more match within an edit budget
    fuzzy_share: float = 0.2
    prefix_weight: float = 0.375
    fuzzy_weight: float = 0.45
    k1: float = 1.2
    b: float = 0.7
    delta: float = 0.5
    synonyms: tuple[tuple[str, ...], ...] = SYNONYM_GROUPS


TYPEAHEAD = Options()
PRECISION = Options(boosts={"heading": 2.0, "text": 1.0}, prefix_from=5, fuzzy_from=None)


@dataclass(frozen=True)
class Index:
    """``postings(term, field, doc_id, size, tf)`` with the size of the field, ``lengths(doc_id, field, size)``,
    ``frequencies(term, field, field_df)``, ``vocabulary(term, df)``."""

    postings: DataFrame
    lengths: DataFrame
    frequencies: DataFrame
    vocabulary: DataFrame
    fields: DataFrame | None = None

    @staticmethod
    def of(postings: DataFrame, lengths: DataFrame) -> Index:
        """The index with what follows from its postings."""
        frequencies = postings.groupBy("term", "field").agg(F.count("*").alias("field_df"))
        return Index(postings, lengths, frequencies, postings.groupBy("term").agg(F.count_distinct("doc_id").alias("df")))

    def staged(self) -> Index:
        """The same index over staged tables: texts are read and cut into terms once."""
        return Index.of(stage(self.postings, "postings"), stage(self.lengths, "lengths"))

    def save(self, path: str) -> None:
        """Written once; all but the lengths sorted by term, so a query reads the row groups of its terms.

        Texts are cut into terms once for the postings; what follows from them
        is computed from what is written.
        """
        spark = self.postings.sparkSession
        self.lengths.write.parquet(f"{path}/lengths")
        lengths = spark.read.parquet(f"{path}/lengths")
        lengths.groupBy("field").agg(F.avg("size").alias("mean_size"), F.count("*").alias("n_docs")).write.parquet(f"{path}/fields")
        unsorted = stage(self.postings, "postings")
        unsorted.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/postings")
        written = Index.of(spark.read.parquet(f"{path}/postings"), lengths)
        for name in ("frequencies", "vocabulary"):
            getattr(written, name).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/{name}")

    @staticmethod
    def load(spark, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "lengths", "frequencies", "vocabulary", "fields")))

    def means(self) -> DataFrame:
        """``field, mean_size, n_docs``; one row a field."""
        return self.fields if self.fields is not None else self.lengths.groupBy("field").agg(F.avg("size").alias("mean_size"), F.count("*").alias("n_docs"))


def build_index(docs: DataFrame, fields: tuple[str, ...] = ("heading", "text")) -> Index:
    """The index over the text columns ``fields`` of ``docs(doc_id, …)``; terms are counted before they are shuffled."""
    words = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("body")) for f in fields])).alias("x")).select(
        "doc_id", "x.field", F.filter(tokens(F.col("x.body")), is_searchable).alias("terms")
    )
    words = words.withColumn("size", F.size("terms").cast("long"))
    lengths = words.select("doc_id", "field", "size")
    postings = words.select("doc_id", "field", "size", F.explode("terms").alias("term")).groupBy("term", "field", "doc_id", "size").agg(F.count("*").alias("tf"))
    return Index.of(postings, lengths)


def query_terms(query: str) -> list[str]:
    """Folded words of a query; stopwords stay, as they may still complete a prefix."""
    folded = query.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))
    return [t for t in re.split(r"[\W_]+", folded) if t]


def term_groups(query: str, options: Options = TYPEAHEAD) -> dict[str, int]:
    """Every query term and synonym with the position of the query term it stands for; the first claim holds."""
    others = {t: [s for s in group if s != t] for group in options.synonyms for t in group}
    groups: dict[str, int] = {}
    for i, term in enumerate(query_terms(query)):
        for t in (term, *others.get(term, ())):
            groups.setdefault(t, i)
    return groups


def expand(vocabulary: DataFrame, query: str, options: Options = TYPEAHEAD) -> DataFrame:
    """``term, query_group, weight``: vocabulary terms that match, with their best weight per group."""
    return expand_many(vocabulary, {0: query}, options).drop("query_id")


def expand_many(vocabulary: DataFrame, queries: dict[int, str], options: Options = TYPEAHEAD) -> DataFrame:
    """``query_id, term, query_group, weight`` for several queries, in one pass over the vocabulary."""
    term, size = F.col("term"), F.length("term")
    matches: list[Column] = []
    wanted_terms: set[str] = set()
    for query_id, query in queries.items():
        for wanted, group in term_groups(query, options).items():
            wanted_terms.add(wanted)
            n = len(wanted)
            weights = [F.when(term == wanted, F.lit(1.0)), F.lit(None).cast("double")]
            if options.prefix_from is not None and n >= options.prefix_from:
                weights.append(F.when(term.startswith(wanted), options.prefix_weight * n / (n + 0.3 * (size - n))))
            if options.fuzzy_from is not None and n >= options.fuzzy_from:
                budget = max(1, round(options.fuzzy_share * n))
                distance = F.levenshtein(term, F.lit(wanted), budget)
                near = F.abs(size - n) <= budget
                weights.append(F.when(near & (distance >= 0), options.fuzzy_weight * n / (n + distance)))
            matches.append(F.struct(F.lit(query_id).alias("query_id"), F.lit(group).alias("query_group"), F.greatest(*weights).alias("weight")))
    if not matches:
        return vocabulary.select(F.lit(0).alias("query_id"), "term", F.lit(0).alias("query_group"), F.lit(0.0).alias("weight")).limit(0)
    if options.prefix_from is None and options.fuzzy_from is None:  # whole terms only: the scan skips all others
        vocabulary = vocabulary.filter(term.isin(sorted(wanted_terms)))
    found = F.filter(F.array(*matches), lambda m: m["weight"].isNotNull())
    return vocabulary.select("term", F.explode(found).alias("m")).groupBy("m.query_id", "term", "m.query_group").agg(F.max("m.weight").alias("weight"))


def scored(index: Index, query: str, options: Options = TYPEAHEAD) -> DataFrame:
    """``doc_id, coverage, score`` of every document that matches."""
    return scored_many(index, {0: query}, options).drop("query_id")


#: so many terms are looked up by the scan, more by the join alone
LOOKED_UP = 1000


def scored_many(index: Index, queries: dict[int, str], options: Options = TYPEAHEAD) -> DataFrame:
    """``query_id, doc_id, coverage, score`` of every document that matches one of several queries; queries under two characters match none."""
    asked = {k: q for k, q in queries.items() if len(q.strip()) >= 2}
    if not asked:
        return index.postings.select(F.lit(0).alias("query_id"), "doc_id", F.lit(0).alias("coverage"), F.lit(0.0).alias("score")).limit(0)
    spark = index.postings.sparkSession
    expanded = expand_many(index.vocabulary, asked, options)
    postings, frequencies = index.postings, index.frequencies
    first = expanded.limit(LOOKED_UP + 1).collect()
    if len(first) <= LOOKED_UP:
        terms = sorted({r["term"] for r in first})
        expanded = spark.createDataFrame(first, expanded.schema) if first else expanded.limit(0)
        postings, frequencies = postings.filter(F.col("term").isin(terms)), frequencies.filter(F.col("term").isin(terms))
    boost = F.lit(None).cast("double")
    for name, b in options.boosts.items():
        boost = F.when(F.col("field") == name, b).otherwise(boost)
    wanted = expanded.join(frequencies.filter(F.col("field").isin(list(options.boosts))), "term")
    rated = postings.join(wanted, ["term", "field"]).join(F.broadcast(index.means()), "field")
    idf = F.log(1 + (F.col("n_docs") - F.col("field_df") + 0.5) / (F.col("field_df") + 0.5))
    norm = options.k1 * (1 - options.b + options.b * F.col("size") / F.col("mean_size"))
    part = boost * F.col("weight") * idf * (options.delta + F.col("tf") * (options.k1 + 1) / (F.col("tf") + norm))
    return rated.groupBy("query_id", "doc_id").agg(F.count_distinct("query_group").alias("coverage"), F.round(F.sum(part), 6).alias("score"))


def reference_pattern(query: str, instruments: tuple[str, ...] = (), main: str = "hoofdakte") -> tuple[str, bool] | None:
    """The document id a direct reference names, and whether it is the whole id or its start."""
    q, instrument = query.strip().lower(), main
    for name in sorted(instruments, key=len, reverse=True):
        if q.startswith(f"{name} "):
            instrument, q = name, q[len(name) :].strip()
            break
    if m := re.fullmatch(r"artikel\s+(\d+)(?:\s*,?\s*lid\s+(\d+))?", q):
        return (f"{instrument}-art-{m[1]}-lid-{m[2]}", True) if m[2] else (f"{instrument}-art-{m[1]}-", False)
    if m := re.fullmatch(r"overweging\s+(\d+)", q):
        return f"{instrument}-rct-{m[1]}", True
    if m := re.fullmatch(r"bijlage\s+([ivxlc]+)(?:\s*,?\s*punt\s+(\d+|[a-z]))?", q):
        return (f"{instrument}-anx-{m[1]}-punt-{m[2]}", True) if m[2] else (f"{instrument}-anx-{m[1]}-", False)
    return None


def search(index: Index, query: str, limit: int = 30, options: Options = TYPEAHEAD, instruments: tuple[str, ...] = (), main: str = "hoofdakte") -> DataFrame:
    """The best ``limit`` documents: named ones first, then by coverage, score and id."""
    hits = scored(index, query, options)
    named = reference_pattern(query, instruments, main)
    key = F.col("doc_id").cast("string")
    pinned = F.lit(False) if named is None else key == named[0] if named[1] else key.startswith(named[0])
    return hits.withColumn("pinned", pinned).orderBy(F.desc("pinned"), F.desc("coverage"), F.desc("score"), "doc_id").limit(limit)


def search_many(index: Index, queries: dict[int, str], limit: int = 30, options: Options = TYPEAHEAD, instruments: tuple[str, ...] = (), main: str = "hoofdakte") -> DataFrame:
    """``query_id, rank, doc_id, pinned, coverage, score``: the best ``limit`` documents of each of several queries, the index being read once."""
    key, pinned = F.col("doc_id").cast("string"), F.lit(False)
    for query_id, query in queries.items():
        if named := reference_pattern(query, instruments, main):
            pinned = pinned | ((F.col("query_id") == query_id) & (key == named[0] if named[1] else key.startswith(named[0])))
    best = Window.partitionBy("query_id").orderBy(F.desc("pinned"), F.desc("coverage"), F.desc("score"), "doc_id")
    ranked = scored_many(index, queries, options).withColumn("pinned", pinned).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= limit).select("query_id", "rank", "doc_id", "pinned", "coverage", "score")


def filtered_after_limit(hits: DataFrame, docs: DataFrame, condition: Column, limit: int = 10) -> DataFrame:
    """A filter on the candidates found, not on the corpus: fewer than ``limit`` may be left."""
    return hits.join(docs, "doc_id").filter(condition).orderBy(F.desc("pinned"), F.desc("coverage"), F.desc("score"), "doc_id").limit(limit)


def grouped_hits(hits: DataFrame, docs: DataFrame, kind: str) -> DataFrame:
    """Hits listed by kind, best first."""
    ranked = hits.join(docs.select("doc_id", kind), "doc_id")
    return ranked.groupBy(kind).agg(
        F.count("*").alias("n_hits"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("coverage")).alias("c"), (-F.col("score")).alias("s"), "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids")
    )


def snippet(text: Column, terms: list[str], radius: int = 120) -> Column:
    """The window of twice the radius with most distinct terms (then most matches, then first), as text.

    Texts hardly longer than the window are returned whole.
    """
    wanted = [t.lower() for t in terms if len(t) >= 2]
    table = str.maketrans(FOLD_FROM, FOLD_TO)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None or len(t) <= 2 * radius + 60:
                return t
            folded = "".join(c.lower()[:1] for c in t).translate(table)
            spots = sorted((m.start(), k) for k, w in enumerate(wanted) for m in re.finditer(f"(?={re.escape(w)})", folded))
            if not spots:
                return t[: 2 * radius] + "…"
            best, best_at, hi = (0, 0), spots[0][0], 0
            inside: dict[int, int] = {}
            for lo, (at, k) in enumerate(spots):
                while hi < len(spots) and spots[hi][0] - at <= 2 * radius:
                    inside[spots[hi][1]] = inside.get(spots[hi][1], 0) + 1
                    hi += 1
                if (rank := (len(inside), hi - lo)) > best:
                    best, best_at = rank, at
                inside[k] -= 1
                if not inside[k]:
                    del inside[k]
            start = max(0, best_at - 40)
            end = min(len(t), start + 2 * radius)
            return ("…" if start else "") + t[start:end].strip() + ("…" if end < len(t) else "")

        return texts.map(one)

    return cut(text)


def best_window(docs: DataFrame, terms: list[str], radius: int = 120) -> DataFrame:
    """The same window relationally: positions as rows, a range frame over them; ``doc_id, position, n_distinct, n_matches``."""
    folded = F.translate(F.lower(F.col("text")), FOLD_FROM, FOLD_TO)
    # the text cut before every occurrence of a term: a piece that starts with the term starts where the pieces before it end
    cuts = F.array(*[F.struct(F.lit(t).alias("term"), F.split(F.col("f"), f"(?={re.escape(t)})").alias("pieces")) for t in terms])
    holding = docs.select("doc_id", folded.alias("f")).filter(F.col("f").rlike("|".join(map(re.escape, terms))))
    pieces = holding.select("doc_id", F.explode(cuts).alias("c")).select("doc_id", "c.term", F.posexplode("c.pieces").alias("i", "piece"))
    pieces = pieces.select("doc_id", "term", "i", F.length("piece").cast("long").alias("n"), F.expr("startswith(piece, term)").alias("hit")).repartition("doc_id")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id", "term").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = pieces.withColumn("position", before).filter("hit").select("doc_id", "position", "term")
    ahead = Window.partitionBy("doc_id").orderBy("position").rangeBetween(0, 2 * radius)
    rated = found.select("doc_id", "position", F.size(F.collect_set("term").over(ahead)).alias("n_distinct"), F.count("*").over(ahead).alias("n_matches"))
    best = F.max(F.struct("n_distinct", "n_matches", (-F.col("position")).alias("p")))
    return rated.groupBy("doc_id").agg(best.alias("b")).select("doc_id", (-F.col("b.p")).alias("position"), "b.n_distinct", "b.n_matches")


def quoted(text: Column, terms: list[str], whole: int = 600, radius: int = 200) -> Column:
    """Short texts whole, longer ones as a snippet."""
    return F.when(F.length(text) <= whole, text).otherwise(snippet(text, terms, radius))


def stopword_fallback(term: Column) -> Column:
    """The folded term where it is searchable, its lower case where it is not."""
    return F.when(is_searchable(term), term).otherwise(F.lower(term))


__all__ = ["Index", "Options", "PRECISION", "STOPWORDS", "SYNONYM_GROUPS", "TYPEAHEAD", "build_index", "expand", "search", "snippet"]
