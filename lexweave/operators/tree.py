"""Trees of legal content as edge lists.

A node is a row ``doc_key, path, node_type, marker, anchor, body, cells``; the
path is an array of positions from the root, so document order is the order of
paths and a subtree is a prefix.  Everything below is built-in columns: one
grouping by document, or one window over it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import markdown_table, slug
from lexweave.operators.nested import as_elements

EDGE_SCHEMA = "doc_key string, path array<int>, depth int, node_type string, marker string, anchor string, body string, cells array<array<string>>"


def marker_slug(marker: str | None) -> str:
    """``a)`` is ``a``, ``(14)`` is ``14``, a dash is nothing."""
    return re.sub(r"[^a-z0-9]+", "-", (marker or "").lower()).strip("-")


def flat_text(content: object) -> str:
    """A content tree as text: items led by their markers, cells by blanks, figures empty; each level trimmed."""
    parts = []
    for node in as_elements(content):
        if not isinstance(node, dict):
            continue
        kind = node.get("type")
        if kind == "list":
            parts.append(" ".join(f"{i.get('marker') or ''} {flat_text(i.get('content'))}" for i in as_elements(node.get("items")) if isinstance(i, dict)))
        elif kind == "table":
            parts.append(" ".join(" ".join(str(c) for c in row) for row in as_elements(node.get("rows")) if isinstance(row, list)))
        else:
            parts.append("" if kind == "figure" else str(node.get("text") or ""))
    return " ".join(parts).strip()


def flattened(content: Column) -> Column:
    """``flat_text`` of a JSON column, batch by batch."""

    @F.pandas_udf("string")
    def flat(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else flat_text(x))

    return flat(content)


def edges(content: object, path: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], dict]]:
    """The nodes of a content tree with their paths; a list is its items."""
    for i, node in enumerate(as_elements(content)):
        if not isinstance(node, dict):
            continue
        if node.get("type") == "list":
            for k, item in enumerate(as_elements(node.get("items"))):
                if isinstance(item, dict):
                    yield (*path, i, k), {"node_type": "item", "marker": item.get("marker"), "anchor": item.get("anchor")}
                    yield from edges(item.get("content"), (*path, i, k))
        else:
            yield (*path, i), {"node_type": node.get("type"), "body": node.get("text"), "cells": node.get("rows")}


def edge_list(documents: DataFrame) -> DataFrame:
    """The edge list of ``documents(doc_key, content)``, content being JSON."""
    columns = ["doc_key", "path", "depth", "node_type", "marker", "anchor", "body", "cells"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, raw in zip(pdf["doc_key"], pdf["content"]):
                for path, node in edges(raw):
                    cells = node.get("cells")
                    table = [[None if c is None else str(c) for c in r] for r in cells if isinstance(r, list)] if isinstance(cells, list) else None
                    texts = [None if node.get(c) is None else str(node[c]) for c in ("node_type", "marker", "anchor", "body")]
                    rows.append((key, list(path), len(path), *texts, table))
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return documents.select("doc_key", "content").mapInPandas(run, EDGE_SCHEMA)


def node_text() -> Column:
    """The text a node adds by itself."""
    cells = F.array_join(F.transform("cells", lambda r: F.array_join(r, " ")), " ")
    return F.when(F.col("node_type") == "item", F.coalesce("marker", F.lit(""))).when(F.col("node_type") == "table", cells).otherwise(F.coalesce("body", F.lit("")))


def flat_documents(nodes: DataFrame) -> DataFrame:
    """``doc_key, n_nodes, flat_text`` of an edge list, in document order."""
    own = nodes.select("doc_key", F.struct("path", node_text().alias("t")).alias("x"))
    joined = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), lambda t: t != ""), " ")
    return own.groupBy("doc_key").agg(F.count("*").alias("n_nodes"), joined.alias("flat_text"))


def anchors(nodes: DataFrame) -> DataFrame:
    """``doc_key, anchor, n`` – an anchor can be linked to where ``n`` is 1."""
    return nodes.filter("anchor IS NOT NULL").groupBy("doc_key", "anchor").agg(F.count("*").alias("n"))


def unique_anchors(nodes: DataFrame) -> DataFrame:
    return anchors(nodes).filter("n = 1").select("doc_key", "anchor")


def numbered_anchors(rows: DataFrame, group: list[str], base: str, order: list[str]) -> DataFrame:
    """Repeated anchors of a group told apart: the second ``-bis``, the third ``-bis-3``."""
    n = F.row_number().over(Window.partitionBy(*group, base).orderBy(*order))
    return rows.withColumn("unique_anchor", F.when(n == 1, F.col(base)).when(n == 2, F.concat(F.col(base), F.lit("-bis"))).otherwise(F.concat(F.col(base), F.lit("-bis-"), n)))


def item_anchors(nodes: DataFrame) -> DataFrame:
    """Anchors items should carry: the paragraph's anchor and the slug of the marker, or ``punt-`` and the slug."""
    parents = nodes.filter("node_type = 'paragraph'").select("doc_key", F.element_at("path", 1).alias("top"), F.col("anchor").alias("prefix"))
    items = nodes.filter("node_type = 'item' AND depth = 3").withColumn("top", F.element_at("path", 1)).withColumn("s", slug(F.col("marker")))
    return items.join(parents, ["doc_key", "top"], "left").select("doc_key", "path", "marker", F.when(F.col("s") != "", F.concat_ws("-", F.coalesce("prefix", F.lit("punt")), "s")).alias("expected_anchor"), "anchor")


def carried_heading(nodes: DataFrame) -> DataFrame:
    """Every node with the last heading before it in its document."""
    before = Window.partitionBy("doc_key").orderBy("path", "node_id").rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn("under_heading", F.last(F.when(F.col("node_type") == "heading", F.col("body")), ignorenulls=True).over(before))


def chunks(nodes: DataFrame) -> DataFrame:
    """Searchable pieces of a document: items of the first level with what is below them, tables, and runs of text between.

    ``doc_key, chunk_no, heading, kind, anchor, chunk_text``; the chunk id takes
    the anchor where it is unique in the document.
    """
    order = Window.partitionBy("doc_key").orderBy("path", "node_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    starts = (F.col("node_type").isin("heading", "table", "figure")) | ((F.col("node_type") == "item") & (F.col("depth") == 3))
    kind = F.when(F.col("node_type").isin("heading", "table", "item"), F.col("node_type")).otherwise("text")
    before = F.lag(F.struct(kind.alias("k"), F.col("depth").alias("d"))).over(order)
    # a text after a heading, a table or an item it does not belong to starts a run of its own
    leaves = (F.col("depth") <= 2) & (before["d"] > 2) | before["k"].isin("table", "heading")
    begin = F.coalesce(starts | leaves, F.lit(True)) | before.isNull()
    marked = nodes.withColumn("t", node_text()).withColumn("b", begin.cast("int")).withColumn("chunk_no", F.sum("b").over(so_far)).withColumn("h", F.last(F.when(F.col("node_type") == "heading", F.col("body")), ignorenulls=True).over(so_far))
    linkable = F.when(F.count("*").over(Window.partitionBy("doc_key", "anchor")) == 1, F.col("anchor"))
    marked = marked.withColumn("linkable", linkable)
    first = F.min_by(F.struct(kind.alias("kind"), "linkable", F.col("h").alias("heading")), F.struct("path", "node_id"))
    text = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("path", "node_id", "t"))), lambda x: x["t"]), lambda t: t != ""), " ")
    grouped = marked.groupBy("doc_key", "chunk_no").agg(first.alias("f"), text.alias("chunk_text")).filter("f.kind <> 'heading' AND chunk_text <> ''")
    number = F.row_number().over(Window.partitionBy("doc_key").orderBy("chunk_no"))
    return grouped.select(
        "doc_key", number.alias("chunk_no"), "f.heading", "f.kind", F.col("f.linkable").alias("anchor"), "chunk_text"
    )


def tables(nodes: DataFrame) -> DataFrame:
    """Tables of an edge list with their size and as Markdown."""
    return nodes.filter("node_type = 'table' AND cells IS NOT NULL").select("doc_key", "path", F.size("cells").alias("n_rows"), F.size(F.element_at("cells", 1)).alias("n_columns"), markdown_table(F.col("cells")).alias("markdown"))


def _pipes(rows: list[list]) -> str:
    lines = ["| " + " | ".join(re.sub(r"\s*\n\s*", " ", str(c).replace("|", "\\|")) for c in r) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join("---" for _ in rows[0]) + " |", *lines[1:]]) if lines else ""


def markdown(content: object, site: str = "") -> str:
    """A content tree as Markdown: headings, texts with their links, items with bold markers and indented bodies, tables."""
    out = []
    for node in as_elements(content):
        if not isinstance(node, dict):
            continue
        kind, text = node.get("type"), str(node.get("text") or "")
        if kind == "list":
            items = []
            for item in as_elements(node.get("items")):
                if isinstance(item, dict):
                    first, *rest = markdown(item.get("content"), site).split("\n")
                    items.append("\n".join([f"- **{item.get('marker') or ''}** {first}", *(f"  {line}" if line else "" for line in rest)]))
            out.append("\n".join(items))
        elif kind == "table":
            out.append(_pipes([r for r in as_elements(node.get("rows")) if isinstance(r, list)]))
        elif kind == "figure":
            out.append(f"*[afbeelding: {node['alt']}]*" if node.get("alt") else "*[afbeelding]*")
        else:
            out.append(f"### {text}" if kind == "heading" else spliced(text, node.get("refs"), site))
    return "\n\n".join(out)


def spliced(text: str, refs: object, site: str = "") -> str:
    """Links put into a text from the last to the first; spans that overlap or leave the text are skipped."""
    limit = len(text)
    for ref in sorted((r for r in as_elements(refs) if isinstance(r, dict)), key=lambda r: -(r.get("start") or 0)):
        start, end = ref.get("start"), ref.get("end")
        if isinstance(start, int) and isinstance(end, int) and 0 <= start < end <= limit:
            text = f"{text[:start]}[{text[start:end]}]({site}{ref.get('href')}){text[end:]}"
            limit = start
    return text


def rendered(content: Column) -> Column:
    """Markdown of a JSON column."""

    @F.pandas_udf("string")
    def render(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else markdown(x))

    return render(content)
