"""Deeply nested records to flat tables with parent links (problem 2).

Every node of a record carries a Dewey label: the list of steps from the root,
each step a field name with the ordinal of the element, ``["paragraphs[0]",
"content[1]", "items[0]"]``.  The parent of a node is its label cut short; the
table a node belongs to is its schema path, the label without ordinals.

Defined results: positions count from 0 and null elements keep their place
without being a node; a lone object where an array belongs is an array of one; a
text of JSON where an array belongs stands for what it holds, however often it
was quoted; unreadable JSON, null and scalars yield nothing; unknown fields are
not entered; repeated records give repeated rows; extra columns are never read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABEL_SCHEMA = "record_id long, label array<string>, body string"


def as_elements(value: object) -> list:
    """What stands where an array belongs, as a list."""
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return []
    if isinstance(value, list):
        return value
    return [value] if isinstance(value, dict) else []


def walk_list_items(value: object, label: list[str]) -> Iterator[tuple[list[str], dict]]:
    """Items of list nodes below a ``content``, to any depth, in document order."""
    stack = [(value, label)]
    while stack:
        content, at = stack.pop()
        below = []
        for i, node in enumerate(as_elements(content)):
            if not isinstance(node, dict) or node.get("type") != "list":
                continue
            for k, item in enumerate(as_elements(node.get("items"))):
                if isinstance(item, dict):
                    path = [*at, f"content[{i}]", f"items[{k}]"]
                    yield path, item
                    below.append((item.get("content"), path))
        stack.extend(reversed(below))


def walk_fields(value: object, steps: tuple[str, ...]) -> Iterator[tuple[list[str], dict]]:
    """Objects at ``steps`` (names of nested array fields) below a record."""

    def go(holder: dict, label: list[str], rest: tuple[str, ...]) -> Iterator[tuple[list[str], dict]]:
        for i, x in enumerate(as_elements(holder.get(rest[0]))):
            if isinstance(x, dict):
                here = [*label, f"{rest[0]}[{i}]"]
                if len(rest) == 1:
                    yield here, x
                else:
                    yield from go(x, here, rest[1:])

    while isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return
    if isinstance(value, dict):
        yield from go(value, [], steps)


def own_body(node: dict, inner: str | None) -> str:
    """A node as JSON without the field its own nodes stand in, which have bodies of their own."""
    return json.dumps({k: v for k, v in node.items() if k != inner} if inner else node, ensure_ascii=False)


def labelled(
    df: DataFrame, record_id: Column, prefix: Column, text: Column, walk: Callable[[object, list[str]], Iterator[tuple[list[str], dict]]], inner: str | None = None, with_body: bool = True
) -> DataFrame:
    """``record_id, label, body``: the nodes ``walk`` meets in the JSON ``text`` below ``prefix``; bodies null where they are not wanted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, labels, bodies = [], [], []
            for rid, pre, raw in zip(pdf["record_id"], pdf["prefix"], pdf["raw"]):
                for label, node in walk(raw, list(pre)):
                    ids.append(rid)
                    labels.append(label)
                    bodies.append(own_body(node, inner) if with_body else None)
            if ids:
                yield pd.DataFrame({"record_id": pd.Series(ids, dtype="int64"), "label": labels, "body": bodies})

    return df.select(record_id.alias("record_id"), prefix.alias("prefix"), text.alias("raw")).filter("raw IS NOT NULL AND record_id IS NOT NULL").mapInPandas(run, LABEL_SCHEMA)


def article_items(articles: DataFrame, with_body: bool = True) -> DataFrame:
    """Dewey-labelled items of list nodes in ``articles.paragraphs.content``."""
    flat = articles.select("article_id", F.posexplode("paragraphs").alias("pos", "p")).filter("p.content IS NOT NULL")
    prefix = F.array(F.concat(F.lit("paragraphs["), F.col("pos"), F.lit("]")))
    return labelled(flat, F.col("article_id"), prefix, F.col("p.content"), walk_list_items, "content", with_body)


def questionnaire_options(questionnaires: DataFrame, with_body: bool = True) -> DataFrame:
    """Dewey-labelled options of ``questionnaires.raw_json``."""
    return labelled(questionnaires, F.col("quest_id"), F.array().cast("array<string>"), F.col("raw_json"), lambda raw, _: walk_fields(raw, ("modules", "questions", "options")), None, with_body)


def chain_elements(arrangements: DataFrame, with_body: bool = True) -> DataFrame:
    """Dewey-labelled elements of ``arrangements.chain``; no Python, no shuffle."""
    return (
        arrangements.select(F.col("arr_row").alias("record_id"), F.posexplode("chain").alias("pos", "c"))
        .filter("c IS NOT NULL AND record_id IS NOT NULL")
        .select("record_id", F.array(F.concat(F.lit("chain["), F.col("pos"), F.lit("]"))).alias("label"), (F.to_json("c") if with_body else F.lit(None).cast("string")).alias("body"))
    )


def label_path(label: Column) -> Column:
    return F.array_join(label, ".")


def parent_label(label: Column, steps: int) -> Column:
    """The label cut short by the steps between a node and its parent."""
    return F.slice(label, F.lit(1), F.greatest(F.size(label) - steps, F.lit(0)))


def schema_path(label: Column) -> Column:
    """The label without ordinals, which names the flat table of a node."""
    return F.regexp_replace(label_path(label), r"\[\d+\]", "")


def child_table(nodes: DataFrame, table_name: str, steps_to_parent: int) -> DataFrame:
    """``table_name, record_id, child_path, parent_path, position, depth, schema_path, body``."""
    label = F.col("label")
    return nodes.select(
        F.lit(table_name).alias("table_name"),
        "record_id",
        label_path(label).alias("child_path"),
        label_path(parent_label(label, steps_to_parent)).alias("parent_path"),
        F.regexp_extract(F.element_at(label, -1), r"\[(\d+)\]", 1).cast("int").alias("position"),
        F.size(label).alias("depth"),
        schema_path(label).alias("schema_path"),
        "body",
    )


def nested_tables(arrangements: DataFrame, articles: DataFrame, questionnaires: DataFrame, with_body: bool = True) -> DataFrame:
    """All child rows of the three nested sources in one labelled form."""
    return (
        child_table(chain_elements(arrangements, with_body), "arrangements", 1)
        .unionByName(child_table(article_items(articles, with_body), "articles", 2))
        .unionByName(child_table(questionnaire_options(questionnaires, with_body), "questionnaires", 1))
    )


def own_columns(children: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """A flat table of one kind of node with its fields as columns beside its place and its parent's."""
    return children.select("record_id", "child_path", "parent_path", "position", *[F.get_json_object("body", f"$.{f}").alias(f) for f in fields])


CHAIN_FIELDS = ("id", "service_type", "provider_code", "code_type", "chain_rank", "recipient_code")
ITEM_FIELDS = ("marker", "anchor")
OPTION_FIELDS = ("value", "label")
