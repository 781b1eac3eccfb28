"""Keyed state from events: latest values, toggles, bounded recency lists, merges.

Batch forms of what ``lexweave.streaming`` keeps incrementally.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value of each key; combined before the shuffle."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("n_events"))


def renamed(records: DataFrame, answers: DataFrame, key: str, name: str, question: str) -> DataFrame:
    """Records whose name follows the last answer to one question, where that is not blank."""
    given = answers.filter(F.col("question_id") == question).select(key, F.trim("value").alias("_name"))
    return records.join(given, key, "left").withColumn(name, F.when(F.coalesce("_name", F.lit("")) != "", F.col("_name")).otherwise(F.col(name))).drop("_name")


def without_blank(state: DataFrame, value: str) -> DataFrame:
    """Keys whose last value is blank are cleared."""
    return state.filter(F.trim(F.coalesce(F.col(value).cast("string"), F.lit(""))) != "")


def alive(events: DataFrame, keys: list[str], order: list[str], deleted: Column) -> DataFrame:
    """Keys whose last event is no deletion."""
    return events.groupBy(*keys).agg(F.max_by(F.coalesce(deleted, F.lit(False)), F.struct(*order)).alias("gone")).filter("NOT gone").drop("gone")


def toggled(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Keys switched an odd number of times, since when."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.max(at).alias("since")).filter("n % 2 = 1").drop("n")


def reset(state: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """State without the keys given."""
    return state.join(keys.select(*on).distinct(), on, "left_anti")


def most_recent(events: DataFrame, owner: str, item: str, at: str, size: int = 8) -> DataFrame:
    """The items an owner visited last, ``size`` at most (without closings this is the bounded list's set).

    Visits are counted per item before the ranks, and the ranks are cut to
    ``size`` in every partition before an owner's rows meet.
    """
    visits = events.groupBy(owner, item).agg(F.max(at).alias("last_at"))
    best = Window.partitionBy(owner).orderBy(F.desc("last_at"), item)
    return visits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size)


def bounded_lists(events: DataFrame, owner: str, item: str, at: str, closed: Column, tie: str, size: int = 8) -> DataFrame:
    """The list of each owner after all visits and closings, in the order shown.

    A visit to a listed item refreshes it in place; a new item joins the end and
    the least recent leaves when the list is full; a closing removes its item.
    Each event depends on the one before, so the events of an owner are sorted
    within a partition and folded as they stream by; only the list itself is
    held, however many events an owner has.  The events of one owner depend on
    each other in order, so they are folded by one task.
    """
    moves = events.select(F.col(owner).cast("string").alias("owner"), F.col(at).alias("at"), F.col(tie).alias("tie"), F.col(item).cast("string").alias("item"), F.coalesce(closed, F.lit(False)).alias("closed"))
    in_order = moves.filter("owner IS NOT NULL AND at IS NOT NULL").repartition("owner").sortWithinPartitions("owner", "at", "tie")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, listed = None, {}

        def shown() -> pd.DataFrame:
            return pd.DataFrame({"owner": current, "place": range(len(listed)), "item": list(listed), "last_at": pd.Series(list(listed.values()), dtype="datetime64[ns]")})

        for pdf in batches:
            done = []
            for who, when, what, gone in zip(pdf["owner"], pdf["at"], pdf["item"], pdf["closed"]):
                if who != current:
                    if listed:
                        done.append(shown())
                    current, listed = who, {}
                if gone:
                    listed.pop(what, None)
                else:
                    if what not in listed and len(listed) >= size:
                        del listed[min(listed, key=listed.get)]
                    listed[what] = when
            if done:
                yield pd.concat(done)
        if listed:
            yield shown()

    folded = in_order.mapInPandas(fold, f"owner string, place int, item string, last_at {moves.schema['at'].dataType.simpleString()}")
    return folded.select(F.col("owner").cast(events.schema[owner].dataType).alias(owner), "place", "item", "last_at")


def merged(current: DataFrame, incoming: DataFrame, key: str, valid: Column) -> DataFrame:
    """Current records with the valid incoming ones put over them by key."""
    fresh = incoming.filter(valid & F.col(key).isNotNull())
    return current.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def with_version(raw: DataFrame, column: str, schema: str, version: int = 1) -> DataFrame:
    """Stored states of the version known; any other, and what cannot be read, counts as none."""
    parsed = raw.withColumn("state", F.from_json(column, schema))
    return parsed.filter((F.col("state.v") == version))


_RECORD = "(schema_of_variant(try_variant_get(x, '$.id', 'variant')) = 'STRING' AND schema_of_variant(try_variant_get(x, '$.name', 'variant')) = 'STRING' AND schema_of_variant(try_variant_get(x, '$.answers', 'variant')) LIKE 'OBJECT%')"


def imported(raw: DataFrame, column: str, version: int = 1) -> DataFrame:
    """States to import with ``records``, their valid records as JSON, and ``n_imported``, how many those are.

    -1 and no records for what cannot be read, is of another version, or has no
    array of arrangements; a record is valid with a text id, a text name and
    answers that are an object.
    """
    parsed = raw.withColumn("_v", F.expr(f"try_parse_json({column})"))
    kind = F.expr("schema_of_variant(try_variant_get(_v, '$.arrangements', 'variant'))")
    readable = F.coalesce((F.expr("try_variant_get(_v, '$.v', 'int')") == version) & kind.startswith("ARRAY"), F.lit(False))
    parsed = parsed.withColumn("_all", F.when(readable, F.expr("try_variant_get(_v, '$.arrangements', 'array<variant>')")))
    valid = F.expr(f"transform(filter(_all, x -> coalesce({_RECORD}, false)), x -> to_json(x))")
    out = parsed.withColumn("records", F.coalesce(F.when(readable, valid), F.array().cast("array<string>")))
    return out.withColumn("n_imported", F.when(readable, F.size("records")).otherwise(-1)).drop("_v", "_all")


def exported(records: DataFrame, columns: dict[str, str], version: int = 1) -> DataFrame:
    """``state_json``: each record as a whole state with its version; ``columns`` maps names of the state to columns. Null fields stand as null."""
    record = F.struct(*[F.col(c).alias(name) for name, c in columns.items()])
    whole = F.to_json(F.struct(F.lit(version).alias("v"), F.array(record).alias("arrangements")), {"ignoreNullFields": "false"})
    return records.withColumn("state_json", whole)
