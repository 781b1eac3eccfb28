"""Constraints as queries: each returns the rows that violate it, none when it holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)


def misnumbered(df: DataFrame, group: list[str], number: str, first: int = 1) -> DataFrame:
    """Rows of a group whose number is not their place."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(number)) + (first - 1)
    return df.select(*group, number, place.alias("expected")).filter(F.col(number).isNull() | (F.col(number) != F.col("expected")))


def dangling(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose key is no parent's; a null key refers to nothing and is not one."""
    return children.filter(F.col(child_key).isNotNull()).join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def different_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))


def unused(parents: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    """Parents nothing refers to."""
    return parents.join(uses.select(key).distinct(), key, "left_anti")


def backward(dependencies: DataFrame, positions: DataFrame, key: str, needs: str, position: str) -> DataFrame:
    """Dependencies on what does not come earlier, or does not exist."""
    own = positions.select(F.col(key), F.col(position).alias("own_pos"))
    needed = positions.select(F.col(key).alias(needs), F.col(position).alias("needed_pos"))
    return dependencies.join(own, key).join(needed, needs, "left").filter(F.col("needed_pos").isNull() | (F.col("needed_pos") >= F.col("own_pos")))


def outside(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """Rows whose value is given and not allowed."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(allowed))


def off_pins(counts: DataFrame, pins: DataFrame, key: str, complete: bool = True) -> DataFrame:
    """Counts that differ from their pins; an incomplete corpus may only have fewer."""
    joined = counts.join(pins, key, "full_outer").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("pin", F.lit(0)).alias("pin"))
    return joined.filter(F.col("n") != F.col("pin") if complete else F.col("n") > F.col("pin"))


def without_text(df: DataFrame, key: str, text: str, phrases: dict[str, str]) -> DataFrame:
    """Keys whose text lacks the phrase pinned for them."""
    wanted = df.filter(F.col(key).cast("string").isin(list(phrases)))
    phrase: Column = F.create_map(*[F.lit(x) for kv in phrases.items() for x in kv])[F.col(key).cast("string")]
    return wanted.select(key, phrase.alias("phrase"), F.contains(F.col(text), phrase).alias("found")).filter("NOT coalesce(found, false)")


def not_exactly_once(listed: DataFrame, things: DataFrame, keys: list[str]) -> DataFrame:
    """Things a list has not or has more than once, and entries that are no thing; ``n_listed`` tells which."""
    counted = listed.groupBy(*keys).agg(F.count("*").alias("n_listed"))
    joined = things.select(*keys).distinct().withColumn("is_thing", F.lit(True)).join(counted, keys, "full_outer")
    return joined.select(*keys, F.coalesce("is_thing", F.lit(False)).alias("is_thing"), F.coalesce("n_listed", F.lit(0)).alias("n_listed")).filter("NOT is_thing OR n_listed <> 1")


def off_list(rows: DataFrame, key: str, condition: Column, pinned: DataFrame) -> DataFrame:
    """Keys that meet a condition and are not on its pinned list, and those on the list that do not meet it."""
    meets = rows.filter(F.coalesce(condition, F.lit(False))).select(key).distinct().withColumn("meets", F.lit(True))
    listed = pinned.select(key).distinct().withColumn("listed", F.lit(True))
    return meets.join(listed, key, "full_outer").filter("meets IS NULL OR listed IS NULL").select(key, F.when(F.col("listed").isNull(), "not listed").otherwise("does not meet").alias("problem"))


def changed_between_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows that two runs of one query do not share."""
    return first.exceptAll(second).unionByName(second.exceptAll(first))


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """Violations per check, checks without violations included."""
    parts = [df.agg(F.lit(name).alias("check_name"), F.count("*").alias("n_violations")) for name, df in checks.items()]
    return reduce(DataFrame.unionByName, parts)
