"""Column profiles per load and the breaks between loads (problem 1).

Every profiled field of a table is unpivoted to ``(field, load, value)`` and
counted once.  Everything else – null rates, exact distincts, ranges, pattern
violations, class shares, chi-square, population stability – is an aggregate of
those counts, so a hot value costs one row after the map-side combine.

Defined results: a null map, an absent key, null and white space are all the
class ``blank``; rows without a load number belong to no load and are left out;
an empty table gives no rows; extra columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.codes import is_blank, is_euid, is_iso_date, is_lei

BLANK, VALID, OTHER = "blank", "valid", "other"


@dataclass(frozen=True)
class Field:
    """One profiled field: its name, its text value and the class of the value."""

    name: str
    value: Column
    cls: Column
    #: the class that counts as a violation of the field's form
    violation: str | None = OTHER


def code_field(name: str, value: Column) -> Field:
    return Field(name, value, F.when(is_blank(value), BLANK).when(is_lei(value) | is_euid(value), VALID).otherwise(OTHER))


def date_field(name: str, value: Column) -> Field:
    return Field(name, value, F.when(is_blank(value), BLANK).when(is_iso_date(value), VALID).otherwise(OTHER))


def pattern_field(name: str, value: Column, pattern: str) -> Field:
    return Field(name, value, F.when(is_blank(value), BLANK).when(value.rlike(pattern), VALID).otherwise(OTHER))


def magnitude_field(name: str, value: Column) -> Field:
    """A plain decimal, classed by its number of digits before the point."""
    digits = F.length(F.regexp_extract(value, r"\A(\d+)(\.\d+)?\z", 1))
    return Field(
        name,
        value,
        F.when(is_blank(value), BLANK).when(digits > 0, F.concat(F.lit("digits:"), digits.cast("string"))).otherwise(OTHER),
    )


def category_field(name: str, value: Column) -> Field:
    """Each value as it stands is a class of its own."""
    return Field(name, value, F.when(is_blank(value), BLANK).otherwise(F.concat(F.lit("="), value)), None)


def boolean_field(name: str, value: Column) -> Field:
    text = value.cast("string")
    return Field(name, text, F.coalesce(text, F.lit(BLANK)), None)


def class_counts(df: DataFrame, load: str, fields: list[Field]) -> DataFrame:
    """``field_name, load_no, cls, n``: unpivoted counts of the classified values."""
    return (
        df.filter(F.col(load).isNotNull())
        .select(F.col(load).alias("load_no"), F.explode(F.array(*[F.struct(F.lit(f.name).alias("field_name"), f.cls.alias("cls")) for f in fields])).alias("u"))
        .groupBy("u.field_name", "load_no", "u.cls")
        .agg(F.count("*").alias("n"))
    )


def value_counts(df: DataFrame, load: str, fields: list[Field]) -> DataFrame:
    """``field_name, load_no, value, cls, violates, n``: exact counts of every value."""
    cells = [
        F.struct(F.lit(f.name).alias("field_name"), f.value.alias("value"), f.cls.alias("cls"), (f.cls == F.lit(f.violation) if f.violation else F.lit(False)).alias("violates"))
        for f in fields
    ]
    return (
        df.filter(F.col(load).isNotNull())
        .select(F.col(load).alias("load_no"), F.explode(F.array(*cells)).alias("u"))
        .groupBy("u.field_name", "load_no", "u.value", "u.cls", "u.violates")
        .agg(F.count("*").alias("n"))
    )


def map_value_counts(df: DataFrame, load: str, entries: str, prefix: str, declared: list[Field]) -> DataFrame:
    """As ``value_counts``, for every key of a map column: ``{prefix}{key}`` is a field whether it is declared or not.

    Declared fields classify a column ``value``; under all other keys each value
    is a class of its own.  Rows without a key are its blanks: the rows of the
    load less the entries of the key, also in loads that do not have the key.
    """
    loaded = df.filter(F.col(load).isNotNull())
    cells = loaded.select(F.col(load).alias("load_no"), F.explode(entries).alias("key", "value")).select(F.concat(F.lit(prefix), "key").alias("field_name"), "load_no", "value")
    cls, violates = category_field("", F.col("value")).cls, F.lit(False)
    for f in declared:
        own = F.col("field_name") == f.name
        cls = F.when(own, f.cls).otherwise(cls)
        violates = F.when(own, f.cls == F.lit(f.violation) if f.violation else F.lit(False)).otherwise(violates)
    # classes are a function of field and value, so they are taken after counting
    met = cells.groupBy("field_name", "load_no", "value").agg(F.count("*").alias("n"))
    entered = met.groupBy("field_name", "load_no").agg(F.sum("n").alias("n_entries"))
    loads = loaded.groupBy(F.col(load).alias("load_no")).agg(F.count("*").alias("n_rows"))
    names = entered.select("field_name")
    if declared:
        names = names.unionByName(loaded.sparkSession.createDataFrame([(f.name,) for f in declared], "field_name string"))
    absent = (
        loads.crossJoin(names.distinct()).join(entered, ["field_name", "load_no"], "left")
        .select("field_name", "load_no", F.lit(None).cast("string").alias("value"), (F.col("n_rows") - F.coalesce("n_entries", F.lit(0))).alias("n")).filter("n > 0")
    )
    return met.unionByName(absent).select("field_name", "load_no", "value", cls.alias("cls"), violates.alias("violates"), "n")


def map_class_counts(df: DataFrame, load: str, entries: str, prefix: str, declared: list[Field]) -> DataFrame:
    """As ``class_counts``, for every key of a map column."""
    return map_value_counts(df, load, entries, prefix, declared).groupBy("field_name", "load_no", "cls").agg(F.sum("n").alias("n"))


def profile(values: DataFrame) -> DataFrame:
    """Per field and load: rows, blanks, exact distincts, range as text, as numbers and as days, violations, top count."""
    filled = F.col("cls") != BLANK
    number = F.expr("try_cast(value AS double)")
    day = F.when(is_iso_date(F.col("value")), F.try_to_date("value", "yyyy-MM-dd"))
    return values.groupBy("field_name", "load_no").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(filled, 0).otherwise(F.col("n"))).alias("n_blank"),
        F.count(F.when(filled, 1)).alias("n_distinct"),
        F.min(F.when(filled, F.col("value"))).alias("min_value"),
        F.max(F.when(filled, F.col("value"))).alias("max_value"),
        F.min(F.when(filled, number)).alias("min_number"),
        F.max(F.when(filled, number)).alias("max_number"),
        F.min(F.when(filled, day)).alias("min_day"),
        F.max(F.when(filled, day)).alias("max_day"),
        F.sum(F.when(F.col("violates"), F.col("n")).otherwise(0)).alias("n_violations"),
        F.max(F.when(filled, F.col("n"))).alias("top_count"),
    )


def class_changes(counts: DataFrame) -> DataFrame:
    """Counts of each class in a load beside those in the next lower load.

    One row per field, load with a predecessor, and class met in either; the
    predecessor is found on the (field, load) totals, which are one row a load.
    """
    totals = counts.groupBy("field_name", "load_no").agg(F.sum("n").alias("total"))
    # an array of loads per field: as long as there are loads, and never a value of the data
    series = totals.groupBy("field_name").agg(F.array_sort(F.collect_list(F.struct("load_no", "total"))).alias("s"))
    pairs = series.filter("size(s) > 1").select(
        "field_name", F.explode(F.expr("transform(sequence(1, size(s) - 1), i -> struct(s[i] AS cur, s[i - 1] AS prev))")).alias("p")
    )
    pairs = pairs.select("field_name", "p.cur", "p.prev")
    here = pairs.select("field_name", F.col("cur.load_no").alias("load_no"), F.col("cur.load_no").alias("of"), F.lit(1).alias("now"))
    before = pairs.select("field_name", F.col("prev.load_no").alias("load_no"), F.col("cur.load_no").alias("of"), F.lit(0).alias("now"))
    sides = counts.join(here.unionByName(before), ["field_name", "load_no"])
    cells = sides.groupBy("field_name", "of", "cls").agg(
        F.sum(F.when(F.col("now") == 1, F.col("n")).otherwise(0)).alias("n_now"), F.sum(F.when(F.col("now") == 0, F.col("n")).otherwise(0)).alias("n_before")
    )
    sizes = pairs.select("field_name", F.col("cur.load_no").alias("of"), F.col("cur.total").alias("total_now"), F.col("prev.total").alias("total_before"), F.col("prev.load_no").alias("before_load"))
    return cells.join(sizes, ["field_name", "of"]).withColumnRenamed("of", "load_no")


def drift(counts: DataFrame, smoothing: float = 0.5) -> DataFrame:
    """Total variation, chi-square and population stability of each load against the one before.

    ``smoothing`` is added to every class count for the stability index only,
    so that a class absent on one side stays finite.
    """
    p, q = F.col("n_now") / F.col("total_now"), F.col("n_before") / F.col("total_before")
    ps = (F.col("n_now") + smoothing) / (F.col("total_now") + smoothing)
    qs = (F.col("n_before") + smoothing) / (F.col("total_before") + smoothing)
    both = F.col("n_now") + F.col("n_before")
    scale_now, scale_before = F.sqrt(F.col("total_before") / F.col("total_now")), F.sqrt(F.col("total_now") / F.col("total_before"))
    return class_changes(counts).groupBy("field_name", "load_no", "before_load").agg(
        (F.sum(F.abs(p - q)) / 2).alias("total_variation"),
        F.sum(F.pow(scale_now * F.col("n_now") - scale_before * F.col("n_before"), 2) / both).alias("chi_square"),
        (F.count("*") - 1).alias("degrees"),
        F.sum((ps - qs) * F.log(ps / qs)).alias("stability_index"),
    )
