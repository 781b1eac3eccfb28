"""References to records that do not exist at the time of citing (problem 5).

A citation needs its page and, where it has a fragment, also its anchor: one
child key for each.  Parents (lives of targets) and children (needed keys) are
put into one long form and grouped by parent table and key; the group says
whether the key was ever a target, and its lives as disjoint intervals.  Child
keys then meet their group again and stay when no life covers the citing time;
a citation with any such key is an orphan.

Skew: the grouping combines on the map side, so a key holding a third of all
citations is a handful of partial rows; the second meeting is a plain equi-join
whose large side needs no further exchange, which lets adaptive execution split
a skewed key over many tasks.  Only keys without a life are brought together by
citation, of which no two rows share more than a handful.

Defined results: null refs, null elements and null hrefs are no reference; a
citation without a time cannot be judged and is left out; a blank href is a
reference to nothing and is reported; an empty fragment is the page itself;
repeated hrefs of one row count once, repeated rows as often as they stand;
empty tables give no rows; extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.codes import WHITESPACE


def percent_decode(c: Column) -> Column:
    """%XX escapes decoded; a plus sign stays a plus, a malformed escape stays as written."""
    return F.when(c.contains("%"), F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)).otherwise(c)


def page_key(path: Column) -> Column:
    """Lower case, escapes decoded, no final slash."""
    return F.regexp_replace(F.lower(percent_decode(path)), r"/+\z", "")


def href_key(href: Column) -> Column:
    """``{page}#{anchor}``, the anchor empty for the page itself; null for null."""
    h = F.btrim(href, F.lit(WHITESPACE))
    path = F.regexp_extract(h, r"\A([^#?]*)", 1)
    fragment = F.regexp_extract(h, r"\A[^#]*#(.*)\z", 1)
    return F.concat(page_key(path), F.lit("#"), F.lower(percent_decode(fragment)))


def target_key(prefix: Column, kind: Column, number: Column, anchor: Column) -> Column:
    """The key under which an index entry is found."""
    path = F.concat_ws("/", F.btrim(prefix, F.lit(WHITESPACE)), kind, number)
    return F.concat(page_key(path), F.lit("#"), F.lower(F.coalesce(anchor, F.lit(""))))


def needed_keys(href: Column) -> Column:
    """The keys that must live for an href to hold: its page's, and its anchor's where it has a fragment."""
    key = href_key(href)
    page = F.concat(F.substring_index(key, "#", 1), F.lit("#"))
    return F.array_distinct(F.array(page, key))


def citations(df: DataFrame, child_table: str, record_id: str, hrefs: Column, at: str) -> DataFrame:
    """``table_name, record_id, cited_at, href, parent_key``: every key the distinct hrefs of each row need, with no shuffle."""
    return (
        df.filter(F.col(at).isNotNull())
        .select(F.lit(child_table).alias("table_name"), F.col(record_id).alias("record_id"), F.col(at).alias("cited_at"), F.explode(F.array_distinct(hrefs)).alias("href"))
        .filter(F.col("href").isNotNull())
        .select("*", F.explode(needed_keys(F.col("href"))).alias("parent_key"))
    )


def lives(index: DataFrame, parent_table: str = "anchor_index") -> DataFrame:
    """``parent_table, parent_key, lived_from, lived_to`` of each index entry; never alive without a start."""
    return index.filter(F.col("indexed_at").isNotNull()).select(
        F.lit(parent_table).alias("parent_table"),
        target_key(F.col("route_prefix"), F.col("target_kind"), F.col("target_no"), F.col("anchor")).alias("parent_key"),
        F.col("indexed_at").alias("lived_from"),
        F.col("deleted_at").alias("lived_to"),
    )


def disjoint(parents: DataFrame) -> DataFrame:
    """Lives of each key that overlap or meet merged into one; an open life has no end.

    Lives of one start combine before the sort, which streams by and can spill.
    """
    key = ["parent_table", "parent_key"]
    ends = F.struct(F.col("lived_to").isNull().alias("open"), "lived_to")
    starts = parents.groupBy(*key, "lived_from").agg(F.max(ends).alias("end"))
    in_order = Window.partitionBy(*key).orderBy("lived_from")
    before = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begun = starts.withColumn("before", before).withColumn("begins", F.coalesce(~F.col("before.open") & (F.col("lived_from") > F.col("before.lived_to")), F.lit(True)))
    runs = begun.withColumn("run", F.sum(F.col("begins").cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*key, "run").agg(F.min("lived_from").alias("lived_from"), F.max("end").alias("end")).select(*key, "lived_from", F.col("end.lived_to").alias("lived_to"))


def key_groups(children: DataFrame, parents: DataFrame, parent_table: str = "anchor_index") -> DataFrame:
    """Parents and children in long form, grouped by parent table and key.

    ``has_parent`` is the parent flag, ``lives`` the disjoint lives of the key
    (as many as the target was gone and entered again).
    """
    long_parents = disjoint(parents).select("parent_table", "parent_key", F.lit(True).alias("is_parent"), F.struct("lived_from", "lived_to").alias("life"), F.lit(0).alias("cites"))
    long_children = children.select(
        F.lit(parent_table).alias("parent_table"), "parent_key", F.lit(False).alias("is_parent"), F.lit(None).cast(long_parents.schema["life"].dataType).alias("life"), F.lit(1).alias("cites")
    )
    return (
        long_parents.unionByName(long_children)
        .groupBy("parent_table", "parent_key")
        .agg(F.max("is_parent").alias("has_parent"), F.collect_set("life").alias("lives"), F.sum("cites").alias("n_cites"))
        .filter("n_cites > 0")
    )


def orphans(children: DataFrame, parents: DataFrame, parent_table: str = "anchor_index") -> DataFrame:
    """Citations of which a needed key has no life at the citing time, with the month of citing.

    ``known_once``: every key it needs was a target at some time.
    """
    groups = key_groups(children, parents, parent_table).select("parent_key", "has_parent", "lives")
    alive = F.exists("lives", lambda x: (x["lived_from"] <= F.col("cited_at")) & (x["lived_to"].isNull() | (F.col("cited_at") < x["lived_to"])))
    dead = children.join(groups, "parent_key", "left").filter(~F.coalesce(F.col("has_parent") & alive, F.lit(False)))
    is_page = F.instr("parent_key", "#") == F.length("parent_key")
    per_citation = dead.groupBy("table_name", "record_id", "href", "cited_at").agg(
        F.min(F.coalesce("has_parent", F.lit(False))).alias("known_once"), F.count_if(is_page).alias("pages"), F.count_if(~is_page).alias("anchors")
    )
    # copies of a row have the same keys without a life, so either count is the number of copies
    copies = F.explode(F.sequence(F.lit(1), F.greatest("pages", "anchors").cast("int")))
    return per_citation.select("table_name", "record_id", "href", F.date_format("cited_at", "yyyy-MM").alias("period"), "known_once", copies.alias("copy")).drop("copy")


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per child table and month, split into never known and not alive then."""
    return found.groupBy("table_name", "period").agg(
        F.count("*").alias("n_orphans"), F.count_if(~F.col("known_once")).alias("n_never_known"), F.count_if("known_once").alias("n_not_alive")
    )
