"""Editorial maps over a corpus: forward and inverse indexes, coverage, contents, neighbours, previews.

Maps are long tables of pairs with a position; nested forms exist only at the
edge.  Small dimension tables (acts, orders) are joined, never hard-coded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import clip, half_up


def grouped(pairs: DataFrame, key: str, value: str, position: str, name: str = "targets") -> DataFrame:
    """One row a key with its distinct values in order of first position.

    The nested form is for the edge of a system: a row is as long as its key has
    distinct values.  Where a key may be hot, stay with the pairs.
    """
    first = pairs.groupBy(key, value).agg(F.min(position).alias("p"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", value))), lambda x: x[value]).alias(name), F.count("*").alias("n"))


def inverse_mismatches(forward: DataFrame, inverse: DataFrame, source: str, target: str, name: str = "targets") -> DataFrame:
    """Pairs that stand in one of two grouped maps and not in the other."""
    ahead = forward.select(source, F.explode(name).alias(target))
    back = inverse.select(F.explode(name).alias(source), target)
    return ahead.exceptAll(back).withColumn("missing_in", F.lit("inverse")).unionByName(back.exceptAll(ahead).withColumn("missing_in", F.lit("forward")))


def qualified(value: Column, act: Column) -> Column:
    """A bare number belongs to the act given; a key that names its act stays."""
    text = value.cast("string")
    return F.when(F.instr(text, ":") > 0, text).otherwise(F.concat_ws(":", act, text))


def reviewed_pairs(map_rows: DataFrame, key: str, targets: str, reviewed: str) -> DataFrame:
    """``key, target, pos, state``: pairs, and keys reviewed without a target apart from keys not reviewed."""
    rows = map_rows.select(key, reviewed, F.posexplode_outer(targets).alias("pos", "target"))
    state = F.when(F.col("target").isNotNull(), "mapped").when(F.col(reviewed), "none_relevant").otherwise("unreviewed")
    return rows.select(key, "target", "pos", state.alias("state"))


def related(pairs: DataFrame, details: DataFrame, key: str, value: str, text: str, size: int = 100) -> DataFrame:
    """Pairs with a short opening of what they point to; pairs that point nowhere fall out."""
    return pairs.join(details.select(value, clip(F.col(text), size).alias("opening")), value)


def target_href(target: Column, route_prefix: Column) -> Column:
    """``act:3`` is an article, ``act:bijlage:iii`` an annex, ``act`` the act itself."""
    rest = F.substring_index(target, ":", -1)
    return F.when(~F.contains(target, F.lit(":")), route_prefix).when(F.contains(target, F.lit(":bijlage:")), F.concat(route_prefix, F.lit("/bijlage/"), F.lower(rest))).otherwise(F.concat(route_prefix, F.lit("/artikel/"), rest))


def split_route(paths: DataFrame, acts: DataFrame, path: str, main: str) -> DataFrame:
    """The act of a path by the longest prefix that ends at a slash, and the rest of the path.

    Each path meets all its own prefixes in an equi-join.
    """
    steps = F.split(F.ltrim(F.col(path), F.lit("/")), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(steps, F.lit(1), n), "/")))
    found = (
        paths.select(path).distinct().select(path, F.explode(prefixes).alias("route_prefix")).join(acts.filter("route_prefix <> ''").select("act", "route_prefix"), "route_prefix")
        .groupBy(path).agg(F.max_by(F.struct("act", "route_prefix"), F.length("route_prefix")).alias("hit"))
    )
    rest = F.substring(F.col(path), F.length("hit.route_prefix") + 1, F.length(F.col(path)))
    return paths.join(found, path, "left").select(*paths.columns, F.coalesce("hit.act", F.lit(main)).alias("act"), F.when(F.col("hit").isNull(), F.col(path)).when(rest == "", "/").otherwise(rest).alias("local_path"))


def coverage(universe: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Every provision with its entry or none."""
    return universe.join(entries, keys, "left").withColumn("covered", F.col("disposition").isNotNull())


def coverage_tally(matrix: DataFrame, by: list[str], step: str = "stap") -> DataFrame:
    """Universe, covered, implementing, context and open per group."""
    covered, steps = F.count_if("covered"), F.count_if(F.col("disposition") == step)
    return matrix.groupBy(*by).agg(F.count("*").alias("universe"), covered.alias("covered"), steps.alias("steps"), (covered - steps).alias("context"), (F.count("*") - covered).alias("open"))


def contents(articles: DataFrame) -> DataFrame:
    """Chapters of an act with sections and articles nested, in order."""
    entry = F.struct("article_no", "title")
    listed = F.array_sort(F.collect_list(entry))
    sections = articles.groupBy("instrument", "chapter", "chapter_title", "section_roman").agg(listed.alias("articles"), F.min("article_no").alias("first_no"))
    return sections.groupBy("instrument", "chapter", "chapter_title").agg(
        F.array_sort(F.collect_list(F.struct("first_no", "section_roman", "articles"))).alias("sections"), F.sum(F.size("articles")).alias("n_articles"), F.min("first_no").alias("first_no")
    )


def neighbours_by_position(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """The rows before and after in order, whatever their numbers."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.select("*", F.lag(value).over(w).alias("previous"), F.lead(value).over(w).alias("next"))


def neighbours_by_number(rows: DataFrame, group: list[str], number: str) -> DataFrame:
    """The rows numbered one less and one more; a gap has no neighbour."""
    numbers = rows.select(*group, number).filter(F.col(number).isNotNull()).distinct()
    less = numbers.select(*group, (F.col(number) + 1).alias(number), F.col(number).alias("previous"))
    more = numbers.select(*group, (F.col(number) - 1).alias(number), F.col(number).alias("next"))
    return rows.join(less, [*group, number], "left").join(more, [*group, number], "left")


def number_ranges(articles: DataFrame) -> DataFrame:
    """First and last article of each chapter, as a line of text."""
    low, high = F.min("article_no"), F.max("article_no")
    return articles.groupBy("instrument", "chapter").agg(
        low.alias("first_no"), high.alias("last_no"), F.count("*").alias("n_articles"),
        F.when(F.count("*") > 1, F.concat(F.lit("Artikelen "), low, F.lit(" tot en met "), high)).otherwise(F.concat(F.lit("Artikel "), low)).alias("range_text"),
    )


def previews(hrefs: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Title and opening for each distinct ``href``: the paragraph an anchor names (itself or an anchor below it), else the first.

    ``paragraphs(page, para_pos, anchor, title, para_no, body)``.
    """
    wanted = hrefs.select("href").filter("href IS NOT NULL").distinct().withColumn("page", F.substring_index("href", "#", 1)).withColumn("fragment", F.when(F.contains("href", F.lit("#")), F.substring_index("href", "#", -1)))
    hit = (F.col("fragment") == F.col("anchor")) | F.col("fragment").startswith(F.concat(F.col("anchor"), F.lit("-")))
    joined = wanted.join(paragraphs, "page").withColumn("hit", F.coalesce(hit, F.lit(False)))
    best = F.min_by(F.struct("hit", "title", "para_no", "body"), F.struct((~F.col("hit")).alias("miss"), "para_pos"))
    title = F.concat(F.col("b.title"), F.when(F.col("b.hit") & F.col("b.para_no").isNotNull(), F.concat(F.lit(", lid "), F.col("b.para_no"))).otherwise(""))
    return joined.groupBy("href").agg(best.alias("b")).select("href", title.alias("title"), clip(F.col("b.body")).alias("snippet"))


def placed_dependencies(steps: DataFrame, needs: DataFrame, key: str = "step_id", group: str = "fase") -> DataFrame:
    """Dependencies with where the needed step stands, and whether that is in another group."""
    there = steps.select(F.col(key).alias("needs"), F.col(group).alias("needed_in"))
    return needs.join(steps.select(key, group), key).join(there, "needs", "left").withColumn("elsewhere", ~F.col(group).eqNullSafe(F.col("needed_in")))


def in_buckets(rows: DataFrame, column: str, order: list[str], rest: str = "overig") -> DataFrame:
    """Rows with a bucket and its place in a fixed order; what is not in the order comes last."""
    place = F.coalesce(*[F.when(F.col(column) == name, F.lit(i)) for i, name in enumerate(order)], F.lit(len(order)))
    return rows.withColumn("bucket", F.when(F.col(column).isin(order), F.col(column)).otherwise(rest)).withColumn("bucket_no", place)


def percent(done: Column, total: Column) -> Column:
    """Whole percent, halves upwards; 0 of nothing is 0."""
    return F.when(total > 0, half_up(F.lit(100.0) * done / total)).otherwise(F.lit(0)).cast("long")


def patched(rows: DataFrame, changes: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a column replaced by key, and the changes whose key is unknown."""
    news = changes.select(key, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    out = rows.join(news, key, "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).select(rows.columns)
    return out, changes.join(rows.select(key), key, "left_anti")
