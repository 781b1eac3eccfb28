"""Mixing sources to target weights (problem 8).

The amounts follow from the token totals of the sources alone: the targets of
the sources that have tokens, scaled to one, are met exactly by the largest
total no source must be repeated too often for.  Each source is cut into blocks
by a hash of its texts; whole passes take every block, the last pass takes as
many of the permuted blocks as fit, and from the blocks behind them the texts
that come nearest to the amount.

Output shards get their texts by slices of about equal tokens, several thousand
to a shard, so their number grows with the mix and not with the rows.  At every
node of a splitting tree the slice counts of all sources are divided between the
two halves by one draw from the multivariate hypergeometric distribution, so
every shard has an exact quota of slices of each source and together they use
each slice once.  The top of the tree is split on the driver, what lies below it
by tasks.  A hash puts every use of a text into a slice; shards then shuffle
their texts locally.

Only one row a source and the nodes of the top meet on the driver; which slices
are of which shard is a table.

Defined results: texts without a source, of a source without a target, or
without tokens are not used; sources without tokens reach share 0 and their
weight goes to the others in proportion; a null repeat cap counts as 1; repeated
rows are texts of their own; empty tables give an empty mix; extra columns are
never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_SOURCES = 10_000
#: texts a block holds at most on average, blocks of a source at least, texts to choose from for what is missing
ROWS_PER_BLOCK, LEAST_BLOCKS, ROWS_TO_CHOOSE = 100_000, 64, 100_000
SHARD_TOKENS = 2_000_000
#: slices of a shard, all sources together, and slices that are looked up together
SLICES_PER_SHARD, SLICES_PER_RANGE = 4096, 64
#: nodes of the splitting tree that the driver splits down to, and the most one draw can divide
TOP_NODES, MOST_DRAWN = 1024, 900_000_000
SEED = 17


@dataclass(frozen=True)
class Source:
    name: str
    share: float
    max_repeats: int
    n_rows: int
    n_tokens: int


def amounts(sources: list[Source]) -> dict[str, float]:
    """Tokens to take of each source: shares exact, total as large as the caps allow."""
    usable = [s for s in sources if s.share > 0 and s.n_tokens > 0 and s.max_repeats > 0]
    if not usable:
        return {}
    whole = sum(s.share for s in usable)
    total = min(s.max_repeats * s.n_tokens * whole / s.share for s in usable)
    return {s.name: total * s.share / whole for s in usable}


def draw(left: np.ndarray, take: int, rng: np.random.Generator, most: int = MOST_DRAWN) -> np.ndarray:
    """``take`` slices of those left, by the multivariate hypergeometric distribution; of very many in equal strata."""
    strata = max(1, -(-int(left.sum()) // most))
    out = np.zeros_like(left)
    for i in range(strata):
        part = left * (i + 1) // strata - left * i // strata
        size = int(part.sum())
        wanted = min(size, take * (i + 1) // strata - take * i // strata) if i + 1 < strata else take - int(out.sum())
        out += rng.multivariate_hypergeometric(part, min(size, wanted), method="marginals") if size else part
    missing = take - int(out.sum())
    for k in np.argsort(out - left):  # a last stratum too small for what was still wanted
        more = min(missing, int(left[k] - out[k]))
        out[k] += more
        missing -= more
    return out


def split(quotas: np.ndarray, lo: int, hi: int, starts: np.ndarray, rng: np.random.Generator, width: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Nodes ``(lo, hi, starts, quotas)`` of at most ``width`` shards, by recursive hypergeometric splits."""
    waiting = [(lo, hi, starts, quotas)]
    while waiting:
        lo, hi, starts, left = waiting.pop()
        if hi - lo <= width:
            yield lo, hi, starts, left
            continue
        mid = (lo + hi) // 2
        part = draw(left, round(int(left.sum()) * (mid - lo) / (hi - lo)), rng)
        waiting += [(mid, hi, starts + part, left - part), (lo, mid, starts, part)]


def split_blocks(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Slices of each source for each shard (shards × sources)."""
    nodes = split(quotas.astype(np.int64), 0, shards, np.zeros(len(quotas), dtype=np.int64), rng)
    return np.array([left for *_, left in nodes]).reshape(shards, len(quotas))


def mix(sizes: DataFrame, targets: DataFrame, seed: int = SEED, shard_tokens: int = SHARD_TOKENS, rows_per_block: int = ROWS_PER_BLOCK, rows_to_choose: int = ROWS_TO_CHOOSE) -> DataFrame:
    """``shard_no, position, source, doc_id, repeat_no, n_tokens`` of every text of the mix.

    ``sizes`` is a staged table with ``row_key, doc_id, source, n_tokens``.
    """
    spark = sizes.sparkSession
    schema = "shard_no int, position int, source string, doc_id long, repeat_no int, n_tokens long"
    wanted = targets.filter("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("cap"))
    used = sizes.filter("n_tokens > 0 AND source IS NOT NULL").select("row_key", "doc_id", "source", "n_tokens")
    rows = wanted.join(used.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")), "source", "left").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = sorted((Source(r["source"], r["share"], r["cap"], r["n"] or 0, r["t"] or 0) for r in rows), key=lambda s: s.name)
    take = amounts(sources)
    if not take:
        return spark.createDataFrame([], schema)
    total = sum(take.values())
    shards = max(1, round(total / shard_tokens))
    slices = {name: max(1, round(n / total * shards * SLICES_PER_SHARD)) for name, n in take.items()}
    passes = {s.name: divmod(take[s.name], s.n_tokens) for s in sources if s.name in take}
    # one row a source: at most MAX_SOURCES
    shape = [(s.name, max(LEAST_BLOCKS, -(-s.n_rows // rows_per_block)), int(passes[s.name][0]), float(passes[s.name][1]), slices[s.name]) for s in sources if s.name in take]
    shape_df = spark.createDataFrame(shape, "source string, n_blocks long, passes int, rest double, n_slices long")
    blocked = used.join(F.broadcast(shape_df), "source").withColumn("block", F.pmod(F.xxhash64("row_key", F.lit(seed)), "n_blocks"))
    edges = {r["source"]: (r["last_block"], r["end_block"], r["missing"]) for r in _last_pass(blocked, rows_to_choose).collect()}
    plan = spark.createDataFrame([(name, *edges[name]) for name, *_ in shape], "source string, last_block long, end_block long, missing double")
    planned = blocked.join(F.broadcast(plan), "source")
    uses = F.col("passes") + (F.col("block") <= F.col("last_block")).cast("int")
    whole = planned.withColumn("uses", uses).filter("uses > 0").select("row_key", "doc_id", "source", "n_tokens", "n_slices", F.explode(F.expr("sequence(0, uses - 1)")).alias("repeat_no"))
    parts = whole.unionByName(_chosen(planned.filter("block > last_block AND block <= end_block AND missing >= 1"), seed))
    sliced = parts.withColumn("slice", F.pmod(F.xxhash64("row_key", "repeat_no", F.lit(seed + 3)), "n_slices")).withColumn("span", F.expr(f"slice div {SLICES_PER_RANGE}"))
    runs = slice_runs(spark, slices, shards, seed)
    ranged = runs.select("source", "shard_no", "first", "last", F.explode(F.expr(f"sequence(first div {SLICES_PER_RANGE}, last div {SLICES_PER_RANGE})")).alias("span"))
    placed = sliced.join(ranged, ["source", "span"]).filter("slice BETWEEN first AND last")
    place = Window.partitionBy("shard_no").orderBy(F.xxhash64("row_key", "repeat_no", F.lit(seed + 2)), "row_key", "repeat_no")
    return placed.select("shard_no", F.row_number().over(place).alias("position"), "source", "doc_id", "repeat_no", "n_tokens")


def _last_pass(blocked: DataFrame, rows_to_choose: int) -> DataFrame:
    """``source, last_block, end_block, missing``: the last block the pass takes whole, the last one to choose texts from, and the tokens these are to fill.

    Blocks are counted, not texts: a window over them is one row in ``ROWS_PER_BLOCK``.
    """
    in_order, whole = Window.partitionBy("source").orderBy("block"), Window.partitionBy("source")
    totals = blocked.groupBy("source", "rest", "block").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c"))
    sums = totals.withColumn("tokens", F.sum("t").over(in_order)).withColumn("texts", F.sum("c").over(in_order)).withColumn("fits", F.col("tokens") <= F.col("rest"))
    sums = sums.withColumn("before", F.coalesce(F.max(F.when(F.col("fits"), F.col("texts"))).over(whole), F.lit(0)))
    near = ~F.col("fits") & (F.col("texts") - F.col("c") - F.col("before") < rows_to_choose)
    return sums.groupBy("source", "rest").agg(
        F.coalesce(F.max(F.when(F.col("fits"), F.col("block"))), F.lit(-1)).alias("last_block"), F.coalesce(F.max(F.when(near, F.col("block"))), F.lit(-1)).alias("end_block"),
        (F.col("rest") - F.coalesce(F.max(F.when(F.col("fits"), F.col("tokens"))), F.lit(0))).alias("missing"),
    )


def _chosen(near: DataFrame, seed: int) -> DataFrame:
    """Of the texts near the edge of each source, those that fill up what is missing.

    Sizes are taken from large to small as often as they fit, so what stays
    missing is less than the smallest text.  A source has ``ROWS_TO_CHOOSE``
    texts and those of one block here, whatever its own size.
    """
    columns = ["row_key", "doc_id", "source", "n_tokens", "n_slices", "repeat_no"]
    rows = near.select("row_key", "doc_id", "source", "n_tokens", "n_slices", F.col("passes").alias("repeat_no"), "missing", F.xxhash64("row_key", F.lit(seed + 1)).alias("_order"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        left = int(pdf["missing"].iloc[0])
        pdf = pdf.sort_values(["n_tokens", "_order", "row_key"], ascending=[False, True, True], kind="stable")
        keep = np.zeros(len(pdf), dtype=bool)
        sizes, first, counts = np.unique(-pdf["n_tokens"].to_numpy(), return_index=True, return_counts=True)
        for size, at, n in zip(-sizes, first, counts):
            k = min(int(n), left // int(size))
            keep[at : at + k] = True
            left -= k * int(size)
        return pdf.loc[keep, columns]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy("source").applyInPandas(fill, ", ".join(f"{c} {kinds[c]}" for c in columns))


def slice_runs(spark: SparkSession, slices: dict[str, int], shards: int, seed: int, top_nodes: int = TOP_NODES) -> DataFrame:
    """``source, shard_no, first, last``: the slices of each source in each shard, consecutive as the hash has permuted the texts."""
    names = list(slices)
    quotas = np.array(list(slices.values()), dtype=np.int64)
    nodes = split(quotas, 0, shards, np.zeros_like(quotas), np.random.default_rng(seed), width=-(-shards // top_nodes))
    rows = [(lo, hi, starts.tolist(), left.tolist()) for lo, hi, starts, left in nodes]
    top = spark.createDataFrame(rows, "lo long, hi long, starts array<long>, quotas array<long>").repartition(min(len(rows), 4 * spark.sparkContext.defaultParallelism))

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for node_lo, node_hi, node_starts, node_quotas in zip(pdf["lo"], pdf["hi"], pdf["starts"], pdf["quotas"]):
                rng = np.random.default_rng([seed, int(node_lo)])
                leaves = split(np.array(node_quotas, dtype=np.int64), int(node_lo), int(node_hi), np.array(node_starts, dtype=np.int64), rng)
                runs = [(name, lo, int(a), int(a + n) - 1) for lo, _, starts, left in leaves for name, a, n in zip(names, starts, left) if n]
                yield pd.DataFrame(runs, columns=["source", "shard_no", "first", "last"])

    return top.mapInPandas(below, "source string, shard_no int, first long, last long")


def reached_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share of each source, and how often its texts were used at most."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_texts"), (F.max("repeat_no") + 1).alias("times_used"))
    whole = got.agg(F.sum("n_tokens").alias("all_tokens"))
    return (
        targets.join(got, "source", "left")
        .join(F.broadcast(whole))
        .select(
            "source", "target_share", "max_repeats", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("times_used", F.lit(0)).alias("times_used"),
            F.round(F.coalesce("n_tokens", F.lit(0)) / F.col("all_tokens"), 6).alias("share_reached"),
        )
    )


def shard_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Tokens and reached share of each source in each shard, also of sources a shard has nothing of."""
    got = mixed.groupBy("shard_no", "source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_texts"))
    whole = got.groupBy("shard_no").agg(F.sum("n_tokens").alias("shard_tokens"))
    wanted = targets.filter("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    n_tokens = F.coalesce("n_tokens", F.lit(0))
    return whole.crossJoin(wanted).join(got, ["shard_no", "source"], "left").select(
        "shard_no", "source", "target_share", n_tokens.alias("n_tokens"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.round(n_tokens / F.col("shard_tokens"), 6).alias("share_reached")
    )
