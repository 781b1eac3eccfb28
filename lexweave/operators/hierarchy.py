"""Parent–child rows to full hierarchies (problem 6).

Trees live inside a group (a contract).  Rows are reduced to one link per node
with a map-side combine, then brought together by group, and depths, roots and
paths grow level by level: the frontier of a level joins the unreached nodes on
their parent, until nothing is reached any more.  What is never reached lies on
a loop or below one.

Where the group fits a batch the frontier joins run on arrays of parent
pointers, for all groups of a batch at once; a path is read off the pointers
only when its row is given out, a bounded number of steps at a time.  Groups of
more than ``max_local`` rows – the only ones whose size is not bounded – take the
same joins as Spark joins on ``(group, node)``, one staged level after another,
so no task ever holds an unbounded group.

Defined results: rows with a blank node or no group key are skipped; of several
rows for a node the latest, then the highest row id, holds; a node whose parent
is blank, itself, or no node of the group is a root of depth 0; nodes on a loop
or below one have root '' and depth -1, an empty path and ``on_loop`` telling
the two apart; an empty table gives no rows; extra columns are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.codes import clean_code
from lexweave.sources.tables import shared_dir, stage

MAX_LOCAL = 100_000
#: steps of paths given out together by the joins on arrays
MAX_STEPS = 500_000

_NODE_SCHEMA = "group_key string, node string, parent string, rank string"


def latest_links(df: DataFrame, group: str, node: str, parent: str, rank: str, order: list[str]) -> DataFrame:
    """One row per (group, node): the link of its latest row."""
    return (
        df.select(F.col(group).alias("group_key"), clean_code(F.col(node)).alias("node"), clean_code(F.col(parent)).alias("parent"), F.col(rank).alias("rank"), F.struct(*order).alias("o"))
        .filter((F.col("node") != "") & F.col("group_key").isNotNull())
        .groupBy("group_key", "node")
        .agg(F.max_by(F.struct("parent", "rank"), "o").alias("l"))
        .select("group_key", "node", F.coalesce("l.parent", F.lit("")).alias("parent"), F.col("l.rank").alias("rank"))
    )


def _levels(pdf: pd.DataFrame, with_path: bool) -> Iterator[pd.DataFrame]:
    """Frontier joins over whole groups: each level gathers from the level before."""
    n = len(pdf)
    gid = pd.factorize(pdf["group_key"])[0].astype(np.int64)
    codes, _ = pd.factorize(pd.concat([pdf["node"], pdf["parent"]], ignore_index=True))
    width = np.int64(codes.max() + 1)
    node_key, parent_key = gid * width + codes[:n], gid * width + codes[n:]
    order = np.argsort(node_key)
    at = np.searchsorted(node_key[order], parent_key)
    at[at == n] = 0
    up = np.where(node_key[order][at] == parent_key, order[at], -1)
    me = np.arange(n)
    up[(up == me) | (pdf["parent"].to_numpy() == "")] = -1
    depth, root = np.full(n, -1), np.full(n, -1)
    reached = np.flatnonzero(up < 0)
    depth[reached], root[reached] = 0, reached
    nodes = pdf["node"].to_numpy(dtype=object)
    # children of each node stand together, so a level is gathered without looking at what still waits
    kids = np.argsort(up, kind="stable")
    first = np.searchsorted(up[kids], me)
    n_kids = np.searchsorted(up[kids], me, side="right") - first
    level, frontier = 0, reached
    while len(frontier := frontier[n_kids[frontier] > 0]):
        counts = n_kids[frontier]
        starts = np.repeat(first[frontier] - (np.cumsum(counts) - counts), counts)
        below = kids[starts + np.arange(counts.sum())]
        level += 1
        depth[below], root[below] = level, np.repeat(root[frontier], counts)
        frontier = below
    waiting = np.flatnonzero(depth < 0)
    # of what was never reached, strip the nodes nobody points to until only the loops are left
    loop, pointing = depth < 0, n_kids.copy()
    bare = waiting[pointing[waiting] == 0]
    while len(bare):
        loop[bare] = False
        above, times = np.unique(up[bare], return_counts=True)
        pointing[above] -= times
        bare = above[pointing[above] == 0]
    out = pd.DataFrame({"group_key": pdf["group_key"].to_numpy(), "node": nodes, "root": np.where(root >= 0, nodes[root], ""), "depth": depth.astype(np.int32), "rank": pdf["rank"].to_numpy(), "on_loop": loop})
    if not with_path:
        yield out
        return
    # rows are given out in pieces whose paths together have a bounded number of steps, or one row
    piece = np.cumsum(np.maximum(depth, 0) + 1) // MAX_STEPS
    for rows in np.split(me, np.flatnonzero(np.diff(piece)) + 1):
        yield out.iloc[rows].assign(path=_paths(rows, depth, up, nodes))


def _paths(rows: np.ndarray, depth: np.ndarray, up: np.ndarray, nodes: np.ndarray) -> list[np.ndarray]:
    """The nodes from the root to each row, read off the parent pointers, one step of all rows at a time."""
    sizes = depth[rows] + 1
    ends = np.cumsum(sizes)
    steps = np.empty(int(ends[-1]), dtype=np.int64)
    at, place = rows[sizes > 0], ends[sizes > 0] - 1
    stop = (ends - sizes)[sizes > 0]
    while len(at):
        steps[place] = at
        more = place > stop
        at, place, stop = up[at[more]], place[more] - 1, stop[more]
    return np.split(nodes[steps], ends[:-1])


def _local(with_path: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf["group_key"].to_numpy()
            last = int(np.argmax(keys == keys[-1]))  # rows are sorted, the last group may go on in the next batch
            if last == 0 and kept and kept[-1]["group_key"].iloc[-1] == keys[0]:
                kept.append(pdf)
                continue
            whole = pd.concat([*kept, pdf.iloc[:last]], ignore_index=True) if kept else pdf.iloc[:last].reset_index(drop=True)
            if len(whole):
                yield from _levels(whole, with_path)
            kept = [pdf.iloc[last:]]
        if kept:
            yield from _levels(pd.concat(kept, ignore_index=True), with_path)

    return run


def _schema(with_path: bool) -> str:
    return "group_key string, node string, root string, depth int, rank string, on_loop boolean" + ", path array<string>" * with_path


def local_hierarchy(links: DataFrame, with_path: bool = False) -> DataFrame:
    """Hierarchies of groups that each fit a batch (``MAX_LOCAL`` rows)."""
    gathered = links.select("group_key", "node", "parent", "rank").repartition("group_key").sortWithinPartitions("group_key")
    return gathered.mapInPandas(_local(with_path), _schema(with_path))


def distributed_hierarchy(links: DataFrame, with_path: bool = False) -> DataFrame:
    """The same joins as Spark joins on (group, node), one staged level after another."""
    spark = links.sparkSession
    names = links.select("group_key", F.col("node").alias("parent"), F.lit(True).alias("known"))
    edges = stage(
        links.join(names, ["group_key", "parent"], "left").select(
            "group_key", "node", "parent", "rank", (F.col("known").isNull() | (F.col("parent") == F.col("node")) | (F.col("parent") == "")).alias("is_root")
        ),
        "edges",
    )
    base = f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}"
    own_path = [F.array("node").alias("path")] if with_path else []
    level_schema = "group_key string, node string, root string, rank string" + ", path array<string>" * with_path
    edges.filter("is_root").select("group_key", "node", F.col("node").alias("root"), "rank", *own_path).write.parquet(f"{base}/depth=0")
    waiting, depth = edges.filter("NOT is_root").select("group_key", "node", "parent", "rank"), 0
    left, fresh = waiting.count(), 0
    reached_so_far = lambda: spark.read.schema(level_schema + ", depth int").option("basePath", base).parquet(base)
    while True:
        frontier = spark.read.schema(level_schema).parquet(f"{base}/depth={depth}").select("group_key", F.col("node").alias("parent"), "root", *(["path"] if with_path else []))
        reached = waiting.join(frontier, ["group_key", "parent"])
        deeper = [F.concat("path", F.array("node")).alias("path")] if with_path else []
        depth += 1
        reached.select("group_key", "node", "root", "rank", *deeper).write.parquet(f"{base}/depth={depth}")
        n = spark.read.schema(level_schema).parquet(f"{base}/depth={depth}").count()
        if not n:
            break
        fresh += n
        if 2 * fresh >= left:  # levels read what still waits, so it is cut whenever half of it is reached
            waiting = stage(waiting.join(reached_so_far().select("group_key", "node"), ["group_key", "node"], "left_anti"), "waiting")
            left, fresh = left - fresh, 0
    done = reached_so_far()
    lost = stage(waiting.join(done.select("group_key", "node"), ["group_key", "node"], "left_anti"), "unreached")
    loops, size = lost, -1
    while (now := loops.count()) != size:
        size = now
        loops = stage(loops.join(loops.select("group_key", F.col("parent").alias("node")).distinct(), ["group_key", "node"], "left_semi"), "loops")
    lost = lost.join(loops.select("group_key", "node", F.lit(True).alias("l")), ["group_key", "node"], "left")
    empty = [F.array().cast("array<string>").alias("path")] if with_path else []
    columns = ["group_key", "node", "root", "depth", "rank", "on_loop"] + ["path"] * with_path
    return done.withColumn("on_loop", F.lit(False)).select(columns).unionByName(
        lost.select("group_key", "node", F.lit("").alias("root"), F.lit(-1).alias("depth"), "rank", F.coalesce("l", F.lit(False)).alias("on_loop"), *empty).select(columns)
    )


def hierarchy(df: DataFrame, group: str, node: str, parent: str, rank: str, order: list[str], with_path: bool = False, max_local: int = MAX_LOCAL) -> DataFrame:
    """``group_key, node, root, depth, rank, on_loop[, path]`` of every node of every group."""
    large = df.groupBy(F.col(group).alias("group_key")).count().filter(F.col("count") > max_local).select("group_key")
    links = latest_links(df, group, node, parent, rank, order)
    if large.isEmpty():
        return local_hierarchy(links, with_path)
    large = stage(large, "large-groups")
    small = local_hierarchy(links.join(large, "group_key", "left_anti"), with_path)
    return small.unionByName(distributed_hierarchy(links.join(large, "group_key", "left_semi"), with_path))


def ancestor_pairs(tree: DataFrame) -> DataFrame:
    """``group_key, ancestor, descendant, distance`` from the paths of ``hierarchy``."""
    return (
        tree.filter("depth > 0")
        .select("group_key", F.col("node").alias("descendant"), "depth", F.posexplode(F.expr("slice(path, 1, depth)")).alias("pos", "ancestor"))
        .select("group_key", "ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))
    )
