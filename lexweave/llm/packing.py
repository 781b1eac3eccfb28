"""Filling containers of fixed capacity with whole texts (problem 7).

A text longer than the capacity is divided into pieces of exactly the capacity,
which fill a container each, and a remainder; nothing else is divided.  What is
left to pack has integer sizes up to the capacity, so the instance is its
histogram – at most ``capacity`` numbers, whatever the number of texts.  On the
histogram the Martello–Toth dominance reduction fixes sets that some best
packing must contain, and best-fit decreasing packs the remainder, many equal
containers at a time.  The solution is a list of container patterns with how
often each is used.

Texts then take their places by rank: ranks within a size are counted in
buckets, so a size shared by a third of all texts is numbered by many tasks, and
a place is found by binary search in the sorted patterns.

Defined results: null and empty texts have size 0, take no room and are in no
container; repeated rows are packed as often as they stand; packs with null or
non-positive capacity are left out; an empty table gives no containers; extra
columns are never read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: packs at most, and their capacities together: the sizes that are counted on the driver
MAX_PACKS, MAX_CAPACITY = 100, 1_000_000
ROWS_PER_BUCKET = 1_000_000

Pattern = list[tuple[int, int]]


def reduce_by_dominance(capacity: int, counts: np.ndarray) -> list[tuple[int, Pattern]]:
    """Fixes dominating sets of one, two or three items; ``counts`` is left with the rest.

    A set holding the item ``j`` may be fixed when every feasible set with ``j``
    can be exchanged for it: alone when nothing else fits; with its exact
    complement; with the largest fitting item when no two others fit together,
    or when no pair beside ``j`` is larger and no three fit.  Taking items away
    leaves each of these reasons standing, so a set is fixed as often as its
    items last, in one step.
    """
    fixed: list[tuple[int, Pattern]] = []

    def fix(items: list[int]) -> None:
        sizes, n = np.unique(items, return_counts=True)
        times = (counts[sizes] // n).min()
        for s, k in zip(sizes, n):
            counts[s] -= times * k
        fixed.append((int(times), [(int(s), int(k)) for s, k in zip(sizes, n)]))

    def smallest(k: int, without: int) -> list[int]:
        out: list[int] = []
        for s in np.flatnonzero(counts):
            free = int(counts[s]) - (s == without)
            out += [int(s)] * min(free, k - len(out))
            if len(out) == k:
                break
        return out

    def largest(room: int, without: int) -> int:
        for s in np.flatnonzero(counts[: room + 1])[::-1]:
            if counts[s] - (s == without) > 0:
                return int(s)
        return 0

    changed = True
    while changed:
        changed = False
        for j in np.flatnonzero(counts)[::-1].tolist():
            while counts[j] > 0:
                room = capacity - j
                low = smallest(3, j)
                if not low or low[0] > room:  # nothing fits beside j, and neither beside another j
                    fix([j])
                elif (i := largest(room, j)) == room or len(low) < 2 or low[0] + low[1] > room:
                    fix([j, i])
                elif len(low) < 3 or sum(low) > room:
                    a, b = _largest_pair(counts, room, j)
                    if i >= a + b:
                        fix([j, i])
                    elif i == a and _best_partner(counts, room, j, a) == b and not _other_pair(counts, room, j, a, b):
                        fix([j, a, b])
                    else:
                        break
                else:
                    break
                changed = True
    return fixed


def _free(counts: np.ndarray, without: int) -> np.ndarray:
    free = counts.copy()
    free[without] -= 1
    return free


def _largest_pair(counts: np.ndarray, room: int, j: int) -> tuple[int, int]:
    """The pair beside ``j`` with the largest sum that fits, larger item first."""
    free, best = _free(counts, j), (0, 0)
    sizes = np.flatnonzero(free[: room + 1] > 0)
    for a in sizes[::-1].tolist():
        if 2 * a < sum(best):
            break
        partners = sizes[(sizes <= min(a, room - a))]
        partners = partners[(partners != a) | (free[a] > 1)]
        if len(partners) and a + int(partners[-1]) > sum(best):
            best = (a, int(partners[-1]))
    return best


def _best_partner(counts: np.ndarray, room: int, j: int, a: int) -> int:
    free = _free(_free(counts, j), a)
    sizes = np.flatnonzero(free[: room - a + 1] > 0)
    return int(sizes[-1]) if len(sizes) else 0


def _other_pair(counts: np.ndarray, room: int, j: int, a: int, b: int) -> bool:
    """Whether a pair fits beside ``j`` that {a, b} does not dominate: both of its items larger than ``b``."""
    free = _free(_free(counts, j), a)
    above = np.flatnonzero(free[: room + 1] > 0)
    above = above[above > b]
    if not len(above):
        return False
    first = int(above[0])
    second = first if free[first] > 1 else int(above[1]) if len(above) > 1 else room + 1
    return first + second <= room


def best_fit(capacity: int, counts: np.ndarray) -> list[tuple[int, Pattern]]:
    """Best-fit decreasing on a histogram: equal containers are filled together."""
    groups: dict[int, list[tuple[int, tuple]]] = {}  # room left -> [(containers, linked items)]
    rooms: list[int] = []

    def put(room: int, times: int, items: tuple) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((times, items))

    for s in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[s])
        while n:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                per = capacity // s
                if n >= per:
                    put(capacity - per * s, n // per, ((), s, per))
                if n % per:
                    put(capacity - (n % per) * s, 1, ((), s, n % per))
                n = 0
                continue
            room = rooms[at]
            times, items = groups[room].pop()
            used = min(n, times)
            if used < times:
                groups[room].append((times - used, items))
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            put(room - s, used, (items, s, 1))
            n -= used
    out = []
    for room in rooms:
        for times, items in groups[room]:
            pattern: dict[int, int] = {}
            while items:
                items, s, k = items
                pattern[s] = pattern.get(s, 0) + k
            out.append((times, sorted(pattern.items())))
    return out


def solve(capacity: int, histogram: dict[int, int]) -> list[tuple[int, Pattern]]:
    """Container patterns ``(times, [(size, items of the size)])`` holding every item of the histogram."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in histogram.items():
        counts[size] = n
    fixed = reduce_by_dominance(capacity, counts)
    return fixed + best_fit(capacity, counts)


class Places:
    """Where the item of a pack, size and rank goes: sorted slots, searched in whole columns."""

    def __init__(self, packs: dict[int, tuple[int, list[tuple[int, Pattern]]]]):
        rows: list[tuple[int, int, int, int, int]] = []  # pack, size, first rank, first container, items a container
        for pack, (_, patterns) in sorted(packs.items()):
            taken: dict[int, int] = {}
            container = 0
            for times, pattern in patterns:
                for size, k in pattern:
                    rows.append((pack, size, taken.get(size, 0), container, k))
                    taken[size] = taken.get(size, 0) + times * k
                container += times
        rows.sort()
        table = np.array(rows, dtype=np.int64).reshape(-1, 5)
        self.key = table[:, :2]
        self.first, self.container, self.items = table[:, 2], table[:, 3], table[:, 4]
        self.starts = {(int(p), int(s)): i for i, (p, s) in reversed(list(enumerate(self.key.tolist())))}

    def find(self, pack: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.empty(len(rank), dtype=np.int64)
        order = np.lexsort((size, pack))
        cuts = np.flatnonzero((np.diff(pack[order]) != 0) | (np.diff(size[order]) != 0)) + 1
        for rows in np.split(order, cuts) if len(order) else []:
            p, s = int(pack[rows[0]]), int(size[rows[0]])
            lo = self.starts[p, s]
            hi = lo + int(np.searchsorted((self.key[lo:, 0] != p) | (self.key[lo:, 1] != s), True)) if lo < len(self.key) else lo
            slot = lo + np.searchsorted(self.first[lo:hi], rank[rows], side="right") - 1
            out[rows] = self.container[slot] + (rank[rows] - self.first[slot]) // self.items[slot]
        return out


def bounded_packs(pack_sizes: DataFrame) -> dict[int, int]:
    rows = pack_sizes.filter("pack_id IS NOT NULL AND capacity_tokens > 0").groupBy("pack_id").agg(F.max("capacity_tokens").alias("c")).limit(MAX_PACKS + 1).collect()
    if len(rows) > MAX_PACKS or sum(r["c"] for r in rows) > MAX_CAPACITY:
        raise ValueError(f"more than {MAX_PACKS} packs, or capacities above {MAX_CAPACITY} together")
    return {r["pack_id"]: r["c"] for r in rows}


def packed_items(sizes: DataFrame, pack_sizes: DataFrame) -> DataFrame:
    """``pack_id, capacity, container_id, doc_id, piece_no, n_tokens`` of every piece of every text.

    ``sizes`` is a staged table with ``row_key, doc_id, n_tokens``.
    """
    spark = sizes.sparkSession
    packs = bounded_packs(pack_sizes)
    schema = "pack_id int, capacity int, container_id string, doc_id long, piece_no long, n_tokens long"
    if not packs:
        return spark.createDataFrame([], schema)
    table = F.array(*[F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("int").alias("capacity")) for p, c in sorted(packs.items())])
    per_pack = sizes.filter("n_tokens > 0").select("row_key", "doc_id", "n_tokens", F.explode(table).alias("k")).select("row_key", "doc_id", "n_tokens", "k.pack_id", "k.capacity")
    full = per_pack.filter("n_tokens >= capacity").select(
        "pack_id", "capacity", "row_key", "doc_id", F.explode(F.expr("sequence(0L, n_tokens div capacity - 1)")).alias("piece_no")
    ).select("pack_id", "capacity", F.concat_ws("-", F.lit("full"), "row_key", "piece_no").alias("container_id"), "doc_id", "piece_no", F.col("capacity").cast("long").alias("n_tokens"))
    rest = per_pack.withColumn("size", F.col("n_tokens") % F.col("capacity")).filter("size > 0").select("pack_id", "capacity", "row_key", "doc_id", F.expr("n_tokens div capacity").alias("piece_no"), "size")

    histogram: dict[int, dict[int, int]] = {p: {} for p in packs}
    total = 0
    for r in rest.groupBy("pack_id", "size").count().collect():  # at most the sum of the capacities
        histogram[r["pack_id"]][r["size"]] = r["count"]
        total += r["count"]
    places = Places({p: (c, solve(c, histogram[p])) for p, c in packs.items()})

    buckets = max(8, -(-total // ROWS_PER_BUCKET))
    rest = rest.withColumn("bucket", F.pmod(F.xxhash64("row_key"), F.lit(buckets)))
    before = Window.partitionBy("pack_id", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rest.groupBy("pack_id", "size", "bucket").count().select("pack_id", "size", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("pack_id", "size", "bucket").orderBy("row_key")
    ranked = rest.withColumn("n", F.row_number().over(within)).join(offsets, ["pack_id", "size", "bucket"]).withColumn("rank", F.col("n") + F.col("offset") - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            found = places.find(pdf["pack_id"].to_numpy(np.int64), pdf["size"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64))
            yield pdf[["pack_id", "capacity"]].assign(container_id=["mix-" + str(c) for c in found], doc_id=pdf["doc_id"], piece_no=pdf["piece_no"], n_tokens=pdf["size"])

    placed = ranked.select("pack_id", "capacity", "doc_id", "piece_no", "size", "rank").mapInPandas(run, schema)
    return full.unionByName(placed)


def containers(items: DataFrame) -> DataFrame:
    """One row a container: fill, number of pieces and content; a container holds at most ``capacity`` pieces."""
    return (
        items.groupBy("pack_id", "container_id")
        .agg(
            F.first("capacity").alias("capacity"),
            F.sum("n_tokens").alias("fill"),
            F.count("*").alias("n_pieces"),
            F.array_sort(F.collect_list(F.struct("doc_id", "piece_no", "n_tokens"))).alias("content"),
        )
        .withColumn("fill_share", F.round(F.col("fill") / F.col("capacity"), 6))
    )


def packing_report(filled: DataFrame) -> DataFrame:
    """Containers, tokens, unused space and the least possible number of containers per pack."""
    return filled.groupBy("pack_id", "capacity").agg(
        F.count("*").alias("n_containers"),
        F.sum("fill").alias("n_tokens"),
        F.ceil(F.sum("fill") / F.col("capacity")).alias("least_containers"),
        F.round(F.sum("fill") / (F.count("*") * F.col("capacity")), 6).alias("fill_share"),
    )
