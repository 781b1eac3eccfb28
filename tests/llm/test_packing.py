import random
from itertools import combinations

import numpy as np
import pytest

from lexweave.llm import packing as K
from tests.conftest import rows


def least(capacity, items):
    """Fewest containers, by search."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[i] <= capacity and bins[b] not in bins[:b]:
                go(i + 1, [*bins[:b], bins[b] + items[i], *bins[b + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0] if items else 0


def histogram(items):
    return {s: items.count(s) for s in set(items)}


def unpacked(solution):
    return [s for times, pattern in solution for _ in range(times) for s, k in pattern for _ in range(k)]


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_the_least_number(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 10, 13, 20])
    items = [rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(1, 10))]
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for s in items:
        counts[s] += 1
    fixed = K.reduce_by_dominance(capacity, counts)
    rest = [s for s in range(capacity + 1) for _ in range(counts[s])]
    assert sorted(unpacked(fixed) + rest) == sorted(items)
    assert all(sum(s * k for s, k in p) <= capacity for _, p in fixed)
    assert sum(t for t, _ in fixed) + least(capacity, rest) == least(capacity, items)


@pytest.mark.parametrize("seed", range(10))
def test_solution_holds_every_item_and_is_near_the_bound(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([50, 256, 1000])
    items = [min(capacity, max(1, int(rnd.expovariate(4 / capacity)))) for _ in range(5000)]
    solution = K.solve(capacity, histogram(items))
    assert sorted(unpacked(solution)) == sorted(items)
    assert all(sum(s * k for s, k in p) <= capacity for _, p in solution)
    assert sum(t for t, _ in solution) <= -(-sum(items) // capacity) * 1.02 + 1


def test_many_equal_items_are_cheap():
    solution = K.solve(100, {60: 10**9, 40: 10**9, 30: 10**10, 7: 10**9})
    assert sum(t for t, _ in solution) < 45 * 10**8 and len(solution) < 50
    assert sum(t * k for t, p in solution for s, k in p if s == 30) == 10**10


def packed(spark, docs, packs):
    sizes = spark.createDataFrame([(i, d, n) for i, (d, n) in enumerate(docs)], "row_key long, doc_id long, n_tokens long")
    return K.packed_items(sizes, spark.createDataFrame(packs, "pack_id int, capacity_tokens int"))


def test_rows(spark):
    rnd = random.Random(2)
    docs = [(i, 10) for i in range(150)] + [(1000 + i, rnd.randrange(0, 60)) for i in range(200)] + [(7, 10), (7, 10), (None, 25), (8, 500), (9, 0)]
    got = packed(spark, docs, [(1, 25), (2, 100), (3, None), (None, 9), (4, 0)])
    items = got.collect()
    for pack, capacity in ((1, 25), (2, 100)):
        mine = [r for r in items if r["pack_id"] == pack]
        want = sorted((str(d), n) for d, size in docs for n in [capacity] * (size // capacity) + [size % capacity] * (size % capacity > 0))
        assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in mine) == want
        fill = {}
        for r in mine:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
        assert max(fill.values()) <= capacity
        whole = {(d, size) for d, size in docs if size <= capacity}
        assert all(r["piece_no"] == 0 for r in mine if (r["doc_id"], r["n_tokens"]) in whole)
    assert {r["pack_id"] for r in items} == {1, 2}
    report = {r["pack_id"]: r for r in K.packing_report(K.containers(got)).collect()}
    assert report[2]["n_tokens"] == sum(n for _, n in docs) and report[2]["n_containers"] <= report[2]["least_containers"] + 2


def test_empty(spark):
    assert rows(packed(spark, [], [(1, 10)])) == [] and rows(packed(spark, [(1, 5)], [])) == []


def test_dominating_pairs_by_definition():
    for items in combinations(range(1, 10), 4):
        counts = np.bincount(items, minlength=11).astype(np.int64)
        fixed = K.reduce_by_dominance(10, counts)
        assert sum(t for t, _ in fixed) + least(10, [s for s in range(11) for _ in range(counts[s])]) == least(10, list(items))


def test_sets_of_three_are_fixed_in_bulk():
    counts = np.zeros(257, dtype=np.int64)
    counts[[254, 1, 200, 28]] = 10**9, 2 * 10**9, 10**9, 2 * 10**9
    fixed = K.reduce_by_dominance(256, counts)
    assert (10**9, [(1, 2), (254, 1)]) in fixed and (10**9, [(28, 2), (200, 1)]) in fixed and not counts.any()
