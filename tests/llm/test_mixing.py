import random

import numpy as np
from pyspark.sql import functions as F

from lexweave.llm import mixing as M
from tests.conftest import rows


def mixed(spark, docs, targets, **kw):
    sizes = spark.createDataFrame([(i, i, s, n, 0) for i, (s, n) in enumerate(docs)], "row_key long, doc_id long, source string, n_tokens long, block int")
    goals = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return M.mix(sizes, goals, **kw), goals


def test_amounts():
    s = [M.Source("a", 0.5, 1, 1, 100), M.Source("b", 0.3, 4, 1, 10), M.Source("c", 0.2, 2, 0, 0)]
    take = M.amounts(s)
    assert "c" not in take and abs(take["a"] / take["b"] - 5 / 3) < 1e-9
    assert abs(max(take["a"] / 100, take["b"] / 40) - 1) < 1e-9


def test_split_is_exact_and_fair():
    rng = np.random.default_rng(1)
    quotas = np.array([1000, 37, 0, 400])
    parts = M.split_blocks(quotas, 7, rng)
    assert (parts.sum(axis=0) == quotas).all() and (parts >= 0).all()
    assert parts.sum(axis=1).max() - parts.sum(axis=1).min() <= 2
    mean = sum(M.split_blocks(quotas, 2, rng)[0] for _ in range(300)) / 300
    assert abs(mean[0] - 500) < 5 and abs(mean[1] - 18.5) < 1


def test_shares_caps_and_disjoint_use(spark):
    rnd = random.Random(3)
    docs = [("big", rnd.randrange(1, 400)) for _ in range(3000)] + [("small", rnd.randrange(1, 400)) for _ in range(300)] + [(None, 9), ("other", 9), ("small", 0), ("big", 30000)]
    got, goals = mixed(spark, docs, [("big", 0.6, 1), ("small", 0.3, 3), ("gone", 0.1, 5), (None, 0.2, 1)], shard_tokens=20000)
    out = got.collect()
    assert len({(r["doc_id"], r["repeat_no"]) for r in out}) == len(out)
    tokens = {s: sum(r["n_tokens"] for r in out if r["source"] == s) for s in ("big", "small")}
    assert set(r["source"] for r in out) == {"big", "small"}
    assert abs(tokens["big"] / sum(tokens.values()) - 2 / 3) < 0.002
    assert max(r["repeat_no"] for r in out if r["source"] == "small") <= 2 and max(r["repeat_no"] for r in out if r["source"] == "big") == 0
    for s in {r["shard_no"] for r in out}:
        assert sorted(r["position"] for r in out if r["shard_no"] == s) == list(range(1, 1 + sum(r["shard_no"] == s for r in out)))
    report = {r["source"]: r for r in M.reached_shares(got, goals.filter("source IS NOT NULL")).collect()}
    assert report["gone"]["share_reached"] == 0 and abs(report["small"]["share_reached"] - 1 / 3) < 0.002 and report["small"]["times_used"] <= 3
    again, _ = mixed(spark, docs, [("big", 0.6, 1), ("small", 0.3, 3), ("gone", 0.1, 5), (None, 0.2, 1)], shard_tokens=20000)
    assert rows(again) == rows(got)


def test_ties_and_empty(spark):
    got, _ = mixed(spark, [("a", 10)] * 50 + [("b", 10)] * 50, [("a", 0.5, None), ("b", 0.5, 1)])
    assert len(got.collect()) == 100
    assert rows(mixed(spark, [], [("a", 1.0, 1)])[0]) == []
    assert rows(mixed(spark, [("a", 5)], [])[0]) == []


def test_every_shard_has_the_target_weights(spark):
    docs = [("big", 10)] * 15000 + [("small", 10)] * 5000
    got, goals = mixed(spark, docs, [("big", 0.75, 1), ("small", 0.25, 1)], shard_tokens=2000)
    shares = M.shard_shares(got, goals).filter("source = 'small'").collect()
    assert sorted(r["shard_no"] for r in shares) == list(range(100))
    assert all(0.08 < r["share_reached"] < 0.45 for r in shares) and sum(r["n_texts"] for r in shares) == 5000
    sizes = [r["n"] for r in got.groupBy("shard_no").agg(F.sum("n_tokens").alias("n")).collect()]
    assert min(sizes) > 1300 and max(sizes) < 2700


def test_very_many_slices_are_drawn_in_strata():
    rng = np.random.default_rng(2)
    left = np.array([5000, 3000, 1, 0, 1999])
    for take in (0, 1, 4999, 10_000):
        part = M.draw(left, take, rng, most=700)
        assert part.sum() == take and (part >= 0).all() and (part <= left).all()
    mean = sum(M.draw(left, 5000, rng, most=700) for _ in range(200)) / 200
    assert abs(mean[0] - 2500) < 15 and abs(mean[1] - 1500) < 15


def test_runs_use_every_slice_once_however_the_tree_is_cut(spark):
    slices = {"a": 900, "b": 333, "c": 1}
    for top in (1, 3, 1024):
        runs = M.slice_runs(spark, slices, 41, 5, top).collect()
        for name, n in slices.items():
            own = sorted((r["first"], r["last"]) for r in runs if r["source"] == name)
            assert [i for a, b in own for i in range(a, b + 1)] == list(range(n))
        assert {r["shard_no"] for r in runs} == set(range(41))


def test_many_shards_none_empty_each_mixed(spark):
    """1 500 shards of eight equal sources, 160 texts each: every shard holds every source, its share within six standard deviations (0.028)."""
    n = 240_000
    sizes = spark.range(n).select(F.col("id").alias("row_key"), F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 8).alias("source"), (20 + F.col("id") % 61).alias("n_tokens"))
    goals = spark.createDataFrame([(f"s{i}", 0.125, 1) for i in range(8)], "source string, target_share double, max_repeats int")
    total = sizes.agg(F.sum("n_tokens")).first()[0]
    got = M.mix(sizes, goals, shard_tokens=total // 1500)
    shares = M.shard_shares(got, goals).collect()
    assert len({r["shard_no"] for r in shares}) == 1500 and len(shares) == 12_000
    assert min(r["share_reached"] for r in shares) > 0 and max(r["share_reached"] for r in shares) < 0.125 + 6 * 0.028


def test_blocks_and_choice_of_any_number_give_the_amount(spark):
    rnd = random.Random(8)
    docs = [("a", rnd.randrange(1, 90)) for _ in range(2000)] + [("b", rnd.randrange(1, 90)) for _ in range(700)]
    for per_block, choose in ((10, 1), (10, 50), (100_000, 100_000)):
        got, _ = mixed(spark, docs, [("a", 0.3, 1), ("b", 0.7, 2)], rows_per_block=per_block, rows_to_choose=choose)
        out = got.collect()
        assert len({(r["doc_id"], r["repeat_no"]) for r in out}) == len(out)
        tokens = {s: sum(r["n_tokens"] for r in out if r["source"] == s) for s in "ab"}
        assert abs(tokens["a"] / sum(tokens.values()) - 0.3) < 0.002
