"""The queries without SQL over whole small tables: against brute force, or against what must hold of every row."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexweave.llm import lookalike as L
from lexweave.llm import queries as Q
from lexweave.llm import tokens
from lexweave.sources.tables import table
from tests import oracle
from tests.llm.test_lookalike import brute

DATA, SOME = str(oracle.DATA), str(oracle.DATA.parent / "sf0.01")
pytestmark = pytest.mark.skipif(not oracle.DATA.exists(), reason="no test data here")


def test_p3_queries_agree(spark):
    found = Q.p3_found(spark, DATA).collect()
    entries = table(spark, DATA, "arrangements").select("arr_row", F.explode("manual").alias("code", "entry")).join(table(spark, DATA, "closed_lists").select(F.col("column_code").alias("code")).distinct(), "code").filter("trim(coalesce(entry, '')) <> ''")
    assert Counter((r["arr_row"], r["column_code"]) for r in found) == Counter((r["arr_row"], r["code"]) for r in entries.collect())
    how = Q.p3_how(spark, DATA).collect()
    by_column = Counter(r["column_code"] for r in found)
    assert {c: sum(r["n_entries"] for r in how if r["column_code"] == c) for c in by_column} == dict(by_column)
    items = {(r["column_code"], r["item_no"]) for r in table(spark, DATA, "closed_lists").collect()}
    assert all(r["item_no"] == 0 or (r["column_code"], r["item_no"]) in items for r in found)


def test_p4_against_whole_string_normalisation(spark):
    texts = L.register_texts(table(spark, DATA, "content_nodes"), table(spark, DATA, "roi_columns")).collect()
    key = lambda r: (r["table_name"], r["field_name"], r["record_id"])
    want = [(key(r), r["text"], brute(r["text"], r["script"], r["is_marker"])) for r in texts]
    assert Counter(map(key, Q.p4_found(spark, DATA).collect())) == Counter(k for k, was, now in want if was != now)
    assert Counter((key(r), r["normal"]) for r in Q.p4_forms(spark, DATA).collect()) == Counter((k, now) for k, _, now in want)


def test_p7_packs_every_token_once(spark):
    sizes = Counter()
    for r in tokens.token_sizes(table(spark, DATA, "documents"), ["doc_id"]).collect():
        sizes[r["doc_id"]] += r["n_tokens"]
    packed, report = defaultdict(Counter), {r["pack_id"]: r for r in Q.p7_report(spark, DATA).collect()}
    n = Counter()
    for c in Q.p7_containers(spark, DATA).collect():
        n[c["pack_id"]] += 1
        assert c["fill"] == sum(x["n_tokens"] for x in c["content"]) <= c["capacity"] and c["n_pieces"] == len(c["content"])
        for x in c["content"]:
            packed[c["pack_id"]][x["doc_id"]] += x["n_tokens"]
    wanted = {d: k for d, k in sizes.items() if k}
    assert all(dict(got) == wanted for got in packed.values()) and len(packed) == 4
    for pack, r in report.items():
        assert r["n_containers"] == n[pack] and r["least_containers"] <= n[pack] <= r["least_containers"] * 1.05 + 1


def test_p8_shares_of_the_mix(spark):
    """A hundred texts are too few to meet shares nearly, a thousand are not."""
    mix = Q.p8_mix(spark, SOME).collect()
    assert len({(r["doc_id"], r["repeat_no"], r["n_tokens"], r["source"]) for r in mix}) <= len(mix)
    tokens_of, whole = Counter(), sum(r["n_tokens"] for r in mix)
    for r in mix:
        tokens_of[r["source"]] += r["n_tokens"]
    shares = {r["source"]: r for r in Q.p8_shares(spark, SOME).collect()}
    present = sum(r["target_share"] for r in shares.values() if r["n_tokens"])
    for source, r in shares.items():
        assert r["n_tokens"] == tokens_of[source] and abs(r["share_reached"] - tokens_of[source] / whole) < 1e-5 and r["times_used"] <= r["max_repeats"]
        assert not r["n_tokens"] or abs(r["share_reached"] - r["target_share"] / present) < 0.005
    by_shard = Q.p8_shard_shares(spark, SOME).collect()
    assert sum(r["n_tokens"] for r in by_shard) == whole
    for s in {r["shard_no"] for r in by_shard}:
        assert abs(sum(r["share_reached"] for r in by_shard if r["shard_no"] == s) - 1) < 1e-4


def test_p9_shares_and_found_agree(spark):
    shares = Q.p9_shares(spark, DATA).collect()
    found = Counter(r["doc_id"] for r in Q.p9_found(spark, DATA).collect())
    for r in shares:
        assert not r["n_lines"] or abs(r["prose_share"] + r["list_share"] + r["table_share"] + r["junk_share"] - 1) < 1e-5
        assert r["sentence_share"] <= r["prose_share"] + 1e-9
    assert found == Counter(r["doc_id"] for r in shares if r["n_lines"] and r["sentence_share"] < 0.5) and 0 < sum(found.values()) < len(shares)
