"""One key with a third of all rows: results stay whole and equal to plain counting."""

from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lexweave.operators import hierarchy as H
from lexweave.operators import orphans as O
from lexweave.operators import profile as P
from lexweave.operators import state as K

T = datetime(2024, 1, 1)


def test_citations_of_one_page(spark):
    rows = [(i, [("/hot/artikel/1#lid-1" if i % 3 == 0 else f"/cold/artikel/{i}",)], T + timedelta(days=i % 60)) for i in range(6000)]
    nodes = spark.createDataFrame(rows, "node_id long, refs array<struct<href string>>, cited_at timestamp")
    index = spark.createDataFrame([(1, "/hot", "artikel", "1", "lid-1", T + timedelta(days=10), T + timedelta(days=20)), (2, "/hot", "artikel", "1", None, T, None)], "index_id long, route_prefix string, target_kind string, target_no string, anchor string, indexed_at timestamp, deleted_at timestamp")
    found = O.orphans(O.citations(nodes, "n", "node_id", F.col("refs.href"), "cited_at"), O.lives(index))
    assert {r["record_id"] for r in found.collect()} == {i for i in range(6000) if i % 3 or not 10 <= i % 60 < 20}


def test_one_contract(spark):
    links = [("hot" if i % 3 == 0 else f"c{i % 50}", f"n{i}", f"n{i - 3 * 50}" if i % 3 else f"n{i // 6 * 3}") for i in range(3000)]
    df = spark.createDataFrame([(c, p, r, None, T, i) for i, (c, p, r) in enumerate(links)], "contract_ref string, provider_code string, recipient_code string, chain_rank string, loaded_at timestamp, row_id long")
    run = lambda most: {(r["group_key"], r["node"]): (r["root"], r["depth"]) for r in H.hierarchy(df, "contract_ref", "provider_code", "recipient_code", "chain_rank", ["loaded_at", "row_id"], max_local=most).collect()}
    together = run(H.MAX_LOCAL)
    assert len(together) == 3000 and together == run(500)


def test_one_value_and_one_owner(spark):
    df = spark.createDataFrame([(i % 2, "NL" if i % 3 == 0 else f"v{i}") for i in range(3000)], "load_no int, value string")
    got = {r["value"]: r["n"] for r in P.value_counts(df, "load_no", [P.category_field("f", F.col("value"))]).groupBy("value").agg(F.sum("n").alias("n")).collect()}
    assert got == Counter("NL" if i % 3 == 0 else f"v{i}" for i in range(3000))
    events = spark.createDataFrame([(i, T + timedelta(seconds=i), 1 if i % 3 == 0 else i, f"t{i % 40}", False) for i in range(3000)], "event_id long, ts timestamp, owner long, item string, closed boolean")
    lists = K.bounded_lists(events, "owner", "item", "ts", F.col("closed"), "event_id")
    assert lists.filter("owner = 1").count() == 8 and lists.select("owner").distinct().count() == 2000  # owner 1 is hot and its own
