"""One source, size or text with a third of all rows."""

from lexweave.llm import lookalike as L
from lexweave.llm import mixing as M
from lexweave.llm import packing as K


def test_one_size_and_one_source(spark):
    rows = [(i, i, "hot" if i % 3 == 0 else f"s{i % 5}", 7 if i % 3 == 0 else 1 + i % 90) for i in range(6000)]
    sizes = spark.createDataFrame(rows, "row_key long, doc_id long, source string, n_tokens long")
    items = K.packed_items(sizes, spark.createDataFrame([(1, 64)], "pack_id int, capacity_tokens int"))
    assert items.count() == sum(-(-n // 64) for *_, n in rows)
    fill = {r["container_id"]: r["fill"] for r in K.containers(items).collect()}
    assert max(fill.values()) <= 64 and len(fill) <= -(-sum(n for *_, n in rows) // 64) * 1.01 + 1
    mixed = M.mix(sizes, spark.createDataFrame([("hot", 0.5, 1), ("s1", 0.5, 9)], "source string, target_share double, max_repeats int"), shard_tokens=3000).collect()
    hot = sum(r["n_tokens"] for r in mixed if r["source"] == "hot")
    assert hot == 7 * 2000 and abs(hot / sum(r["n_tokens"] for r in mixed) - 0.5) < 0.001


def test_one_text(spark):
    rows = [(i, "zоnder" if i % 3 == 0 else f"tekst {i} x", "Latin", False) for i in range(3000)]
    got = L.with_normal_form(spark.createDataFrame(rows, "record_id long, text string, script string, is_marker boolean"))
    assert {r["record_id"]: r["normal"] for r in got.collect()} == {i: "zonder" if i % 3 == 0 else f"tekst {i} x" for i in range(3000)}
