import random
from datetime import datetime

import pytest

from lexweave.operators import hierarchy as H
from tests.conftest import rows

SCHEMA = "contract_ref string, provider_code string, recipient_code string, chain_rank string, loaded_at timestamp, row_id long, node string, depth string"
T = datetime(2024, 1, 1)


def table(spark, links):
    return spark.createDataFrame([(c, p, r, None, T, i, "clash", "clash") for i, (c, p, r) in enumerate(links)], SCHEMA)


def run(df, **kw):
    return H.hierarchy(df, "contract_ref", "provider_code", "recipient_code", "chain_rank", ["loaded_at", "row_id"], **kw)


def brute(links):
    """Last row of a node holds; parents followed by hand."""
    up = {}
    for c, p, r in links:
        code = (p or "").strip().upper()
        if code and c is not None:
            up[c, code] = (r or "").strip().upper()
    out = []
    for c, n in up:
        path, at = [n], n
        while True:
            p = up[c, at]
            if not p or p == at or (c, p) not in up:
                out.append((c, n, path[-1], len(path) - 1, tuple(reversed(path))))
                break
            if p in path:
                out.append((c, n, "", -1, ()))
                break
            path.append(p)
            at = p
    return sorted(out)


def compare(df, links, **kw):
    got = sorted((r["group_key"], r["node"], r["root"], r["depth"], tuple(r["path"])) for r in run(df, with_path=True, **kw).collect())
    assert got == brute(links)


LINKS = [
    ("c1", "a", None), ("c1", " B ", "A"), ("c1", "c", "b "), ("c1", "d", "nowhere"), ("c1", "", "a"), ("c1", None, "a"), (None, "a", "b"),
    ("c1", "x", "y"), ("c1", "y", "z"), ("c1", "z", "y"), ("c1", "s", "s"), ("c2", "b", "a"), ("c2", "b", "c"), ("c2", "c", "  "),
]


@pytest.mark.parametrize("max_local", [H.MAX_LOCAL, 0, 5])
def test_small(spark, max_local):
    compare(table(spark, LINKS), LINKS, max_local=max_local)
    loops = {r["node"] for r in run(table(spark, LINKS), max_local=max_local).filter("on_loop").collect()}
    assert loops == {"Y", "Z"}


@pytest.mark.parametrize("max_local", [H.MAX_LOCAL, 40])
def test_random_forests(spark, max_local):
    rnd = random.Random(1)
    links = [(f"k{rnd.randrange(12)}", f"n{rnd.randrange(30)}", rnd.choice([None, "", f"n{rnd.randrange(30)}", f"n{rnd.randrange(60)}"])) for _ in range(700)]
    links += [("long", f"p{i}", f"p{i - 1}" if i else None) for i in range(50)]
    rnd.shuffle(links)
    compare(table(spark, links), links, max_local=max_local)


def test_groups_that_cross_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        links = [(f"k{i % 3}", f"n{i}", f"n{i - 3}") for i in range(120)]
        compare(table(spark, links), links)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_latest_row_holds_and_descendants(spark):
    df = spark.createDataFrame(
        [("c", "a", "b", "1", datetime(2024, 1, 2), 1, "", ""), ("c", "a", None, "2", datetime(2024, 1, 1), 9, "", ""), ("c", "b", None, "1", None, 3, "", ""), ("c", "d", "b", "1", T, 4, "", ""), ("c", "d", "a", "1", T, 5, "", "")],
        SCHEMA,
    )
    tree = run(df, with_path=True)
    assert rows(tree, "node", "root", "depth") == [("A", "B", 1), ("B", "B", 0), ("D", "B", 2)]
    assert rows(H.ancestor_pairs(tree), "ancestor", "descendant", "distance") == [("A", "D", 1), ("B", "A", 1), ("B", "D", 2)]


def test_empty(spark):
    assert rows(run(table(spark, []))) == []


def test_a_deep_chain_and_a_long_tail_of_a_loop_take_no_quadratic_room():
    import time

    import pandas as pd

    n = 60_000
    chain = pd.DataFrame({"group_key": "c", "node": [f"n{i}" for i in range(n)], "parent": [f"n{i - 1}" if i else "" for i in range(n)], "rank": None})
    began = time.time()
    depth = next(H._levels(chain, False)).set_index("node")["depth"]
    assert depth["n0"] == 0 and depth[f"n{n - 1}"] == n - 1
    tail = chain.assign(parent=[f"n{i - 1}" if i else "n1" for i in range(n)])
    out = next(H._levels(tail, False))
    assert set(out.loc[out["on_loop"], "node"]) == {"n0", "n1"} and (out["depth"] == -1).all()
    assert time.time() - began < 30
    sizes = []
    for piece in H._levels(chain.iloc[:4000], True):
        sizes.append(int(piece["depth"].sum()) + len(piece))
        assert all(len(p) == d + 1 and p[-1] == x and p[0] == "n0" for p, d, x in zip(piece["path"], piece["depth"], piece["node"]))
    assert len(sizes) > 10 and max(sizes) <= H.MAX_STEPS + 4000 and sum(sizes) == 4000 * 4001 // 2
