"""Queries that have no SQL against plain Python over the same tables."""

import csv
import io
import json
import shutil
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lexweave.queries import corpus, records, training
from tests import oracle

DATA = str(oracle.DATA)


@pytest.fixture(scope="module")
def con():
    if not oracle.DATA.exists():
        pytest.skip("no test data here")
    return oracle.database()


def elements(x):
    while isinstance(x, str):
        try:
            x = json.loads(x)
        except ValueError:
            return []
    return x if isinstance(x, list) else [x] if isinstance(x, dict) else []


def nodes_of(x):
    return [n for n in elements(x) if isinstance(n, dict)]


def contents(con):
    return con.execute("SELECT article_id, k - 1, x.content FROM (SELECT article_id, unnest(paragraphs) AS x, generate_subscripts(paragraphs, 1) AS k FROM articles)").fetchall()


def lists(con_rows, path):
    """Every (type, depth) of a content tree, items counted for their lists."""
    for node in nodes_of(con_rows):
        if node.get("type") == "list":
            for item in nodes_of(node.get("items")):
                yield "item", path + 2
                yield from lists(item.get("content"), path + 2)
        else:
            yield node.get("type"), path + 1


def test_tree_edges(spark, con):
    want = Counter(x for _, _, c in contents(con) if c is not None for x in lists(c, 0))
    assert {(r["node_type"], r["depth"]): r["n_nodes"] for r in corpus.tree_edges(spark, DATA).collect()} == want


def words(content):
    """The words of a tree in reading order, whatever the blanks between them."""
    out = []
    for node in nodes_of(content):
        if node.get("type") == "list":
            for item in nodes_of(node.get("items")):
                out += str(item.get("marker") or "").split() + words(item.get("content"))
        elif node.get("type") == "table":
            out += [w for row in elements(node.get("rows")) if isinstance(row, list) for c in row for w in str(c).split()]
        elif node.get("type") != "figure":
            out += str(node.get("text") or "").split()
    return out


def test_flat_texts_and_markdown_hold_all_words(spark, con):
    want = {(a, k): c for a, k, c in contents(con)}
    flat = {(r["article_id"], r["pos"]): r["flat_text"] for r in corpus.tree_flatten_json(spark, DATA).collect()}
    assert set(flat) == set(want) and all((flat[k] or "").split() == words(c) and (flat[k] is None) == (c is None) for k, c in want.items())
    marked = {(r["article_id"], r["pos"]): r["markdown"] for r in corpus.tree_markdown(spark, DATA).collect()}
    for key, c in want.items():
        bare = [n for n in nodes_of(c) if n.get("type") == "text" and not n.get("refs")]
        assert all(str(n.get("text") or "").strip() in marked[key] for n in bare)
        assert (marked[key] or "").count("- **") == sum(1 for x in lists(c, 0) if x[0] == "item")


def test_spans_are_the_stored_ones(spark, con):
    """Where the tables store the places of citations, the reader finds these places."""
    stored = con.execute("SELECT node_id, r.start_pos, r.end_pos FROM (SELECT node_id, body, unnest(refs) AS r FROM content_nodes WHERE body IS NOT NULL)").fetchall()
    bodies = dict(con.execute("SELECT node_id, body FROM content_nodes WHERE body IS NOT NULL").fetchall())
    stored = {(n, a, b) for n, a, b in stored if a is not None and bodies[n][a:b].lower().startswith(("artikel ", "bijlage ", "overweging "))}
    found = {(r["row_id"], r["start_pos"], r["end_pos"]) for r in corpus.ref_spans(spark, DATA).collect()}
    assert len(stored) > 20 and len(stored & found) > 0.95 * len(stored)


def test_child_rows_hold_their_own_fields(spark, con):
    rows = [r for r in training.p2_children(spark, DATA).collect() if r["table_name"] == "arrangements"]
    want = con.execute("SELECT arr_row, k - 1, e.id, e.provider_code FROM (SELECT arr_row, unnest(chain) AS e, generate_subscripts(chain, 1) AS k FROM arrangements) WHERE e IS NOT NULL").fetchall()
    assert Counter((r["record_id"], r["position"], r["own_key"], r["own_text"]) for r in rows) == Counter(want)


def test_request_documents(spark):
    asked = {}
    from lexweave.operators import register as G

    for r in G.supplier_requests(records._fields(spark, DATA)).collect():
        asked.setdefault(r["arr_row"], []).append((r["code"], r["label"] or "", r["instruction"] or "", r["mandatory_raw"] or ""))
    got = {r["arr_row"]: r for r in records.request_documents(spark, DATA).collect()}
    assert set(got) == set(asked)
    for key, items in asked.items():
        lines = list(csv.reader(io.StringIO(got[key]["csv"], newline="")))
        assert lines[0] == ["Veld", "Omschrijving", "Instructie", "Verplicht", "Waarde"] and [tuple(x) for x in lines[1:]] == [(*i, "") for i in sorted(items)]
        assert got[key]["markdown"].startswith("# Gegevensuitvraag") and got[key]["markdown"].count("\n| B_") == len(items)


def lists_by_hand(events, size=8):
    state = {}
    for at, tie, owner, item, closed in sorted(events):
        listed = state.setdefault(owner, {})
        if closed:
            listed.pop(item, None)
        else:
            if item not in listed and len(listed) >= size:
                del listed[min(listed, key=listed.get)]
            listed[item] = at
    return {(o, i, name, at) for o, listed in state.items() for i, (name, at) in enumerate(listed.items())}


def test_bounded_lists_batch_and_stream_of_three_files(spark, con, tmp_path):
    events = con.execute("SELECT ts, event_id, user_id, json_extract_string(props, '$.k'), event_type = 'error' FROM events").fetchall()
    want = lists_by_hand(events)
    plain = lambda df: {(r["user_id"], r["place"], r["item"], r["last_at"].replace(tzinfo=None)) for r in df.collect()}
    assert plain(records.lru8_with_closes(spark, DATA)) == want
    rows = spark.read.parquet(f"{DATA}/events.parquet").orderBy("ts", "event_id")
    cuts = [r["ts"] for r in rows.select("ts").collect()]
    a, b = cuts[len(cuts) // 3], cuts[2 * len(cuts) // 3]
    (tmp_path / "events.parquet").mkdir()
    for i, part in enumerate((rows.filter(F.col("ts") < a), rows.filter((F.col("ts") >= a) & (F.col("ts") < b)), rows.filter(F.col("ts") >= b))):
        part.coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        one = next((tmp_path / f"p{i}").glob("part-*.parquet"))
        shutil.copy(one, tmp_path / "events.parquet" / f"{i}.parquet")
    assert plain(records.stream_bounded_lists(spark, str(tmp_path))) == want and datetime.max not in {x[3] for x in want}
