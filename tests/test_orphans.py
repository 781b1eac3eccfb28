from datetime import datetime

from pyspark.sql import functions as F

from lexweave.operators import orphans as O
from tests.conftest import rows

INDEX = "index_id long, route_prefix string, target_kind string, target_no string, anchor string, indexed_at timestamp, deleted_at timestamp"


def day(n):
    return datetime(2024, 1, n)


def found(spark, refs, index):
    nodes = spark.createDataFrame([(i, [(h,) for h in hs] if hs is not None else None, at, "x") for i, hs, at in refs], "node_id long, refs array<struct<href string>>, cited_at timestamp, parent_key string")
    kids = O.citations(nodes, "content_nodes", "node_id", F.col("refs.href"), "cited_at")
    return O.orphans(kids, O.lives(spark.createDataFrame(index, INDEX)))


def test_notations_and_lives(spark):
    index = [
        (1, "/toets-rts", "artikel", "3", None, day(1), None),
        (2, "/toets-rts", "artikel", "3", "lid-1", day(5), day(10)),
        (3, "/toets-rts", "artikel", "3", "lid-1", day(20), None),
        (4, "/toets-rts", "artikel", "3", "lid-1", day(20), None),
        (5, "/toets-rts", "bijlage", "iv", None, None, None),
    ]
    refs = [
        (1, ["/toets-rts/artikel/3", " /TOETS%2Drts/Artikel/3/?v=2 ", "/toets-rts/artikel/3?v=1#LID-1"], day(6)),
        (2, ["/toets-rts/artikel/3#lid-1"], day(10)),
        (3, ["/toets-rts/artikel/3#lid-1", "/toets-rts/artikel/3#lid-1"], day(4)),
        (4, ["/toets-rts/artikel/3/#lid-1"], day(5)),
        (5, ["/toets-rts/artikel/3#lid-2", None], day(21)),
        (6, ["/toets-rts/bijlage/iv"], day(21)),
        (7, None, day(21)),
        (8, [], day(21)),
        (9, ["/nergens"], None),
        (10, ["/toets-rts/artikel/3#"], day(1)),
    ]
    got = rows(found(spark, refs, index), "record_id", "href", "period", "known_once")
    assert got == sorted(
        [
            (2, "/toets-rts/artikel/3#lid-1", "2024-01", True),
            (3, "/toets-rts/artikel/3#lid-1", "2024-01", True),
            (5, "/toets-rts/artikel/3#lid-2", "2024-01", False),
            (6, "/toets-rts/bijlage/iv", "2024-01", False),
        ],
        key=repr,
    )


def test_counts_and_empty_tables(spark):
    got = found(spark, [(1, ["/a"], day(1)), (1, ["/a"], day(1)), (2, ["/b"], day(1))], [])
    assert rows(O.orphan_counts(got)) == [("content_nodes", "2024-01", 3, 3, 0)]
    assert rows(found(spark, [], [])) == []


def test_malformed_escape_stays(spark):
    df = spark.createDataFrame([("/a%zz+b",), ("/a%2Bb%20c",)], "h string").select(O.href_key(F.col("h")).alias("k"))
    assert [r["k"] for r in df.collect()] == ["/a%zz+b#", "/a+b c#"]


def test_overlapping_lives_of_a_key_are_merged(spark):
    from datetime import timedelta
    import random

    rnd = random.Random(5)
    lives = [(h, h + rnd.randrange(-1, 3)) for h in (rnd.randrange(60) for _ in range(40))] + [(80 + h, 82 + h) for h in range(50)] + [(200, None), (210, 211)]
    at = lambda h: None if h is None else day(1) + timedelta(hours=h)
    index = [(i, "/x", "artikel", "1", None, at(a), at(b)) for i, (a, b) in enumerate(lives)]
    refs = [(h, ["/x/artikel/1"], at(h)) for h in range(220)]
    gone = {h for h in range(220) if not any(a <= h and (b is None or h < b) for a, b in lives)}
    assert {r["record_id"] for r in found(spark, refs, index).collect()} == gone and 0 < len(gone) < 220
    parents = O.lives(spark.createDataFrame(index, INDEX))
    kids = spark.createDataFrame([("/x/artikel/1#",)], "parent_key string")
    kept = sorted(((x["lived_from"], x["lived_to"]) for x in O.key_groups(kids, parents).first()["lives"]), key=lambda x: x[0])
    assert len(kept) < 42 and all(b is not None and max(a, b) < c for (a, b), (c, _) in zip(kept, kept[1:]))
    assert (at(80), at(131)) in kept and kept[-1] == (at(200), None)


def test_a_living_anchor_on_a_dead_page_is_an_orphan(spark):
    index = [
        (1, "/p", "artikel", "1", None, day(3), day(6)),
        (2, "/p", "artikel", "1", "lid-1", day(1), None),
        (3, "/p", "artikel", "2", "lid-1", day(1), None),
    ]
    refs = [
        (1, ["/p/artikel/1#lid-1"], day(2)),  # the page comes later
        (2, ["/p/artikel/1#lid-1", "/p/artikel/1#lid-9"], day(4)),  # page and anchor live; the other anchor never did
        (3, ["/p/artikel/1#lid-1", "/p/artikel/1"], day(6)),  # the page is gone
        (4, ["/p/artikel/2#lid-1"], day(4)),  # the page was never a target
        (5, ["/p/artikel/3#lid-1"], day(4)),  # neither was
        (5, ["/p/artikel/3#lid-1"], day(4)),
    ]
    got = rows(found(spark, refs, index), "record_id", "href", "known_once")
    assert got == sorted(
        [
            (1, "/p/artikel/1#lid-1", True), (2, "/p/artikel/1#lid-9", False), (3, "/p/artikel/1", True), (3, "/p/artikel/1#lid-1", True),
            (4, "/p/artikel/2#lid-1", False), (5, "/p/artikel/3#lid-1", False), (5, "/p/artikel/3#lid-1", False),
        ],
        key=repr,
    )
