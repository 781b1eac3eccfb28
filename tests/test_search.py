import math
import random

import pytest
from pyspark.sql import functions as F

from lexweave.functions.text import STOPWORDS
from lexweave.operators import search as S
from tests.conftest import rows

DOCS = [
    ("main-art-6-lid-1", "Artikel 6 — Het register", "De entiteit houdt een register bij van overeenkomsten."),
    ("main-art-6-lid-2", "Artikel 6 — Het register", "De toezichthouder kan het informatieregister opvragen."),
    ("main-art-16-lid-1", "Artikel 16 — Uitbesteding", "Uitbesteding aan een onderaannemer wordt gemeld."),
    ("sub-art-6-lid-1", "Artikel 6 — Onderaanneming", "Een onderaannemer meldt een incident."),
    ("main-rct-58", "Overweging 58", "Incidenten en dreigingen, ook kredietwaardigheid."),
    ("main-anx-iii-punt-5", "Bijlage III", None),
]


@pytest.fixture(scope="module")
def index(spark):
    return S.build_index(spark.createDataFrame(DOCS, "doc_id string, heading string, text string"))


def ids(df):
    return [r["doc_id"] for r in df.collect()]


def test_scores_against_plain_python(spark, index):
    options = S.Options(boosts={"heading": 2.0, "text": 1.0}, prefix_from=None, fuzzy_from=None, synonyms=())
    words = {(d, f): [w for w in S.query_terms(t or "") if w not in STOPWORDS and (len(w) > 1 or w.isdigit())] for d, h, b in DOCS for f, t in (("heading", h), ("text", b))}
    mean = {f: sum(len(w) for (_, g), w in words.items() if g == f) / len(DOCS) for f in ("heading", "text")}
    want = {}
    for d, _, _ in DOCS:
        score, covered = 0.0, set()
        for g, term in enumerate(("register", "onderaannemer", "6")):
            for f, boost in options.boosts.items():
                tf = words[d, f].count(term)
                if tf:
                    df = sum(term in words[e, f] for e, _, _ in DOCS)
                    score += boost * math.log(1 + (len(DOCS) - df + 0.5) / (df + 0.5)) * (0.5 + tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * len(words[d, f]) / mean[f])))
                    covered.add(g)
        if covered:
            want[d] = (len(covered), score)
    got = {r["doc_id"]: (r["coverage"], r["score"]) for r in S.scored(index, "register onderaannemer 6", options).collect()}
    assert got.keys() == want.keys() and all(got[d][0] == want[d][0] and abs(got[d][1] - want[d][1]) < 1e-5 for d in want)


def test_ranking_expectations(index):
    assert ids(S.search(index, "artikel 6, lid 2", main="main"))[0] == "main-art-6-lid-2"
    assert ids(S.search(index, "sub artikel 6", instruments=("sub",), main="main"))[0] == "sub-art-6-lid-1"
    assert ids(S.search(index, "overweging 58", main="main"))[0] == "main-rct-58"
    assert "main-art-6-lid-1" in ids(S.search(index, "informatieregister"))  # synonym
    assert "main-art-6-lid-2" in ids(S.search(index, "informatieregster"))  # edit distance
    assert ids(S.search(index, "krediet", options=S.PRECISION)) == ["main-rct-58"]  # prefix of a compound
    assert ids(S.search(index, "kred", options=S.PRECISION)) == [] and ids(S.search(index, "a")) == [] and ids(S.search(index, " ")) == []
    assert len(ids(S.search(index, "artikel", limit=2))) == 2


def test_coverage_comes_before_score(index):
    hits = S.search(index, "register toezichthouder", options=S.Options(prefix_from=None, fuzzy_from=None)).collect()
    assert hits[0]["doc_id"] == "main-art-6-lid-2" and [h["coverage"] for h in hits] == sorted((h["coverage"] for h in hits), reverse=True)


def test_synonym_groups():
    terms = [t for g in S.SYNONYM_GROUPS for t in g]
    assert len(terms) == len(set(terms)) and all(S.query_terms(t) == [t] and t not in STOPWORDS for t in terms)
    assert S.term_groups("keten ranking") == {"keten": 0, "toeleveringsketen": 0, "ranking": 0}


def test_reference_patterns():
    assert S.reference_pattern("Artikel 28", main="m") == ("m-art-28-", False) and S.reference_pattern("artikel 28 lid 3", main="m") == ("m-art-28-lid-3", True)
    assert S.reference_pattern("its bijlage III punt 5", ("its",), "m") == ("its-anx-iii-punt-5", True) and S.reference_pattern("zorgplicht") is None


def snippet_by_hand(text, terms, radius):
    low = text.lower()
    spots = sorted((i, t) for t in terms for i in range(len(low)) if low.startswith(t, i))
    best = max(spots, key=lambda s: (len({t for p, t in spots if s[0] <= p <= s[0] + 2 * radius}), sum(s[0] <= p <= s[0] + 2 * radius for p, _ in spots), -s[0]))
    return best[0]


def test_snippets(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["register", "keten", "melding", "de", "entiteit", "toezicht", "artikel"]) for _ in range(rnd.randrange(60, 200))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = ["register", "keten"]
    cut = {r["doc_id"]: r["s"] for r in df.select("doc_id", S.snippet(F.col("text"), terms, 60).alias("s")).collect()}
    place = {r["doc_id"]: r["position"] for r in S.best_window(df, terms, 60).collect()}
    for i, t in enumerate(texts):
        at = snippet_by_hand(t, terms, 60)
        start = max(0, at - 40)
        assert place[i] == at and cut[i].strip("…") == t[start : start + 120].strip()
    short = spark.createDataFrame([("kort",), (None,), ("x" * 500,)], "t string").select(S.snippet(F.col("t"), terms, 60).alias("s"))
    assert [r["s"] for r in short.collect()] == ["kort", None, "x" * 120 + "…"]


def test_saved_index_and_empty_corpus(spark, index, tmp_path):
    index.save(str(tmp_path / "i"))
    loaded = S.Index.load(spark, str(tmp_path / "i"))
    assert ids(S.search(loaded, "register")) == ids(S.search(index, "register"))
    empty = S.build_index(spark.createDataFrame([], "doc_id string, heading string, text string"))
    assert rows(S.search(empty, "register")) == []
