import random
from itertools import product

import numpy as np
import pytest

from lexweave.llm import prose as P
from tests.conftest import rows

COMMON = frozenset("de het een van in voor met the of and to in a is that for de der die das und den le la les des et à pour".split())
SENTENCE = "De instelling kan voor de ingangsdatum het uitwijkplan herzien, met een drempel van 500 euro."


MODEL = P.fit([])


@pytest.mark.parametrize(
    "line, state",
    [
        (SENTENCE, "sentences"), ("1. " + SENTENCE, "sentences"), (SENTENCE.upper(), "sentences"), ("De instelling kan voor de ingangsdatum het uitwijkplan (B_22.01.0240; S18; 2025/354).", "sentences"),
        ("De registerhouder dient voor de instelling het uitwijk", "wrapped"), ("- de exitstrategie", "items"), ("de exitstrategie;met de meldkamer;14;x", "records"),
        ("logboek | 7750 | nee | 2022-08-05", "records"), ("10,31 1854,60 5353,17", "figures"), ("Rang: S06", "figures"),
        ("Vzsotx suivqkvl nrwnodfd tpqifgme.", "wordless"), ("de het een van in voor met", "noise"), ("vPcD4BSCPHQ+WcZwauDcXUUW2LCJ7ZoP1vLUbFB7RqZ", "noise"), ("1.1 Uitwijkplan ................. 3", "noise"),
    ],
)
def test_labels_of_the_prior(line, state):
    """Without a sample the prior alone tells plain cases."""
    codes, _, _ = P.observe(line, COMMON, {})
    assert P.LABELS[P.labels_of(P.most_likely(MODEL, [codes])[0])[0]] == P.STATES[state]


def test_a_tail_is_told_by_the_line_before():
    wrapped = P.observe("De registerhouder dient voor de instelling het uitwijk\nplan toe.", COMMON, {})[0]
    alone = P.observe("Menu\nplan toe.", COMMON, {})[0]
    assert list(P.STATES)[P.most_likely(MODEL, [wrapped])[0][1]] == "tail"
    assert P.bins_of(wrapped)["joins"][1] == P.RUNS_ON and P.bins_of(alone)["joins"][1] == P.AFTER_OTHER


def random_model(rnd):
    n = len(P.STATES)
    emission = tuple(np.log(rnd.dirichlet(np.ones(k), size=n)) for k in P.BINS.values())
    return P.Model(emission, np.log(rnd.dirichlet(np.ones(n), size=n)), np.log(rnd.dirichlet(np.ones(n))))


def paths(model, codes):
    """Every sequence of states with its probability."""
    seen = model.seen(codes)
    return {s: np.exp(model.start[s[0]] + sum(seen[t, x] for t, x in enumerate(s)) + sum(model.move[a, b] for a, b in zip(s, s[1:]))) for s in product(range(len(P.STATES)), repeat=len(codes))}


def test_most_likely_and_expected_counts_against_all_sequences():
    rnd = np.random.default_rng(1)
    model = random_model(rnd)
    distinct = np.unique(rnd.integers(0, int(np.prod(list(P.BINS.values()))), 6))
    sequences = [rnd.integers(0, len(distinct), n) for n in (1, 3, 2, 4, 0, 3)]
    held = np.where(np.arange(len(distinct)) == 2, 4, -1)
    for codes, states in zip(sequences, P.most_likely(model, [distinct[x] for x in sequences])):
        if len(codes):
            every = paths(model, distinct[codes])
            assert abs(every[tuple(states)] - max(every.values())) < 1e-12 * max(every.values()) + 1e-300
        else:
            assert len(states) == 0
    weights, moves, starts = P.expected(model, [x for x in sequences if len(x)], distinct, held)
    want_w, want_m, want_s = np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(starts)
    for codes in filter(len, sequences):
        every = {s: p for s, p in paths(model, distinct[codes]).items() if all(held[c] < 0 or held[c] == x for c, x in zip(codes, s))}
        whole = sum(every.values())
        for s, p in every.items():
            want_s[s[0]] += p / whole
            for c, x in zip(codes, s):
                want_w[c, x] += p / whole
            for x, y in zip(s, s[1:]):
                want_m[x, y] += p / whole
    assert np.allclose(weights, want_w) and np.allclose(moves, want_m) and np.allclose(starts, want_s)


def test_a_fit_learns_moves_and_emissions():
    text = "\n".join([SENTENCE] * 6 + ["- de exitstrategie"] * 6)
    codes = P.observe(text, COMMON, {})[0]
    model = P.fit([codes] * 200)
    s, i = list(P.STATES).index("sentences"), list(P.STATES).index("items")
    move = np.exp(model.move)
    assert abs(move[s, i] / move[s, s] - 1 / 5) < 0.02 and move[i, i] > 0.98 and np.exp(model.start)[s] > 0.9
    assert np.exp(model.emission[1])[i, P.BULLET] > 0.99
    assert np.exp(P.fit([]).move)[s, s] < move[i, i]


def labels(spark, texts):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_lines string")
    words = spark.createDataFrame([("nl", w) for w in sorted(COMMON)] + [("nl", None), ("nl", "")], "lang string, word string")
    return docs, words, P.line_labels(docs, words)


def test_documents(spark):
    wrapped = "".join(f"De instelling {x} dient voor de ingangsdatum het\nlogboek te herzien, met een drempel\nvan {x}5.\n" for x in ("Stocon", "Venmos", "Merval"))
    texts = [
        SENTENCE * 3, "\n".join("- " + SENTENCE for _ in range(5)), wrapped, "\n".join(f"{i}) de exitstrategie" for i in range(9)), "\n".join(["logboek;123;nee;x"] * 9), None, "", "  \n ",
        SENTENCE + "\n" + "\n".join(["Menu", "Sitemap", "Volgende »", "Contact"] * 20), "De instelling kan voor het bijkantoor, \n\n" + "\n".join("aB3d" * 12 for _ in range(4)),
        (SENTENCE + "\n") * 3000, SENTENCE,
    ]
    docs, words, got = labels(spark, texts)
    assert rows(P.not_prose(got), "doc_id") == [(3,), (4,), (8,), (9,)]
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[4]["table_chars"] == by[4]["n_line_chars"] and by[3]["list_chars"] == by[3]["n_line_chars"]
    assert by[5]["n_line_chars"] == by[7]["n_line_chars"] == 0 and by[9]["sentence_chars"] == 0
    stats = {r["doc_id"]: r for r in P.text_statistics(docs, words).collect()}
    assert stats[11]["n_words"] == 14 and stats[11]["ended_line_share"] == 1.0 and stats[5]["n_words"] == 0 and stats[5]["mean_word_length"] is None


def test_empty_and_repeated(spark):
    docs, words, got = labels(spark, [])
    assert rows(got) == [] and rows(P.text_statistics(docs, words)) == []
    twice = spark.createDataFrame([(1, "Menu\nHome")] * 2, "doc_id long, text string")
    assert len(P.not_prose(P.line_labels(twice, words)).collect()) == 2
    with pytest.raises(ValueError):
        P.bounded_words(words, 2)


def test_a_fitted_model_is_a_parameter_and_long_or_null_texts_are_not_drawn(spark):
    docs, words, _ = labels(spark, [SENTENCE, None, "Menu\nHome", "x" * 200_000])
    model = P.fitted(docs, P.bounded_words(words), n=10)
    assert rows(P.not_prose(P.line_labels(docs, words, model)), "doc_id") == [(2,), (3,)]
