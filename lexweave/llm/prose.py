"""Per-document text statistics, and prose told from lists, tables and junk (problem 9).

Counts and ratios are plain columns.  For the label of each line a hidden Markov
model runs over line statistics: a line is observed as eleven statistics in
bins (end, start, words, common words, letters, digits, separators, longest
word, length, repetition, how it joins the line before), which are independent
given the state.  There are nine states, each a part of prose, list, table or
junk, and the most likely sequence of states is found for the whole document, so
a line is judged with its neighbours.  Shares of characters per label are
aggregated per document; a last exact check takes from the prose what follows
the final sentence end of a paragraph.

The model is trained: emissions, transitions and starts are fitted by Baum–Welch
on a bounded sample of documents (``FIT_DOCUMENTS``), drawn by hash.  Lines that
a seed rule recognises keep its state during the fit, all others are free; the
seed rules themselves take no part in labelling.  Where the sample is small, the
prior counts – every combination of bins a seed rule admits once, weighted as
``PRIOR_LINES`` lines – stand in.  All documents are then labelled with the one
model, one by one, in one pass without a shuffle.

Defined results: null and blank texts have no characters, share 0 of everything
and are never reported; repeated rows are reported as often as they stand; a
language code is not needed; extra columns are never read.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("prose", "list", "table", "junk")
#: the states and the label each belongs to
STATES = {
    "sentences": "prose", "wrapped": "prose", "tail": "prose", "items": "list", "records": "table", "figures": "table", "fragments": "junk", "wordless": "junk", "noise": "junk",
}
_LABEL_OF = np.array([LABELS.index(x) for x in STATES.values()], dtype=np.int8)
MAX_COMMON_WORDS = 10_000
#: documents the model is fitted on, the longest of them in characters, rounds of the fit, weight of the prior
FIT_DOCUMENTS, FIT_CHARACTERS, FIT_ROUNDS, PRIOR_LINES = 2000, 100_000, 6, 20.0

#: the statistics of a line and the number of bins of each
BINS = {"end": 3, "start": 4, "words": 5, "common": 6, "letters": 4, "digits": 3, "separators": 4, "longest": 2, "length": 4, "repeated": 2, "joins": 4}
_SIZES = np.array(list(BINS.values()))
_STEP = np.concatenate([[1], np.cumprod(_SIZES)[:-1]])
OPEN, COMMA, ENDED = 0, 1, 2  # end
BULLET, CAPITAL, SMALL, OTHER = 1, 0, 2, 3  # start
APART, RUNS_ON, AFTER_END, AFTER_OTHER = 0, 1, 2, 3  # joins
NONE, PAIR, LEADERS, CELLS = 0, 1, 2, 3  # separators

_BULLET = re.compile(r"(?:[-*•–—·▪‣]|\(?\d{1,3}(?:\.\d{1,3})*[.)]|\(?(?:[ivxIVX]{1,4}|[a-zA-Z])[.)])\s+")
_END = re.compile(r"[.!?;:][\"'”’»)\]]*$")
_LAST_END = re.compile(r".*[.!?;:][\"'”’»)\]]*(?=\s|$)", re.S)
_LEADERS = re.compile(r"\.{4,}|(?: \.){4,}|_{4,}")
_WORDS = re.compile(r"[^\W\d_]+")
_PAIR = re.compile(r"[^\W\d_][\w-]*\s?[:=]\s?\S")
_GAPS = re.compile(r"\S(?: {3,}|\t)")
_BRACKETS = re.compile(r"\([^)]*\)")
_DIGITS = re.compile(r"\d")


def line_statistics(line: str, common: frozenset[str]) -> tuple[int, ...]:
    """The bins of one stripped line, without those that depend on other lines."""
    if "(" in line and len(bare := _BRACKETS.sub("", line).rstrip(" .;:!?")) > 0.5 * len(line):
        line = bare + line[-1]  # what stands in brackets is beside the sentence
    n = len(line)
    bullet = _BULLET.match(line)
    body = line[bullet.end() :] if bullet else line
    words = _WORDS.findall(body.lower())
    count, letters, pieces, semicolons = len(words), sum(map(len, words)), body.count(" ") + 1, line.count(";")
    shared = sum(map(common.__contains__, words)) / count if count else 0.0
    if "{" in line and ":" in line or line.startswith("<") or line.count("|") >= 2 or "\t" in line or _GAPS.search(line) or semicolons >= 2 and n < 40 * semicolons:
        separators = CELLS
    elif _LEADERS.search(line):
        separators = LEADERS
    else:
        separators = PAIR if pieces <= 6 and _PAIR.match(line) else NONE
    return (
        ENDED if _END.search(line) else COMMA if line.endswith((",", "-")) else OPEN,
        BULLET if bullet else CAPITAL if line[0].isupper() else SMALL if line[0].islower() else OTHER,
        bisect_right((1, 4, 7, 13), count),
        0 if count < 4 else 1 + bisect_right((0.1, 0.16, 0.3, 0.9), shared),
        bisect_right((0.3, 0.55, 0.72), letters / n),
        bisect_right((0.05, 0.3), len(_DIGITS.findall(line)) / n),
        separators,
        int(n / pieces > 22),
        bisect_right((20, 40, 90), n),
    )


def _runs_on(bins: tuple[int, ...]) -> bool:
    """Whether a line is running text that breaks off: the next line goes on with it."""
    end, _, words, common, _, _, separators, _, length = bins
    return end != ENDED and words >= 2 and common in (3, 4) and separators == NONE and length >= 2


def observe(text: str | None, common: frozenset[str], known: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, list[str], list[bool]]:
    """The observations of the lines of a text, the stripped lines, and whether a blank line stands before each."""
    seen: list[tuple[int, ...]] = []
    lines, fresh, met, gap, before = [], [], set(), True, None
    for raw in (text or "").split("\n"):
        line = raw.strip()
        if not line:
            gap = True
            continue
        repeated = False
        if len(line) < 60:
            bins = known.get(line)
            if bins is None:
                bins = known[line] = line_statistics(line, common)
            folded = line.lower()
            repeated = folded in met and bins[0] != ENDED and not line[0].islower()
            met.add(folded)
        else:
            bins = line_statistics(line, common)
        joins = APART if gap or before is None else AFTER_END if before[0] == ENDED else RUNS_ON if _runs_on(before) else AFTER_OTHER
        seen.append((*bins, int(repeated), joins))
        lines.append(line)
        fresh.append(gap)
        gap, before = False, bins
    return (np.array(seen, dtype=np.int64).reshape(-1, len(BINS)) @ _STEP).astype(np.int32), lines, fresh


def bins_of(codes: np.ndarray) -> dict[str, np.ndarray]:
    """The bins of each statistic behind observations."""
    return {name: codes // step % size for (name, size), step in zip(BINS.items(), _STEP)}


def seeded(codes: np.ndarray) -> np.ndarray:
    """The state a seed rule recognises an observation as, or -1; later rules go before earlier ones."""
    b = bins_of(codes)
    out = np.full(len(codes), -1, dtype=np.int64)
    plain = (b["separators"] == NONE) & (b["longest"] == 0) & (b["digits"] < 2)
    fluent = plain & (b["common"] >= 3) & (b["common"] <= 4) & (b["letters"] >= 2)
    ended, joins, bare = b["end"] == ENDED, b["joins"], (b["separators"] == NONE) & (b["longest"] == 0)
    rules = {
        "sentences": fluent & ended & (b["words"] >= 3),
        "wrapped": (fluent & ~ended & (b["words"] >= 2) & (b["length"] >= 2) & ((b["start"] == CAPITAL) | (b["start"] == SMALL))) | (fluent & ended & (joins == RUNS_ON) & (b["words"] >= 2)),
        "tail": bare & (joins == RUNS_ON) & ended & (b["length"] <= 1) & (b["start"] != BULLET) & (b["common"] != 1),
        "items": plain & (b["start"] == BULLET) & ~ended & (b["words"] <= 2) & (b["letters"] >= 2),
        "records": b["separators"] == CELLS,
        "figures": (b["separators"] == PAIR) | (bare & (b["digits"] == 2) & (~ended | (joins != RUNS_ON))),
        "fragments": plain & (b["repeated"] == 1) & (b["start"] != BULLET),
        "noise": (b["longest"] == 1) | (b["common"] == 5) | (b["separators"] == LEADERS),
        "wordless": plain & ((b["common"] == 1) | ((b["common"] == 2) & (b["start"] == CAPITAL))) & (b["words"] >= 2) & (b["start"] != BULLET) & (joins != RUNS_ON),
    }
    for name, holds in rules.items():
        out[holds] = list(STATES).index(name)
    return out


@dataclass(frozen=True)
class Model:
    """Logarithms: ``emission[statistic][state, bin]``, ``move[from, to]``, ``start[state]``."""

    emission: tuple[np.ndarray, ...]
    move: np.ndarray
    start: np.ndarray

    def seen(self, codes: np.ndarray) -> np.ndarray:
        """How likely each state shows each observation (observations × states)."""
        return sum(e[:, b].T for e, b in zip(self.emission, bins_of(codes).values()))


@functools.cache
def _prior() -> tuple[np.ndarray, ...]:
    """Counts of bins per state: every combination a seed rule admits once, scaled to ``PRIOR_LINES``, and a little of everything."""
    codes = np.arange(int(_SIZES.prod()), dtype=np.int64)
    state = seeded(codes)
    out = []
    for bins, size in zip(bins_of(codes).values(), _SIZES):
        counts = np.stack([np.bincount(bins[state == s], minlength=size) for s in range(len(STATES))]).astype(float)
        out.append(PRIOR_LINES * counts / counts.sum(axis=1, keepdims=True) + 0.5)
    return tuple(out)


def _estimate(codes: np.ndarray, weights: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> Model:
    """The model of expected counts: ``weights`` of observations × states, moves and starts."""
    emission = []
    for bins, size, prior in zip(bins_of(codes).values(), _SIZES, _prior()):
        counts = prior + np.stack([np.bincount(bins, weights=weights[:, s], minlength=size) for s in range(len(STATES))])
        emission.append(np.log(counts / counts.sum(axis=1, keepdims=True)))
    moves = moves + 0.5 + 5 * np.eye(len(STATES))
    return Model(tuple(emission), np.log(moves / moves.sum(axis=1, keepdims=True)), np.log((starts + 1) / (starts + 1).sum()))


def _columns(sequences: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sequences from long to short, and the values at each place of those that reach it."""
    order = np.argsort([-len(x) for x in sequences], kind="stable")
    sizes = np.array([len(sequences[i]) for i in order])
    places = []
    for t in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -t, side="left"))
        places.append(np.array([sequences[i][t] for i in order[:live]]))
    return order, places


def expected(model: Model, sequences: list[np.ndarray], distinct: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of observations × states, moves and starts; all sequences go forward and back together.

    Sequences hold places in ``distinct``; ``held`` is the state each of those keeps, or -1.
    """
    n_states = len(STATES)
    shown = model.seen(distinct)
    shown = shown - shown.max(axis=1, keepdims=True)
    fixed = np.flatnonzero(held >= 0)
    alone = np.full((len(fixed), n_states), -np.inf)
    alone[np.arange(len(fixed)), held[fixed]] = 0.0
    shown[fixed] = alone
    shown, move = np.exp(shown), np.exp(model.move)
    _, places = _columns(sequences)
    weights, moves, starts = np.zeros((len(distinct), n_states)), np.zeros((n_states, n_states)), np.zeros(n_states)
    ahead: list[np.ndarray] = []
    for t, at in enumerate(places):
        now = shown[at] * (np.exp(model.start) if t == 0 else ahead[-1][: len(at)] @ move)
        ahead.append(now / now.sum(axis=1, keepdims=True))
    back = np.empty((0, n_states))
    for t in range(len(places) - 1, -1, -1):
        at = places[t]
        behind = np.ones((len(at), n_states))
        if t + 1 < len(places):
            k = len(places[t + 1])
            coming = shown[places[t + 1]] * back
            behind[:k] = coming @ move.T
            both = ahead[t][:k, :, None] * move * coming[:, None, :]
            moves += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = behind / behind.sum(axis=1, keepdims=True)
        state = ahead[t] * back
        state /= state.sum(axis=1, keepdims=True)
        np.add.at(weights, at, state)
        if t == 0:
            starts += state.sum(axis=0)
    return weights, moves, starts


def fit(sequences: list[np.ndarray], rounds: int = FIT_ROUNDS) -> Model:
    """Baum–Welch on sequences of observations; observations that a seed rule recognises keep their state."""
    sequences = [x for x in sequences if len(x)]
    if not sequences:
        return _estimate(np.empty(0, dtype=np.int64), np.empty((0, len(STATES))), np.zeros((len(STATES), len(STATES))), np.zeros(len(STATES)))
    distinct, places = np.unique(np.concatenate(sequences), return_inverse=True)
    sequences = np.split(places, np.cumsum([len(x) for x in sequences])[:-1])
    held = seeded(distinct)
    often = np.bincount(places, minlength=len(distinct)).astype(float)
    weights = np.zeros((len(distinct), len(STATES)))
    weights[np.flatnonzero(held >= 0), held[held >= 0]] = often[held >= 0]
    model = _estimate(distinct, weights, np.zeros((len(STATES), len(STATES))), np.zeros(len(STATES)))
    for _ in range(rounds):
        model = _estimate(distinct, *expected(model, sequences, distinct, held))
    return model


def most_likely(model: Model, sequences: list[np.ndarray]) -> list[np.ndarray]:
    """The most likely states of each sequence of observations; all sequences advance together."""
    out: list[np.ndarray] = [np.empty(0, dtype=np.int8)] * len(sequences)
    if not any(map(len, sequences)):
        return out
    distinct, places = np.unique(np.concatenate(sequences), return_inverse=True)
    seen = model.seen(distinct)
    indexed = np.split(places, np.cumsum([len(x) for x in sequences])[:-1])
    order, columns = _columns(indexed)
    score, back = np.empty(0), []
    ends = np.zeros(len(order), dtype=np.int64)
    for t, at in enumerate(columns):
        if t == 0:
            score = model.start + seen[at]
            back.append(np.empty(0, dtype=np.int8))
            continue
        ends[len(at) : len(score)] = score[len(at) :].argmax(axis=1)
        paths = score[: len(at), :, None] + model.move
        back.append(paths.argmax(axis=1).astype(np.int8))
        score = paths.max(axis=1) + seen[at]
    ends[: len(score)] = score.argmax(axis=1)
    for row, i in enumerate(order):
        n = len(sequences[i])
        states = np.empty(n, dtype=np.int8)
        if n:
            states[-1] = ends[row]
            for t in range(n - 1, 0, -1):
                states[t - 1] = back[t][row, states[t]]
        out[i] = states
    return out


def labels_of(states: np.ndarray) -> np.ndarray:
    return _LABEL_OF[states]


def complete_characters(labels: np.ndarray, lines: list[str], fresh: list[bool]) -> int:
    """Characters of prose lines up to the last sentence end of each paragraph."""
    total, run = 0, []
    for label, line, new in zip(labels, lines, fresh):
        if run and (new or label != 0):
            total += _ended(run)
            run = []
        if label == 0:
            run.append(line)
    return total + (_ended(run) if run else 0)


def _ended(run: list[str]) -> int:
    if _END.search(run[-1]):
        return sum(map(len, run))
    for k in range(len(run) - 1, -1, -1):
        if m := _LAST_END.match(run[k]):
            return sum(map(len, run[:k])) + m.end()
    return 0


def bounded_words(common_words: DataFrame, max_words: int = MAX_COMMON_WORDS) -> frozenset[str]:
    """The common words of all languages; an error if there are more than ``max_words``."""
    rows = common_words.select(F.lower("word").alias("w")).filter("w IS NOT NULL AND w <> ''").distinct().limit(max_words + 1).collect()
    if len(rows) > max_words:
        raise ValueError(f"more than {max_words} common words")
    return frozenset(r["w"] for r in rows)


def fitted(documents: DataFrame, common: frozenset[str], n: int = FIT_DOCUMENTS, longest: int = FIT_CHARACTERS) -> Model:
    """The model fitted on about ``n`` documents drawn by hash, at most twice as many; documents over ``longest`` characters are not drawn."""
    total = documents.count()
    if not total:
        return fit([])
    drawn = documents.filter("text IS NOT NULL").select("doc_id", "text").filter((F.length("text") <= longest) & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.lit(int(min(1.0, n / total) * (1 << 30)) + 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, ...]] = {}
        for pdf in batches:
            found = [observe(t, common, known)[0].tolist() for t in pdf["text"]]
            yield pd.DataFrame({"codes": found})

    rows = drawn.mapInPandas(run, "codes array<int>").limit(2 * n).collect()
    return fit(sorted((np.array(r["codes"], dtype=np.int64) for r in rows), key=lambda x: (len(x), x.tolist())))


def line_labels(documents: DataFrame, common_words: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, n_lines, n_line_chars, prose_chars, list_chars, table_chars, junk_chars, sentence_chars``."""
    common = bounded_words(common_words)
    trained = model or fitted(documents.filter("doc_id IS NOT NULL"), common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, ...]] = {}
        for pdf in batches:
            if len(known) > 200_000:
                known.clear()
            seen = [observe(t, common, known) for t in pdf["text"]]
            rows = []
            for doc_id, (_, lines, fresh), states in zip(pdf["doc_id"], seen, most_likely(trained, [s[0] for s in seen])):
                labels = labels_of(states)
                sizes = np.array([len(x) for x in lines], dtype=np.int64)
                by = np.bincount(labels, weights=sizes, minlength=4).astype(np.int64) if len(lines) else np.zeros(4, dtype=np.int64)
                rows.append((doc_id, len(lines), int(sizes.sum()), *map(int, by), complete_characters(labels, lines, fresh)))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "n_lines", "n_line_chars", *(f"{x}_chars" for x in LABELS), "sentence_chars"])

    schema = "doc_id long, n_lines long, n_line_chars long, prose_chars long, list_chars long, table_chars long, junk_chars long, sentence_chars long"
    return documents.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(run, schema)


def not_prose(labels: DataFrame, share: float = 0.5) -> DataFrame:
    """Documents in which less than ``share`` of the characters stand in complete sentences."""
    return labels.filter((F.col("n_line_chars") > 0) & (F.col("sentence_chars") < share * F.col("n_line_chars")))


def text_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """Counts and ratios of each text, all JVM-side."""
    common = sorted(bounded_words(common_words))
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    parts = documents.select("doc_id", text.alias("t"), words.alias("w"), lines.alias("l"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.round(a / b, 6))

    n_words, n_chars, n_lines = F.size("w"), F.length("t"), F.size("l")
    return parts.select(
        "doc_id",
        n_chars.cast("long").alias("n_characters"),
        n_words.cast("long").alias("n_words"),
        n_lines.cast("long").alias("n_lines"),
        ratio(F.length(F.array_join("w", "")), n_words).alias("mean_word_length"),
        ratio(F.length(F.regexp_replace("t", r"[\p{L}\p{N}\s]", "")), n_chars).alias("symbol_ratio"),
        ratio(F.size(F.filter("l", lambda x: x.rlike(r"[.!?;:]\z"))), n_lines).alias("ended_line_share"),
        ratio(F.size(F.filter("w", lambda x: x.isin(common))), n_words).alias("common_word_share"),
    )
