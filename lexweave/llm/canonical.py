"""Free entries mapped to the items of a closed list (problem 3).

A multi-pattern automaton over the canonical names and aliases of a column finds
the names embedded in an entry; the longest non-overlapping mentions win.  What
carries no mention goes to token-set similarity, which bears typing slips,
shortened words and another word order.  Every entry is judged on its own, so
the operator is one pass over the rows without a shuffle.

The lists travel to the workers.  Their size is checked: more than ``max_items``
items raise an error instead of being broadcast.

Defined results: null and blank entries and codes without a list are left out; a
bare number means the item of that number where the official texts are numbered
and no item elsewhere; an entry naming two different items equally long, or
equally similar to two items, means none (0); repeated entries give repeated
rows; an empty list or table gives no rows; extra columns are never read.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ITEMS = 50_000
#: similarity from which an entry means an item, and the lead it needs over every other item
MIN_SIMILARITY, MIN_LEAD = 0.7, 0.02

# fixed values: letters without a decomposition, as typed on a plain keyboard
_PLAIN = str.maketrans({"æ": "ae", "ø": "o", "œ": "oe", "ß": "ss", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})
_NUMBERED = re.compile(r"\s*(\d+)\s*[.)]\s*(?=\S)")
_BARE = re.compile(r"\(?\s*(?:nr\.?\s*)?0*(\d{1,9})\s*[.)]?\s*")
_REMARK = re.compile(r"\s*(?:\(.*|/.*|\*+|,\s.*|\s[-–—]\s.*)$", re.S)
_WORD = re.compile(r"[^\W_]+\.?")


def fold(text: str) -> str:
    """Lower case without accents, every run of separators one blank; full stops stay."""
    text = unicodedata.normalize("NFKD", text).casefold().translate(_PLAIN)
    text = "".join(c for c in text if not unicodedata.combining(c))
    return " ".join(re.sub(r"[\s_\-­‐-―]+", " ", text).split())


@functools.lru_cache(maxsize=1 << 16)
def _places(word: str) -> tuple[dict[str, int], frozenset[str]]:
    """For each letter of a word the bits of its places, and its letters."""
    places: dict[str, int] = {}
    for i, c in enumerate(word):
        places[c] = places.get(c, 0) | 1 << i
    return places, frozenset(places)


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; most + 1 if there are more.

    A column of the table of distances is two integers of bits (Hyyrö 2003), one
    step a letter of ``a``.  Every letter that ``b`` lacks costs one edit at
    least, which decides most pairs before the first step.
    """
    n = len(b)
    if abs(len(a) - n) > most:
        return most + 1
    if not n:
        return len(a)
    places, letters = _places(b)
    if len(set(a) - letters) > most:
        return most + 1
    full, last = (1 << n) - 1, 1 << (n - 1)
    up, down, diagonal, before, distance = full, 0, 0, 0, n
    for c in a:
        here = places.get(c, 0)
        swap = ((~diagonal & here) << 1) & before
        diagonal = ((((here & up) + up) ^ up) | here | down | swap) & full
        rise = (down | ~(diagonal | up)) & full
        fall = diagonal & up
        if rise & last:
            distance += 1
        elif fall & last:
            distance -= 1
        rise = (rise << 1 | 1) & full
        up = (fall << 1 | ~(diagonal | rise)) & full
        down = diagonal & rise
        before = here
    return min(distance, most + 1)


def _word_match(v: str, dotted: bool, c: str) -> tuple[float, float]:
    """How well word ``v`` stands for ``c`` (0 to 1), and the share of ``c`` it covers."""
    if v == c:
        return 1.0, 1.0
    if c.startswith(v):
        return (0.95 if dotted or len(v) >= 3 else 0.9), len(v) / len(c)
    most = 1 if len(c) < 4 else 2
    d = edits(v, c, most)
    if d <= most and d < len(c) * 0.5:
        return 1 - d / max(len(v), len(c)), 1 - d / max(len(v), len(c))
    if len(v) >= 5 and len(c) > len(v) and min(edits(v, c[: len(v) + k], 1) for k in (-1, 0, 1)) <= 1:
        return 0.85, len(v) / len(c)
    return 0.0, 0.0


def token_set(value: list[tuple[str, bool]], name: list[str]) -> float:
    """Similarity of an entry's words to a name's words, in any order.

    The share of the entry that stands for words of the name weighs 0.6, the
    share of the name that is covered 0.4; 0 where either is too small.
    """
    left = list(value)
    fit = covered = 0.0
    for c in sorted(name, key=len, reverse=True):
        best, at = (0.0, 0.0), -1
        for i, (v, dotted) in enumerate(left):
            m = _word_match(v, dotted, c)
            if m > best:
                best, at = m, i
        if at >= 0:
            fit += best[0] * len(left[at][0])
            covered += best[1] * len(c)
            left.pop(at)
    total = sum(len(v) for v, _ in value)
    if not total:
        return 0.0
    precision, coverage = fit / total, covered / sum(map(len, name))
    return 0.6 * precision + 0.4 * coverage if precision >= 0.8 and coverage >= 0.4 else 0.0


class ClosedList:
    """One column's list: its automaton, its numbers and its names."""

    def __init__(self, items: list[tuple[int, str, list[str]]]):
        import ahocorasick

        self.numbers: set[int] = set()
        self.names: list[tuple[str, list[str], int]] = []
        owners: dict[str, set[int]] = {}
        for no, official, alternatives in items:
            if official and (m := _NUMBERED.match(official)) and int(m[1]) == no:
                self.numbers.add(no)
            for text in [official, *(alternatives or [])]:
                if text and (name := fold(_NUMBERED.sub("", text, count=1))):
                    owners.setdefault(name, set()).add(no)
        self.automaton = ahocorasick.Automaton()
        for name, own in owners.items():
            self.automaton.add_word(name, (len(name), own))
            self.names += [(name, [w.rstrip(".") for w in _WORD.findall(name)], no) for no in own]
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def mentions(self, text: str) -> list[tuple[int, int, set[int]]]:
        """Longest non-overlapping names standing in ``text`` as whole words."""
        found = []
        for end, (size, own) in self.automaton.iter(text):
            start = end - size + 1
            if (start == 0 or not text[start - 1].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
                found.append((size, start, own))
        kept: list[tuple[int, int, set[int]]] = []
        for size, start, own in sorted(found, key=lambda x: (-x[0], x[1])):
            if all(start >= s + n or s >= start + size for n, s, _ in kept):
                kept.append((size, start, own))
        return kept

    def similar(self, text: str) -> tuple[int, float]:
        """The item most similar to ``text``, 0 if none is near or two are equally near."""
        words = [(w.rstrip("."), w.endswith(".")) for w in _WORD.findall(text)]
        joined = "".join(w for w, _ in words)
        best: dict[int, float] = {}
        for name, name_words, no in self.names:
            whole = name.replace(" ", "")
            longest = max(len(joined), len(whole))
            most = int(longest * (1 - MIN_SIMILARITY))
            score = 0.0
            if joined and abs(len(joined) - len(whole)) <= most and (d := edits(joined, whole, most)) <= most:
                score = 1 - d / longest
            score = max(score, token_set(words, name_words))
            if score > best.get(no, 0.0):
                best[no] = score
        ranked = sorted(best.items(), key=lambda x: -x[1])
        if not ranked or ranked[0][1] < MIN_SIMILARITY or len(ranked) > 1 and ranked[0][1] - ranked[1][1] < MIN_LEAD:
            return 0, ranked[0][1] if ranked else 0.0
        return ranked[0]

    def find(self, entry: str) -> tuple[int, str, float]:
        """``(item, how, score)``: how is number, mention, similar or none."""
        if self.empty:
            return 0, "none", 0.0
        if m := _BARE.fullmatch(entry.strip()):
            no = int(m[1])
            return (no, "number", 1.0) if no in self.numbers else (0, "none", 0.0)
        text = fold(entry)
        if kept := self.mentions(text):
            own = {no for size, _, nos in kept if size == kept[0][0] for no in nos}
            return (own.pop(), "mention", 1.0) if len(own) == 1 else (0, "none", 0.0)
        text = _NUMBERED.sub("", text, count=1)
        no, score = max((self.similar(t) for t in {text, _REMARK.sub("", text)}), key=lambda x: (x[0] > 0, x[1]))
        return (no, "similar", score) if no else (0, "none", score)


def bounded_lists(closed_lists: DataFrame, max_items: int = MAX_ITEMS) -> dict[str, list[tuple[int, str, list[str]]]]:
    """The lists by column code; an error if there are more than ``max_items`` items."""
    rows = closed_lists.select("column_code", "item_no", "official_text", "alt_texts").filter("column_code IS NOT NULL AND item_no IS NOT NULL").limit(max_items + 1).collect()
    if len(rows) > max_items:
        raise ValueError(f"the closed lists hold more than {max_items} items")
    lists: dict[str, list[tuple[int, str, list[str]]]] = {}
    for r in sorted(rows, key=lambda r: (r["column_code"], r["item_no"])):
        lists.setdefault(r["column_code"], []).append((r["item_no"], r["official_text"], [a for a in r["alt_texts"] or [] if a]))
    return lists


def canonical_items(entries: DataFrame, closed_lists: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """``row_key, column_code, entry`` with ``item_no, how, score`` for codes that have a list."""
    lists = bounded_lists(closed_lists, max_items)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built = {code: ClosedList(items) for code, items in lists.items()}
        seen: dict[tuple[str, str], tuple[int, str, float]] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            if len(seen) > 200_000:  # remembered answers, not results
                seen.clear()
            answers = []
            for key in zip(pdf["column_code"], pdf["entry"]):
                if (a := seen.get(key)) is None:
                    a = seen[key] = built[key[0]].find(key[1])
                answers.append(a)
            out = pdf.copy()
            out["item_no"] = pd.Series([a[0] for a in answers], dtype="int32")
            out["how"] = [a[1] for a in answers]
            out["score"] = pd.Series([float(a[2]) for a in answers], dtype="float64")
            yield out

    wanted = entries.filter(F.col("column_code").isin(list(lists)) & ~F.coalesce(F.col("entry"), F.lit("")).rlike(r"\A\s*\z"))
    return wanted.select("row_key", "column_code", "entry").mapInPandas(run, "row_key long, column_code string, entry string, item_no int, how string, score double")


def manual_entries(arrangements: DataFrame) -> DataFrame:
    """``row_key, column_code, entry`` of every free entry."""
    return arrangements.select(F.col("arr_row").alias("row_key"), F.explode("manual").alias("column_code", "entry"))


def unmatched(mapped: DataFrame) -> DataFrame:
    """Entries meaning no item, with how often each was typed."""
    return mapped.filter("item_no = 0").groupBy("column_code", "entry").agg(F.count("*").alias("n_rows"), F.round(F.max("score"), 6).alias("best_score"))
