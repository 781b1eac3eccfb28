"""Citations in legal text: finding them, resolving them, counting them.

Text is read as tokens.  A small lexicon gives every token a class of one
letter, so a sentence becomes a string of classes and the grammar of citations
is a handful of patterns over classes – a chunk grammar – in which a match is a
run of tokens.  A phrase is a kind (article, annex, chapter, recital), its
numbers and what narrows them down; a walk over its tokens gives each number its
role, and a table of rules says which roles become links.

The act a phrase means is settled from the last phrase of a sentence to the
first: by what stands behind it, else by what the phrase it is joined to means,
else it is the act the text stands in.  Resolution against pages and anchors is
two joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators.tree import marker_slug

SPAN_SCHEMA = "ord int, start_pos int, end_pos int, href string"
#: joined phrases farther than this from the act named behind them mean the act they stand in
FARTHEST_JOIN = 8

# fixed values: the words citations are made of, and the class of each
LEXICON = {
    "artikel": "A", "artikelen": "A", "bijlage": "B", "bijlagen": "B", "hoofdstuk": "H", "hoofdstukken": "H", "overweging": "O", "overwegingen": "O",
    "lid": "l", "leden": "L", "punt": "p", "punten": "Q", "alinea": "a", "afdeling": "s", "afdelingen": "s",
    "eerste": "d", "tweede": "d", "derde": "d", "vierde": "d", "vijfde": "d", "zesde": "d", "zevende": "d", "achtste": "d", "negende": "d", "tiende": "d", "laatste": "d",
    "en": "e", "of": "f", "tot": "t", "met": "m", "respectievelijk": "r", "onverminderd": "u", "van": "v", "bij": "v",
    "de": "E", "het": "E", "die": "K", "dat": "K", "een": "K", "deze": "D", "onderhavige": "o", "gedelegeerde": "g",
    "verordening": "V", "uitvoeringsverordening": "V", "VWEU": "T", "VEU": "T",
}
# fixed values: what an act is called; compounds end in these
ACT_NOUNS = ("verordening", "verordeningen", "richtlijn", "richtlijnen", "besluit", "besluiten", "aanbeveling", "aanbevelingen", "verdrag", "verdragen", "handvest", "overeenkomst", "overeenkomsten", "akkoord", "protocol")

KINDS = {"A": "artikel", "B": "bijlage", "H": "hoofdstuk", "O": "overweging"}
_STEM = re.compile("|".join(f"[{k[0].upper()}{k[0]}]{k[1:]}" for k in KINDS.values()))
#: nothing is cited across these
_BREAK = re.compile(r"[;:!?\n\r\t]|\.(?!\d)")
_TOKEN = re.compile(r"(?P<bracketed>\(\d+\))|(?P<point>(?<!\w)[a-z]{1,2}\)|(?<!\w)[ivx]{3,}\))|(?P<slashed>\d+(?:\.\d+)*/[\d/.]*)|(?P<dotted>\d+(?:\.\d+)+)|(?P<number>\d+)|(?P<word>[^\W\d_]\w*(?:-\w+)*)|(?P<blank>[ \u00a0]+)|(?P<other>.)", re.S)


@dataclass(frozen=True)
class Act:
    """An act that can be cited: its form in text and the prefix of its pages."""

    id: str
    citation: str
    route_prefix: str


def word_class(word: str) -> str:
    """The class of a word: the lexicon's, else act noun, numeral, capital letter, capitalised or other word."""
    if found := LEXICON.get(word):
        return found
    small = word[0].lower() + word[1:]
    if LEXICON.get(small) in KINDS:
        return LEXICON[small]
    if small.endswith(ACT_NOUNS):
        return "N"
    if not word.strip("IVX"):
        return "X" if len(word) == 1 else "x"
    if len(word) == 1 and word.isupper():
        return "S"
    return "W" if word[0].isupper() else "w"


@dataclass
class Tokens:
    """A stretch of text as tokens; blanks only separate."""

    classes: str
    starts: list[int]
    ends: list[int]
    texts: list[str]

    @staticmethod
    def of(text: str, start: int = 0, end: int | None = None) -> Tokens:
        classes, starts, ends, texts = [], [], [], []

        def add(cls: str, at: int, piece: str) -> None:
            classes.append(cls)
            starts.append(at)
            ends.append(at + len(piece))
            texts.append(piece)

        for m in _TOKEN.finditer(text, start, len(text) if end is None else end):
            kind, piece, at = m.lastgroup, m[0], m.start()
            if kind == "blank":
                continue
            if kind == "word":
                head, joint, last = piece.rpartition("-")
                if joint and word_class(last) in KINDS:  # a compound that ends in a kind still cites
                    add("w", at, head)
                    add(word_class(last), at + len(head) + 1, last)
                else:
                    add(word_class(piece), at, piece)
            elif kind == "point":
                roman = not piece[:-1].strip("ivx")
                add("j" if len(piece) > 3 else "i" if roman else "c", at, piece)
            else:
                add({"bracketed": "k", "slashed": "y", "dotted": "q", "number": "n"}.get(kind or "", piece if piece in ",)" else "z"), at, piece)
        return Tokens("".join(classes), starts, ends, texts)


def _several(one: str) -> str:
    """One, the two ends of a range, or an enumeration."""
    return f"{one}(?:t?em{one}|(?:,{one})*(?:,?(?:t?em?|f){one})?)"


_POINT = r"(?:[ci]|[nq]\)?)"
_PARAGRAPHS = f"(?:ln|L{_several('n')})"
_POINTS = f"(?:p{_POINT}|Q{_several(_POINT)})"
#: what narrows a single number down; a bracketed number goes on with paragraphs named before
_NARROWER = f",e?{_POINTS}|,?rp{_POINT}|,da|,e?[ci](?:[ef][ci])*|,j|,?f[ci]"
_NARROWED = f"(?:{_NARROWER})*(?:,e?{_PARAGRAPHS}(?:{_NARROWER}|,e?{_PARAGRAPHS}|,e?k)*)?"
#: of each kind: its numbers, what may follow a single one, what may follow any
GRAMMAR = {
    kind: tuple(map(re.compile, parts))
    for kind, parts in {
        "A": (_several("n"), _NARROWED, ""),
        "B": (_several("[xX]"), f"(?:,s[SX])?{_NARROWED}", ""),
        "H": (_several("[xX]"), "", "(?:,s[xXn](?:e[xXn])?)?"),
        "O": (_several("n"), "", ""),
    }.items()
}
#: the roles of what narrows down; points "respectively" meant are no targets
_ROLES = re.compile(f"rp{_POINT}|(?P<paragraph>{_PARAGRAPHS}|k)|(?P<point>{_POINTS})|.")
_ITEMS = {"number": re.compile("[nxX]"), "paragraph": re.compile("[nk]"), "point": re.compile(_POINT)}
_BEHIND_SELF = re.compile("v(?:E?o|D)g?V")
_BEHIND_TREATY = re.compile("T")
_BEHIND_FOREIGN = re.compile("vr?[EK]?W?[NV]")
_JOINED = re.compile(",?[ef]u?E?|,")


@dataclass
class Phrase:
    """A citation phrase: the tokens from ``first`` up to ``stop``, and those of each role as ranges."""

    kind: str
    first: int
    stop: int
    roles: dict[str, list[tuple[int, int]]]


def read_phrase(tokens: Tokens, at: int) -> Phrase | None:
    """The phrase whose kind is token ``at``."""
    classes = tokens.classes
    several, after_one, after_any = GRAMMAR[classes[at]]
    numbers = several.match(classes, at + 1)
    if not numbers:
        return None
    found = {"number": [m.span() for m in _ITEMS["number"].finditer(classes, *numbers.span())], "paragraph": [], "point": []}
    stop = numbers.end()
    if len(found["number"]) == 1:
        stop = after_one.match(classes, stop).end()
    stop = after_any.match(classes, stop).end()
    for part in _ROLES.finditer(classes, numbers.end(), stop):
        if role := part.lastgroup:
            found[role] += [m.span() for m in _ITEMS[role].finditer(classes, *part.span())]
    return Phrase(KINDS[classes[at]], at, stop, found)


@dataclass(frozen=True)
class Rule:
    """Which role of a phrase is linked: for the kinds, where ``one`` stands once and ``some`` at least once."""

    kinds: tuple[str, ...]
    one: tuple[str, ...]
    some: tuple[str, ...]
    linked: str
    fragment: str
    #: the last link reaches to the end of the phrase where nothing of this role stands in it
    reaches_without: str | None = None


#: the first rule that fits holds
RULES = (
    Rule(("artikel",), ("number", "paragraph"), ("point",), "point", "#lid-{paragraph}-{value}"),
    Rule(("artikel",), ("number",), ("paragraph",), "paragraph", "#lid-{value}", "point"),
    Rule(("artikel", "bijlage"), ("number",), ("point",), "point", "#punt-{value}"),
    Rule(("bijlage", "hoofdstuk"), ("number",), (), "number", "", "point"),
    Rule(("artikel", "bijlage", "hoofdstuk", "overweging"), (), (), "number", ""),
)


def links(text: str, tokens: Tokens, phrase: Phrase, prefix: str) -> Iterator[tuple[int, int, str]]:
    """``(start, end, href)`` of each target of a phrase; the first starts at the word for its kind."""

    def value(role: str, k: int) -> str:
        first, stop = phrase.roles[role][k]
        raw = text[tokens.starts[first] : tokens.ends[stop - 1]]
        return marker_slug(raw) if role == "point" else raw.strip("()").lower()

    count = {role: len(found) for role, found in phrase.roles.items()}
    rule = next(r for r in RULES if phrase.kind in r.kinds and all(count[x] == 1 for x in r.one) and all(count[x] for x in r.some))
    base = f"{prefix}/#hoofdstuk-" if phrase.kind == "hoofdstuk" else f"{prefix}/{phrase.kind}/"
    for k, (first, stop) in enumerate(phrase.roles[rule.linked]):
        inside = int(tokens.classes[first] == "k")  # of a bracketed number the digits
        start, end = tokens.starts[first] + inside, tokens.ends[stop - 1] - inside
        if k == 0:
            start = tokens.starts[phrase.first]
        if rule.reaches_without and k == count[rule.linked] - 1 and not count[rule.reaches_without]:
            end = tokens.ends[phrase.stop - 1]
        number = value("number", k if rule.linked == "number" else 0)
        own = rule.fragment.format(value=value(rule.linked, k), paragraph=value("paragraph", 0) if "paragraph" in rule.one else "")
        yield start, end, base + number + own


class CitationReader:
    """Finds citations for a registry of acts; built once per worker."""

    def __init__(self, acts: list[Act]):
        self.prefix = {a.id: a.route_prefix for a in acts}
        self.forms = [(a.id, Tokens.of(a.citation).texts) for a in sorted(acts, key=lambda a: -len(a.citation)) if a.citation]

    def named_behind(self, tokens: Tokens, at: int, own: str) -> tuple[bool, str | None]:
        """Whether an act is named behind token ``at``, and which; none where it is not of the registry."""
        classes = tokens.classes
        at += classes[at : at + 1] == ","
        if _BEHIND_SELF.match(classes, at):
            return True, own
        if classes[at : at + 1] == "v":
            for act, form in self.forms:
                if tokens.texts[at + 1 : at + 1 + len(form)] == form:
                    return True, act
        return bool(_BEHIND_TREATY.match(classes, at) or _BEHIND_FOREIGN.match(classes, at)), None

    def acts_of(self, tokens: Tokens, phrases: list[Phrase], own: str, bare: bool) -> list[str | None]:
        """The act of each phrase, settled from the last to the first; none for acts outside the registry."""
        unnamed = own if bare else None
        out: list[str | None] = [None] * len(phrases)
        named, away = False, 0  # whether the phrase behind has its act from a name, and how many joins away that is
        for i in range(len(phrases) - 1, -1, -1):
            found, act = self.named_behind(tokens, phrases[i].stop, own)
            if found:
                out[i], named, away = act, True, 0
                continue
            joined = False
            if i + 1 < len(phrases):
                link = _JOINED.match(tokens.classes, phrases[i].stop)
                behind = phrases[i + 1].first
                joined = bool(link) and link.end() == behind and tokens.texts[behind][0].islower()
            named, away = named and joined and away < FARTHEST_JOIN, away + 1
            out[i] = out[i + 1] if named else unnamed
        return out

    def find(self, text: str, own: str, self_kind: str = "", self_ref: str = "", bare: bool = True) -> list[tuple[int, int, str]]:
        """``(start, end, href)`` of every citation; a page's links to itself without a fragment are left out."""
        own_page = f"{self.prefix.get(own, '')}/{self_kind}/{self_ref.lower()}"
        out: list[tuple[int, int, str]] = []
        at = 0
        while stem := _STEM.search(text, at):
            stop = _BREAK.search(text, stem.end())
            at = stop.end() if stop else len(text)
            begin = stem.start()
            while begin > 0 and (text[begin - 1].isalnum() or text[begin - 1] in "-_"):
                begin -= 1
            tokens = Tokens.of(text, begin, stop.start() if stop else None)
            phrases = [p for i, c in enumerate(tokens.classes) if c in KINDS and (p := read_phrase(tokens, i))]
            for phrase, act in zip(phrases, self.acts_of(tokens, phrases, own, bare)):
                if act is not None:
                    out += [x for x in links(text, tokens, phrase, self.prefix.get(act, "")) if x[2] != own_page]
        return out


def find_citations(texts: DataFrame, acts: list[Act] | None = None, bare: bool = True) -> DataFrame:
    """Citations of ``texts(row_id, body, act, route_prefix, self_kind, self_ref)``.

    An act that is not in the registry is known by the row's own prefix, so a
    corpus of many acts needs no registry for its bare citations; with ``bare``
    off only citations that name their act are links.
    """
    registry = acts or []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers: dict[tuple[str, str], CitationReader] = {}
        for pdf in batches:
            rows = []
            for row_id, body, act, prefix, kind, ref in zip(pdf["row_id"], pdf["body"], pdf["act"], pdf["route_prefix"], pdf["self_kind"], pdf["self_ref"]):
                if (act, prefix) not in readers:
                    if len(readers) > 10_000:
                        readers.clear()
                    readers[act, prefix] = CitationReader([*registry, Act(act or "", "", prefix or "")])
                for i, (start, end, href) in enumerate(readers[act, prefix].find(body, act or "", kind or "", ref or "", bare)):
                    rows.append((row_id, i, start, end, href))
            if rows:
                yield pd.DataFrame(rows, columns=["row_id", "ord", "start_pos", "end_pos", "href"])

    wanted = texts.select("row_id", "body", "act", "route_prefix", "self_kind", "self_ref").filter("body IS NOT NULL")
    # texts without a keyword never reach Python
    return wanted.filter(F.col("body").rlike("(?i)artikel|bijlage|hoofdstuk|overweging")).mapInPandas(run, f"row_id long, {SPAN_SCHEMA}")


def resolve(links: DataFrame, pages: DataFrame, anchors: DataFrame) -> DataFrame:
    """Links against ``pages(page)`` and ``anchors(page, anchor, n)``.

    ``state`` is ``missing`` where the page does not exist, ``stripped`` where
    the anchor does not exist or is not unique, ``linked`` otherwise.
    """
    split = links.withColumn("page", F.substring_index("href", "#", 1)).withColumn("anchor", F.when(F.contains("href", F.lit("#")), F.substring_index("href", "#", -1)))
    known = pages.select("page").distinct().withColumn("has_page", F.lit(True))
    unique = anchors.filter("n = 1").select("page", "anchor", F.lit(True).alias("has_anchor"))
    state = F.when(F.col("has_page").isNull(), "missing").when(F.col("anchor").isNotNull() & F.col("has_anchor").isNull(), "stripped").otherwise("linked")
    joined = split.join(known, "page", "left").join(unique, ["page", "anchor"], "left")
    return joined.select(*links.columns, state.alias("state"), F.when(state == "linked", F.col("href")).when(state == "stripped", F.col("page")).alias("resolved_href"))


def counts(links: DataFrame, by: str) -> DataFrame:
    """Links per group and in all (the row without a group)."""
    return links.rollup(by).agg(F.count("*").alias("n_refs"))
