"""Text functions as columns: cleaning, folding, slugs, clipping, highlighting, cells, numerals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: lower-case Latin letters with a mark, and the letter without it
FOLD_FROM = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
FOLD_TO = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"

# fixed values: Dutch words that carry no search
STOPWORDS = (
    "de", "het", "een", "en", "van", "in", "op", "te", "die", "dat", "voor", "met", "zijn", "is", "aan", "als", "of", "door", "worden", "wordt",
    "bij", "naar", "om", "tot", "uit", "over", "ook", "deze", "dit", "der", "niet", "waarin", "onder",
)

TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def clean(c: Column) -> Column:
    """No-break spaces are spaces, white space collapses, ``( 1 )`` is ``(1)``, ends are trimmed."""
    spaced = F.regexp_replace(c, r"[\s\x{00A0}]+", " ")
    return F.trim(F.regexp_replace(spaced, r"\( ([0-9]+) \)", "($1)"))


def fold(c: Column) -> Column:
    """Lower case without marks, one character for one, so offsets hold."""
    return F.translate(F.lower(c), FOLD_FROM, FOLD_TO)


def tokens(c: Column) -> Column:
    """Folded words and numbers in order; an array without empty words."""
    return F.filter(F.split(fold(c), TOKEN_BREAK), lambda t: t != "")


def is_searchable(term: Column) -> Column:
    """Folded terms that are kept in an index: no stopword, and longer than one unless a digit."""
    return ~term.isin(*STOPWORDS) & ((F.length(term) > 1) | term.rlike(r"\A[0-9]\z"))


def slug(c: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"\A-+|-+\z", "")


def without_corrigendum(c: Column) -> Column:
    """Marks of corrections off: ``►C1 text ◄`` is ``text``."""
    return F.trim(F.regexp_replace(c, "►C[0-9]+|◄", ""))


def file_name(c: Column) -> Column:
    """Runs of anything but letters, digits, hyphens and underscores of ASCII one underscore."""
    return F.regexp_replace(c, "[^A-Za-z0-9_-]+", "_")


def zero_padded(c: Column, size: int = 2) -> Column:
    """A whole number with zeros before it; a longer one as it is."""
    text = c.cast("string")
    return F.when(F.length(text) < size, F.lpad(text, size, "0")).otherwise(text)


def clip(c: Column, size: int = 200, least: int = 120) -> Column:
    """At most ``size`` characters, cut at the last blank but never before ``least``, with an ellipsis."""
    text = F.trim(c)
    head = F.substring(text, 1, size)
    last_blank = F.length(head) - F.locate(" ", F.reverse(head))  # 0-based; length where there is none
    cut = F.when(F.contains(head, F.lit(" ")), F.greatest(last_blank, F.lit(least))).otherwise(F.lit(least))
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(head, F.lit(1), cut), F.lit("…")))


def highlight(c: Column, terms: list[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """Occurrences of the terms of two characters or more, in any case, between two marks."""
    wanted = sorted({re.escape(t) for t in terms if len(t) >= 2}, key=lambda t: (-len(t), t))
    return F.regexp_replace(c, f"(?i)({'|'.join(wanted)})", f"{before}$1{after}") if wanted else c


def csv_cell(c: Column) -> Column:
    """Quoted where a quote, comma, line feed or semicolon stands in it; null is empty."""
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike('[",\n;]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(*cells: Column) -> Column:
    return F.concat_ws(",", *[csv_cell(c) for c in cells])


def plain_cell(c: Column) -> Column:
    """Tabs and line ends become one blank."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\r\n]+", " "))


def tsv_line(*cells: Column) -> Column:
    return F.concat_ws("\t", *[plain_cell(c) for c in cells])


def markdown_row(cells: Column) -> Column:
    """One row of a table from an array of texts: pipes escaped, line ends blanks."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\|", r"\\|"), r"\r?\n", " ")), " | "), F.lit(" |"))


def markdown_table(rows: Column) -> Column:
    """A table from an array of rows; the first row is the head."""
    head = F.element_at(rows, 1)
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(head)))
    body = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), markdown_row)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(markdown_row(head), rule), body), "\n")).otherwise("")


def half_up(c: Column) -> Column:
    """Rounded to an integer, halves upwards."""
    return F.floor(c + F.lit(0.5))


_ROMAN = (("m", 1000), ("cm", 900), ("d", 500), ("cd", 400), ("c", 100), ("xc", 90), ("l", 50), ("xl", 40), ("x", 10), ("ix", 9), ("v", 5), ("iv", 4), ("i", 1))


def to_roman(c: Column) -> Column:
    """Numbers from 1 to 3999 as capital numerals; null outside."""
    rest, text = c, F.lit("")
    for sign, value in _ROMAN:
        text = F.concat(text, F.repeat(F.lit(sign.upper()), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.when(c.between(1, 3999), text)


def from_roman(c: Column) -> Column:
    """The number of a numeral in any case; null where the signs are no numeral."""
    signs = F.split(F.upper(F.trim(c)), "")
    value = F.create_map(*[F.lit(x) for s, v in _ROMAN if len(s) == 1 for x in (s.upper(), v)])
    values = F.filter(F.transform(signs, lambda s: F.coalesce(value[s], F.lit(0))), lambda v: v > 0)
    total = F.aggregate(
        values,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda a, v: F.struct((a["sum"] + v - F.when(a["last"] < v, a["last"] * 2).otherwise(0)).alias("sum"), v.alias("last")),
        lambda a: a["sum"],
    )
    return F.when(F.upper(F.trim(c)).rlike(r"\A(?=[MDCLXVI])M*(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})\z"), total)
