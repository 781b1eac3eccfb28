"""One consistent written form for text that only looks alike (problem 4).

Texts are exploded to positioned code points, each code point meets its
decomposition, its replacement and its look-alike in the script of the row by a
broadcast join, combining marks are ordered by class and recomposed, and the
string is rebuilt.  The mapping tables follow from the Unicode character
database of the interpreter by rule, so their size is fixed.

Only texts that hold a code point which can change are exploded; every other
text is its own normal form.  Equal texts are exploded once.

What changes: canonical compositions; spaces of other widths and kinds to the
ordinary blank; hyphens to the ordinary hyphen; full- and half-width characters
to normal width; invisible characters to nothing; joined letters and Roman
numeral signs to plain letters; letters of another script that look like a
letter of the row's script, inside words that also hold letters of that script
(in markers: wherever they stand).  What stays: everything that differs in
print, letter case, repeated blanks, words wholly in another script.

Defined results: null text has no form and is never reported; empty text is its
own form; a null or unknown language counts as Latin script; repeated rows are
reported as often as they stand; extra columns are never read.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: letters that look the same in print, Latin with Greek and Latin with Cyrillic
GREEK_LATIN = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
}
CYRILLIC_LATIN = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
}
SCRIPT_OF_LANG = {"el": "Greek", "bg": "Cyrillic"}
SCRIPTS = ("Latin", "Greek", "Cyrillic")


def home_script(lang: Column) -> Column:
    known = F.lower(F.btrim(lang))
    out = F.when(known == "el", "Greek")
    return out.when(known == "bg", "Cyrillic").otherwise("Latin")


@functools.cache
def look_alikes() -> dict[str, dict[str, str]]:
    """For each home script, letters of the other scripts and the home letter they look like."""
    latin = {**GREEK_LATIN, **CYRILLIC_LATIN}
    greek = {v: k for k, v in reversed(GREEK_LATIN.items())}
    cyrillic = {v: k for k, v in reversed(CYRILLIC_LATIN.items())}
    to_greek = {**greek, **{k: greek[v] for k, v in CYRILLIC_LATIN.items() if v in greek}}
    to_cyrillic = {**cyrillic, **{k: cyrillic[v] for k, v in GREEK_LATIN.items() if v in cyrillic}}
    return {"Latin": latin, "Greek": to_greek, "Cyrillic": to_cyrillic}


def _invisible(c: str) -> bool:
    o = ord(c)
    return unicodedata.category(c) == "Cf" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5)


def _plain(c: str) -> str:
    """The replacement of one code point, before canonical decomposition."""
    if _invisible(c):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    if c in "‐‑":
        return "-"
    form = unicodedata.decomposition(c)
    if form.startswith(("<wide>", "<narrow>")):
        return unicodedata.normalize("NFKC", c)
    if form.startswith("<compat>"):
        name = unicodedata.name(c, "")
        plain = unicodedata.normalize("NFKC", c)
        joined = "LIGATURE" in name or unicodedata.category(c) in ("Ll", "Lu", "Lt") and len(plain) == 2 and plain.isalpha() and "N PRECEDED" not in name
        if (joined or name.startswith(("ROMAN NUMERAL", "SMALL ROMAN NUMERAL"))) and plain.isalpha():
            return plain
    return c


@functools.cache
def code_points() -> list[tuple[str, str, int]]:
    """``(character, canonical decomposition of its replacement, class)`` wherever one of them says something."""
    rows = []
    for o in range(0x110000):
        if 0xD800 <= o <= 0xDFFF or 0xAC00 <= o <= 0xD7A3:
            continue
        c = chr(o)
        to = unicodedata.normalize("NFD", _plain(c))
        cls = unicodedata.combining(c)
        if to != c or cls:
            rows.append((c, to, cls))
    return rows


@functools.cache
def compositions() -> dict[str, str]:
    """Pairs that compose, by the canonical rules of the database."""
    pairs = {}
    for c, to, _ in code_points():
        form = unicodedata.decomposition(c)
        if form and not form.startswith("<") and len(parts := form.split()) == 2:
            pair = "".join(chr(int(x, 16)) for x in parts)
            if unicodedata.normalize("NFC", pair) == c:
                pairs[pair] = c
    return pairs


def _char_class(chars: list[str]) -> str:
    """A regular-expression class of the characters, as ranges."""
    points = sorted(map(ord, chars))
    runs: list[list[int]] = []
    for p in points:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs)


@functools.cache
def _restless() -> str:
    """Class of the code points that do not stand alone as their own normal form, and of all marks."""
    return _char_class([c for c, to, cls in code_points() if cls or unicodedata.normalize("NFC", to) != c])


@functools.cache
def _calm(home: str) -> str:
    """Class of common code points that cannot change in a text of a home script: a few ranges, so one look decides most texts."""
    restless = {c for c, to, cls in code_points() if cls or unicodedata.normalize("NFC", to) != c}
    foreign = tuple(s.upper() for s in SCRIPTS if s != home)
    points = [chr(o) for block in (range(0x20, 0x7F), range(0xA1, 0x530), range(0x2012, 0x2128)) for o in block]
    return _char_class(["\n", "\t", *(c for c in points if c not in restless and not unicodedata.name(c, "").startswith(foreign) and unicodedata.category(c) != "Cn")])


#: asked first in a class, so that most characters never reach its many ranges; Latin letters are foreign in other scripts
_BEYOND_ASCII, _BEYOND_SIGNS = r"[^\x{20}-\x{7E}]", r"[^\x{20}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7E}]"


def may_change(text: Column, script: Column, is_marker: Column) -> Column:
    """Whether a text holds anything that can change: exact, without a false no."""
    stirred = F.lit(False)
    for home in SCRIPTS:
        stirred = F.when(script == home, text.rlike(f"[{_BEYOND_ASCII if home == 'Latin' else _BEYOND_SIGNS}&&[^{_calm(home)}]]")).otherwise(stirred)
    out = text.rlike(f"[{_BEYOND_ASCII}&&[{_restless()}]]") | text.rlike(_JAMO)
    for home in SCRIPTS:
        others = "".join(rf"\p{{Is{s}}}" for s in SCRIPTS if s != home)
        mixed = rf"\p{{Is{home}}}\p{{M}}*[{others}]|[{others}]\p{{M}}*\p{{Is{home}}}"
        out = out | (script == home) & F.when(is_marker, text.rlike(f"[{others}]")).otherwise(text.rlike(mixed))
    return F.coalesce(stirred & out, F.lit(False))


def _mapping(spark: SparkSession) -> DataFrame:
    """One row per code point that says something: its decomposition, and its look-alike by home script."""
    alike = look_alikes()
    rows = {c: [to, None, None, None] for c, to, _ in code_points()}
    for i, home in enumerate(SCRIPTS, 1):
        for c, to in alike[home].items():
            rows.setdefault(c, [c, None, None, None])[i] = to
    return spark.createDataFrame([(c, *v) for c, v in rows.items()], "ch string, plain string, latin string, greek string, cyrillic string")


def _literal_map(pairs: dict) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*map(F.lit, pairs.values())))


#: above every class: nothing composes across a mark of class 0
_BLOCKED = 1000


def _composed(cluster: Column, classes: Column, pairs: Column) -> Column:
    """A starter and its marks: marks ordered by class, then composed onto the starter where not blocked."""
    chars = F.split(cluster, "")
    marks = F.transform(F.slice(chars, F.lit(2), F.size(chars)), lambda c, i: F.struct(F.coalesce(F.element_at(classes, c), F.lit(0)).alias("k"), i.alias("i"), c.alias("c")))
    # marks of class 0 stay where they are; between them marks are put in order of class
    runs = F.transform(marks, lambda m, i: F.struct(F.size(F.filter(F.slice(marks, F.lit(1), i + 1), lambda x: x["k"] == 0)).alias("run"), m["k"].alias("k"), m["i"].alias("i"), m["c"].alias("c")))
    ordered = F.transform(F.array_sort(runs), lambda m: F.struct(m["k"].alias("k"), m["i"].alias("i"), m["c"].alias("c")))
    marks = F.when(F.exists(marks, lambda m: m["k"] == 0), ordered).otherwise(F.array_sort(marks))

    def add(acc: Column, m: Column) -> Column:
        pair = F.element_at(pairs, F.concat(acc["base"], m["c"]))
        free = (acc["rest"] == "") | (acc["last"] < m["k"])
        return F.when(free & pair.isNotNull(), F.struct(pair.alias("base"), acc["rest"].alias("rest"), acc["last"].alias("last"))).otherwise(
            F.struct(acc["base"].alias("base"), F.concat(acc["rest"], m["c"]).alias("rest"), F.greatest(acc["last"], F.when(m["k"] == 0, _BLOCKED).otherwise(m["k"])).alias("last"))
        )

    start = F.struct(F.element_at(chars, 1).alias("base"), F.lit("").alias("rest"), F.lit(-1).alias("last"))
    return F.aggregate(marks, start, add, lambda acc: F.concat(acc["base"], acc["rest"]))


#: fixed values: where the letters of Hangul begin, and how many there are of the second and third kind
_LEAD, _VOWEL, _TRAIL, _SYLLABLE, _VOWELS, _TRAILS = 0x1100, 0x1161, 0x11A7, 0xAC00, 21, 28
_JAMO = r"[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11A8}-\x{11C2}]?|[\x{AC00}-\x{D7A3}][\x{11A8}-\x{11C2}]"


def _syllable(jamo: Column) -> Column:
    """The syllable of a run of letters: two or three letters, or a syllable without a last letter and one; others as they are."""
    first, second, third = (F.ascii(F.substring(jamo, n, 1)) for n in (1, 2, 3))
    letters = _SYLLABLE + ((first - _LEAD) * _VOWELS + (second - _VOWEL)) * _TRAILS + F.when(F.length(jamo) > 2, third - _TRAIL).otherwise(0)
    code = F.when(first < _SYLLABLE, letters).when((first - _SYLLABLE) % _TRAILS == 0, first + second - _TRAIL)
    return F.coalesce(F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE"), jamo)


def _hangul(text: Column) -> Column:
    found = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({_JAMO})"), 1)), lambda j: F.struct(j.alias("was"), _syllable(j).alias("now")))
    # longer runs first, so that two letters of three are not taken for themselves
    longest = F.array_sort(found, lambda a, b: F.length(b["was"]) - F.length(a["was"]))
    return F.when(text.rlike(_JAMO), F.aggregate(longest, text, lambda t, j: F.replace(t, j["was"], j["now"]))).otherwise(text)


def recomposed(text: Column) -> Column:
    """A decomposed text with every cluster ordered and composed, and letters of Hangul put into syllables."""
    # marks before any starter are put in order behind one that takes part in nothing
    headless = text.rlike(r"\A\p{M}")
    text = F.when(headless, F.concat(F.lit("\n"), _hangul(text))).otherwise(_hangul(text))
    classes = _literal_map({c: cls for c, _, cls in code_points() if cls})
    pairs = _literal_map(compositions())
    clusters = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\P{M}\p{M}+)"), 1)), lambda a, b: F.length(b) - F.length(a))
    done = F.transform(clusters, lambda c: F.struct(c.alias("was"), _composed(c, classes, pairs).alias("now")))
    whole = F.aggregate(done, text, lambda t, c: F.replace(t, c["was"], c["now"]))
    return F.when(headless, F.substring(whole, F.lit(2), F.length(whole))).otherwise(whole)


_TOKEN = r"([\p{L}\p{M}]+|[^\p{L}\p{M}]+)"


def normal_forms(texts: DataFrame) -> DataFrame:
    """``text_key, script, is_marker, normal`` of the texts (``text, script, is_marker``) that may change.

    Each distinct text is exploded once; ``text_key`` is its digest.
    """
    distinct = texts.filter(may_change(F.col("text"), F.col("script"), F.col("is_marker"))).select("text", "script", "is_marker").distinct()
    points = distinct.select(F.unhex(F.md5("text")).alias("text_key"), "script", "is_marker", F.posexplode(F.split("text", "")).alias("pos", "ch"))
    look = F.when(F.col("script") == "Greek", F.col("greek")).when(F.col("script") == "Cyrillic", F.col("cyrillic")).otherwise(F.col("latin"))
    mapped = points.join(F.broadcast(_mapping(texts.sparkSession)), "ch", "left").select(
        "text_key", "script", "is_marker", F.struct("pos", F.coalesce("plain", "ch").alias("p"), look.alias("l")).alias("x")
    )
    rebuilt = mapped.groupBy("text_key", "script", "is_marker").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    base_alike = F.transform("xs", lambda x: F.coalesce(x["l"], x["p"]))
    plain, alike = F.array_join(F.transform("xs", lambda x: x["p"]), ""), F.array_join(base_alike, "")
    rebuilt = rebuilt.select("text_key", "script", "is_marker", plain.alias("plain"), alike.alias("alike"))
    rebuilt = rebuilt.withColumn("alike", _accented_alike(F.col("alike"), F.col("script")))
    home = F.when(F.col("script") == "Greek", r"\p{IsGreek}").when(F.col("script") == "Cyrillic", r"\p{IsCyrillic}").otherwise(r"\p{IsLatin}")
    words = F.zip_with(
        F.regexp_extract_all("plain", F.lit(_TOKEN), 1), F.regexp_extract_all("alike", F.lit(_TOKEN), 1), lambda p, a: F.when(F.col("is_marker") | F.regexp_like(p, home), a).otherwise(p)
    )
    return rebuilt.select("text_key", "script", "is_marker", F.array_join(words, "").alias("d")).select("text_key", "script", "is_marker", recomposed(F.col("d")).alias("normal"))


def _accented_alike(text: Column, script: Column) -> Column:
    """Look-alikes for letters that came out of a decomposition (an accented letter of another script)."""
    out = text
    for home in SCRIPTS:
        pairs = look_alikes()[home]
        out = F.when(script == home, F.translate(text, "".join(pairs), "".join(pairs.values()))).otherwise(out)
    return out


def with_normal_form(rows: DataFrame) -> DataFrame:
    """``rows`` (``text, script, is_marker`` and any keys) with ``normal``."""
    forms = normal_forms(rows)
    key = F.when(may_change(F.col("text"), F.col("script"), F.col("is_marker")), F.unhex(F.md5("text")))
    return rows.withColumn("text_key", key).join(forms, ["text_key", "script", "is_marker"], "left").withColumn("normal", F.coalesce("normal", "text")).drop("text_key")


def changed(rows: DataFrame) -> DataFrame:
    """The rows whose text only looks like its normal form."""
    restless = rows.filter(may_change(F.col("text"), F.col("script"), F.col("is_marker"))).withColumn("text_key", F.unhex(F.md5("text")))
    return restless.join(normal_forms(rows), ["text_key", "script", "is_marker"]).filter(F.col("normal") != F.col("text")).drop("text_key")


def register_texts(content_nodes: DataFrame, roi_columns: DataFrame) -> DataFrame:
    """Markers and bodies of content nodes and labels of register columns in one long form."""
    fields = F.explode(F.array(F.struct(F.lit("marker").alias("f"), F.col("marker").alias("t")), F.struct(F.lit("body").alias("f"), F.col("body").alias("t"))))
    nodes = content_nodes.select(F.col("node_id").alias("record_id"), "lang", fields.alias("x")).select(
        F.lit("content_nodes").alias("table_name"), F.col("x.f").alias("field_name"), "record_id", home_script(F.col("lang")).alias("script"), (F.col("x.f") == "marker").alias("is_marker"), F.col("x.t").alias("text")
    )
    labels = roi_columns.select(
        F.lit("roi_columns").alias("table_name"), F.lit("label").alias("field_name"), F.col("col_row").alias("record_id"), home_script(F.col("lang")).alias("script"), F.lit(False).alias("is_marker"), F.col("label").alias("text")
    )
    return nodes.unionByName(labels).filter("text IS NOT NULL")
