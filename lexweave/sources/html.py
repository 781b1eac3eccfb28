"""Legal acts in HTML to provisions with nested content.

Two published layouts are read: consolidated texts (grid points, numbered
paragraph wrappers) and journal texts (points as one-row tables).  What differs
between them is data in ``Layout``; the walk over blocks is one.  Pages are
parsed inside ``mapInPandas``, one page at a time, into rows of provisions whose
content is JSON.

Raw text elements (script, style) never count as markup; unclosed elements end
with their parent; an unreadable or empty page yields no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from lexweave.operators.tree import marker_slug

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_BLOCKS = {"p", "div", "table", "ul", "ol", "figure", "section"}


@dataclass
class Element:
    """An element with its children in order; texts are plain strings."""

    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Element | str] = field(default_factory=list)
    parent: Element | None = None

    def has(self, *names: str) -> bool:
        css = self.attrs.get("class", "")
        return any(n in css for n in names)

    def elements(self, *tags: str) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element) and (not tags or c.tag in tags)]

    def walk(self) -> Iterator[Element]:
        for c in self.elements():
            yield c
            yield from c.walk()

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else "" if c.tag in ("script", "style") else c.text() for c in self.children)

    def above(self) -> Iterator[Element]:
        at = self.parent
        while at is not None:
            yield at
            at = at.parent


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("#root")
        self.at = self.root

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.at.tag == "p" and tag in _BLOCKS:
            self.at = self.at.parent or self.root
        while self.at.tag in _CLOSES.get(tag, ()):
            self.at = self.at.parent or self.root
        element = Element(tag, {k: v or "" for k, v in attrs}, parent=self.at)
        self.at.children.append(element)
        if tag not in _VOID:
            self.at = element

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        at: Element | None = self.at
        while at is not None and at.tag != tag:
            at = at.parent
        if at is not None and at.parent is not None:
            self.at = at.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def clean(text: str) -> str:
    """White space collapsed, note numbers joined with their brackets."""
    return re.sub(r"\( (\*?\d+) \)", r"(\1)", " ".join(text.split()))


@dataclass(frozen=True)
class Layout:
    """Class names and rules of one published layout."""

    skipped: tuple[str, ...]
    heading: str
    title: str
    point: str  # class of a block that is one point of a list
    points_are_tables: bool


CONSOLIDATED = Layout(("footnote", "arrow", "title-article-norm", "title-annex-1", "title-annex-2", "title-division-1", "title-division-2"), "title-gr-seq", ".stitle-article-norm", "grid-container", False)
JOURNAL = Layout(("oj-ti-art", "oj-sti-art", "oj-note"), "oj-ti-grseq", ".oj-sti-art", "oj-enumeration-spacing", True)
LAYOUTS = {"consolidated": CONSOLIDATED, "journal": JOURNAL}

_MARKER = re.compile(r"[—–-]|\(?[a-z0-9]{1,4}\)|[a-z0-9]{1,4}\.", re.I)


def _direct_rows(table: Element) -> list[Element]:
    return [r for body in (table.elements("tbody") or [table]) for r in body.elements("tr")]


def _table(table: Element) -> dict | None:
    """A data table: its own rows only, rows without any text left out."""
    cells = [[clean(c.text()) for c in row.elements("td", "th")] for row in _direct_rows(table)]
    rows = [r for r in cells if any(r)]
    return {"type": "table", "rows": rows} if rows else None


def _point(block: Element, layout: Layout) -> dict | None:
    """The list item a block is, if it is one: marker and content."""
    if not layout.points_are_tables:
        if block.tag == "div" and block.has(layout.point):
            columns = [c for c in block.elements() if c.has("grid-list-column-1", "grid-list-column-2")]
            first = next((c for c in columns if c.has("grid-list-column-1")), None)
            second = next((c for c in columns if c.has("grid-list-column-2")), None)
            return {"marker": clean(first.text()) if first else "", "content": blocks(second.children, layout) if second else []}
        return None
    if block.tag == "table":
        rows = _direct_rows(block)
        cells = rows[0].elements("td") if len(rows) == 1 else []
        if len(cells) == 2 and _MARKER.fullmatch(marker := clean(cells[0].text())):
            return {"marker": marker, "content": blocks(cells[1].children, layout)}
    elif block.tag == "div" and block.has(layout.point):
        head = next(iter(block.elements("p")), None)
        if head is not None and _MARKER.fullmatch(marker := clean(head.text())):
            return {"marker": marker, "content": blocks([c for c in block.children if c is not head], layout)}
    return None


def blocks(children: list[Element | str], layout: Layout, drop_number: bool = False) -> list[dict]:
    """Content nodes of mixed children: running text is gathered until a block ends it, points in a row are one list."""
    out: list[dict] = []
    running: list[str] = []

    def end_text() -> None:
        if text := clean("".join(running)):
            out.append({"type": "text", "text": text})
        running.clear()

    for child in children:
        if isinstance(child, str):
            running.append(child)
        elif child.tag in ("a", "span", "em", "b", "i", "sup", "sub", "strong"):
            if drop_number and child.tag == "span" and child.has("no-parag"):
                drop_number = False  # only the first number belongs to the paragraph
            else:
                running.append(child.text())
        else:
            end_text()
            if (item := _point(child, layout)) is not None:
                if out and out[-1]["type"] == "list":
                    out[-1]["items"].append(item)
                else:
                    out.append({"type": "list", "items": [item]})
            elif child.tag == "p":
                if not child.has(*layout.skipped) and (text := clean(child.text())):
                    out.append({"type": "heading" if child.has(layout.heading) else "text", "text": text})
            elif child.tag == "table":
                if table := _table(child):
                    out.append(table)
            elif child.tag == "figure":
                out += [{"type": "figure", "src": i.attrs["src"], "alt": clean(i.attrs.get("alt", ""))} for i in child.walk() if i.tag == "img" and i.attrs.get("src")]
            elif child.tag not in ("script", "style") and not child.has("eli-title"):
                out += blocks(child.children, layout)
    end_text()
    return out


def with_anchors(content: list[dict], prefix: str) -> list[dict]:
    """Anchors on the items of top-level lists; markers without letters or digits get none."""
    for node in content:
        for item in node.get("items", ()) if node["type"] == "list" else ():
            if slug := marker_slug(item["marker"]):
                item["anchor"] = f"{prefix or 'punt'}-{slug}"
    return content


def anchored_paragraphs(entries: list[tuple[int | None, list[dict]]]) -> list[dict]:
    """Paragraphs with anchors unique within the provision."""
    out: list[dict] = []
    used: set[str] = set()
    for number, content in entries:
        base = f"lid-{number}" if number is not None else "inhoud" if len(entries) == 1 else f"alinea-{len(out) + 1}"
        anchor, n = base, 1
        while anchor in used:
            n += 1
            anchor = f"{base}-bis" if n == 2 else f"{base}-bis-{n}"
        used.add(anchor)
        out.append({"para_no": number, "anchor": anchor, "content": with_anchors(content, anchor if number is not None else "")})
    return out


def _number_of(child: Element, layout: Layout) -> int | None:
    """The number of a paragraph that starts with ``child``."""
    if layout.points_are_tables:
        return None
    mark = next((clean(s.text()) for s in child.elements("span") if s.has("no-parag")), "")
    return int(mark[:-1]) if child.tag == "div" and child.has("norm") and re.fullmatch(r"\d+\.", mark) else None


def _article(el: Element, layout: Layout) -> list[tuple[int | None, list[dict]]]:
    entries: list[tuple[int | None, list[dict]]] = []
    loose: list[Element | str] = []

    def take_loose() -> None:
        content = blocks(loose, layout)
        loose.clear()
        if content and entries:
            entries[-1][1].extend(content)
        elif content:
            entries.append((None, content))

    for child in el.children:
        if isinstance(child, Element):
            if child.has("eli-title", *layout.skipped[:1]) if layout.points_are_tables else child.has("eli-title", "title-article-norm"):
                continue
            if (number := _number_of(child, layout)) is not None:
                take_loose()
                entries.append((number, blocks(child.children, layout, drop_number=True)))
                continue
            if layout.points_are_tables and child.tag == "div" and re.fullmatch(r"\d{3}\.\d{3}", child.attrs.get("id", "")):
                take_loose()
                content, number = blocks(child.children, layout), None
                if content and content[0]["type"] == "text" and (m := re.match(r"(\d+)\.\s+", content[0]["text"])):
                    number, content[0]["text"] = int(m[1]), content[0]["text"][m.end() :]
                entries.append((number, content))
                continue
        loose.append(child)
    take_loose()
    return entries


_NUMERAL = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}


def roman_value(roman: str) -> int:
    values = [_NUMERAL[c] for c in roman]
    return sum(-v if v < after else v for v, after in zip(values, [*values[1:], 0]))


def roman_sign(n: int) -> str:
    out = ""
    for sign, value in (("C", 100), ("XC", 90), ("L", 50), ("XL", 40), ("X", 10), ("IX", 9), ("V", 5), ("IV", 4), ("I", 1)):
        out += sign * (n // value)
        n %= value
    return out


def _division(el: Element) -> dict:
    """Chapter and section an element stands in, by the ids of what encloses it."""
    out: dict = {"chapter": "", "chapter_title": "", "section": None, "section_title": None}
    for up in el.above():
        title = next((clean(p.text()) for p in up.walk() if p.tag == "p" and p.has("title-division-2")), "")
        if m := re.fullmatch(r"cpt_[IVXLC]+\.sct_([IVXLC]+|\d+)", up.attrs.get("id", "")):
            out |= {"section": m[1], "section_title": title or None}
        elif m := re.fullmatch(r"cpt_([IVXLC]+)", up.attrs.get("id", "")):
            out |= {"chapter": m[1], "chapter_title": title}
    return out


def _consolidated_notes(root: Element) -> dict[str, str]:
    notes = {}
    for p in root.walk():
        if p.tag == "p" and p.has("footnote"):
            key = next((a.attrs["id"] for a in p.walk() if a.tag == "a" and "id" in a.attrs), "")
            text = "".join(c if isinstance(c, str) else "" if c.tag == "a" else c.text() for c in p.children)
            notes[key] = re.sub(r"^\(\s*\)\s*", "", clean(text))
    return notes


def _notes_in(el: Element, pool: dict[str, str]) -> list[dict]:
    """Notes an element refers to, each once, in order of first reference."""
    out: dict[str, dict] = {}
    for a in el.walk():
        if a.tag == "a" and a.attrs.get("id", "").startswith("src."):
            target = a.attrs.get("href", "").removeprefix("#")
            if target in pool:
                out.setdefault(target, {"note_id": target, "note_label": f"({clean(a.text())})", "note_text": pool[target]})
    return list(out.values())


def _journal_notes(el: Element) -> list[dict]:
    out: list[dict] = []
    for p in el.walk():
        if p.tag == "p" and p.has("oj-note"):
            link = next(iter(p.elements("a")), None)
            label, text = clean(link.text()) if link else "", clean(p.text())
            if text := text.removeprefix(label).strip():
                key = re.search(r"E\d+$", link.attrs.get("id", "")) if link else None
                out.append({"note_id": key[0] if key else f"fn-{len(out) + 1}", "note_label": label, "note_text": text})
    return out


def provisions(html: str, layout_name: str) -> list[dict]:
    """Articles, annexes and recitals of one page, in order of kind and number."""
    layout, root = LAYOUTS[layout_name], parse(html or "")
    pool = _consolidated_notes(root)
    out = []
    for el in root.walk():
        key = el.attrs.get("id", "")
        if el.tag != "div" or not key:
            continue
        if (m := re.fullmatch(r"art_(\d+)", key)) and el.has("eli-subdivision"):
            css = layout.title.removeprefix(".")
            title = next((clean(t.text()) for h in el.elements() if h.has("eli-title") for t in h.walk() if t.has(css)), "")
            notes = [] if layout.points_are_tables else _notes_in(el, pool)
            out.append({"kind": "artikel", "number": int(m[1]), "roman": None, "title": title, **_division(el), "paragraphs": anchored_paragraphs(_article(el, layout)), "footnotes": notes})
        elif m := re.fullmatch(r"anx_([IVXLC]+|\d+)", key):
            roman = roman_sign(int(m[1])) if m[1].isdigit() else m[1]
            if layout.points_are_tables:
                heads = [clean(p.text()) for p in el.elements("p") if p.has("oj-doc-ti")]
                title = " — ".join(h for h in heads if h and not re.match(r"BIJLAGE\b", h, re.I))
                content = blocks([c for c in el.children if not (isinstance(c, Element) and c.tag == "p" and c.has("oj-doc-ti"))], layout)
                notes = _journal_notes(el)
            else:
                title = next((clean(p.text()) for p in el.walk() if p.tag == "p" and p.has("title-annex-2")), "")
                content, notes = blocks(el.children, layout), _notes_in(el, pool)
            body = [{"para_no": None, "anchor": "inhoud", "content": with_anchors(content, "")}]
            out.append({"kind": "bijlage", "number": roman_value(roman), "roman": roman, "title": title or f"Bijlage {roman}", **_division(el), "paragraphs": body, "footnotes": notes})
        elif (m := re.fullmatch(r"rct_(\d+)", key)) and el.has("eli-subdivision"):
            row = next((r for r in el.walk() if r.tag == "tr"), None)
            cells = row.elements("td") if row else []
            texts = [t for p in (cells[-1].elements("p") if cells else []) if (t := clean(p.text()))]
            body = [{"para_no": i + 1, "anchor": f"alinea-{i + 1}", "content": [{"type": "text", "text": t}]} for i, t in enumerate(texts)]
            out.append({"kind": "overweging", "number": int(m[1]), "roman": None, "title": "", **_division(el), "paragraphs": body, "footnotes": []})
    return sorted(out, key=lambda p: (p["kind"], p["number"]))


PROVISION_SCHEMA = (
    "instrument string, kind string, number int, roman string, title string, chapter string, chapter_title string, section string, section_title string, "
    "paragraphs array<struct<para_no int, anchor string, content string>>, footnotes array<struct<note_id string, note_label string, note_text string>>"
)


def parse_pages(pages: DataFrame) -> DataFrame:
    """Provisions of ``pages(instrument, layout, html)``; one pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ("instrument", "kind", "number", "roman", "title", "chapter", "chapter_title", "section", "section_title", "paragraphs", "footnotes")]
        for pdf in batches:
            rows = []
            for instrument, layout, html in zip(pdf["instrument"], pdf["layout"], pdf["html"]):
                for p in provisions(html, layout):
                    body = [x | {"content": json.dumps(x["content"], ensure_ascii=False)} for x in p["paragraphs"]]
                    rows.append(p | {"instrument": instrument, "paragraphs": body})
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return pages.select("instrument", "layout", "html").filter("html IS NOT NULL").mapInPandas(run, PROVISION_SCHEMA)


def read_manifest(spark, manifest: list[tuple[str, str, str]]) -> DataFrame:
    """Pages of a manifest of ``(instrument, path, layout)``, one read for each layout."""
    from pyspark.sql import functions as F

    names = F.create_map(*[F.lit(x) for act, path, _layout in manifest for x in (path.rsplit("/", 1)[-1], act)])
    out = None
    for layout in sorted({m[2] for m in manifest}):
        files = spark.read.text([m[1] for m in manifest if m[2] == layout], wholetext=True).withColumn("file", F.substring_index(F.input_file_name(), "/", -1))
        part = files.select(names[F.col("file")].alias("instrument"), F.lit(layout).alias("layout"), F.col("value").alias("html"))
        out = part if out is None else out.unionByName(part)
    return out


def read_pages(spark, path: str, layout: str) -> DataFrame:
    """``instrument, layout, html`` of the files under a path; the instrument is the file's name."""
    from pyspark.sql import functions as F

    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return files.select(F.regexp_extract("file", r"([^/]+)\.x?html?$", 1).alias("instrument"), F.lit(layout).alias("layout"), F.col("value").alias("html"))
