"""Pages to facts: flat pages over the standard parser, and rules for each language."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.months import french_section_date, portuguese_section
from ..functions.text import nonbreaking_to_space, normalize_text

#: Elements without content, and elements whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "template"))
#: Fixed value: title of a section that has none.
UNTITLED = "(без заголовка)"


class Page:
    """A page as flat arrays, filled in one pass: elements in the order in which they begin, with tag, parent, attributes, the number of the last
    element inside and the span of the texts inside; and the texts with their owner.

    What is inside an element is a span of both arrays, so questions are answered by scans and searches, however deep the markup is.
    """

    def __init__(self):
        self.tag, self.parent, self.attrs, self.last, self.opens, self.closes = ["[document]"], [-1], [{}], [0], [0], [0]
        self.text, self.owner = [], []
        self.by_tag: dict[str, list[int]] = {}
        self.spans: dict[tuple[str, ...], tuple[list[int], list[int]]] = {}
        self.errors: list[str] = []

    def inside(self, i: int, tags: tuple[str, ...]) -> list[int]:
        """Elements with one of the tags inside element i, in order."""
        found = []
        for t in tags:
            row = self.by_tag.get(t, [])
            found += row[bisect_right(row, i) : bisect_right(row, self.last[i])]
        return found if len(tags) == 1 else sorted(found)

    def outermost(self, i: int, tags: tuple[str, ...]) -> list[int]:
        """Those of inside() that aren't inside another one."""
        out = []
        for x in self.inside(i, tags):
            if not out or x > self.last[out[-1]]:
                out.append(x)
        return out

    def within(self, i: int, tags: tuple[str, ...]) -> bool:
        """Whether element i or one around it has one of the tags."""
        if tags not in self.spans:
            starts = self.outermost(0, tags)
            self.spans[tags] = starts, [self.last[x] for x in starts]
        starts, ends = self.spans[tags]
        at = bisect_right(starts, i) - 1
        return at >= 0 and i <= ends[at]

    def resolved(self, base: str, href: str) -> str | None:
        """The URL of a link; one that is none goes to ``errors``."""
        try:
            return unquote(urljoin(base, href))
        except ValueError as e:
            self.errors.append(f"{href}: {e}")
            return None


class Element:
    """An element of a page: its number there."""

    __slots__ = ("at", "page")

    def __init__(self, page: Page, at: int):
        self.page, self.at = page, at

    def __eq__(self, other):
        return self.at == other.at and self.page is other.page

    __hash__ = None

    @property
    def tag(self) -> str:
        return self.page.tag[self.at]

    @property
    def attrs(self) -> dict[str, str]:
        return self.page.attrs[self.at]

    @property
    def tokens(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def all(self) -> Iterator[Element]:
        """Elements inside, in the order of the page."""
        return (Element(self.page, i) for i in range(self.at + 1, self.page.last[self.at] + 1))

    def every(self, *tags: str) -> list[Element]:
        return [Element(self.page, i) for i in self.page.inside(self.at, tags)]

    def first(self, *tags: str) -> Element | None:
        rows = [self.page.by_tag.get(t, []) for t in tags]
        found = [row[k] for row in rows if (k := bisect_right(row, self.at)) < len(row)]
        return Element(self.page, min(found)) if found and min(found) <= self.page.last[self.at] else None

    def children(self) -> Iterator[Element]:
        i, end = self.at + 1, self.page.last[self.at]
        while i <= end:
            yield Element(self.page, i)
            i = self.page.last[i] + 1

    def after(self) -> Iterator[Element]:
        """Elements that follow under the same parent."""
        p = self.page.parent[self.at]
        i, end = self.page.last[self.at] + 1, self.page.last[p] if p >= 0 else -1
        while i <= end:
            yield Element(self.page, i)
            i = self.page.last[i] + 1

    def above(self, *tags: str) -> bool:
        """Whether an element around this one has one of the tags."""
        p = self.page.parent[self.at]
        return p >= 0 and self.page.within(p, tags)

    def strings(self, without: tuple[str, ...] = ()) -> Iterator[str]:
        """Texts inside, but for those in elements with one of the tags ``without``."""
        page, t = self.page, self.page.opens[self.at]
        for x in [*(page.outermost(self.at, without) if without else []), None]:
            end = page.closes[self.at] if x is None else page.opens[x]
            yield from (page.text[k] for k in range(t, end) if page.tag[page.owner[k]] not in SILENT)
            t = end if x is None else page.closes[x]

    def parts(self) -> Iterator[Element | str]:
        """Texts and elements right inside, in order."""
        page, t = self.page, self.page.opens[self.at]
        for e in self.children():
            yield from page.text[t : page.opens[e.at]]
            yield e
            t = page.closes[e.at]
        yield from page.text[t : page.closes[self.at]]

    def text(self, between: str = "", without: tuple[str, ...] = ()) -> str:
        return between.join(s for x in self.strings(without) if (s := x.strip()))


#: Fixed value: elements after whose start tag the standard parser reads on in another way. A start tag without attributes, and none.
_RAW = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())
_BARE, _NONE = re.compile("<([a-zA-Z][a-zA-Z0-9]*)>"), {}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page, self.open, self.count, self.pieces = Page(), [0], {}, []

    def parse_starttag(self, i):
        m = _BARE.match(self.rawdata, i)
        if m is None or m[1].lower() in _RAW:
            return super().parse_starttag(i)
        # a run of them, without going back to the parser between
        while m is not None and (tag := m[1].lower()) not in _RAW:
            self._begin(tag, _NONE)
            i = m.end()
            m = _BARE.match(self.rawdata, i)
        return i

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # one that the parser doesn't know is a comment up to ">", and no reason to lose the page
            return self.parse_bogus_comment(i, report)

    def handle_starttag(self, tag, attrs):
        self._begin(tag, {k: v or "" for k, v in attrs} if attrs else _NONE)

    def _begin(self, tag: str, attrs: dict[str, str]) -> None:
        self._end_text()
        page, i, texts = self.page, len(self.page.tag), len(self.page.text)
        page.tag.append(tag)
        page.parent.append(self.open[-1])
        page.attrs.append(attrs)
        page.last.append(i)
        page.opens.append(texts)
        page.closes.append(texts)
        page.by_tag.setdefault(tag, []).append(i)
        if tag not in VOID:
            self.open.append(i)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        # what was left open inside ends with it; an end without a start only ends the text before it
        self._end_text()
        while self.count.get(tag) and self._ended() != tag:
            pass

    def _ended(self) -> str:
        page, i = self.page, self.open.pop()
        page.last[i], page.closes[i] = len(page.tag) - 1, len(page.text)
        if i:
            self.count[page.tag[i]] -= 1
        return page.tag[i]

    def handle_data(self, data):
        # a "<" that begins no markup comes apart from what is around it, but is one text with it
        self.pieces.append(data)
        if self.cdata_elem is not None:
            self._end_text()

    def _end_text(self, *_) -> None:
        if self.pieces:
            self.page.text.append("".join(self.pieces))
            self.page.owner.append(self.open[-1])
            self.pieces = []

    handle_comment = handle_decl = handle_pi = unknown_decl = _end_text

    def close(self):
        super().close()
        self._end_text()
        while self.open:
            self._ended()


def read(html: str) -> Element:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return Element(reader.page, 0)


def _year(text: str) -> bool:
    return len(text) == 4 and text.isdecimal()


@dataclass
class Fact:
    section: str | None
    text: str
    links: list[str]
    relevant: list[str] | None
    note: str | None = None


def _fact(e: Element, url: str, section: str | None, without: tuple[str, ...] = ()) -> Fact:
    anchors = [a for a in e.every("a") if a.attrs.get("href", "").startswith("/wiki/") and not (without and a.above(*without))]
    links = [(u, a.above("b")) for a in anchors if (u := e.page.resolved(url, a.attrs["href"])) is not None]
    return Fact(section, e.text(" ", without), [u for u, _ in links], [u for u, bold in links if bold])


@dataclass(frozen=True)
class Sections:
    """Facts in the siblings that follow a heading block, up to the next one."""

    begins: Callable[[Element], bool]
    ends: Callable[[Element], bool]
    title: tuple[str, ...]
    items: Callable[[Element], list[Element]]
    untitled: str | None = UNTITLED
    blanks: bool = True

    def __call__(self, page: Element, url: str) -> Iterator[Fact]:
        for block in filter(self.begins, page.all()):
            heading = block.first(*self.title)
            section = heading.text() if heading else self.untitled
            for e in block.after():
                if self.ends(e):
                    break
                for item in self.items(e):
                    f = _fact(item, url, section)
                    if f.text or self.blanks:
                        yield f


def _div(*tokens: str) -> Callable[[Element], bool]:
    return lambda e: e.tag == "div" and all(t in e.tokens for t in tokens)


def _exact(tag: str, classes: str) -> Callable[[Element], bool]:
    return lambda e: e.tag == tag and e.attrs.get("class") == classes


def _english_items(e: Element) -> list[Element]:
    return e.every("li")[1:] if e.tag == "ul" else []


def _portuguese_heading(e: Element) -> bool:
    return "mw-heading" in e.tokens and any(f"mw-heading{i}" in e.tokens for i in (2, 3, 4))


def _portuguese_items(e: Element) -> list[Element]:
    return [e] if e.tag == "p" else e.every("li") if e.tag == "ul" else []


_portuguese_sections = Sections(lambda e: e.tag == "div" and _portuguese_heading(e), _portuguese_heading, ("h2", "h3", "h4"), _portuguese_items, None, False)


def _portuguese(page: Element, url: str) -> Iterator[Fact]:
    table = next((e for e in page.every("table") if "wikitable" in e.tokens), None)
    if table is None:
        yield from _portuguese_sections(page, url)
        return
    for row in table.every("tr")[1:]:
        cell = row.first("td")
        if cell is not None and (f := _fact(cell, url, None)).text:
            yield f


def _german(page: Element, url: str) -> Iterator[Fact]:
    for card in filter(_div("hintergrundfarbe-basis"), page.all()):
        date = next((e for e in card.every("span") if "font-weight:bold" in e.attrs.get("style", "")), None)
        p = card.first("p")
        if p is not None:  # a card without a paragraph has no fact
            f = _fact(p, url, "".join(date.strings()).strip() if date else "None")
            parts = [x.strip() if isinstance(x, str) else x.text(" ") for x in p.parts()]
            yield Fact(f.section, " ".join(parts), f.links, None)


def _french(page: Element, url: str) -> Iterator[Fact]:
    body = next(filter(_exact("div", "mw-content-ltr mw-parser-output"), page.all()), None)
    for ul in body.every("ul") if body else []:
        for li in ul.every("li"):
            f = _fact(li, url, None, ("figure", "dl"))
            note = li.first("dl")
            f.note = "".join(note.strings()) if note else None
            if f.text.replace("\u00a0", " "):
                yield f


#: Rules by language: how facts stand on a page.
RULES: dict[str, Callable[[Element, str], Iterator[Fact]]] = {
    "en": Sections(_exact("div", "mw-heading mw-heading3"), lambda e: "mw-heading3" in e.tokens, ("h3",), _english_items),
    "ru": Sections(_div("ext-discussiontools-init-section"), lambda e: "ext-discussiontools-init-section" in e.tokens, ("h2",), lambda e: e.every("li")),
    "de": _german,
    "pt": _portuguese,
    "fr": _french,
}


@dataclass(frozen=True)
class Link:
    year: str
    month: str | None
    href: str
    exists: bool


def _link(a: Element, year: str, month: str | None) -> Link:
    return Link(year, month, a.attrs.get("href", ""), "new" not in a.tokens)


def _english_index(page: Element) -> Iterator[Link]:
    box = next(filter(_div("floatleft"), page.all()), None)
    for row in box.every("tr") if box is not None and box.first("table") else []:
        head = row.first("th")
        year = "".join(head.strings()).strip() if head else ""
        if _year(year):
            for cell in row.every("td"):
                a = next((x for x in cell.every("a") if "href" in x.attrs), None)
                if a is not None:
                    yield _link(a, year, "".join(a.strings()).strip())


def _russian_index(page: Element) -> Iterator[Link]:
    box = next(filter(_div("ts-Box-description"), page.all()), None)

    def year_of(li: Element) -> str | None:
        bold = li.first("b")
        text = "".join(bold.strings()).strip() if bold else ""
        return text[:4] if _year(text[:4]) and text[4:5].isspace() and text[5:8] == "год" and (text[8:9] == ":" or text[8:9].isspace()) else None

    own = lambda e, tag: [x for x in e.children() if x.tag == tag]
    for ul in box.every("ul") if box else []:
        if all(year_of(li) for li in own(ul, "li")):
            for li in own(ul, "li"):
                yield from (_link(a, year_of(li), "".join(a.strings()).strip()) for a in own(li, "a"))
            return


def _german_index(page: Element) -> Iterator[Link]:
    box = next(filter(_exact("div", "mw-content-ltr mw-parser-output"), page.all()), None)
    tables = box.every("table") if box else []
    for row in tables[1].every("tr") if len(tables) > 1 else []:
        cells = row.every("td")
        bold = cells[0].first("b") if cells else None
        for cell in cells[1:] if bold else []:
            if (a := cell.first("a")) is not None:
                yield _link(a, "".join(bold.strings()), "".join(a.strings()).strip())


def _year_links(anchors: list[Element]) -> Iterator[Link]:
    for a in anchors:
        text = "".join(a.strings()).strip()
        if "href" in a.attrs and _year(text):
            yield _link(a, text, None)


def _portuguese_index(page: Element) -> Iterator[Link]:
    box = next(filter(_exact("table", "tmbox tmbox-notice }}"), page.all()), None)
    found = [next((a for a in b.every("a") if "href" in a.attrs), None) for b in (box.every("b") if box else [])]
    return _year_links([a for a in found if a is not None])


def _french_index(page: Element) -> Iterator[Link]:
    head = next(filter(_exact("div", "mw-heading mw-heading2 ext-discussiontools-init-section"), page.all()), None)
    after = list(head.after()) if head else []
    p = after[1].first("p") if len(after) > 1 else None
    return _year_links([a for a in (p.every("a") if p else []) if "href" in a.attrs][1:])


INDEX_RULES = {"en": _english_index, "ru": _russian_index, "de": _german_index, "pt": _portuguese_index, "fr": _french_index}
FACT_SCHEMA = "lang string, url string, year string, pos int, section string, text string, links array<string>, relevant_links array<string>, note string"
INDEX_SCHEMA = "lang string, pos int, year string, month string, url string, exists boolean"
ERROR_SCHEMA = "lang string, url string, error string"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _rows_of_pages(pages: DataFrame, rows_of: Callable, schema: str) -> DataFrame:
    """The rows that ``rows_of`` gives for each page, and a row for each thing that went wrong, with its ``error``; a page that can't be read
    at all has one such row, and no other page is touched by it."""
    names = [*_names(schema), "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b.itertuples():
                try:
                    page = read(p.html)
                    out += [(*r, None) for r in rows_of(p, page)]
                    wrong = page.page.errors
                except Exception as e:  # whatever it is, it is this page's
                    wrong = [f"{type(e).__name__}: {e}"]
                out += [(*(getattr(p, n) if n in ("lang", "url") else None for n in names[:-1]), x) for x in wrong]
            yield pd.DataFrame(out, columns=names, dtype=object)

    return pages.mapInPandas(run, schema + ", error string")


def _fact_rows(p, page: Element) -> Iterator[tuple]:
    for i, f in enumerate(RULES[p.lang](page, p.url) if p.lang in RULES else []):
        yield p.lang, p.url, p.year, i, f.section, f.text, f.links, f.relevant, f.note


def _index_rows(p, page: Element) -> Iterator[tuple]:
    found = list(INDEX_RULES[p.lang](page) if p.lang in INDEX_RULES else [])
    if p.lang in ("pt", "fr"):
        found = list({x.year: x for x in found}.values())
    for i, x in enumerate(found):
        try:
            yield p.lang, i, x.year, x.month, urljoin(p.url, x.href), x.exists
        except ValueError as e:
            page.page.errors.append(f"{x.href}: {e}")


def parse_facts(pages: DataFrame) -> DataFrame:
    """pages (lang, url, year, html) -> facts in page order. The page is parsed once in Python; titles, dates and clean-up are expressions.
    Links whose URL can't be made, and pages that can't be read, are left out: page_errors() has them."""
    return _facts(_rows_of_pages(pages.select("lang", "url", "year", "html"), _fact_rows, FACT_SCHEMA))


def facts_and_errors(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """parse_facts() and page_errors() of pages (lang, url, year, html) that are read once: what comes out is stored."""
    from .storage import stored

    rows = stored(_rows_of_pages(pages.select("lang", "url", "year", "html"), _fact_rows, FACT_SCHEMA), "facts")
    return _facts(rows), rows.where("error is not null").select(*_names(ERROR_SCHEMA))


def _facts(rows: DataFrame) -> DataFrame:
    facts, lang = rows.where("error is null"), F.col("lang")
    section: Column = F.when(lang == "pt", portuguese_section(F.col("section"), F.col("year"))).when(lang == "fr", F.coalesce(french_section_date(F.col("note")), "year")).otherwise(F.col("section"))
    text = F.when(lang == "fr", nonbreaking_to_space("text")).when(lang == "ru", normalize_text("text")).otherwise(F.col("text"))
    return facts.select("lang", "url", "year", "pos", section.alias("section"), text.alias("text"), "links", "relevant_links")


def parse_index(pages: DataFrame) -> DataFrame:
    """pages (lang, url, html) of archives -> the pages they link to, in their order; a year's later entry wins for year pages."""
    return _rows_of_pages(pages.select("lang", "url", "html"), _index_rows, INDEX_SCHEMA).where("error is null").drop("error")


def page_errors(pages: DataFrame, index: bool = False) -> DataFrame:
    """(lang, url, error): what parse_facts(), or parse_index(), leaves out of pages (lang, url, html[, year])."""
    rows = pages.select("lang", "url", F.col("year") if "year" in pages.columns else F.lit(None).cast("string").alias("year"), "html")
    found = _rows_of_pages(rows, _index_rows if index else _fact_rows, INDEX_SCHEMA if index else FACT_SCHEMA)
    return found.where("error is not null").select(*_names(ERROR_SCHEMA))


#: Fixed value: stands for "&" where the parser is not to decode references; no text read from UTF-8 holds it.
_AMPERSAND = "\ud800"


def page_text(pages: DataFrame, key: str = "page_id", references: dict[str, str] | None = None, blanks: str | None = None) -> DataFrame:
    """(key, text): the page's strings, stripped and joined by spaces; null where there is no page or it can't be read. With ``references``, those
    and no others are decoded, in place of HTML's; with ``blanks``, those characters are stripped, in place of all white space."""
    named = re.compile("|".join(re.escape(r) for r in sorted(references, key=len, reverse=True))) if references else None

    def decoded(s: str) -> str:
        return s if named is None else named.sub(lambda m: references[m[0]], s.replace(_AMPERSAND, "&"))

    def text(html: str | None) -> str | None:
        if html is None:
            return None
        try:
            page = read(html if named is None else html.replace("&", _AMPERSAND))
            return " ".join(x for s in page.strings() if (x := decoded(s).strip(blanks)))
        except Exception:  # a page's markup must not end the job
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([text(h) for h in b.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(key).cast(pa.int64()), texts], [key, "text"])

    return pages.select(key, "html").mapInArrow(run, f"{key} long, text string")
