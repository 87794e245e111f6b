"""Captured HTML pages to text fields and CAPTURE rows.

The only Python in a hot path: Spark has no HTML parser. Pages go through
Arrow batches, every page on its own, so the work spreads with the partitions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelab.schemas import CAPTURE
from placelab.session import ship_package, spread

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# their text is no text of what they are in (a title is inside the head)
_APART = frozenset(("title", "script", "style", "template", "noscript", "head"))

# Selectors of the captured fields.
NAME = "h1.DUwDvf, h1.fontHeadlineLarge, h1"
CATEGORY = 'button.DkEaL, div.LBgpqf button, button[jsaction*="category"]'
ADDRESS = 'button[data-item-id="address"], div.rogA2c, button[aria-label*="Address"]'
ADDRESS_LABEL = 'button[data-item-id*="address"]'
RATING_BOX = "div.F7nice"
RATING_ALTERNATE = 'div.F7nice span[aria-hidden="true"], span.ceNzKf[aria-hidden="true"]'
PHONE = 'button[data-item-id*="phone"]'
WEBSITE = 'a[data-item-id="authority"]'
HOURS = 'button[data-item-id*="oh"]'
STAR_BAR = "tr.BHOKXe"
PANEL_LINKS = ("a.hfpxzc", "div.Nv2PK")


@dataclass(eq=False)
class _Element:
    """An element, the numbers of itself and of the last one inside it, and its stretch of the text."""

    tag: str
    attrs: dict
    at: int
    last: int
    written: list
    begin: int
    end: int | None = None

    def text(self) -> str:
        return re.sub(r"[ \t\r\f]+", " ", "".join(self.written[self.begin : self.end])).strip()


class _Page(HTMLParser):
    """Elements of one page in document order and by tag. Text is written once; elements know where theirs is."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[_Element] = []
        self.by_tag: dict[str, list[_Element]] = {}
        self._open: list[_Element] = []
        self._open_tags: Counter[str] = Counter()
        self._written: list[list[str]] = [[]]  # text of hidden elements belongs to themselves only
        self.feed(html)
        self.close()
        for element in self._open:
            element.last = len(self.elements) - 1

    def handle_starttag(self, tag, attrs):
        if tag in _APART:
            self._written.append([])
        now, at = self._written[-1], len(self.elements)
        element = _Element(tag, {k: v or "" for k, v in attrs}, at, at, now, len(now))
        self.elements.append(element)
        self.by_tag.setdefault(tag, []).append(element)
        if tag == "br":
            now.append("\n")
        if tag in _VOID:
            element.end = element.begin
        else:
            self._open.append(element)
            self._open_tags[tag] += 1

    def handle_endtag(self, tag):
        while self._open_tags[tag]:
            element = self._open.pop()
            self._open_tags[element.tag] -= 1
            element.last, element.end = len(self.elements) - 1, len(element.written)
            if element.tag in _APART:
                self._written.pop()
            if element.tag == tag:
                return

    def handle_data(self, data):
        if self._open:
            self._written[-1].append(data)

    def matching(self, steps: list) -> list[_Element]:
        """Elements that match a selector, in document order: step by step, each inside one of the step before."""
        outer = None
        for step in steps:
            found, reach, seen = [], -1, 0
            for element in self.by_tag.get(step[0], []) if step[0] else self.elements:
                while outer and seen < len(outer) and outer[seen].at < element.at:
                    reach, seen = max(reach, outer[seen].last), seen + 1
                if (outer is None or reach >= element.at) and _fits(element, step):
                    found.append(element)
            outer = found
        return outer


_STEP = re.compile(r"(?P<tag>[a-zA-Z0-9]*)(?:\.(?P<cls>[\w-]+))?(?P<attrs>(?:\[[^\]]+\])*)")
_ATTR = re.compile(r"""\[([\w-]+)(?:(\*?=)["']?([^"'\]]*)["']?)?\]""")


def _parse(selector: str) -> list[list]:
    """One simple selector as steps (tag, class, [(attribute, operator, value)])."""
    steps = []
    for text in re.findall(r"(?:[^\s\[]|\[[^\]]*\])+", selector.strip()):
        m = _STEP.fullmatch(text)
        if not m:
            raise ValueError(f"unsupported selector {selector!r}")
        steps.append((m["tag"].lower(), m["cls"], _ATTR.findall(m["attrs"])))
    return steps


def _fits(element: _Element, step) -> bool:
    tag, cls, attrs = step
    if tag and element.tag != tag:
        return False
    if cls and cls not in element.attrs.get("class", "").split():
        return False
    for name, operator, value in attrs:
        have = element.attrs.get(name)
        if have is None or (operator == "=" and have != value) or (operator == "*=" and value not in have):
            return False
    return True


def _alternatives(selector: str) -> list:
    return [_parse(s) for s in selector.split(",")]


def _all(page: _Page, alternatives) -> list[_Element]:
    """Elements that match any alternative, in document order."""
    found = {e.at: e for steps in alternatives for e in page.matching(steps)}
    return [found[at] for at in sorted(found)]


def _first_text(page: _Page, alternatives) -> str | None:
    """Text of the first element of the first alternative whose first element has text."""
    firsts = (page.matching(steps)[:1] for steps in alternatives)
    return next((t for found in firsts for e in found if (t := e.text())), None)


def _first_any(page: _Page, alternatives) -> _Element | None:
    """First element in document order that matches any alternative."""
    return next(iter(_all(page, alternatives)), None)


def extract_fields(pages: DataFrame, texts: dict[str, str] | None = None,
                   attributes: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Add text and attribute columns to a table with ``html``.

    ``texts`` maps a column to a comma list of selectors: the first whose first
    match has text. ``attributes`` maps a column to (selector list, attribute)
    of the first matching element. Selector forms: ``tag``, ``tag.class``,
    ``tag[attr=v]``, ``tag[attr*=v]``, and descendants.
    """
    wanted_texts = {c: _alternatives(s) for c, s in (texts or {}).items()}
    wanted_attributes = {c: (_alternatives(s), a) for c, (s, a) in (attributes or {}).items()}
    columns = [c for c in pages.columns if c != "html"]
    schema = pages.drop("html").schema
    for c in (*wanted_texts, *wanted_attributes):
        schema = schema.add(c, "string")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[columns].copy()
            parsed = [_Page(h or "") for h in batch["html"]]
            for c, alternatives in wanted_texts.items():
                out[c] = [_first_text(p, alternatives) for p in parsed]
            for c, (alternatives, name) in wanted_attributes.items():
                found = [_first_any(p, alternatives) for p in parsed]
                out[c] = [None if e is None else e.attrs.get(name) for e in found]
            yield out

    ship_package(pages.sparkSession)
    return spread(pages).mapInPandas(read, schema)


_CAPTURED = {
    "name_text": NAME, "category_text": CATEGORY, "address_text": ADDRESS, "rating_alt_text": RATING_ALTERNATE,
    "phone_text": PHONE,
}


def captures_from_pages(pages: DataFrame) -> DataFrame:
    """CAPTURE rows of detail pages: task_id, rank, url, html and optionally search_* and captured_at.

    Lists (address labels, star bars) and the raw box texts are read as well.
    """
    defaults = {"search_keyword": "string", "search_location": "string", "captured_at": "timestamp"}
    absent = {c: F.lit(None).cast(t) for c, t in defaults.items() if c not in pages.columns}
    rows = (pages.withColumns(absent) if absent else pages).select(
        "task_id", "rank", F.col("url").alias("link"), *defaults, "html"
    )
    texts = {c: _alternatives(s) for c, s in _CAPTURED.items()}
    box, labels, bars = _alternatives(RATING_BOX), _alternatives(ADDRESS_LABEL), _alternatives(STAR_BAR)
    phone, website, hours = _alternatives(PHONE), _alternatives(WEBSITE), _alternatives(HOURS)
    names = CAPTURE.fieldNames()

    def one(html: str) -> dict:
        page = _Page(html or "")
        record = {c: _first_text(page, alternatives) for c, alternatives in texts.items()}
        for c, alternatives in (("rating_box_text", box), ("hours_text", hours)):
            element = _first_any(page, alternatives)
            record[c] = None if element is None else element.text()
        for c, alternatives, name in (("phone_aria", phone, "aria-label"), ("website", website, "href")):
            element = _first_any(page, alternatives)
            record[c] = None if element is None else element.attrs.get(name)
        record["address_aria"] = [e.attrs["aria-label"] for e in _all(page, labels) if "aria-label" in e.attrs]
        record["star_bar_texts"] = [e.text() for e in _all(page, bars)[:5]]
        return record

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([one(h) for h in batch["html"]], index=batch.index)
            yield pd.concat([batch.drop(columns="html"), found], axis=1).reindex(columns=names)

    ship_package(rows.sparkSession)
    return spread(rows).mapInPandas(read, CAPTURE)


def observations_from_panels(panels: DataFrame) -> DataFrame:
    """OBSERVATION rows of result-panel pages (task_id, scroll_no, html): links in document order.

    The first selector that finds any element wins, as a whole.
    """
    selectors = [_alternatives(s) for s in PANEL_LINKS]
    schema = "task_id long, scroll_no int, pos int, href string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for task, scroll, html in zip(batch["task_id"], batch["scroll_no"], batch["html"]):
                page = _Page(html or "")
                for alternatives in selectors:
                    hits = _all(page, alternatives)
                    if hits:
                        rows += [(task, scroll, i, e.attrs.get("href")) for i, e in enumerate(hits)]
                        break
            yield pd.DataFrame(rows, columns=["task_id", "scroll_no", "pos", "href"])

    ship_package(panels.sparkSession)
    return spread(panels.select("task_id", "scroll_no", "html")).mapInPandas(read, schema)
