"""HTML walking inside Arrow batches: text of a fragment, and the listings of a page.

Only the parse itself is Python. Which pages visit a worker, and what becomes of the
parsed parts, is decided by native expressions in ``operators.extract``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql import functions as F
from pyspark.sql import types as T

# the parsers travel to the workers by value: nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements without content, elements whose text is not page text,
# elements that keep their white space, and the white space of HTML.
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta "
    "nextid param source spacer track wbr".split()
)
HIDDEN = frozenset(("script", "style", "template", "rt", "rp"))
VERBATIM = frozenset(("pre", "textarea"))
HTML_SPACE = " \n\t\f\r"

# Class names and selectors, in order of preference.
CARD_CLASSES = frozenset(("job-card", "job-listing", "job-item", "position-card"))
CARD_FIELDS = {
    "title": ("h2", "h3", ".job-title", ".position-title"),
    "department": (".department", ".team", ".category"),
    "location": (".location", ".job-location"),
    "employment_type": (".employment-type", ".job-type"),
}



def _texts(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


_ITEM = T.StructType([*_texts("text"), T.StructField("has_marker", T.BooleanType())])
ANCHOR = T.StructType([*_texts("title", "url"), T.StructField("items", T.ArrayType(_ITEM))])
CARD = T.StructType(_texts(*CARD_FIELDS, "url"))
LISTINGS = T.StructType([T.StructField("anchors", T.ArrayType(ANCHOR)), T.StructField("cards", T.ArrayType(CARD))])
TEXT_GROUPS = T.ArrayType(T.ArrayType(T.StringType()))


class Element:
    """A tag with its attributes and its children: elements and visible texts."""

    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []

    def nodes(self) -> Iterator[Element | str]:
        """Descendants in document order."""
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            yield node
            if isinstance(node, Element):
                stack.extend(reversed(node.children))

    def elements(self, name: str | None = None, classes: frozenset[str] | None = None) -> Iterator[Element]:
        for node in self.nodes():
            if isinstance(node, Element) and name in (None, node.name):
                if classes is None or not classes.isdisjoint(node.attrs.get("class", "").split()):
                    yield node

    def first(self, selector: str, css_class: str | None = None) -> Element | None:
        if selector.startswith("."):
            return next(self.elements(None, frozenset((selector[1:],))), None)
        return next(self.elements(selector, frozenset((css_class,)) if css_class else None), None)

    def text(self) -> str:
        """Every text stripped, empty ones left out, no separator."""
        return "".join(node.strip() for node in self.nodes() if isinstance(node, str))


class _Builder(HTMLParser):
    """Lenient tree: an end tag closes up to its latest open namesake, unknown end tags are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = Element("", {})
        self.open = [self.root]
        self.buffer: list[str] = []
        self.hidden = self.verbatim = 0

    def _flush(self) -> None:
        if not self.buffer:
            return
        text = "".join(self.buffer)
        self.buffer = []
        if self.hidden:
            return
        if not self.verbatim and not text.strip(HTML_SPACE):
            text = "\n" if "\n" in text else " "
        self.open[-1].children.append(text)

    def handle_data(self, data: str) -> None:
        self.buffer.append(data)

    def handle_entityref(self, name: str) -> None:
        """A named character, closed or not; an unknown name stays as it is, without its semicolon."""
        self.buffer.append(html5.get(f"{name};") or html5.get(name) or f"&{name}")

    def handle_charref(self, name: str) -> None:
        """A numbered character; numbers below 256 are read as Windows-1252."""
        try:
            number = int(name[1:], 16) if name[0] in "xX" else int(name)
            text = bytes([number]).decode("windows-1252") if number < 256 else chr(number)
        except (ValueError, OverflowError):
            text = "\N{REPLACEMENT CHARACTER}"
        self.buffer.append(text)

    def _count(self, name: str, step: int) -> None:
        self.hidden += step * (name in HIDDEN)
        self.verbatim += step * (name in VERBATIM)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._flush()
        element = Element(tag, {key: value or "" for key, value in attrs})
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)
            self._count(tag, 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if any(element.name == tag for element in self.open[1:]):
            while True:
                closed = self.open.pop()
                self._count(closed.name, -1)
                if closed.name == tag:
                    return

    def _mark(self, _content: str) -> None:
        self._flush()

    handle_comment = handle_decl = handle_pi = unknown_decl = _mark


def parse(markup: str) -> Element:
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    builder._flush()
    return builder.root


def fragment_text(markup: str) -> str:
    """Visible texts joined by a line feed, ends stripped."""
    if "<" not in markup and "&" not in markup:
        return markup.strip()
    return "\n".join(node for node in parse(markup).nodes() if isinstance(node, str)).strip()


def _anchor(link: Element) -> dict:
    title = link.first("span", "positionLink")
    details = link.first("ul", "positionDetails")
    items = details.elements("li") if details else ()
    return {
        "title": title.text() if title else None,
        "url": link.attrs.get("href") or link.attrs.get("ng-href"),
        "items": [{"text": li.text(), "has_marker": li.first("i", "fa-map-marker") is not None} for li in items],
    }


def _card(card: Element) -> dict:
    row: dict[str, str | None] = {}
    for field, selectors in CARD_FIELDS.items():
        hit = next((found for found in map(card.first, selectors) if found), None)
        row[field] = hit.text() if hit else None
    row["url"] = next((a.attrs["href"] for a in card.elements("a") if "href" in a.attrs), None)
    return row


def page_listings(markup: str) -> dict:
    """Titled anchors of a page; its titled cards only when there is no such anchor."""
    root = parse(markup)
    anchors = [row for row in map(_anchor, root.elements("a", frozenset(("positionItem",)))) if row["title"]]
    cards = [] if anchors else [row for row in map(_card, root.elements("div", CARD_CLASSES)) if row["title"]]
    return {"anchors": anchors, "cards": cards}


def _each(values: pa.Array, kind: T.DataType, work) -> pa.Array:
    """Apply ``work`` to every non-NULL value of an Arrow batch."""
    rows = [None if value is None else work(value) for value in values.to_pylist()]
    return pa.array(rows, type=to_arrow_type(kind))


def _texts_of(markup: pa.Array) -> pa.Array:
    return _each(markup, T.StringType(), fragment_text)


def _text_groups_of(groups: pa.Array) -> pa.Array:
    return _each(groups, TEXT_GROUPS, lambda rows: [[fragment_text(text) for text in row] for row in rows])


def _listings_of(pages: pa.Array) -> pa.Array:
    return _each(pages, LISTINGS, page_listings)


# marked so that the planner never parses a page twice: once for a filter and once for its rows
html_text = F.arrow_udf(_texts_of, T.StringType()).asNondeterministic()
html_text_groups = F.arrow_udf(_text_groups_of, TEXT_GROUPS).asNondeterministic()
html_listings = F.arrow_udf(_listings_of, LISTINGS).asNondeterministic()
