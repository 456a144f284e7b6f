"""Container-level page features that need the element tree: main content, menus, cards, nested tables.

A small parser, the standard library's where a page is not plain, runs once per page inside an Arrow UDF. Spark partitions the pages;
the columns passed in are NULL for pages that do not need the tree, so those cost nothing here.

Elements and texts are numbered as they open, so what an element holds is an interval of numbers. Results name texts by
intervals too: they are as long as the page, however deep its elements are nested.
"""

import re
from bisect import bisect_left
from collections import defaultdict
from functools import cache
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from licensum import vocab
from licensum.schemas import NAVIGATION

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNREAD = frozenset(("script", "style", "template"))
# A sibling's start ends an element whose end tag was left out: which open elements it ends, and where the search stops.
CELLS, LISTS = frozenset(("td", "th")), frozenset(("ul", "ol", "menu"))
ENDED_BY = {
    "td": (CELLS, frozenset(("tr", "table"))),
    "th": (CELLS, frozenset(("tr", "table"))),
    "tr": (CELLS | {"tr"}, frozenset(("table",))),
    "tbody": (CELLS | {"tr", "thead", "tbody"}, frozenset(("table",))),
    "tfoot": (CELLS | {"tr", "thead", "tbody"}, frozenset(("table",))),
    "li": (frozenset(("li",)), LISTS),
    "p": (frozenset(("p",)), CELLS | LISTS | {"li", "div", "table", "section", "article", "body"}),
}

_SPAN = [T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]
_SPANS = T.ArrayType(T.StructType(_SPAN))
_TEXTS = T.StructField("texts", T.ArrayType(T.StringType()))
#: Texts of a page; its cells as spans of texts, its rows as spans of cells, and the wanted tables as spans of rows.
TABLES = T.StructType([_TEXTS, T.StructField("cells", _SPANS), T.StructField("rows", _SPANS), T.StructField("tables", T.ArrayType(T.StructType([T.StructField("no", T.IntegerType()), *_SPAN])))])
#: Texts of a page; its boxes with the number of the box around them and of their first item, and the substantial cards as
#: spans of texts, each in its innermost box.
CARDS = T.StructType(
    [
        _TEXTS,
        T.StructField("boxes", T.ArrayType(T.StructType([T.StructField("parent", T.IntegerType()), T.StructField("items", T.IntegerType())]))),
        T.StructField("cards", T.ArrayType(T.StructType([T.StructField("container", T.IntegerType()), T.StructField("item", T.IntegerType()), *_SPAN]))),
    ]
)


class Page:
    """Elements in document order: tag, attributes, the number behind their last descendant, the span of their texts.

    ``texts`` are the text nodes without outer blanks, but for empty ones and those of scripts, styles and templates.
    """

    def __init__(self):
        self.tags, self.attrs, self.end, self.first, self.last = [], [], [], [], []
        self.texts = []

    def numbers(self, *tags, among=None):
        wanted = frozenset(tags)
        return [i for i in (range(len(self.tags)) if among is None else among) if self.tags[i] in wanted]

    def within(self, numbers, i):
        """The slice of sorted element numbers that are descendants of element ``i``."""
        return bisect_left(numbers, i + 1), bisect_left(numbers, self.end[i])

    def text(self, sep, i):
        return sep.join(self.texts[self.first[i] : self.last[i]])

    def css_has(self, i, words):
        css = (self.attrs[i].get("class") or "").lower()
        return any(w in css for w in words)

    def matches(self, i, selector):
        if selector[0] == ".":
            return selector[1:] in (self.attrs[i].get("class") or "").split()
        if selector[0] == "#":
            return self.attrs[i].get("id") == selector[1:]
        return self.tags[i] == selector


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.open = []
        self.count = defaultdict(int)
        self.data = []

    def _flush(self):
        """Ends a text node."""
        if self.data:
            text = "".join(self.data).strip()
            self.data = []
            if text and not any(map(self.count.__getitem__, UNREAD)):
                self.page.texts.append(text)

    def _close(self, depth):
        if self.data:
            self._flush()
        page = self.page
        for i in self.open[depth:]:
            self.count[page.tags[i]] -= 1
            page.end[i], page.last[i] = len(page.tags), len(page.texts)
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        if self.data:
            self._flush()
        page = self.page
        if tag in ENDED_BY:
            ended, border = ENDED_BY[tag]
            if any(map(self.count.__getitem__, ended)):
                outermost = None
                for depth in range(len(self.open) - 1, -1, -1):
                    if page.tags[self.open[depth]] in border:
                        break
                    if page.tags[self.open[depth]] in ended:
                        outermost = depth
                if outermost is not None:
                    self._close(outermost)
        self.open.append(len(page.tags))
        self.count[tag] += 1
        page.tags.append(tag)
        page.attrs.append(dict(attrs))
        page.end.append(0)
        page.first.append(len(page.texts))
        page.last.append(0)
        if tag in VOID:
            self._close(len(self.open) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        if self.data:
            self._flush()
        if not self.count[tag]:
            return
        for depth in range(len(self.open) - 1, -1, -1):
            if self.page.tags[self.open[depth]] == tag:
                self._close(depth)
                return

    def handle_data(self, data):
        self.data.append(data)

    def _break(self, _):
        self._flush()

    handle_comment = handle_decl = handle_pi = unknown_decl = _break


_BLANK = r"[\t\n\r\f ]"
# A text and the plain tag, comment or document type behind it; or all that is left, from the first piece on that is not plain.
_PLAIN = re.compile(
    rf"""([^<]*+)<(?:(/?)([a-zA-Z][a-zA-Z0-9]*+)((?:{_BLANK}++[a-zA-Z][a-zA-Z0-9_-]*+(?:="[^"<>&]*+")?+)*+){_BLANK}*+(/?)>|!--[^<>-]*+-->|!(?:doctype|DOCTYPE) [a-zA-Z]++>)|(.+)""", re.S
)
_PLAIN_ATTR = re.compile(r"""([a-zA-Z][a-zA-Z0-9_-]*+)(?:="([^"]*+)")?+""")
# Elements whose contents a parser may take for text alone.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())


def _read_plain(reader: _Reader, html: str) -> bool:
    """Reads a page of plain tags, as most are, in a fraction of the parser's time; False if a piece is not plain.

    Does what the reader does for each piece, without a call for each.
    """
    pieces = _PLAIN.findall(html)
    if pieces and pieces[-1][5]:
        return False
    page, opened, count, unread, raw = reader.page, reader.open, reader.count, 0, None
    tags, end, first, last, texts = page.tags, page.end, page.first, page.last, page.texts

    def close(depth):
        nonlocal unread
        for i in opened[depth:]:
            tag = tags[i]
            count[tag] -= 1
            if tag in UNREAD:
                unread -= 1
            end[i], last[i] = len(tags), len(texts)
        del opened[depth:]

    for data, ends, tag, attrs, closed, _ in pieces:
        tag = tag.lower()
        if raw is not None:
            if not (ends and tag == raw and (raw in UNREAD or "&" not in data)):
                return False
            raw = None
        if data and not unread and (text := (unescape(data) if "&" in data else data).strip()):
            texts.append(text)
        if not tag:
            continue
        if ends:
            if attrs or closed:
                return False
            if count[tag]:
                depth = len(opened) - 1
                while tags[opened[depth]] != tag:
                    depth -= 1
                close(depth)
            continue
        if tag in RAW:
            if closed or tag == "plaintext":
                return False
            raw = tag
        if tag in ENDED_BY:
            ended, border = ENDED_BY[tag]
            if any(map(count.__getitem__, ended)):
                outermost = None
                for depth in range(len(opened) - 1, -1, -1):
                    if tags[opened[depth]] in border:
                        break
                    if tags[opened[depth]] in ended:
                        outermost = depth
                if outermost is not None:
                    close(outermost)
        number = len(tags)
        tags.append(tag)
        page.attrs.append({m[1].lower(): m[2] for m in _PLAIN_ATTR.finditer(attrs)} if attrs else {})
        first.append(len(texts))
        if closed or tag in VOID:
            end.append(number + 1)
            last.append(len(texts))
        else:
            opened.append(number)
            count[tag] += 1
            if tag in UNREAD:
                unread += 1
            end.append(0)
            last.append(0)
    return raw is None


def parse(html: str) -> Page:
    """The elements and texts of a page. Behind the last ``>`` no tag can end, so what is there is text, up to an open comment."""
    end = html.rfind(">") + 1
    reader = _Reader()
    if not _read_plain(reader, html[:end]):
        reader = _Reader()
        reader.feed(html[:end])
        reader.close()
    reader.handle_data(unescape(html[end:].partition("<!--")[0]))
    reader._close(0)
    return reader.page


def main_text(page, selectors, drop) -> str:
    kept, nodes, behind = [True] * len(page.texts), [], 0
    for i, tag in enumerate(page.tags):
        if i < behind:
            continue
        if tag in drop:
            behind = page.end[i]
            kept[page.first[i] : page.last[i]] = [False] * (page.last[i] - page.first[i])
        else:
            nodes.append(i)
    for selector in [*selectors, "body"]:
        for i in nodes:
            if page.matches(i, selector):
                return " ".join(t for t, k in zip(page.texts[page.first[i] : page.last[i]], kept[page.first[i] : page.last[i]], strict=True) if k)
    return " ".join(t for t, k in zip(page.texts, kept, strict=True) if k)


def navigation(page, words, menus, links_per_menu) -> dict:
    anchors = [i for i in page.numbers("a") if "href" in page.attrs[i]]
    links = {i: {"text": page.text("", i), "url": page.attrs[i]["href"] or ""} for i in anchors}

    def inside(i, limit=None):
        a, b = page.within(anchors, i)
        return [links[x] for x in anchors[a:b][:limit]]

    bars = [i for i in page.numbers("nav", "ul", "div") if page.css_has(i, words)][:menus]
    crumbs = [i for i in range(len(page.tags)) if page.css_has(i, ["breadcrumb"])]
    return {
        "main_menu_items": [link for i in bars for link in inside(i, links_per_menu)],
        "breadcrumbs": [link for i in crumbs for link in inside(i)],
        "sidebar_links": [],
        "footer_links": [],
    }


#: Elements that are boxes of cards, or cards.
BOXES = frozenset(("ul", "ol", "div", "li"))


@cache
def _any_of(words: tuple[str, ...]) -> re.Pattern:
    """A pattern of any of the words; of nothing without words."""
    return re.compile("|".join(map(re.escape, words)) if words else "(?!)")


def cards(page, words, containers, items, min_length) -> dict:
    """A card is an item in some box, and is given once, with the innermost of its boxes and its number there.

    The boxes around that one are its parents; a card's number in a box is its number among all items less the box's
    ``items``. With limits a card counts if it is among the first ``items`` of one of the first ``containers``.
    """
    has = _any_of(tuple(words)).search
    named = [i for i, attrs in enumerate(page.attrs) if (css := attrs.get("class")) and page.tags[i] in BOXES and has(css.lower())]
    lists = [i for i in named if page.tags[i] != "li"]
    inner = [i for i in named if page.tags[i] in ("li", "div")]
    number = {i: n for n, i in enumerate(lists)}
    length = [0, *accumulate(len(text) + 1 for text in page.texts)]
    boxes, found, around, place = [], [], [], 0
    for i in named:
        while around and page.end[lists[around[-1]]] <= i:
            around.pop()
        if place < len(inner) and inner[place] == i:
            limited = containers is not None or items is not None
            fits = not limited or any((containers is None or c < containers) and (items is None or place - boxes[c]["items"] < items) for c in around)
            a, b = page.first[i], page.last[i]
            if around and fits and length[b] - length[a] - 1 >= min_length:
                found.append({"container": around[-1], "item": place - boxes[around[-1]]["items"], "a": a, "b": b})
            place += 1
        if i in number:
            boxes.append({"parent": around[-1] if around else None, "items": place})
            around.append(number[i])
    return {"texts": page.texts, "boxes": boxes, "cards": found}


def tables(page, words) -> dict:
    """The tables whose header, their first row, mentions a word; rows and cells of inner tables belong to the outer ones too.

    Where a word stands is found once in all texts. A cell's text is its texts without a separator, so a word may run over
    several of them, but not over the end of an outermost cell.
    """
    rows, cells = page.numbers("tr"), page.numbers("td", "th")
    lows = [t.lower() for t in page.texts]
    start = [0]
    for low in lows:
        start.append(start[-1] + len(low))
    joined = "".join(lows)
    places = []
    for word in words:
        found, at = [], joined.find(word)
        while at >= 0:
            found.append(at)
            at = joined.find(word, at + 1)
        places.append((len(word), found))

    def mentions(row):
        a, b = page.within(cells, row)
        while a < b:
            left, right = start[page.first[cells[a]]], start[page.last[cells[a]]]
            for size, found in places:
                at = bisect_left(found, left)
                if at < len(found) and found[at] + size <= right:
                    return True
            a = page.within(cells, cells[a])[1] if page.end[cells[a]] > cells[a] + 1 else a + 1
        return False

    spans = []
    for no, i in enumerate(page.numbers("table")):
        a, b = page.within(rows, i)
        if a < b and mentions(rows[a]):
            spans.append({"no": no, "a": a, "b": b})
    if not spans:
        return {"texts": [], "cells": [], "rows": [], "tables": []}
    of_rows = [dict(zip("ab", page.within(cells, i), strict=True)) for i in rows]
    return {"texts": page.texts, "cells": [{"a": page.first[i], "b": page.last[i]} for i in cells], "rows": of_rows, "tables": spans}


def _arrow(kind: T.DataType) -> pa.DataType:
    """The Arrow type of a result."""
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return pa.int32() if isinstance(kind, T.IntegerType) else pa.string()


def _column(kind: T.DataType, values: list) -> pa.Array:
    """Results as an Arrow array, field by field; a structure is always there, its fields may be NULL."""
    if isinstance(kind, T.StructType):
        return pa.StructArray.from_arrays([_column(f.dataType, [v[f.name] for v in values]) for f in kind], fields=list(_arrow(kind)))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        offsets = [0, *accumulate(0 if v is None else len(v) for v in values)]
        starts = pa.array([None if v is None else a for v, a in zip(values, offsets, strict=False)] + offsets[-1:], pa.int32())
        return pa.ListArray.from_arrays(starts, _column(kind.elementType, [x for v in values if v for x in v]), type=_arrow(kind))
    return pa.array(values, _arrow(kind))


def _udf(kind, fn, needs=None):
    """Arrow UDF over pages; NULL pages stay NULL, a structure of them has NULL fields.

    Results go to Arrow as they are: by way of pandas every text and span would be converted in Python. Pages that
    ``needs`` denies are not parsed; they give what a page without elements and texts gives.
    """
    empty = dict.fromkeys(kind.names) if isinstance(kind, T.StructType) else None

    def run(html: pa.Array) -> pa.Array:
        return _column(kind, [empty if h is None else fn(parse(h) if needs is None or needs(h) else Page()) for h in html.to_pylist()])

    return F.arrow_udf(run, returnType=kind)


def _may_have_class(words):
    """A test in front of the parser: whether some class attribute may have one of the words.

    It takes all that any parser may take for the value of such an attribute, and every value with a reference in it.
    """
    wanted = "|".join([*map(re.escape, words), "&"])
    value = rf"""(?:"[^"]*?(?:{wanted})|'[^']*?(?:{wanted})|[^\s>]*?(?:{wanted}))"""
    pattern = re.compile(rf"class[\s\x00=]*{value}")
    return lambda html: pattern.search(html.lower()) is not None


def joined(texts: Column, span: Column, sep: str) -> Column:
    """The texts of a span as one text."""
    return F.array_join(F.slice(texts, span["a"] + 1, span["b"] - span["a"]), sep)


def main_text_column(html: Column, selectors=vocab.MAIN_SELECTORS, drop=vocab.BOILERPLATE_TAGS) -> Column:
    """Text of the first element in selector priority, else of the body, else of the page."""
    selectors, drop = list(selectors), frozenset(drop)
    return _udf(T.StringType(), lambda page: main_text(page, selectors, drop))(html)


def navigation_column(html: Column, words=vocab.NAV_CLASS_WORDS, menus=None, links_per_menu=None) -> Column:
    """Links of the menus, all or the first of them, and of all breadcrumbs."""
    words = list(words)
    return _udf(NAVIGATION, lambda page: navigation(page, words, menus, links_per_menu))(html)


def cards_column(html: Column, words=vocab.CARD_CLASS_WORDS, containers=None, items=None, min_length=51) -> Column:
    """Substantial texts of list items and cards, as ``CARDS``."""
    words = list(words)
    return _udf(CARDS, lambda page: cards(page, words, containers, items, min_length), _may_have_class(words))(html)


def tables_column(html: Column, words=vocab.TABLE_HEADER_WORDS) -> Column:
    """The tables whose header mentions a word, as ``TABLES``."""
    words = list(words)
    return _udf(TABLES, lambda page: tables(page, words))(html)
