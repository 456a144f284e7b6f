"""Pages that are not closed, or very long."""

import time
from html import unescape

import pytest
from pyspark.sql import functions as F

from licensum.functions import html as H
from licensum.functions import tree
from licensum.operators import pages as P
from licensum.operators import responses as R


@pytest.mark.parametrize("shape", ["<a ", "<script ", "<!--", "</", "<p class=", "<script>", "<a <b "])
def test_cost_of_open_tags(spark, shape):
    """Four times the page takes about four times as long, not sixteen."""

    def seconds(size):
        df = spark.createDataFrame([(shape * (size // len(shape)),)], "h string")
        start = time.perf_counter()
        df.select(F.length(H.visible_text(F.col("h"))), F.length(H.class_text(H.markup(F.col("h"))))).collect()
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(400_000) < 10


def test_text_behind_the_last_tag(one):
    assert one(H.visible_text(F.col("c")), "<p>a</p> b < c <a href=") == "a b < c <a href="
    assert one(H.visible_text(F.col("c")), "<p>a</p> b <!-- c < d") == "a b"
    assert one(H.visible_text(F.col("c")), "<p>a</p><script>if (a < b") == "a"
    assert one(H.markup(F.col("c")), "<p>a</p><script>if (a < b") == "<p>a</p><script>"


TABLE = "<table><tr><th>Premises Name<th>Address<th>Status<tr><td>A<td>B<td>C<tr><td>D<td>E<td>F</table>"


@pytest.mark.parametrize("html", [TABLE, f"<table><tr><td>{TABLE}</td></tr></table>"])
def test_left_out_end_tags(spark, html):
    rows = P.table_rows(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()
    assert [r.cells for r in rows if r.headers[0] == "premises name"] == [["A", "B", "C"], ["D", "E", "F"]]


def test_left_out_end_tags_do_not_nest():
    start = time.perf_counter()
    inner = "<tr><td>x<td>y<td>z" * 3000
    got = tree.tables(tree.parse(f"<table><tr><td>name<table>{inner}</table></td></tr></table>"), ["name", "x"])
    assert [(t["a"], t["b"]) for t in got["tables"]] == [(0, 3001), (1, 3001)]
    assert {r["b"] - r["a"] for r in got["rows"][1:]} == {3}
    assert time.perf_counter() - start < 5


def test_no_rows_are_cut(spark):
    rows = "".join(f"<tr><td>Inn {i}</td><td>{i} Road</td><td>granted</td></tr>" for i in range(120))
    html = f"<table><tr><th>Premises Name</th><th>Address</th><th>Status</th></tr>{rows}</table>"
    assert P.table_rows(spark.createDataFrame([(1, html)], "page_id int, html string")).count() == 120


def test_lists_that_cannot_be_read_are_rejected(spark):
    texts = ['[{"premises_name": "A", "premises_address": "B"}', "none", "[]", '[{"premises_name": {"x": 1}, "premises_address": "B"}]', '[{"premises_name": "A", "premises_address": "B", "conditions": "C"}]', '[{"premises_name": "A", "premises_address": "B", "conditions": []}]']
    df = spark.createDataFrame([(i, "X", t) for i, t in enumerate(texts)], "page_id int, council_name string, response string")
    got = {r.page_id: (r.item, r.reject_reason) for r in R.parse_array_responses(df).collect()}
    assert got == {0: (None, "no JSON found"), 1: (None, "no JSON found"), 3: (0, "field of a wrong type"), 4: (0, "field of a wrong type"), 5: (0, None)}


SHAPES = ["<form ", "<div x ", "<table ", "<td ", "<input ", "<a ", "<a href='", "<!--", "<", "&", "<p class=", "<script ", "<table><tr><td>a", "<table><tr><td>name ", "<div class=item>some words ", "<ul class=nav>", "<td>", "<tr>", "<li>", "<form><input>"]
OPERATORS = {
    "visible_text": P.visible_text, "line_text": P.line_text, "main_content": P.main_content, "page_links": P.page_links, "scored_links": P.scored_links, "structure_counts": P.structure_counts,
    "page_flags": P.page_flags, "page_features": P.page_features, "card_boxes": P.card_boxes, "navigation": P.navigation, "page_analysis": P.page_analysis,
}


def _pages(spark, size, shapes=SHAPES):
    return spark.createDataFrame([(i, "https://a.uk/x", s * (size // len(s)) + end) for i, s in enumerate(shapes) for end in ("", ">")], "page_id int, url string, html string")


def _seconds(df):
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_are_linear_in_the_page(spark, name):
    _seconds(OPERATORS[name](_pages(spark, 1000).repartition(8)))
    assert _seconds(OPERATORS[name](_pages(spark, 200_000).repartition(8))) < 20


def test_nested_tables_and_cards_cost_what_they_hold(spark):
    """2,000 tables, and boxes of 40 kB, in each other: the tree is as long as the page, texts are made row by row."""
    start = time.perf_counter()
    page = tree.parse("<table><tr><td>a" * 2000)
    assert tree.tables(page, ["name"])["tables"] == []
    found = tree.tables(tree.parse("<table><tr><td>name" * 2000), ["name"])
    assert len(found["tables"]) == len(found["rows"]) == len(found["cells"]) == 2000
    nested = tree.cards(tree.parse("<div class=item>words in an item " * 1200), ["item"], None, None, 51)
    assert time.perf_counter() - start < 1
    assert len(nested["texts"]) == len(nested["boxes"]) == 1200
    assert [c["container"] for c in nested["cards"]] == list(range(len(nested["cards"])))
    rows = spark.createDataFrame([(1, "<div class=item>words in an item " * 300)], "page_id int, html string")
    # Items inside the first box, but for those at the end whose texts are short.
    assert P.card_texts(rows).count() == 296
    assert [(r.container, r.parent, r["items"]) for r in P.card_boxes(rows).orderBy("container").limit(3).collect()] == [(0, None, 1), (1, 0, 2), (2, 1, 3)]


def test_nested_tables_by_a_plain_reader(spark):
    """All rows of the wanted tables of nested pages, as a search for each table's rows and each row's cells finds them."""
    import random
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.root = self.at = ["", None, []]

        def handle_starttag(self, tag, attrs):
            self.at[2].append([tag, self.at, []])
            self.at = self.at[2][-1]

        def handle_endtag(self, tag):
            self.at = self.at[1]

        def handle_data(self, data):
            self.at[2].append(data)

    def search(node, tags):
        for x in node[2]:
            if not isinstance(x, str):
                if x[0] in tags:
                    yield x
                yield from search(x, tags)

    def words(node):
        return "".join(x.strip() if isinstance(x, str) else words(x) for x in node[2])

    rng = random.Random(1)

    def table(depth):
        cell = lambda: table(depth + 1) if depth < 3 and rng.random() < 0.3 else rng.choice(["a", " b <b>c</b>", "na<i>me</i>", "", "Date", "x y"])
        row = lambda: "<tr>" + "".join(f"<td>{cell()}</td>" for _ in range(rng.randint(0, 4))) + "</tr>"
        return "<table>" + "".join(row() for _ in range(rng.randint(0, 4))) + "</table>"

    htmls = ["<div>" + table(0) + table(0) + "</div>" for _ in range(60)]
    want = set()
    for i, html in enumerate(htmls):
        reader = Plain()
        reader.feed(html)
        for no, found in enumerate(search(reader.root, ["table"])):
            rows = [[words(c) for c in search(r, ["td", "th"])] for r in search(found, ["tr"])]
            headers = [h.lower() for h in rows[0]] if rows else []
            if any(w in " ".join(headers) for w in ["name", "date"]):
                want |= {(i, no, n, tuple(headers), tuple(r)) for n, r in enumerate(rows[1:]) if len(r) >= 3}
    got = P.table_rows(spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string"), header_words=["name", "date"]).collect()
    assert len(want) > 50
    assert {(r.page_id, r.table_no, r.row_no, tuple(r.headers), tuple(r.cells)) for r in got} == want


def test_named_references_as_the_standard_has_them(spark):
    """Native decoding equals that of the element tree for every name, with and without its semicolon."""
    from html.entities import html5

    names = sorted({n.rstrip(";") for n in html5})
    texts = [f"a &{n}{end} b" for n in names for end in (";", "", "x;", "1")] + ["&", "&;", "&&amp", "&amp&lt;&gt", "x&notit;", "&unknown;"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.d for r in df.select("i", H.decode_entities(F.col("t")).alias("d")).collect()}
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != unescape(t)] == []
