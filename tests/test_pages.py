from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from licensum.functions import html as H
from licensum.functions import urls
from licensum.operators import pages as P

C = F.col("c")
BASE = "https://www.a.gov.uk/business/licensing?x=1#top"


@pytest.mark.parametrize(
    "href",
    ["/register", "premises?id=3", "../up", "../../../up/./x/", "", "#part", "?page=2", "//cdn.b.org/x", "http://b.org/a/../b", "mailto:a@b.c", "a/b/../c", "..", ".", "a//b", "/x/..", "/a//b#f"],
)
def test_resolve_url(one, href):
    assert one(urls.resolve_url(F.lit(BASE), C), href) == urljoin(BASE, href)


@pytest.mark.parametrize(
    "value, expected",
    [("See https://a.gov.uk/x). ok", "https://a.gov.uk/x"), ("https://example.com/a", None), ("none", None), (None, None), ("http://b.uk/;.", "http://b.uk/")],
)
def test_clean_url(one, value, expected):
    assert one(urls.clean_url(C), value) == expected


@pytest.mark.parametrize(
    "value, expected",
    [("&amp;lt;", "&lt;"), ("a &#8217;b&#x41; &pound;5 &nope; & c", "a ’bA £5 &nope; & c"), ("&#128512;&eacute;&#233;", "😀éé"), ("&#0;", "&#0;"), ("plain", "plain"), (None, None)],
)
def test_decode_entities(one, value, expected):
    assert one(H.decode_entities(C), value) == expected


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>top</header><!-- <a href="/no">no</a> -->
<nav class="Main-Menu"><a href="/a?x=1&amp;y=2"> One <b>two</b></a><a name="n">anchor</a></nav>
<script>var s = '<a href="/s">s</a>'; vue()</script><p>x &lt; y</p> 3 < 4 <a href='/q' class=next>Next</a>
<a href=/bare>bare<a href="/open">open
</body></html>"""


def test_visible_text_and_links(one):
    assert one(H.visible_text(C), PAGE) == "T x < y 3 < 4 Next bare open"
    links = one(H.links(H.markup(C)), PAGE)
    assert [(x.href, x.text) for x in links] == [("/a?x=1&y=2", "Onetwo"), ("/q", "Next"), ("/bare", "bare"), ("/open", "open")]
    assert one(H.needs_javascript(H.class_text(H.markup(C)), C), PAGE) is True
    assert one(H.has_next_link(H.markup(C)), PAGE) is True
    assert one(H.visible_text(C), "a<script>never closed <b>x") == "a"


NESTED = """<table><tr><th>Name</th><th>Address</th><th>Status</th></tr>
<tr><td>A</td><td><table><tr><td>in</td><td>ner</td><td>row</td></tr></table></td><td>Granted</td></tr></table>"""
FLAT = """<table class=x><tr><th>Name</th><th>Address</th><th>Status</th></tr>
<tr><td> Red <b>Lion</b></td><td>1 High St</td><td>Granted<tr><td>B</td><td>2 Low Rd</td></tr></table>"""


def test_tables(spark):
    pages = spark.createDataFrame([(1, "u", NESTED), (2, "u", FLAT)], "page_id long, url string, html string")
    rows = {(r.page_id, r.table_no, r.row_no): r.cells for r in P.table_rows(pages).collect()}
    assert rows[(2, 0, 0)] == ["RedLion", "1 High St", "Granted"]
    assert (2, 0, 1) not in rows
    # The outer row holds the inner cells as well, the inner row is also a row of the outer table.
    assert rows[(1, 0, 0)] == ["A", "innerrow", "in", "ner", "row", "Granted"]
    assert rows[(1, 0, 1)] == ["in", "ner", "row"]


def test_rows_have_no_limit_but_a_given_one(spark):
    body = "".join(f"<tr><td>n{i}</td><td>a</td><td>s</td></tr>" for i in range(80))
    pages = spark.createDataFrame([(1, "u", f"<table><tr><th>Name</th></tr>{body}</table>")], "page_id long, url string, html string")
    assert P.table_rows(pages).count() == 80
    assert P.table_rows(pages, max_rows=50).count() == 50


def test_card_and_menu_limits(spark):
    items = "".join(f'<li class="item">{i} {"long enough text " * 4}</li>' for i in range(25))
    menu = "".join(f'<a href="/{i}">{i}</a>' for i in range(12))
    html = f'<ul class="results">{items}</ul><nav class="nav">{menu}</nav><nav>{menu}</nav>'
    pages = spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id long, url string, html string")
    assert P.card_texts(pages).count() == 25
    assert P.card_texts(pages, items=20).count() == 20
    full = {r.page_id: r.navigation_structure for r in P.navigation(pages).collect()}
    assert len(full[1].main_menu_items) == 12
    nav = {r.page_id: r.navigation_structure for r in P.navigation(pages, menus=3, links_per_menu=10).collect()}
    assert len(nav[1].main_menu_items) == 10 and nav[1].breadcrumbs == []


def test_row_record_last_header_wins(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["1", "2", "3", "4"]), (["a", "b"], ["1"])], "h array<string>, c array<string>")
    records = [r.r for r in df.select(P.row_record(F.col("h"), F.col("c")).alias("r")).collect()]
    assert records == [{"a": "3", "b": "2"}, {"a": "1"}]


def test_parameters_in_addresses_are_no_references(one):
    links = one(H.links(H.markup(C)), '<a href="/x?a=1&copy=2&amp;lt=3&para">&copy=</a>')
    assert [(x.href, x.text) for x in links] == [("/x?a=1&copy=2&lt=3¶", "©=")]
