"""What a page does not need is not done for it, and what is done gives the same."""

import random
import re

import pytest
from pyspark.sql import functions as F

from licensum.functions import html as H
from licensum.functions import tree


def test_pages_without_a_wanted_class_are_not_parsed(monkeypatch):
    needs = tree._may_have_class(["card", "item"])
    for html in ('<p class="plain">a card</p>', "<p>item</p>", '<p class=""><b id="card">', "class", ""):
        assert not needs(html), html
    for html in ("<div CLASS = 'x Card'>", "<div class=card>", '<div class="c&#97;rd">', '<p class="a"><p class\n=\n"b item">', "<div class='a > card'>", "<div class==card>"):
        assert needs(html), html


def test_no_page_with_a_wanted_class_is_left_out():
    rng, needs, held = random.Random(3), tree._may_have_class(["card"]), 0
    pieces = ['<div class="', "<div class='", "<div class=", "<li class ", "<li\nCLASS", "=", '"', "'", ">", " ", "card", "Card", "ca", "rd", "c&#97;rd", "&", "<", "/", "x", "<!--", "-->", "<script>"]
    for _ in range(20000):
        html = "".join(rng.choices(pieces, k=rng.randint(2, 9))) + rng.choice(["", '">', ">", "'>"])
        named = any("card" in (attrs.get("class") or "").lower() for attrs in tree.parse(html).attrs)
        held += named
        assert needs(html) or not named, html
    assert held > 200


def test_results_go_to_arrow_field_by_field():
    values = [tree.cards(tree.parse(h), ["card"], None, None, 1) for h in ('<ul class="card"><li class="card">a</li></ul>', "", "<p>x</p>")]
    values += [dict.fromkeys(tree.CARDS.names)]
    assert tree._column(tree.CARDS, values).to_pylist() == values


def test_only_wanted_tables_have_their_cells_read(spark):
    page = "<table><tr><th>Name</th><th>B&amp;C</th></tr><tr><td> a <b>b</b></td><td>c</tr></table><TABLE><tr><td>x</td></tr><tr><td>y</td></tr></TABLE>"
    df = spark.createDataFrame([(page,)], "m string")
    found = df.select(H.flat_tables(F.col("m"), lambda headers: F.array_contains(headers, "name")).alias("t")).first().t
    assert [(t.headers, t.rows) for t in found] == [(["name", "b&c"], [["ab", "c"]]), (["x"], None)]


@pytest.mark.parametrize("until", [None, r"</td\s*>"])
def test_parts_are_those_of_a_split(spark, until):
    rng, pattern = random.Random(5), r"(?i)<td(?:\s[^>]*)?>"
    pieces = ["<td>", "<TD a=1>", "</td>", "</td >", "</TD\n>", "<td ", "<", ">", "a", " b\n", H.CUT, H.HELD, "<!--", "<b>"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 10))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for text, got in rows.select("t", H.parts(F.col("t"), pattern, until).alias("p")).collect():
        tail = text.rpartition(">")[2]
        body = text if "<" not in tail else text[: len(text) - len(tail)] + tail.partition("<!--")[0].replace("<", H.HELD) + ("<!--" if "<!--" in tail else "")
        parts = [p.replace(H.HELD, "<") for p in re.split(pattern, body)]
        assert got == [re.split(f"(?i){until}", p)[0] if until else p for p in parts], text
