"""The quick reading of plain pages against the standard library's parser."""

import random
import re

import pytest

from licensum.functions import tree

PIECES = (
    "<p>|</p>|<div class=\"a b\">|<DIV Class=\"x\" id=\"\">|</div >|<li>|</li>|<ul>|</ul>|<td>|</td>|<tr>|<table>|</table>|<br/>|<br>|<img src=\"a.png\" alt>|<a href=\"/x?y=1\">|</a>|text |"
    " a &amp; b |&notit;|1 < 2|<!-- note -->|<!-- a > b -->|<!DOCTYPE html>|<!doctype html>|<script>|</script>|var a = 1;|a<b|<style>|</style>|<title>|</title>|<textarea>|</textarea>|<noscript>|</noscript>|"
    "<a href='q'>|<a href=u>|<a href=\"a&amp;b\">|</|<|>|</p x>|</p/>|<p/ >|<a\n href=\"n\"\tb=\"c\" >|<script/>|<plaintext>|<?php x ?>|<![CDATA[x]]>|<svg:rect>|<h1/>| |\x00|<p\x0bq>|<a b=\"1\"c=\"2\">|<a b=\"1\" b=\"2\">|<a B>"
).split("|")


def slow(html):
    """As ``parse``, by the standard library alone."""
    reader, end = tree._Reader(), html.rfind(">") + 1
    reader.feed(html[:end])
    reader.close()
    reader.handle_data(tree.unescape(html[end:].partition("<!--")[0]))
    reader._close(0)
    return reader.page


@pytest.mark.parametrize("plain", [True, False])
def test_plain_reading_is_the_parsers(plain):
    rng = random.Random(7)
    pieces = [x for x in PIECES if not plain or re.fullmatch(r"[^<>&]*|</?[a-z]+[0-9]?>|<[a-z]+( [a-z]+=\"[^&]*\")>|<br/>|<!-- note -->", x)]
    quick = 0
    for _ in range(4000):
        html = "".join(rng.choices(pieces, k=rng.randint(1, 14)))
        assert vars(tree.parse(html)) == vars(slow(html)), html
        quick += tree._read_plain(tree._Reader(), html[: html.rfind(">") + 1])
    assert quick > 200


def test_plain_pages_skip_the_parser(monkeypatch):
    monkeypatch.setattr(tree._Reader, "feed", None)
    page = tree.parse('<html><body><ul class="results"><li>One &amp; two<li>Three</ul><script>if (a) b();</script><br/></body></html>')
    assert page.texts == ["One & two", "Three"]
    assert page.tags == ["html", "body", "ul", "li", "li", "script", "br"]
