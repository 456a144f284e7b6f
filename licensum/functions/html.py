"""HTML extraction as Column expressions.

Elements are found by splitting the page at their opening tags. Every piece is then read once, so the cost stays
linear in the page size even when closing tags are missing.
"""

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from licensum import vocab
from licensum.functions.text import contains_any, let, strip

COMMENT = r"<!--.*?(?:-->|\z)"
TAG = r"</?[A-Za-z][^>]*>|<[!?][^>]*>"
# Comments, and the inner text of scripts and styles (group 1 keeps their opening tag).
# All of these begin with ``<``; the look ahead spares other characters the trial of every branch.
HIDDEN = rf"(?is)(?=<)(?:{COMMENT}|(<script(?:[\s/][^>]*)?>).*?(?:</script\s*>|\z)|(<style(?:[\s/][^>]*)?>).*?(?:</style\s*>|\z))"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
CLASS_ATTR = r"""(?i)<[a-z][^<>]*?\sclass\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def dropped_element(tag: str) -> str:
    """Pattern of a whole element; one that is never closed runs to the end of the page."""
    return rf"<{tag}(?:[\s/][^>]*)?>.*?(?:</{tag}\s*>|\z)"


def text_break(drop_tags) -> str:
    """Pattern of everything that separates two text nodes. All of it begins with ``<``, which is looked for first."""
    return "(?is)<(?:" + "|".join(x.removeprefix("<") for x in [COMMENT, *map(dropped_element, drop_tags), *TAG.split("|")]) + ")"


def _utf8(code: Column) -> Column:
    """Text of a Unicode code point."""
    tail = lambda shift: (F.floor(code / shift) % 64) + 128
    one = code
    two = (F.floor(code / 64) + 192) * 256 + tail(1)
    three = ((F.floor(code / 4096) + 224) * 256 + tail(64)) * 256 + tail(1)
    four = (((F.floor(code / 262144) + 240) * 256 + tail(4096)) * 256 + tail(64)) * 256 + tail(1)
    digits = F.when(code < 128, F.lpad(F.hex(one), 2, "0")).when(code < 2048, F.hex(two))
    digits = digits.when(code < 65536, F.hex(three)).otherwise(F.hex(four))
    return F.decode(F.unhex(digits), "UTF-8")


#: All named references of the standard, and those that count without a semicolon too.
NAMED = {name[:-1]: value for name, value in html5.items() if name.endswith(";")}
UNENDED = {name: value for name, value in html5.items() if not name.endswith(";")}
_UNENDED_NAMES = "^(?:" + "|".join(sorted(UNENDED, key=lambda n: (-len(n), n))) + ")"


def _table(entities: dict[str, str]) -> Column:
    """A map as one constant, so that plans hold a single literal."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in entities.items())), F.lit("\x01"), F.lit("\x02"))


def decode_entities(c: Column, entities=vocab.HTML_ENTITIES, *, in_attribute: bool = False) -> Column:
    """Decode named and numeric character references in one pass (``&amp;lt;`` gives ``&lt;``).

    ``entities`` are frequent names, looked up first. A name without a semicolon, or with an unknown end, is the longest
    known beginning, as the standard has it (``&notit;`` gives ``¬it;``); in an attribute it stays in front of letters,
    digits and ``=``, as in an address with parameters.
    """
    names = F.create_map(*[F.lit(x) for pair in entities.items() for x in pair])

    def char_of(ref):
        digits = F.when(ref.rlike("^#[0-9]"), ref.substr(F.lit(2), F.length(ref)).cast("bigint"))
        hexed = F.when(ref.rlike("^#[xX]"), F.conv(ref.substr(F.lit(3), F.length(ref)), 16, 10).cast("bigint"))
        valid = lambda code: (code > 0) & (code < 1114112) & ~code.between(55296, 57343)
        numeric = let(F.coalesce(digits, hexed), lambda code: F.when(valid(code), _utf8(code)))
        return F.when(ref.startswith("#"), numeric).otherwise(F.coalesce(F.try_element_at(names, ref), F.try_element_at(_table(NAMED), ref)))

    def unended(p):
        name = F.regexp_extract(p, _UNENDED_NAMES + ("(?![=A-Za-z0-9])" if in_attribute else ""), 0)
        found = lambda n: F.concat(F.try_element_at(_table(UNENDED), n), p.substr(F.length(n) + 1, F.length(p)))
        return F.coalesce(let(name, lambda n: F.when(n != "", found(n))), F.concat(F.lit("&"), p))

    def piece(p, i):
        ref = F.regexp_extract(p, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        ended = lambda r: F.when(r != "", F.concat(char_of(r), p.substr(F.length(r) + 2, F.length(p))))
        return F.when(i == 0, p).otherwise(F.coalesce(let(ref, ended), unended(p)))

    join = lambda x: F.array_join(F.transform(F.split(x, "&"), piece), "")
    return let(c, lambda x: F.when(x.contains("&"), join(x)).otherwise(x))


HELD = "\uffff"


def _held(c: Column, body) -> Column:
    """``body`` of a page whose last, unclosed tags cannot start a match.

    Behind the last ``>`` no tag can end, and each ``<`` there would be followed to the end of the page in vain; it is
    held as a character that no text has. A comment that is not closed still hides all that follows. Everywhere else a
    ``<`` finds its ``>``, and the match takes all between.
    """
    open_comment = lambda t: F.when(t.contains("<!--"), F.lit("<!--")).otherwise(F.lit(""))
    guarded = lambda t: F.concat(F.translate(F.substring_index(t, "<!--", 1), "<", HELD), open_comment(t))
    safe = lambda x, t: F.concat(x.substr(F.lit(1), F.length(x) - F.length(t)), guarded(t))
    page = lambda x, t: F.when(t.contains("<"), safe(x, t)).otherwise(x)
    return let(c, lambda x: let(let(F.substring_index(x, ">", -1), lambda t: page(x, t)), body))


def _freed(c: Column) -> Column:
    """What was held as it was; unlike ``translate``, which rebuilds every text letter by letter, this looks for the character first."""
    return F.replace(c, F.lit(HELD), F.lit("<"))


#: Stands where a match was; no text has it.
CUT = "\x02"


def _until(c: Column, pattern: str) -> Column:
    """What stands in front of the first match of a pattern; all if there is none."""
    return F.regexp_replace(c, rf"(?is){pattern}.*", "")


def parts(c: Column, pattern: str, until: str | None = None) -> Column:
    """What the matches of a tag pattern separate; each part ends in front of its first match of ``until``.

    ``split`` would compile the pattern for every text, a replacement keeps it; the mark between parts is then split at
    without a pattern. A text that has the mark is split as it is.
    """
    cut = lambda x: F.regexp_replace(x, rf"(?is){until}[^{CUT}]*", "") if until else x
    marked = lambda x: F.split(_freed(cut(F.regexp_replace(x, pattern, CUT))), CUT)
    plainly = lambda p: _until(_freed(p), until) if until else _freed(p)
    return _held(c, lambda x: F.when(x.contains(CUT), F.transform(F.split(x, pattern), plainly)).otherwise(marked(x)))


def _decoded(x: Column) -> Column:
    """A variable's text with its references decoded; most have none."""
    return F.when(x.contains("&"), decode_entities(x)).otherwise(x)


def _nodes(c: Column, pattern: str) -> Column:
    nodes = F.transform(parts(c, pattern), lambda x: strip(_decoded(x)))
    return F.filter(nodes, lambda x: x != "")


def visible_text(html: Column, drop_tags=vocab.BOILERPLATE_TAGS) -> Column:
    """Text nodes outside the dropped elements, each stripped, joined by one space."""
    return F.array_join(_nodes(html, text_break(drop_tags)), " ")


def line_text(html: Column, drop_tags=("script", "style")) -> Column:
    """Text outside scripts and styles, split into lines, stripped, without blank lines, joined by one space."""
    text = decode_entities(F.array_join(parts(html, text_break(drop_tags)), ""))
    lines = F.transform(F.split(text, LINE_BREAK), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def page_text(html: Column) -> Column:
    """Text nodes outside scripts and styles, joined as they are."""
    return decode_entities(F.array_join(parts(html, text_break(("script", "style"))), ""))


def inner_text(fragment: Column) -> Column:
    """Text nodes of a fragment, each stripped, joined without a separator."""
    split = lambda x: F.array_join(_nodes(x, f"(?is)(?=<)(?:{TAG})"), "")
    return let(fragment, lambda x: F.when(x.contains("<"), split(x)).otherwise(strip(_decoded(x))))


def markup(html: Column) -> Column:
    """The page without comments and without the contents of scripts and styles."""
    return _held(html, lambda x: _freed(F.regexp_replace(x, HIDDEN, "$1$2")))


def attribute(attrs: Column, name: str) -> Column:
    """Value of an attribute in the text of a tag; NULL when the tag does not carry it."""
    pattern = rf"""(?is)(?:^|\s){name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    bare = lambda v: F.when(v.rlike("""^["']"""), v.substr(F.lit(2), F.length(v) - 2)).otherwise(v)
    return let(F.regexp_extract(attrs, pattern, 1), lambda v: F.when(v != "", decode_entities(bare(v), in_attribute=True)))


def class_text(m: Column) -> Column:
    """All class attributes of a page's markup, one per line."""
    return F.array_join(F.regexp_extract_all(m, F.lit(CLASS_ATTR), F.lit(1)), "\n")


def script_text(html: Column) -> Column:
    """Contents of all scripts, lower-cased, one per line."""
    pattern = rf"(?is)(?=<)(?:{COMMENT}|<script(?:[\s/][^>]*)?>(.*?)(?:</script\s*>|\z))"
    return _held(html, lambda x: F.lower(F.array_join(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), "\n")))


def opening(tag: str) -> str:
    return rf"(?i)<{tag}(?:[\s/][^>]*)?>"


def pieces(c: Column, pattern: str, until: str | None = None) -> Column:
    """What follows each match of a tag pattern, up to the next one or to ``until``."""
    return rest(parts(c, pattern, until))


#: A whole tag. What a page's features look for are tags of an array that one scan of the page gives.
ANY_TAG = r"</?[A-Za-z][^>]*>"


def tags(m: Column) -> Column:
    """All tags of a page's markup in document order."""
    return _held(m, lambda x: F.regexp_extract_all(x, F.lit(ANY_TAG), F.lit(0)))


def is_tag(t: Column, name: str) -> Column:
    """Whether a tag opens an element, or with ``/`` in front of the name closes it."""
    return t.rlike(rf"(?i)^<{name}[\s/>]")


def rest(c: Column) -> Column:
    """An array without its first element."""
    return F.slice(c, 2, 2**30)


def links(m: Column) -> Column:
    """All ``a[href]`` of a page's markup in document order as array<struct<href, text, css>>."""

    def link(p):
        body = F.regexp_extract(p, r"(?is)^[^>]*>(.*?)(?:</a\s*>|\z)", 1)
        attrs = F.concat(F.lit(" "), F.substring_index(p, ">", 1))
        fields = lambda a: F.struct(
            attribute(a, "href").alias("href"),
            inner_text(body).alias("text"),
            F.coalesce(attribute(a, "class"), F.lit("")).alias("css"),
        )
        return let(attrs, fields)

    opened = F.filter(pieces(m, r"(?i)<a\s"), lambda p: p.contains(">"))
    return F.filter(F.transform(opened, link), lambda e: e.href.isNotNull())


def website_type(css: Column) -> Column:
    """Publishing system of a page, from its class attributes."""
    of = lambda x, low: (
        F.when(x.contains("gov-"), "gov.uk")
        .when(low.contains("wordpress"), "wordpress")
        .when(low.contains("drupal"), "drupal")
        .when(contains_any(low, vocab.OTHER_CMS_WORDS), "other_cms")
        .otherwise("custom")
    )
    return let(css, lambda x: let(F.lower(x), lambda low: of(x, low)))


def has_search(m: Column) -> Column:
    """A form, input or button with a search class, a search input, or a placeholder that mentions search."""
    css = r"""(?i)^<(?:form|input|button)\s(?:[^<>]*?\s)?class\s*=\s*(?:"[^"]*search|'[^']*search|[^\s>"']*search)"""
    kind = r"""(?i:^<input\s(?:[^<>]*?\s)?type\s*=\s*)(?:"search"|'search'|search[\s/>])"""
    hint = r"""(?i)^<input\s(?:[^<>]*?\s)?placeholder\s*=\s*(?:"[^"]*search|'[^']*search|[^\s>"']*search)"""
    found = lambda x: F.exists(tags(x), lambda t: t.rlike(css) | t.rlike(kind) | t.rlike(hint))
    return let(m, lambda x: F.when(F.lower(x).contains("search"), found(x)).otherwise(F.lit(False)))


def has_pagination(css: Column, html: Column) -> Column:
    """A pagination class, or a text that counts or turns pages."""
    return contains_any(F.lower(css), vocab.PAGINATION_CLASS_WORDS) | contains_any(
        F.lower(page_text(html)), vocab.PAGINATION_TEXTS
    )


def needs_javascript(css: Column, html: Column) -> Column:
    """A script that names a page framework, or a class for content that is loaded later."""
    return contains_any(F.lower(css), vocab.DYNAMIC_CLASS_WORDS) | contains_any(
        script_text(html), vocab.SPA_FRAMEWORKS
    )


def has_next_link(m: Column) -> Column:
    """A link that says Next or has a next class, or an input whose value is Next."""
    button = r"""(?i:<input\s(?:[^<>]*?\s)?value\s*=\s*)(?:"Next"|'Next'|Next[\s/>])"""
    return m.rlike(button) | F.exists(links(m), lambda e: e.text.contains("Next") | e.css.contains("next"))


#: Marks between texts, which no text has: a form opens, it closes, one can submit.
FORM_OPENS, FORM_CLOSES, SUBMITS = "\ufdd0", "\ufdd1", "\ufdd2"
SUBMIT_TAG = r"""(?i)^<(?:input|button)\s(?:[^<>]*?\s)?type\s*=\s*["']?submit|^<button\s(?:[^<>]*?\s)?class\s*=\s*(?:"[^"]*search|'[^']*search|[^\s>"']*search)"""


def has_search_form(m: Column, words=vocab.SEARCH_FORM_WORDS) -> Column:
    """A form whose text mentions a search word and that has a submit control.

    The page's texts are joined with a mark for each tag that matters, so a form is what stands between two marks.
    """
    mark = lambda t: F.when(is_tag(t, "form"), FORM_OPENS).when(is_tag(t, "/form"), FORM_CLOSES).when(t.rlike(SUBMIT_TAG), SUBMITS).otherwise("")
    texts = lambda found: F.transform(parts(m, ANY_TAG), lambda p, i: F.concat(F.when(i > 0, mark(F.get(found, i - 1))).otherwise(""), strip(decode_entities(p))))
    marked = let(tags(m), lambda found: F.array_join(texts(found), ""))
    forms = lambda x: F.transform(rest(F.split(x, FORM_OPENS)), lambda f: F.substring_index(f, FORM_CLOSES, 1))
    usable = lambda f: f.contains(SUBMITS) & contains_any(F.lower(f), words)
    return let(m, lambda x: F.when(F.lower(x).contains("<form"), F.exists(forms(marked), usable)).otherwise(F.lit(False)))


def flat_tables(m: Column, wanted=None) -> Column:
    """Tables of a page's markup without inner tables as array<struct<headers, rows>>; a row is an array of cell texts.

    With a test ``wanted`` of headers, only tables that pass it have rows; those of others are NULL and their cells not read.
    """

    def cells(row):
        return F.transform(pieces(row, r"(?i)<t[dh](?:\s[^>]*)?>", r"</t[dhr]\s*>"), inner_text)

    def table(p):
        first = lambda rows: F.coalesce(F.get(F.transform(F.slice(rows, 1, 1), cells), F.lit(0)), F.array().cast("array<string>"))
        below = lambda rows, headers: F.when(wanted(headers) if wanted else F.lit(True), F.transform(rest(rows), cells))
        fields = lambda rows: let(F.transform(first(rows), F.lower), lambda headers: F.struct(headers.alias("headers"), below(rows, headers).alias("rows")))
        return let(pieces(p, r"(?i)<tr(?:\s[^>]*)?>"), fields)

    return F.transform(pieces(m, opening("table"), r"</table\s*>"), table)


def has_nested_table(m: Column) -> Column:
    """True when a table opens before the previous one is closed."""
    open_before = lambda tables: F.exists(
        F.slice(tables, F.lit(1), F.greatest(F.size(tables) - 1, F.lit(0))), lambda p: ~p.contains("</table")
    )
    # In lower-case letters the pattern begins with a fixed text, which is found faster.
    found = lambda low: let(pieces(low, opening("table").removeprefix("(?i)")), open_before)
    return let(F.lower(m), lambda low: F.when(low.contains("<table"), found(low)).otherwise(F.lit(False)))
