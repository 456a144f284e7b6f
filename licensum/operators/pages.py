"""Features and licence data of crawled pages, ``pages(page_id, url, html)``."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from licensum import vocab
from licensum.functions import html as H
from licensum.functions import text, tree, urls
from licensum.operators.clean import evaluated



def readable_pages(pages: DataFrame) -> DataFrame:
    """Pages that were answered with status 200; a table without a status column is taken whole."""
    return pages.filter("status = 200") if "status" in pages.columns else pages


def visible_text(pages: DataFrame, *, drop_tags=vocab.BOILERPLATE_TAGS) -> DataFrame:
    return pages.select("page_id", H.visible_text(F.col("html"), drop_tags).alias("text"))


def line_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", H.line_text(F.col("html")).alias("text"))


def main_content(pages: DataFrame, *, selectors=vocab.MAIN_SELECTORS) -> DataFrame:
    return pages.select("page_id", tree.main_text_column(F.col("html"), selectors).alias("text"))


def licence_content_flag(pages: DataFrame, *, phrases=vocab.LICENCE_CONTENT_PHRASES) -> DataFrame:
    return pages.select("page_id", text.contains_any(F.lower("html"), phrases).alias("has_licence_content"))


def _found(c: Column, words) -> Column:
    return F.filter(F.array(*[F.when(c.contains(w), F.lit(w)) for w in words]), lambda x: x.isNotNull())


def keyword_diagnostics(texts: DataFrame, *, words=vocab.DIAGNOSTIC_WORDS, phrases=vocab.DIAGNOSTIC_PHRASES) -> DataFrame:
    """Length, one flag per word and the phrases found, of ``texts(page_id, text)``."""
    low = F.lower("text")
    flags = [low.contains(w).alias("has_" + w.replace(" ", "_")) for w in words]
    return texts.select("page_id", F.length("text").alias("n_chars"), *flags, _found(low, phrases).alias("phrases"))


def data_indicators(texts: DataFrame, *, words=vocab.DATA_INDICATORS, min_length=500, min_found=2) -> DataFrame:
    """Indicators found in ``texts(page_id, text)`` and whether the page seems to hold licence data."""
    found = _found(F.lower("text"), words)
    return texts.select(
        "page_id",
        found.alias("indicators"),
        ((F.length("text") > min_length) & (F.size(found) >= min_found)).alias("has_data"),
    )


def with_markup(pages: DataFrame, *keep: str) -> DataFrame:
    """The named columns and ``m``, the page without comments, script and style contents, made once per page."""
    kept = [c for c in keep if c in pages.columns]
    return pages.select(*kept, H.markup(F.col("html")).alias("m"))


def unnest(df: DataFrame, array: Column, *names: str) -> DataFrame:
    """All other columns with position and element of an array, one row per element.

    The outer generator and a filter behind it, because a plain one makes Spark test the size of the array in front
    of it and so compute a derived array twice.
    """
    return df.select("*", F.posexplode_outer(array).alias(*names)).filter(F.col(names[0]).isNotNull())


def page_links(pages: DataFrame) -> DataFrame:
    """All links in document order."""
    rows = unnest(with_markup(pages, "page_id", "url"), H.links(F.col("m")), "pos", "link")
    return rows.select("page_id", "url", "pos", "link.href", "link.text")


def candidate_links(pages: DataFrame, *, words=vocab.LICENCE_LINK_WORDS, limit: int | None = None) -> DataFrame:
    """Resolved addresses of licence-related links: distinct, in first-seen order; ``limit`` keeps the first ones of a page."""
    found = candidate_urls(F.col("url"), F.col("m"), words, limit)
    return unnest(with_markup(pages, "page_id", "url"), found, "rank", "target_url").drop("url", "m")


def candidate_urls(base: Column, m: Column, words=vocab.LICENCE_LINK_WORDS, limit: int | None = None) -> Column:
    """As :func:`candidate_links`, as one array per page. A page's links never leave its row."""
    hits = F.filter(H.links(m), lambda e: text.contains_any(F.lower(F.concat(e.text, F.lit("\n"), e.href)), words))
    found = F.array_distinct(F.transform(hits, lambda e: urls.resolve_url(base, e.href)))
    return F.slice(found, 1, limit) if limit else found


def licence_link_listing(pages: DataFrame, *, words=vocab.LISTING_LINK_WORDS, top: int = 5, width: int = 50) -> DataFrame:
    """Number of licence-related links per page and the first ``top`` of them."""
    hits = F.filter(
        H.links(F.col("m")), lambda e: text.contains_any(F.lower(F.concat(e.href, F.lit(" "), e.text)), words)
    )
    cut = lambda e: F.struct(F.substring(e.text, 1, width).alias("text"), e.href.alias("href"))
    listed = lambda found: F.struct(
        F.size(found).alias("n_links"), F.transform(F.slice(found, 1, top), cut).alias("shown")
    )
    return with_markup(pages, "page_id").select("page_id", text.let(hits, listed).alias("l")).select("page_id", "l.*")


def _link_score(combined: Column) -> Column:
    has = combined.contains
    points = [
        (has("register"), 3),
        (has("search"), 2),
        (has("database"), 3),
        (has("view") & (has("licence") | has("application")), 2),
        (has("premises licence"), 4),
        (has("alcohol"), 1),
    ]
    return reduce(lambda a, p: a + F.when(p[0], p[1]).otherwise(0), points, F.lit(0))


def scored_links(pages: DataFrame, *, min_score: int = 2, top: int = 5) -> DataFrame:
    """The ``top`` most promising links per page: highest score, then document order.

    Links are ranked inside their page's row, so no shuffle is needed.
    """
    scored = F.transform(
        H.links(F.col("m")),
        lambda e, i: F.struct(
            (-text.let(F.lower(F.concat(e.href, F.lit(" "), e.text)), _link_score)).alias("order"),
            i.alias("pos"),
            F.substring(F.lower(e.text), 1, 80).alias("text"),
            e.href.alias("href"),
        ),
    )
    best = F.slice(F.array_sort(F.filter(scored, lambda e: e.order <= -min_score)), 1, top)
    rows = unnest(with_markup(pages, "page_id", "url"), best, "rank", "link")
    return rows.select(
        "page_id",
        (F.col("rank") + 1).alias("rank"),
        (-F.col("link.order")).alias("score"),
        "link.text",
        urls.resolve_url(F.col("url"), F.col("link.href")).alias("target_url"),
    )


#: One letter for each tag that structure counts look at; a page's structure is the text of these letters.
_LETTERS = {"form": "F", "/form": "f", "input": "I", "select": "S", "table": "T", "/table": "t", "tr": "R"}


def structure_counts(pages: DataFrame) -> DataFrame:
    """Forms, inputs and selects of each form, tables, rows of each table, divisions with a class."""

    def letter(t):
        out = None
        for name, code in _LETTERS.items():
            out = F.when(H.is_tag(t, name), code) if out is None else out.when(H.is_tag(t, name), code)
        return out.otherwise("")

    def counts(found):
        shape = F.array_join(F.transform(found, letter), "")
        inside = lambda x, opens, closes: F.transform(H.rest(F.split(x, opens)), lambda p: F.substring_index(p, closes, 1))
        number = lambda of, code: F.transform(of, lambda p: F.length(p) - F.length(F.replace(p, F.lit(code), F.lit(""))))
        fields = lambda x: F.struct(
            F.size(inside(x, "F", "f")).alias("n_forms"),
            number(inside(x, "F", "f"), "I").alias("form_inputs"),
            number(inside(x, "F", "f"), "S").alias("form_selects"),
            F.size(inside(x, "T", "t")).alias("n_tables"),
            number(inside(x, "T", "t"), "R").alias("table_rows"),
            F.size(F.filter(found, lambda t: t.rlike(r"(?i)^<div\s(?:[^>]*?\s)?class\s*="))).alias("n_class_divs"),
        )
        return text.let(shape, fields)

    return with_markup(pages, "page_id").select("page_id", text.let(H.tags(F.col("m")), counts).alias("s")).select("page_id", "s.*")


def page_analysis(pages: DataFrame, *, navigation: bool = True, link_limit: int | None = None, menus: int | None = None, links_per_menu: int | None = None) -> DataFrame:
    """The analysis row of a page. Structure features are only given when a licence register was found.

    ``navigation=False`` leaves out the menus, the only part that needs the element tree.
    """
    h, m, css = F.col("html"), F.col("m"), F.col("css")
    found = text.contains_any(F.lower(h), vocab.LICENCE_CONTENT_PHRASES)
    if "status" in pages.columns:
        found = F.coalesce(F.col("status") == 200, F.lit(False)) | found
    when = lambda c: F.when(F.col("licence_register_found"), c)
    flag = lambda c: F.coalesce(when(c), F.lit(False))
    keep = [c for c in ("council_name", "page_id", "url") if c in pages.columns]
    # Markup and class attributes are made once and read by all features.
    staged = pages.select(*keep, "html", F.coalesce(found, F.lit(False)).alias("licence_register_found"))
    staged = staged.withColumn("m", when(H.markup(h))).withColumn("css", H.class_text(m))
    return staged.select(
        *keep,
        "licence_register_found",
        F.coalesce(candidate_urls(F.col("url"), m, limit=link_limit), F.array().cast("array<string>")).alias("potential_licence_urls"),
        when(H.website_type(css)).alias("website_type"),
        flag(H.has_search(m)).alias("search_functionality"),
        flag(H.has_pagination(css, h)).alias("pagination_detected"),
        flag(H.needs_javascript(css, h)).alias("javascript_required"),
        *([tree.navigation_column(when(h), menus=menus, links_per_menu=links_per_menu).alias("navigation_structure")] if navigation else []),
    )


def page_features(pages: DataFrame) -> DataFrame:
    """Site type, search, pagination and script need of every page, whether or not a register was found."""
    h, m, css = F.col("html"), F.col("m"), F.col("css")
    staged = with_markup(pages, "page_id", "html").withColumn("css", H.class_text(m))
    return staged.select(
        "page_id",
        css.alias("classes"),
        H.website_type(css).alias("website_type"),
        H.has_search(m).alias("has_search"),
        H.has_pagination(css, h).alias("has_pagination"),
        H.needs_javascript(css, h).alias("needs_javascript"),
    )


def navigation(pages: DataFrame, *, menus: int | None = None, links_per_menu: int | None = None) -> DataFrame:
    return pages.select("page_id", tree.navigation_column(F.col("html"), menus=menus, links_per_menu=links_per_menu).alias("navigation_structure"))


def _with_rows(pages: DataFrame, header_words, max_rows, min_cells) -> DataFrame:
    """Pages with the rows of their register tables: ``rows``, and ``layout`` for those of nested tables.

    Pages whose tables are nested go through the element tree, all others through native expressions. A row of the
    former names its cells and header by their rows in ``layout``; ``row_texts`` makes texts of them.
    """
    keep = [c for c in ("council_name", "page_id", "url", "html") if c in pages.columns]
    staged = with_markup(pages, *keep).withColumn("nested", H.has_nested_table(F.col("m")))
    staged = staged.select(
        *keep,
        tree.tables_column(F.when(F.col("nested"), F.col("m")), header_words).alias("layout"),
        F.when(~F.col("nested"), F.col("m")).alias("flat"),
    )
    first = lambda rows: F.slice(rows, 1, max_rows) if max_rows else rows

    def flat_rows(t, no):
        row = lambda cells, i: F.struct(
            no.alias("table_no"), i.alias("row_no"), t.headers.alias("headers"), cells.alias("cells"),
            F.lit(None).cast("int").alias("header_row"), F.lit(None).cast("int").alias("row"),
        )
        return F.when(t.rows.isNotNull(), F.filter(F.transform(first(t.rows), row), lambda r: F.size(r.cells) >= min_cells))

    def nested_rows(t):
        none = F.lit(None).cast("array<string>")
        row = lambda i: F.struct(t.no.alias("table_no"), (i - t.a - 1).alias("row_no"), none.alias("headers"), none.alias("cells"), t.a.alias("header_row"), i.alias("row"))
        numbers = F.when(t.b - t.a > 1, F.sequence(t.a + 1, t.b - 1)).otherwise(F.array().cast("array<int>"))
        size = lambda i: text.let(F.get("layout.rows", i), lambda span: span.b - span.a)
        return F.transform(F.filter(first(numbers), lambda i: size(i) >= min_cells), row)

    wanted = lambda headers: text.contains_any(F.array_join(headers, " "), header_words)
    flat = F.filter(F.transform(H.flat_tables(F.col("flat"), wanted), flat_rows), lambda t: t.isNotNull())
    return staged.select(*keep, F.flatten(F.coalesce(F.transform("layout.tables", nested_rows), flat)).alias("rows"), "layout")


def row_texts(r: Column, layout: Column) -> tuple[Column, Column]:
    """Header and cell texts of a row."""

    def of(number):
        cells = lambda span: F.slice(layout["cells"], span["a"] + 1, span["b"] - span["a"])
        return F.transform(text.let(F.get(layout["rows"], number), cells), lambda c: tree.joined(layout["texts"], c, ""))

    return F.coalesce(r["headers"], F.transform(of(r["header_row"]), F.lower)), F.coalesce(r["cells"], of(r["row"]))


def table_rows(pages: DataFrame, *, header_words=vocab.TABLE_HEADER_WORDS, max_rows: int | None = None, min_cells: int = 3) -> DataFrame:
    """Rows of register tables: header texts and cell texts of every row with at least ``min_cells`` cells.

    A table counts when its header mentions a licence word. ``max_rows`` limits the rows read per table. Rows of inner
    tables are rows of the outer ones as well; their texts are made row by row.
    """
    return rows_of_items(_with_rows(pages, header_words, max_rows, min_cells))


def rows_of_items(items: DataFrame) -> DataFrame:
    """One line per table row of pages with ``rows`` and ``layout``."""
    keep = [c for c in ("council_name", "page_id", "url") if c in items.columns]
    found = unnest(items.select(*keep, "rows", "layout"), F.col("rows"), "_", "r")
    headers, cells = row_texts(F.col("r"), F.col("layout"))
    return found.select(*keep, "r.table_no", "r.row_no", headers.alias("headers"), cells.alias("cells"))


def page_items(pages: DataFrame, *, header_words=vocab.TABLE_HEADER_WORDS, max_rows: int | None = None, card_words=vocab.CARD_CLASS_WORDS, text_limit: int | None = None) -> DataFrame:
    """What every page offers, in one pass and without a shuffle.

    ``rows`` (and ``layout``) of its register tables; only when none of them holds a licence, its ``cards`` and its visible
    ``text``, whole unless a ``text_limit`` is given for a reader with a limit. ``step`` names the first that there is.
    """
    keep = [c for c in ("council_name", "page_id", "url") if c in pages.columns]
    h = F.col("html")
    usable = F.exists("rows", lambda r: text.let(row_record(*row_texts(r, F.col("layout"))), _is_licence))
    staged = _with_rows(pages, header_words, max_rows, 3).withColumn("usable", F.coalesce(usable, F.lit(False)))
    wanted = F.when(~F.col("usable") & text.contains_any(F.lower(h), card_words), h)
    staged = evaluated(evaluated(staged).withColumn("cards", tree.cards_column(wanted, card_words)))
    step = F.when(F.col("usable"), "table").when(text.filled(F.col("cards.cards")), "card").otherwise("text")
    visible = F.when(~F.col("usable"), H.visible_text(h))
    return staged.select(
        *keep, step.alias("step"), *(F.when(F.col("usable"), F.col(c)).alias(c) for c in ("rows", "layout")), F.when(step == "card", F.col("cards")).alias("cards"),
        (text.let(visible, lambda x: text.truncate(x, text_limit)) if text_limit else visible).alias("text"),
    )


def card_texts(pages: DataFrame, *, words=vocab.CARD_CLASS_WORDS, containers: int | None = None, items: int | None = None) -> DataFrame:
    """Substantial texts of list items and cards, each once, with its innermost box and its number there.

    Pages without any of the words skip the element tree. Boxes lie in each other; ``card_boxes`` gives those around a box.
    """
    return cards_of_items(_with_cards(pages, words, containers, items))


def _with_cards(pages, words, containers=None, items=None) -> DataFrame:
    h = F.col("html")
    keep = [c for c in ("council_name", "page_id", "url") if c in pages.columns]
    wanted = F.when(text.contains_any(F.lower(h), words), h)
    return pages.select(*keep, tree.cards_column(wanted, words, containers=containers, items=items).alias("cards"))


def cards_of_items(items: DataFrame) -> DataFrame:
    """One line per card of pages with ``cards``; ``card`` numbers them in their page."""
    keep = [c for c in ("council_name", "page_id", "url") if c in items.columns]
    found = unnest(items.select(*keep, "cards"), F.col("cards.cards"), "card", "c")
    return found.select(*keep, "card", "c.container", "c.item", tree.joined(F.col("cards.texts"), F.col("c"), " ").alias("text"))


def card_boxes(pages: DataFrame, *, words=vocab.CARD_CLASS_WORDS) -> DataFrame:
    """The boxes of every page: (page_id, container, parent, items), the box around each and the number of its first item among all."""
    found = unnest(_with_cards(pages, words).select("page_id", "cards.boxes"), F.col("boxes"), "container", "b")
    return found.select("page_id", "container", "b.parent", "b.items")


def row_record(headers: Column, cells: Column) -> Column:
    """Header -> cell; on repeated headers the last cell wins."""
    n = F.least(F.size(headers), F.size(cells))
    pairs = F.zip_with(F.slice(headers, F.lit(1), n), F.slice(cells, F.lit(1), n), lambda k, v: F.struct(k.alias("k"), v.alias("v")))

    def last_wins(entries):
        last = lambda k: F.element_at(F.filter(entries, lambda p: p["k"] == k), -1)["v"]
        return text.let(
            F.array_distinct(F.transform(entries, lambda p: p["k"])),
            lambda keys: F.map_from_arrays(keys, F.transform(keys, last)),
        )

    return text.let(pairs, last_wins)


def _pick(record: Column, names) -> Column:
    """First of the named entries that is there and not empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(record, F.lit(n)), F.lit("")) for n in names])


def _is_licence(record: Column) -> Column:
    synonyms = dict(vocab.TABLE_COLUMN_SYNONYMS)
    return _pick(record, synonyms["premises_name"]).isNotNull() & _pick(record, synonyms["premises_address"]).isNotNull()


def licences_of_rows(rows: DataFrame, *, synonyms=vocab.TABLE_COLUMN_SYNONYMS) -> DataFrame:
    """Licence columns of table rows, found by their header; rows without a name or an address are left out."""
    keep = [c for c in ("council_name", "page_id", "url", "table_no", "row_no") if c in rows.columns]
    record = rows.select(*keep, row_record(F.col("headers"), F.col("cells")).alias("r"), F.array_join("cells", " | ").alias("raw_data"))
    value = {column: _pick(F.col("r"), names) for column, names in synonyms}
    dates = ("application_date", "granted_date")
    value.update({c: text.parse_date(value[c]) for c in dates if c in value})
    value["licence_type"] = text.map_licence_type(value["licence_type"])
    value["licence_status"] = text.map_licence_status(value["licence_status"])
    value["licensable_activities"] = F.coalesce(
        F.split(value["licensable_activities"], r"\s*[,;]\s*"), F.array().cast("array<string>")
    )
    out = record.select(*keep, "raw_data", *[c.alias(name) for name, c in value.items()])
    return evaluated(out).filter(text.truthy(F.col("premises_name")) & text.truthy(F.col("premises_address")))


def page_flags(pages: DataFrame) -> DataFrame:
    """Next-page link and usable search form of every page."""
    m = F.col("m")
    return with_markup(pages, "page_id").select(
        "page_id", H.has_next_link(m).alias("has_next"), H.has_search_form(m).alias("has_search_form")
    )


def linked_pages(sources: DataFrame, targets: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Join each source's candidate addresses, or the first ``limit`` of them, to the pages they lead to.

    ``sources(..., potential_licence_urls)``; ``targets(url, ...)`` should hold extracted rows, not raw html, so a
    page that many sources link to is read once.
    """
    edges = sources.select(
        *[c for c in sources.columns if c != "potential_licence_urls"],
        F.posexplode(F.slice("potential_licence_urls", 1, limit) if limit else F.col("potential_licence_urls")).alias("rank", "target_url"),
    ).withColumn("_key", urls.normalize_url(F.col("target_url")))
    found = targets.withColumn("_key", urls.normalize_url(F.col("url"))).drop("url")
    return edges.join(found, "_key").drop("_key")
