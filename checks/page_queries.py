"""Page features, table and card extraction, and the jobs on pages."""

from pyspark.sql import functions as F

from checks import sql as Q
from checks.registry import query
from checks.tables import CARD_ONE, CARD_PAGES, CARD_TWO, COUNCILS, REGISTER_PAGES, duck
from licensum import vocab
from licensum.functions import text
from licensum.operators import councils as C
from licensum.operators import pages as P
from licensum.plans import discovery, extraction
from licensum.session import kept

F3 = f"WITH register_pages AS ({duck(REGISTER_PAGES)})"
F5 = f"WITH card_pages AS ({duck(CARD_PAGES)})"
join = lambda c, sep=";": F.array_join(c, sep)


@query("s13_readable_pages", "SELECT page_id, url, length(html) AS n_chars FROM pages")
def _(t):
    return P.readable_pages(t.table("pages")).select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


@query("h1_visible_text", f"SELECT page_id, {Q.visible('html')} AS text FROM pages")
def _(t):
    return P.visible_text(t.table("pages"))


@query("h1_line_text", f"SELECT page_id, {Q.line_text('html')} AS text FROM pages")
def _(t):
    return P.line_text(t.table("pages"))


@query("h1_visible_text_registers", f"{F3} SELECT page_id, {Q.visible('html')} AS text FROM register_pages")
def _(t):
    return P.visible_text(t.register_pages)


_CARD_MAIN = f"'Register ' || o_custkey || ' ' || {CARD_ONE} || ' ' || {CARD_TWO}"


@query(
    "h2_main_content",
    f"""SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 4 = 3 THEN 'Home Licensing News no target ' ELSE '' END || {_CARD_MAIN} AS text FROM orders""",
)
def _(t):
    return P.main_content(t.card_pages)


@query("h2_main_content_articles", f"""SELECT page_id, {Q.visible("regexp_extract(html, '(?is)<article>(.*)</article>', 1)")} AS text FROM pages""")
def _(t):
    return P.main_content(t.table("pages"))


@query(
    "h3_truncate",
    """SELECT doc_id, CASE WHEN length(text) > 8000 THEN left(text, 8000) || '...' ELSE text END AS marked, left(text, 4000) AS cut FROM documents""",
)
def _(t):
    c = F.col("text")
    return t.table("documents").select("doc_id", text.truncate(c, 8000).alias("marked"), text.truncate(c, 4000, "").alias("cut"))


@query("h4_licence_content", f"{F3} SELECT page_id, {Q.any_of('lower(html)', vocab.LICENCE_CONTENT_PHRASES)} AS has_licence_content FROM register_pages")
def _(t):
    return P.licence_content_flag(t.register_pages)


_WORDS = ", ".join(f"contains(lower(text), '{w}') AS has_{w.replace(' ', '_')}" for w in vocab.DIAGNOSTIC_WORDS)


@query(
    "h4b_keyword_diagnostics",
    f"{F3} SELECT page_id, CAST(length(text) AS INTEGER) AS n_chars, {_WORDS}, array_to_string({Q.found('lower(text)', vocab.DIAGNOSTIC_PHRASES)}, ';') AS phrases FROM (SELECT page_id, {Q.line_text('html')} AS text FROM register_pages)",
)
def _(t):
    out = P.keyword_diagnostics(P.line_text(t.register_pages))
    return out.withColumn("phrases", join("phrases"))


@query(
    "h4c_data_indicators",
    f"SELECT page_id, array_to_string(ind, ';') AS indicators, length(text) > 500 AND len(ind) >= 2 AS has_data FROM (SELECT page_id, text, {Q.found('lower(text)', vocab.DATA_INDICATORS)} AS ind FROM (SELECT page_id, {Q.line_text('html')} AS text FROM pages))",
)
def _(t):
    return P.data_indicators(P.line_text(t.table("pages"))).withColumn("indicators", join("indicators"))


@query(
    "h4c_data_indicators_short",
    f"{F3} SELECT page_id, array_to_string(ind, ';') AS indicators, length(text) > 500 AND len(ind) >= 2 AS has_data FROM (SELECT page_id, text, {Q.found('lower(text)', vocab.DATA_INDICATORS_SHORT)} AS ind FROM (SELECT page_id, {Q.line_text('html')} AS text FROM register_pages))",
)
def _(t):
    out = P.data_indicators(P.line_text(t.register_pages), words=vocab.DATA_INDICATORS_SHORT)
    return out.withColumn("indicators", join("indicators"))


def _site_type(html):
    css = Q.class_text(html)
    cms = Q.any_of(f"lower({css})", vocab.OTHER_CMS_WORDS)
    return f"CASE WHEN contains({css}, 'gov-') THEN 'gov.uk' WHEN contains(lower({css}), 'wordpress') THEN 'wordpress' WHEN contains(lower({css}), 'drupal') THEN 'drupal' WHEN {cms} THEN 'other_cms' ELSE 'custom' END"


@query("h5_website_type", f"{F3} SELECT page_id, {_site_type('html')} AS website_type FROM register_pages")
def _(t):
    return P.page_features(t.register_pages).select("page_id", "website_type")


@query("h5_class_text", f"SELECT page_id, {Q.class_text('html')} AS classes FROM pages")
def _(t):
    return P.page_features(t.table("pages")).select("page_id", "classes")


def _link_rows(table):
    return f"SELECT page_id, url, CAST(i - 1 AS INTEGER) AS pos, l.href AS href, l.text AS text FROM (SELECT page_id, url, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT page_id, url, {Q.links('html')} AS ls FROM {table}))"


@query("h6_page_links", _link_rows("pages"))
def _(t):
    return P.page_links(t.table("pages"))


@query("h6_page_links_registers", f"{F3} {_link_rows('register_pages')}")
def _(t):
    return P.page_links(t.register_pages)


def _candidates(table):
    hit = f"{Q.any_of('lower(l.text)', vocab.LICENCE_LINK_WORDS)} OR {Q.any_of('lower(l.href)', vocab.LICENCE_LINK_WORDS)}"
    resolved = f"list_transform(list_filter({Q.links('html')}, lambda l: {hit}), lambda m: {Q.resolve('url', 'm.href')})"
    return f"SELECT page_id, list_filter(us, lambda u, i: list_position(us, u) = i)[1:10] AS us FROM (SELECT page_id, {resolved} AS us FROM {table})"


@query(
    "h7_candidate_links",
    f"{F3} SELECT page_id, CAST(i - 1 AS INTEGER) AS rank, u AS target_url FROM (SELECT page_id, unnest(us) AS u, generate_subscripts(us, 1) AS i FROM ({_candidates('register_pages')}))",
)
def _(t):
    return P.candidate_links(t.register_pages)


@query("h8_navigation", """SELECT o_orderkey AS page_id, 'News>/n' || (o_orderkey % 9) AS menu, 'Home>/;Licensing>/lic' AS crumbs FROM orders""")
def _(t):
    shown = lambda c: join(F.transform(c, lambda e: F.concat(e.text, F.lit(">"), e.url)))
    nav = P.navigation(t.card_pages)
    return nav.select(
        "page_id", shown("navigation_structure.main_menu_items").alias("menu"), shown("navigation_structure.breadcrumbs").alias("crumbs")
    )


_SEARCH = r"""(regexp_matches(m, '(?i)<(?:form|input|button)\s(?:[^>]*?\s)?class\s*=\s*"[^"]*search') OR regexp_matches(m, '(?i:<input\s(?:[^>]*?\s)?type\s*=\s*)"search"') OR regexp_matches(m, '(?i)<input\s(?:[^>]*?\s)?placeholder\s*=\s*"[^"]*search'))"""
_PAGING = f"({Q.any_of(f'lower({Q.class_text("html")})', vocab.PAGINATION_CLASS_WORDS)} OR {Q.any_of(f'lower({Q.page_text("html")})', vocab.PAGINATION_TEXTS)})"
_SCRIPTED = f"({Q.any_of(Q.script_text('html'), vocab.SPA_FRAMEWORKS)} OR {Q.any_of(f'lower({Q.class_text("html")})', vocab.DYNAMIC_CLASS_WORDS)})"


@query("h9_has_search", f"{F3} SELECT page_id, {_SEARCH} AS has_search FROM (SELECT page_id, {Q.markup('html')} AS m FROM register_pages)")
def _(t):
    return P.page_features(t.register_pages).select("page_id", "has_search")


@query("h10_has_pagination", f"{F3} SELECT page_id, {_PAGING} AS has_pagination FROM register_pages")
def _(t):
    return P.page_features(t.register_pages).select("page_id", "has_pagination")


@query("h11_needs_javascript", f"{F3} SELECT page_id, {_SCRIPTED} AS needs_javascript FROM register_pages")
def _(t):
    return P.page_features(t.register_pages).select("page_id", "needs_javascript")


@query("h11_needs_javascript_pages", f"SELECT page_id, {_SCRIPTED} AS needs_javascript FROM pages")
def _(t):
    return P.page_features(t.table("pages")).select("page_id", "needs_javascript")


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'Granted' WHEN 'O' THEN 'Application pending' ELSE 'Under review' END"
_TABLE = r"string_split_regex(m, '(?i)<table>')[2:]"
_CELLS = rf"list_transform(string_split_regex(r, '(?i)<t[dh]>')[2:], lambda c: {Q.inner("regexp_extract(c, '(?is)^(.*?)(?:</t[dhr]>)', 1)")})"
_ROWS = rf"list_transform(string_split_regex(split_part(t, '</table>', 1), '(?i)<tr>')[2:], lambda r: {_CELLS})"


@query(
    "h12_table_rows",
    f"""{F3} SELECT page_id, CAST(tn - 1 AS INTEGER) AS table_no, CAST(rn - 1 AS INTEGER) AS row_no, array_to_string(list_transform(hd, lambda h: lower(h)), ';') AS headers, array_to_string(cells, ';') AS cells FROM (
  SELECT page_id, tn, rows[1] AS hd, unnest(rows[2:51]) AS cells, generate_subscripts(rows[2:51], 1) AS rn FROM (
    SELECT page_id, unnest(tables) AS rows, generate_subscripts(tables, 1) AS tn FROM (
      SELECT page_id, list_transform({_TABLE}, lambda t: {_ROWS}) AS tables FROM (SELECT page_id, {Q.markup('html')} AS m FROM register_pages)))
  WHERE {Q.any_of("array_to_string(list_transform(rows[1], lambda h: lower(h)), ' ')", vocab.TABLE_HEADER_WORDS)}) WHERE len(cells) >= 3""",
)
def _(t):
    rows = P.table_rows(t.register_pages)
    return rows.select("page_id", "table_no", "row_no", join("headers").alias("headers"), join("cells").alias("cells"))


# Every result item is also a container of its own, without inner items.
@query(
    "h13_card_texts",
    f"""SELECT page_id, 0 AS container, item, text FROM (SELECT o_orderkey AS page_id, 0 AS item, {CARD_ONE} AS text FROM orders
UNION ALL SELECT o_orderkey, 1, {CARD_TWO} FROM orders) WHERE length(text) > 50""",
)
def _(t):
    return P.card_texts(t.card_pages).select("page_id", "container", "item", "text")


def _score(x):
    has = lambda w: f"contains({x}, '{w}')"
    parts = [(has("register"), 3), (has("search"), 2), (has("database"), 3), (f"{has('view')} AND ({has('licence')} OR {has('application')})", 2), (has("premises licence"), 4), (has("alcohol"), 1)]
    return " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in parts)


@query(
    "h14_scored_links",
    f"""{F3} SELECT page_id, rank, CAST(score AS INTEGER) AS score, left(lower(text), 80) AS text, {Q.resolve('url', 'href')} AS target_url FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS INTEGER) AS rank FROM (
    SELECT *, {_score("lower(href || ' ' || text)")} AS score FROM ({_link_rows('register_pages')})) WHERE score >= 2) WHERE rank <= 5""",
)
def _(t):
    return P.scored_links(t.register_pages)


_FORMS = r"list_transform(string_split_regex(m, '(?i)<form(?:[\s/][^>]*)?>')[2:], lambda f: split_part(f, '</form', 1))"
_TABLE_ROWS = r"list_transform(string_split_regex(m, '(?i)<table(?:[\s/][^>]*)?>')[2:], lambda t: CAST(len(regexp_extract_all(split_part(t, '</table', 1), '(?i)<tr(?:[\s/][^>]*)?>')) AS VARCHAR))"


def _structure(table):
    inputs = lambda tag: f"array_to_string(list_transform({_FORMS}, lambda f: CAST({Q.count('f', Q.opening(tag))} AS VARCHAR)), ';')"
    return f"""SELECT page_id, CAST(len({_FORMS}) AS INTEGER) AS n_forms, {inputs('input')} AS form_inputs, {inputs('select')} AS form_selects,
  CAST({Q.count('m', Q.opening('table'))} AS INTEGER) AS n_tables, array_to_string({_TABLE_ROWS}, ';') AS table_rows,
  CAST({Q.count('m', '(?i)<div' + chr(92) + 's(?:[^>]*?' + chr(92) + 's)?class' + chr(92) + 's*=')} AS INTEGER) AS n_class_divs FROM (SELECT page_id, {Q.markup('html')} AS m FROM {table})"""


def _counts(df):
    texts = {c: F.array_join(F.col(c).cast("array<string>"), ";") for c in ("form_inputs", "form_selects", "table_rows")}
    return P.structure_counts(df).withColumns(texts)


@query("h15_structure_counts", f"{F3} {_structure('register_pages')}")
def _(t):
    return _counts(t.register_pages)


@query("h15_structure_counts_pages", _structure("pages"))
def _(t):
    return _counts(t.table("pages"))


_FOUND = Q.any_of("lower(html)", vocab.LICENCE_CONTENT_PHRASES)


@query(
    "h16_page_analysis",
    f"""{F3} SELECT a.page_id, found AS licence_register_found, CASE WHEN found THEN array_to_string(c.us, ';') ELSE '' END AS potential_licence_urls,
  CASE WHEN found THEN {_site_type('html')} END AS website_type, found AND {_SEARCH} AS search_functionality, found AND {_PAGING} AS pagination_detected, found AND {_SCRIPTED} AS javascript_required
FROM (SELECT *, {_FOUND} AS found, {Q.markup('html')} AS m FROM register_pages) a JOIN ({_candidates('register_pages')}) c ON a.page_id = c.page_id""",
)
def _(t):
    out = P.page_analysis(t.register_pages, navigation=False)
    return out.drop("url").withColumn("potential_licence_urls", join("potential_licence_urls"))


def _analysed(table, menu, crumbs):
    when = lambda x: f"CASE WHEN found THEN {x} END"
    return f"""SELECT a.page_id, a.url, found AS licence_register_found, {when(_site_type('html'))} AS website_type, CASE WHEN found THEN array_to_string(c.us, ';') ELSE '' END AS potential_licence_urls,
  {when(menu)} AS menu, {when(crumbs)} AS crumbs FROM (SELECT *, {_FOUND} AS found FROM {table}) a JOIN ({_candidates(table)}) c ON a.page_id = c.page_id"""


_REGISTER_MENU = "'Public register search>/register;View licence application>premises?id=' || o_custkey || ';Bins>https://x.example.org/bins'"
_NUMBERED = "(SELECT r.*, o_custkey FROM register_pages r JOIN orders ON page_id = o_orderkey)"


@query(
    "l5_analyse_pages",
    f"""WITH register_pages AS ({duck(REGISTER_PAGES)}), card_pages AS ({duck(CARD_PAGES)}), numbered AS {_NUMBERED}
{_analysed("numbered", _REGISTER_MENU, "''")}
UNION ALL {_analysed("card_pages", "'News>/n' || (a.page_id % 9)", "'Home>/;Licensing>/lic'")}""",
)
def _(t):
    out = discovery.analyse_pages(t.card_pages.unionByName(t.register_pages))
    shown = lambda c: join(F.transform(c, lambda e: F.concat(e.text, F.lit(">"), e.url)))
    return out.select(
        "page_id", "url", "licence_register_found", "website_type", join("potential_licence_urls").alias("potential_licence_urls"),
        shown("navigation_structure.main_menu_items").alias("menu"), shown("navigation_structure.breadcrumbs").alias("crumbs"),
    )


@query(
    "h18_licence_link_listing",
    f"""{F3} SELECT page_id, CAST(len(ls) AS INTEGER) AS n_links, array_to_string(list_transform(ls[1:5], lambda s: left(s.text, 50) || '>' || s.href), ';') AS shown FROM (
  SELECT page_id, list_filter({Q.links('html')}, lambda l: {Q.any_of("lower(l.href || ' ' || l.text)", vocab.LISTING_LINK_WORDS)}) AS ls FROM register_pages)""",
)
def _(t):
    out = P.licence_link_listing(t.register_pages)
    return out.withColumn("shown", join(F.transform("shown", lambda e: F.concat(e.text, F.lit(">"), e.href))))


_NEXT = f"(len(list_filter({Q.links('html')}, lambda l: contains(l.text, 'Next') OR contains(l.css, 'next'))) > 0)"
_FORM_TEXT = Q.inner("f")
_SEARCH_FORM = rf"(len(list_filter({_FORMS}, lambda f: {Q.any_of(f'lower({_FORM_TEXT})', vocab.SEARCH_FORM_WORDS)} AND regexp_matches(f, '(?i)<(?:input|button)\s(?:[^>]*?\s)?type\s*=\s*.?submit'))) > 0)"


@query("h19_h20_page_flags", f"{F3} SELECT page_id, {_NEXT} AS has_next, {_SEARCH_FORM} AS has_search_form FROM (SELECT page_id, html, {Q.markup('html')} AS m FROM register_pages)")
def _(t):
    return P.page_flags(t.register_pages)


_STATUS_MAPPED = "CASE o_orderstatus WHEN 'F' THEN 'granted' WHEN 'O' THEN 'pending' ELSE 'under_review' END"
_LICENCE_ROWS = f"""SELECT o_orderkey AS page_id, 'Red Lion ' || (o_custkey % 40) AS premises_name, (o_custkey % 200) || ' High St & Co' AS premises_address, 'new' AS licence_type,
  {_STATUS_MAPPED} AS licence_status, 'Red Lion ' || (o_custkey % 40) || ' | ' || (o_custkey % 200) || ' High St & Co | ' || {_STATUS} AS raw_data,
  'https://www.council' || o_custkey || '.gov.uk/business/licensing' AS url
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 <> 0"""


@query("h21_licences_of_rows", f"SELECT * EXCLUDE (url) FROM ({_LICENCE_ROWS})")
def _(t):
    rows = P.licences_of_rows(P.table_rows(t.register_pages))
    return rows.select("page_id", "premises_name", "premises_address", "licence_type", "licence_status", "raw_data")


@query("h21_row_record", f"SELECT page_id, split_part(raw_data, ' | ', 1) AS name, split_part(raw_data, ' | ', 3) AS status FROM ({_LICENCE_ROWS})")
def _(t):
    record = P.row_record(F.col("headers"), F.col("cells"))
    rows = P.table_rows(t.register_pages).select("page_id", record.alias("r"))
    return rows.select("page_id", F.col("r")["premises name"].alias("name"), F.col("r")["status"].alias("status"))


CASCADE = f"""cascade AS (
  SELECT page_id, url, 'table' AS step, premises_name, premises_address, licence_status FROM ({_LICENCE_ROWS})
  UNION ALL SELECT o_orderkey + 1000000000, 'https://www.council' || o_custkey || '.gov.uk/cards', 'card', 'Red Lion ' || (o_custkey % 40), (o_custkey % 200) || ' High Street, Leeds', 'granted' FROM orders WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT o_orderkey + 1000000000, 'https://www.council' || o_custkey || '.gov.uk/cards', 'card', 'Kebab House', '12 Mill Road, York', 'pending' FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 1 AND o_orderkey % 7 <> 0
  UNION ALL SELECT o_orderkey, 'https://www.council' || o_custkey || '.gov.uk/business/licensing', 'text', 'Text Inn ' || (o_custkey % 7), o_custkey || ' Low Rd', 'pending' FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT o_orderkey + 1000000000, 'https://www.council' || o_custkey || '.gov.uk/cards', 'text', 'Text Inn ' || (o_custkey % 7), o_custkey || ' Low Rd', 'pending' FROM orders WHERE o_orderkey % 3 = 0)"""


def all_pages(t):
    """Register and card pages; the latter are numbered behind the former."""
    return t.register_pages.unionByName(t.card_pages.withColumn("page_id", F.col("page_id") + 1000000000))


@query("h22_extraction_cascade", f"WITH {CASCADE} SELECT page_id, step, premises_name, premises_address FROM cascade")
def _(t):
    items = kept(extraction.read_pages(all_pages(t)))
    return extraction.cascade_licences(items, t.card_answers, t.text_answers).select("page_id", "step", "premises_name", "premises_address")


@query(
    "h22_texts_for_readers",
    f"""SELECT o_orderkey + 1000000000 AS page_id, 0 AS item, {CARD_ONE} AS text FROM orders UNION ALL SELECT o_orderkey + 1000000000, 1, {CARD_TWO} FROM orders WHERE o_orderkey % 2 = 1
UNION ALL SELECT o_orderkey, NULL, {Q.visible('html')} FROM orders JOIN ({duck(REGISTER_PAGES)}) ON page_id = o_orderkey WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey + 1000000000, NULL, {Q.visible('html')} FROM orders JOIN ({duck(CARD_PAGES)}) ON page_id = o_orderkey""",
)
def _(t):
    items = kept(extraction.read_pages(all_pages(t)))
    return extraction.items_cards(items).unionByName(extraction.items_texts(items), allowMissingColumns=True)


@query(
    "j3_linked_pages",
    f"""SELECT c_custkey AS page_id, 1 AS rank, premises_name FROM customer JOIN ({_LICENCE_ROWS}) ON url = 'https://www.council' || c_custkey || '.gov.uk/business/licensing'""",
)
def _(t):
    sources = t.table("customer").select(
        F.col("c_custkey").alias("page_id"),
        F.array(
            F.lit("https://www.nowhere.gov.uk/"),
            F.concat(F.lit("https://WWW.council"), F.col("c_custkey").cast("string"), F.lit(".gov.uk/business/licensing/#list")),
        ).alias("potential_licence_urls"),
    )
    targets = extraction.table_licences(t.register_pages).select("url", "premises_name")
    return P.linked_pages(sources, targets).select("page_id", "rank", "premises_name")


COUNCIL_CTE = f"councils AS ({duck(COUNCILS)})"
_ANALYSIS_SQL = "SELECT DISTINCT ON (council_name) * FROM (SELECT name AS council_name, seq % 4 = 0 AS javascript_required, seq % 6 = 0 AS pagination_detected, seq FROM councils WHERE seq % 3 <> 0) ORDER BY council_name, seq DESC"


def analyses_of(t):
    return t.councils.filter("seq % 3 <> 0").select(
        F.col("name").alias("council_name"), "seq", (F.col("seq") % 4 == 0).alias("javascript_required"),
        (F.col("seq") % 6 == 0).alias("pagination_detected"),
        F.array(*(F.concat(F.col("website_url"), F.lit(path)) for path in ("/business/licensing", "/cards")), F.lit("https://x.example.org/")).alias("potential_licence_urls"),
    )


@query(
    "j1_j4_join_analyses",
    f"""WITH {COUNCIL_CTE}, last AS ({_ANALYSIS_SQL}) SELECT c.seq, l.seq IS NOT NULL AS analysed,
  CASE WHEN coalesce(javascript_required, false) AND coalesce(pagination_detected, false) THEN 'rendered_paginated' WHEN coalesce(javascript_required, false) THEN 'rendered' ELSE 'plain' END AS strategy
FROM councils c LEFT JOIN last l ON c.name = l.council_name""",
)
def _(t):
    out = C.with_strategy(C.join_analyses(t.councils, analyses_of(t)))
    return out.select("seq", F.col("analysis").isNotNull().alias("analysed"), "strategy")


_WITH_CARDS = "SELECT * REPLACE (CASE WHEN seq % 6 = 5 THEN website_url || '/cards' ELSE licence_register_url END AS licence_register_url) FROM councils"
EXTRACTED = f"""{COUNCIL_CTE}, {CASCADE}, asked AS ({_WITH_CARDS}), last AS (SELECT name AS cn, arg_max(website_url, seq) AS site FROM councils WHERE seq % 3 <> 0 GROUP BY 1),
edges AS (SELECT name, licence_register_url AS u, 0 AS rank FROM asked WHERE coalesce(licence_register_url, '') <> ''
  UNION ALL SELECT name, site || '/business/licensing', 1 FROM asked JOIN last ON name = cn WHERE coalesce(licence_register_url, '') <> ''
  UNION ALL SELECT name, site || '/cards', 2 FROM asked JOIN last ON name = cn WHERE coalesce(licence_register_url, '') <> ''),
extracted AS (SELECT DISTINCT ON (name, lower(premises_name), lower(premises_address)) name AS council_name, premises_name, premises_address, step, licence_status, url, page_id
  FROM edges JOIN cascade ON u = url WHERE rank = 0 OR step <> 'text' ORDER BY name, lower(premises_name), lower(premises_address), rank, page_id)"""


def councils_with_cards(t):
    cards = F.concat("website_url", F.lit("/cards"))
    return t.councils.withColumn("licence_register_url", F.when(F.col("seq") % 6 == 5, cards).otherwise(F.col("licence_register_url")))


def _extracted(t):
    return extraction.extract_licences(councils_with_cards(t), analyses_of(t), all_pages(t), card_answers=t.card_answers, text_answers=t.text_answers)


@query("l6_extract_licences", f"WITH {EXTRACTED} SELECT council_name, premises_name, premises_address, step FROM extracted")
def _(t):
    return _extracted(t).select("council_name", "premises_name", "premises_address", "step")


@query(
    "p9_results_per_council",
    f"""WITH {EXTRACTED}, n AS (SELECT council_name, count(*) AS k FROM extracted GROUP BY 1)
SELECT name AS council_name, coalesce(k, 0) > 0 AS success, coalesce(k, 0) AS licences_found, CASE WHEN k IS NULL THEN 'No licence data found' END AS error_message
FROM asked LEFT JOIN n ON name = council_name WHERE coalesce(licence_register_url, '') <> ''""",
)
def _(t):
    return extraction.extraction_results(councils_with_cards(t), _extracted(t))
