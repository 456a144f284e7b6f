"""Responses and the council dimension."""

from pyspark.sql import functions as F

from checks import sql as Q
from checks.registry import query
from checks.tables import ANSWERS, AS_OF, COUNCILS, DIRECTORY_PAGES, LIST_RESPONSES, REGISTER_FILES, RESPONSES, duck
from licensum import vocab
from licensum.functions import text, urls
from licensum.operators import councils as C
from licensum.operators import responses as R
from licensum.plans import discovery
from licensum.sources import readers

RESP = f"responses AS ({duck(RESPONSES)})"
COUNCIL_CTE = f"councils AS ({duck(COUNCILS)})"
ASOF = "TIMESTAMP '2001-06-30 00:00:00'"

_KIND = Q.cascade("lower(coalesce(k, ''))", vocab.LICENCE_TYPE_PHRASES, "'new'")
_STATE = Q.cascade("lower(coalesce(s, ''))", vocab.LICENCE_STATUS_PHRASES, "'pending'")
_DIGEST = "sha256(council_name || '|' || lower(coalesce(n, '')) || '|' || lower(coalesce(a, '')))"


def _fields(source):
    get = lambda f: f"json_extract_string(j, '$.{f}')"
    return f"""SELECT *, {get('premises_name')} AS n, {get('premises_address')} AS a, {get('licence_type')} AS k, {get('licence_status')} AS s, {get('application_date')} AS d,
  {get('licence_holder')} AS h, coalesce(json_type(j, '$.licensable_activities') = 'NULL', false) OR coalesce(json_type(j, '$.conditions') = 'NULL', false)
  OR coalesce(json_type(j, '$.premises_name') = 'NULL', false) AS null_field FROM ({source})"""


_OBJECTS = _fields("SELECT page_id, council_name, regexp_extract(response, '(?s)\\{.*\\}') AS j FROM responses")
_ACCEPTED = f"""SELECT page_id, {_DIGEST} AS licence_id, council_name, n AS premises_name, a AS premises_address, {_KIND} AS licence_type, {_STATE} AS licence_status,
  {Q.date('d')} AS application_date, h AS designated_premises_supervisor FROM ({_OBJECTS}) WHERE NOT null_field AND coalesce(n, '') <> '' AND coalesce(a, '') <> ''"""
_COLUMNS = ["page_id", "licence_id", "council_name", "premises_name", "premises_address", "licence_type", "licence_status", "application_date", "designated_premises_supervisor"]


@query("p1_parse_object_responses", f"WITH {RESP} {_ACCEPTED}")
def _(t):
    return R.accepted(R.parse_object_responses(t.responses)).select(*_COLUMNS)


@query(
    "p7_rejected_responses",
    f"WITH {RESP} SELECT page_id, CASE WHEN null_field THEN 'null in a required field' ELSE 'missing name or address' END AS reject_reason FROM ({_OBJECTS}) WHERE null_field OR coalesce(n, '') = '' OR coalesce(a, '') = ''",
)
def _(t):
    return R.rejected(R.parse_object_responses(t.responses)).select("page_id", "reject_reason")


_ITEMS = _fields(
    """SELECT page_id, council_name, unnest(js) AS j, CAST(generate_subscripts(js, 1) - 1 AS INTEGER) AS item FROM (
  SELECT page_id, council_name, CAST(json_extract(x, '$[*]') AS JSON[]) AS js FROM (
    SELECT page_id, council_name, regexp_extract(response, '(?s)\\[.*\\]') AS x FROM lists) WHERE json_valid(x))"""
)


@query(
    "p2_parse_array_responses",
    f"WITH lists AS ({duck(LIST_RESPONSES)}) SELECT page_id, item, n AS premises_name, a AS premises_address, {_STATE} AS licence_status FROM ({_ITEMS}) WHERE NOT null_field AND coalesce(n, '') <> '' AND coalesce(a, '') <> ''",
)
def _(t):
    out = R.accepted(R.parse_array_responses(t.list_responses))
    return out.select("page_id", "item", "premises_name", "premises_address", "licence_status")


@query(
    "p2_rejected_responses",
    f"WITH lists AS ({duck(LIST_RESPONSES)}) SELECT page_id, 'no JSON found' AS reject_reason FROM (SELECT page_id, regexp_extract(response, '(?s)\\[.*\\]') AS x FROM lists) WHERE NOT json_valid(x)",
)
def _(t):
    out = R.rejected(R.parse_array_responses(t.list_responses))
    return out.filter("item IS NULL").select("page_id", "reject_reason")


@query("p3_parse_analysis_notes", f"WITH {RESP} SELECT page_id, json_extract_string(regexp_extract(response, '(?s)\\{{.*\\}}'), '$.licence_status') AS status FROM responses")
def _(t):
    return R.parse_analysis_notes(t.responses).select("page_id", F.try_variant_get("analysis", "$.licence_status", "string").alias("status"))


@query(
    "p4_p5_map_type_and_status",
    f"SELECT doc_id, {Q.cascade('lower(text)', vocab.LICENCE_TYPE_PHRASES, chr(39) + 'new' + chr(39))} AS kind, {Q.cascade('lower(text)', vocab.LICENCE_STATUS_PHRASES, chr(39) + 'pending' + chr(39))} AS state FROM documents",
)
def _(t):
    c = F.col("text")
    return t.table("documents").select("doc_id", text.map_licence_type(c).alias("kind"), text.map_licence_status(c).alias("state"))


_SPELLED = """CASE o_orderkey % 8 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y')
  WHEN 3 THEN strftime(o_orderdate, '%d %B %Y') WHEN 4 THEN strftime(o_orderdate, '%d %b %Y') WHEN 5 THEN strftime(o_orderdate, '%B %d, %Y') WHEN 6 THEN strftime(o_orderdate, '%b %d, %Y') ELSE '31/02/2024' END"""


@query("p6_parse_date", f"SELECT o_orderkey, {_SPELLED} AS spelled, CASE WHEN o_orderkey % 8 <> 7 THEN o_orderdate END AS parsed FROM orders")
def _(t):
    formats = ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd MMMM yyyy", "dd MMM yyyy", "MMMM dd, yyyy", "MMM dd, yyyy"]
    k = F.col("o_orderkey") % 8
    spelled = F.coalesce(*[F.when(k == i, F.date_format("o_orderdate", f)) for i, f in enumerate(formats)], F.lit("31/02/2024"))
    out = t.table("orders").select("o_orderkey", spelled.alias("spelled"))
    return out.withColumn("parsed", text.parse_date(F.col("spelled")))


@query("p8_surrogate_id", "SELECT c_custkey, sha256(c_name || '|' || coalesce(c_mktsegment, '')) AS id FROM customer")
def _(t):
    return t.table("customer").select("c_custkey", text.surrogate_id(F.col("c_name"), F.col("c_mktsegment")).alias("id"))


_URL = r"rtrim(regexp_extract({x}, 'https?://[^\s\])\n]+'), '.,;:!?')"
_CLEAN_URL = f"CASE WHEN {_URL} <> '' AND NOT contains({_URL}, 'example.com') AND NOT contains({_URL}, 'placeholder') THEN {_URL} END"


@query("p10_clean_url", f"WITH {COUNCIL_CTE} SELECT seq, {_CLEAN_URL.format(x='licence_register_url')} AS url FROM councils")
def _(t):
    return t.councils.select("seq", urls.clean_url(F.col("licence_register_url")).alias("url"))


@query("p11_renamed_holder", f"WITH {RESP} SELECT page_id, json_extract_string(regexp_extract(response, '(?s)\\{{.*\\}}'), '$.licence_holder') AS designated_premises_supervisor, regexp_extract(response, '(?s)\\{{.*\\}}') AS raw_data FROM responses")
def _(t):
    return R.parse_object_responses(t.responses).select("page_id", "designated_premises_supervisor", "raw_data")


def _site(x):
    for word in vocab.COUNCIL_NAME_NOISE:
        x = f"replace({x if x.startswith('replace') else f'lower({x})'}, {Q.lit(word)}, '')"
    return f"'https://www.' || {x} || '.gov.uk'"


_REGION = "CASE WHEN contains(path, 'eng') THEN 'England' WHEN contains(path, 'sct') THEN 'Scotland' WHEN contains(path, 'wls') THEN 'Wales' ELSE 'Unknown' END"
_OFFICIAL = """'Royal Borough of ' || c_mktsegment || '-' || (c_custkey % 300) || ' Council'"""
_REGISTER = f"""SELECT c_custkey AS seq, 0 AS pos, {_OFFICIAL} AS name, CASE WHEN c_custkey % 2 = 0 THEN 'E' || c_custkey ELSE 'R' || c_custkey END AS code,
  {_site(_OFFICIAL)} AS website_url, {_REGION} AS region FROM customer JOIN (SELECT seq AS s, path FROM ({duck(REGISTER_FILES)})) ON s = c_custkey WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0"""


@query("s5_parse_register", f"SELECT *, {Q.info_length(['name', 'code', 'website_url', 'region'])} AS info_len FROM ({_REGISTER})")
def _(t):
    return C.parse_register(t.register_files)


_SEEDS = "VALUES " + ", ".join(f"({i}, {', '.join(map(Q.lit, row))})" for i, row in enumerate(vocab.SEED_COUNCILS))
_SEED = f"SELECT * FROM ({_SEEDS}) s(seq, name, website_url, region, code)"


@query(
    "s6_seed_councils",
    f"WITH {COUNCIL_CTE} SELECT seed.name, seed.code, count(councils.name) AS n FROM ({_SEED}) seed LEFT JOIN councils ON seed.name = councils.name GROUP BY ALL",
)
def _(t):
    seeds = readers.seed_councils(t.spark).select("name", "code")
    counts = t.councils.groupBy("name").agg(F.count("*").alias("n"))
    return seeds.join(counts, "name", "left").select("name", "code", F.coalesce("n", F.lit(0)).alias("n"))


_ANCHOR = """SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, l.text AS name, CASE WHEN l.href LIKE 'http%' THEN l.href ELSE 'https://' || l.href END AS website_url, 'Unknown' AS region FROM (
  SELECT page_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT page_id, {links} AS ls FROM ({pages}))) WHERE {hit}""".format(
    links=Q.links("html"), pages=duck(DIRECTORY_PAGES), hit=Q.any_of("lower(l.href || ' ' || l.text)", vocab.COUNCIL_LINK_WORDS)
)


@query("s7_h17_parse_directory", f"SELECT *, {Q.info_length(['name', 'website_url', 'region'])} AS info_len FROM ({_ANCHOR})")
def _(t):
    return C.parse_directory(t.directory_pages)


_UNION = f"""SELECT 0 AS src_rank, seq AS ord_a, pos AS ord_b, name, code, website_url, region, {Q.info_length(['name', 'code', 'website_url', 'region'])} AS info_len FROM ({_REGISTER})
UNION ALL SELECT 1, page_id, pos, name, NULL, website_url, region, {Q.info_length(['name', 'website_url', 'region'])} FROM ({_ANCHOR})
UNION ALL SELECT 2, seq, 0, name, code, website_url, region, {Q.info_length(['name', 'website_url', 'region', 'code'])} FROM ({_SEED})"""


@query("k1_union_sources", f"SELECT src_rank, count(*) AS n, count(code) AS with_code FROM ({_UNION}) GROUP BY 1")
def _(t):
    union = C.union_sources(C.parse_register(t.register_files), C.parse_directory(t.directory_pages), readers.seed_councils(t.spark))
    return union.groupBy("src_rank").agg(F.count("*").alias("n"), F.count("code").alias("with_code"))


@query("k2_construct_website_url", f"WITH {COUNCIL_CTE} SELECT seq, {_site('name')} AS url FROM councils")
def _(t):
    return t.councils.select("seq", urls.construct_website_url(F.col("name")).alias("url"))


@query("k3_region_of_source", f"SELECT seq, {_REGION} AS region FROM ({duck(REGISTER_FILES)})")
def _(t):
    return t.register_files.select("seq", urls.region_of_source(F.col("path")).alias("region"))


_KEY = f"replace(lower({Q.strip('name')}), ' council', '')"


@query(
    "k4_dedupe_councils",
    f"""WITH {COUNCIL_CTE}, sized AS (SELECT *, {_KEY} AS council_key, {Q.info_length(['name', 'code', 'website_url', 'region'])} AS info_len FROM councils)
SELECT council_key, seq, name FROM (SELECT *, row_number() OVER (PARTITION BY council_key ORDER BY info_len DESC, seq) AS rn FROM sized) WHERE rn = 1""",
)
def _(t):
    sized = C.with_info_length(t.councils, ["name", "code", "website_url", "region"])
    return C.dedupe_councils(sized, ["seq"]).select("council_key", "seq", "name")


@query(
    "l4_discover_councils",
    f"""SELECT council_key, name, code, website_url, region FROM (SELECT *, row_number() OVER (PARTITION BY council_key ORDER BY info_len DESC, src_rank, ord_a, ord_b) AS rn FROM (
  SELECT *, {_KEY} AS council_key FROM ({_UNION}) WHERE {Q.strip('name')} <> '')) WHERE rn = 1""",
)
def _(t):
    out = discovery.discover_councils(C.parse_register(t.register_files), C.parse_directory(t.directory_pages), readers.seed_councils(t.spark))
    return out.select("council_key", "name", "code", "website_url", "region")


@query("k5_with_register", f"WITH {COUNCIL_CTE} SELECT seq FROM councils WHERE coalesce(licence_register_url, '') <> ''")
def _(t):
    return C.with_register(t.councils).select("seq")


@query("k6_eligible_for_extraction", f"WITH {COUNCIL_CTE} SELECT seq FROM councils WHERE coalesce(licence_register_url, '') <> '' AND scrape_successful ORDER BY seq LIMIT 40")
def _(t):
    return C.eligible_for_extraction(t.councils, max_councils=40).select("seq")


_KNOWN = "(VALUES " + ", ".join(f"({Q.lit(k)}, {Q.lit(v)})" for k, v in vocab.KNOWN_REGISTER_URLS.items()) + ") k(kn, ku)"


def _fixed(source):
    return f"""SELECT seq, name, coalesce(ku, licence_register_url) AS licence_register_url, CASE WHEN ku IS NOT NULL AND ku IS DISTINCT FROM licence_register_url THEN true ELSE scrape_successful END AS scrape_successful,
  ku IS NOT NULL AND ku IS DISTINCT FROM licence_register_url AS url_fixed FROM ({source}) LEFT JOIN {_KNOWN} ON name = kn"""


@query("k7_apply_known_urls", f"WITH {COUNCIL_CTE} {_fixed('SELECT * FROM councils')}")
def _(t):
    out = C.apply_known_urls(t.councils, C.known_urls(t.spark))
    return out.select("seq", "name", "licence_register_url", "scrape_successful", "url_fixed")


_QUALITY = """count(*) AS total_councils, count(*) FILTER (coalesce(licence_register_url, '') <> '') AS with_url, count(*) FILTER (licence_register_url LIKE 'http%' AND length(licence_register_url) < 200) AS clean_url,
  count(*) FILTER (licence_register_url LIKE 'http%') AS http_url"""


@query("k8_url_quality", f"WITH {COUNCIL_CTE} SELECT {_QUALITY} FROM councils")
def _(t):
    return C.url_quality(t.councils)


_CLEANED = f"SELECT * REPLACE (coalesce({_CLEAN_URL.format(x='licence_register_url')}, licence_register_url) AS licence_register_url) FROM councils"


@query("l9_repair_register_urls", f"WITH {COUNCIL_CTE} {_fixed(_CLEANED)}")
def _(t):
    out = discovery.repair_register_urls(t.councils, C.known_urls(t.spark))
    return out.select("seq", "name", "licence_register_url", "scrape_successful", "url_fixed")


@query(
    "k9_apply_register_answers",
    f"""WITH {COUNCIL_CTE}, answers AS ({duck(ANSWERS)}), read AS (SELECT name, status, CASE WHEN trim(answer) <> 'NOT_FOUND' THEN {_CLEAN_URL.format(x='answer')} END AS url FROM answers)
SELECT seq, CASE WHEN status = 200 THEN url END AS licence_register_url, status = 200 AND url IS NOT NULL AS scrape_successful,
  CASE WHEN status <> 200 THEN 'Website returned status ' || status WHEN url IS NULL THEN 'No licence register found' END AS error_message, {ASOF} AS last_scraped FROM councils JOIN read ON councils.name = read.name""",
)
def _(t):
    out = C.apply_register_answers(t.councils, t.answers, as_of=AS_OF)
    return out.select("seq", "licence_register_url", "scrape_successful", "error_message", "last_scraped")


_RECENT = f"scrape_successful AND last_scraped > {ASOF} - INTERVAL 30 DAY"


@query("k10_recently_successful", f"WITH {COUNCIL_CTE} SELECT seq FROM councils WHERE {_RECENT}")
def _(t):
    return C.recently_successful(t.councils, as_of=AS_OF).select("seq")


@query("k10_recently_successful_fallback", f"WITH {COUNCIL_CTE} SELECT seq FROM councils WHERE scrape_successful AND coalesce(licence_register_url, '') <> ''")
def _(t):
    from datetime import datetime

    return C.recently_successful(t.councils, as_of=datetime(2010, 1, 1)).select("seq")
