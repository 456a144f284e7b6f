"""Register tables derived by Spark from the driver's tables, and the same text for DuckDB."""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from licensum.plans.processing import process_licences

AS_OF = datetime(2001, 6, 30)

RAW_LICENCES = """
SELECT o_orderkey AS seq,
  concat('LIC_', CAST(o_orderkey AS STRING)) AS licence_id,
  n_name AS council_name,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('C', CAST(n_nationkey AS STRING)) END AS council_code,
  concat(CASE o_orderkey % 7 WHEN 0 THEN 'The  ' WHEN 1 THEN ' ' ELSE '' END,
    CASE o_custkey % 12 WHEN 0 THEN 'Red Lion Pub' WHEN 1 THEN 'Harbour View Restaurant' WHEN 2 THEN 'Blue Bar &amp; Grill'
      WHEN 3 THEN 'Northern Quarter Club' WHEN 4 THEN 'Grand Hotel Ltd' WHEN 5 THEN 'Corner Shop' WHEN 6 THEN 'O&#39;Neill Coffee'
      WHEN 7 THEN 'Royal Theatre' WHEN 8 THEN 'Kebab House' WHEN 9 THEN 'Search results' WHEN 10 THEN 'AB' ELSE 'Dinner Place' END,
    CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat(' ', CAST(o_custkey % 40 AS STRING)) END) AS premises_name,
  concat(CAST(o_custkey % 200 + 1 AS STRING), CASE o_custkey % 3 WHEN 0 THEN ' High St, London' WHEN 1 THEN ' Mill Rd,  Leeds' ELSE ' Park&nbsp;Ave, York' END,
    CASE WHEN o_custkey % 6 = 0 THEN '' ELSE concat(' ', substr('ABCDEFGHIJKLMNOPRSTUWY', CAST(o_custkey % 22 + 1 AS INT), 1), CAST(o_custkey % 9 + 1 AS STRING),
      CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '' END, CAST(o_custkey % 10 AS STRING), 'ab') END) AS premises_address,
  CASE WHEN o_orderkey % 4 = 0 THEN 'ZZ9 9ZZ' END AS postcode,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'new' WHEN '2-HIGH' THEN 'variation' WHEN '3-MEDIUM' THEN 'transfer' WHEN '4-NOT SPECIFIED' THEN 'review' ELSE 'provisional' END AS licence_type,
  CASE o_orderstatus WHEN 'F' THEN 'granted' WHEN 'O' THEN 'pending' ELSE 'under_review' END AS licence_status,
  o_orderdate AS application_date,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 14 DAY END AS granted_date,
  split(CASE o_orderkey % 6 WHEN 0 THEN 'Retail sale of alcohol;Live music' WHEN 1 THEN 'Supply of alcohol;Sale of alcohol;Recorded music'
     WHEN 2 THEN 'Provision of late night refreshment' WHEN 3 THEN 'Films;Performance of dance;quiz night' WHEN 4 THEN 'Indoor sporting events;darts' ELSE 'Boxing or wrestling;quiz night;quiz night;karaoke evening;open mic' END, ';') AS licensable_activities,
  split(CASE o_orderkey % 4 WHEN 0 THEN 'No music after 23:00;short' WHEN 1 THEN 'Challenge 25 policy;CCTV on site at all times;Door staff required;Sound limiter installed;No deliveries before 8;Maximum capacity 100' ELSE 'short' END, ';') AS conditions,
  CASE WHEN o_custkey % 4 = 0 THEN 'Mr john smith-jones' WHEN o_custkey % 4 = 1 THEN 'Dr. MARIA o''neil Jr.' END AS designated_premises_supervisor,
  CASE o_orderkey % 5 WHEN 0 THEN 'mon=11:00-23:00;Monday =12:00-22:00;bank holiday=;sun= 12:00  - 21:00 '
     WHEN 1 THEN 'FRI=18:00-02:00;saturday=18:00-02:00;new year''s eve=open all night' END AS hours_text,
  CASE WHEN o_orderkey % 2 = 0 THEN concat('https://www.council', CAST(n_nationkey AS STRING), '.gov.uk/licensing') END AS source_url,
  CAST('2001-06-30 00:00:00' AS {timestamp}) AS scraped_at
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

REGISTER_PAGES = """
SELECT o_orderkey AS page_id,
  concat('https://www.council', CAST(o_custkey AS STRING), '.gov.uk/business/licensing') AS url,
  concat('<html><body><nav class="', CASE o_orderkey % 4 WHEN 0 THEN 'gov-nav' WHEN 1 THEN 'wordpress-menu' WHEN 2 THEN 'Drupal-nav' ELSE 'site-header' END, '">',
    '<a href="/register">Public register search</a><a href="premises?id=', CAST(o_custkey AS STRING), '">View licence application</a><a href="https://x.example.org/bins">Bins</a></nav>',
    CASE WHEN o_orderkey % 3 = 0 THEN concat('<form class="search-form">', CASE WHEN o_orderkey % 9 = 0 THEN '<label>Find a licence</label>' ELSE '' END, '<input type="search" placeholder="Search premises"><input type="submit" value="Go"></form>') ELSE '' END,
    CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('<table><tr><th>Premises Name</th><th>Address</th><th>Status</th></tr>',
      '<tr><td>Red Lion ', CAST(o_custkey % 40 AS STRING), '</td><td> ', CAST(o_custkey % 200 AS STRING), ' High St &amp; Co</td><td>', CASE o_orderstatus WHEN 'F' THEN 'Granted' WHEN 'O' THEN 'Application pending' ELSE 'Under review' END, '</td></tr>',
      '<tr><td>only</td><td>two</td></tr></table>') END,
    '<table><tr><th>Opening</th><th>Times</th><th>Today</th></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>',
    CASE WHEN o_orderkey % 7 = 0 THEN '<div class="pagination"><a class="next" href="?page=2">Next</a></div>' ELSE '' END,
    CASE WHEN o_orderkey % 11 = 0 THEN '<script>window.react = 1;</script>' ELSE '<script>var a = 1;</script>' END,
    '<p>Premises licence applications &amp; alcohol licence register.</p></body></html>') AS html
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

# Pages with breadcrumbs, menus, a main element and cards, for the operators that need the element tree.
CARD_PAGES = """
SELECT o_orderkey AS page_id,
  concat('https://www.council', CAST(o_custkey AS STRING), '.gov.uk/cards') AS url,
  concat('<html><body><ul class="breadcrumb"><li><a href="/">Home</a><li><a href="/lic"> Licensing</a></ul>',
    '<div class="main-menu"><a href="/n', CAST(o_orderkey % 9 AS STRING), '">News</a><a>no target</a></div>',
    CASE o_orderkey % 4 WHEN 0 THEN '<main>' WHEN 1 THEN '<div id="content">' WHEN 2 THEN '<article>' ELSE '<section>' END,
    '<h1>Register ', CAST(o_custkey AS STRING), '</h1><script>skip()</script><div class="results">',
    '<div class="result-item">', {card_one}, '</div><div class="result-item"><b>', {card_two}, '</b></div></div>',
    CASE o_orderkey % 4 WHEN 0 THEN '</main>' WHEN 1 THEN '</div>' WHEN 2 THEN '</article>' ELSE '</section>' END,
    '<footer>Contact</footer></body></html>') AS html
FROM {orders}
"""
CARD_ONE = "concat('Red Lion ', CAST(o_custkey % 40 AS STRING), ', ', CAST(o_custkey % 200 AS STRING), ' High Street, Leeds. Premises licence held by J. Smith.')"
CARD_TWO = "concat('Kebab House ', CASE WHEN o_orderkey % 2 = 0 THEN 'closed' ELSE 'at 12 Mill Road, York, late night refreshment licence granted' END)"

RESPONSES = """
SELECT o_orderkey AS page_id, n_name AS council_name,
  concat('Here is the data: {{"premises_name": ', CASE WHEN o_orderkey % 13 = 0 THEN 'null' ELSE concat('"Red Lion ', CAST(o_custkey AS STRING), '"') END,
    ', "premises_address": "', CAST(o_custkey % 200 AS STRING), ' High St", "licence_holder": "john smith", "licence_type": "',
    CASE o_orderkey % 6 WHEN 0 THEN 'premises licence' WHEN 1 THEN 'Minor Variation' WHEN 2 THEN 'Transfer of licence' WHEN 3 THEN 'Review' WHEN 4 THEN 'Provisional statement' ELSE '' END,
    '", "licence_status": "', CASE o_orderkey % 7 WHEN 0 THEN 'Granted' WHEN 1 THEN 'approved' WHEN 2 THEN 'Rejected' WHEN 3 THEN 'withdrawn' WHEN 4 THEN 'under review' WHEN 5 THEN 'not granted' ELSE 'unknown' END,
    '", "application_date": "', CASE o_orderkey % 5
      WHEN 0 THEN concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'))
      WHEN 1 THEN concat(CAST(day(o_orderdate) AS STRING), '/', CAST(month(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING))
      WHEN 2 THEN concat(CAST(day(o_orderdate) AS STRING), '-', CAST(month(o_orderdate) AS STRING), '-', CAST(year(o_orderdate) AS STRING))
      WHEN 3 THEN concat(CAST(day(o_orderdate) AS STRING), ' ', substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month(o_orderdate) * 3 - 2 AS INT), 3), ' ', CAST(year(o_orderdate) AS STRING))
      ELSE 'soon' END,
    '", "licensable_activities": ', CASE WHEN o_orderkey % 17 = 0 THEN 'null' ELSE '["Sale of Alcohol"]' END, ', "conditions": []}} Hope this helps.') AS response
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

# Lists of one to 23 licences per response; every third one is broken off.
LIST_RESPONSES = """
SELECT o_orderkey AS page_id, n_name AS council_name,
  concat('Found these: [', array_to_string({items}, ', '), CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE ']' END, ' (end)') AS response
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""
LIST_ITEM = """concat('{{"premises_name": "Inn ', CAST({i} AS STRING), '", "premises_address": ', CASE WHEN ({i} + o_orderkey) % 5 = 0 THEN '""' ELSE concat('"', CAST(o_custkey AS STRING), ' Low Rd"') END, ', "conditions": ', CASE WHEN ({i} + o_orderkey) % 7 = 0 THEN 'null' ELSE '["Door staff"]' END, ', "licence_status": "approved"}}')"""

COUNCILS = """
SELECT c_custkey AS seq,
  CASE c_custkey % 50 WHEN 0 THEN 'Westminster City Council' WHEN 1 THEN 'Leeds City Council' WHEN 2 THEN 'Edinburgh Council' ELSE
    concat(CASE c_custkey % 4 WHEN 0 THEN 'Area ' WHEN 1 THEN 'Upper-' WHEN 2 THEN ' North ' ELSE 'St Mary''s ' END, CAST(c_custkey % 400 AS STRING),
      CASE c_custkey % 3 WHEN 0 THEN ' City Council' WHEN 1 THEN ' Council' ELSE '' END) END AS name,
  CASE WHEN c_custkey % 3 = 0 THEN concat('C', CAST(c_custkey AS STRING)) END AS code,
  concat('https://www.council', CAST(c_custkey AS STRING), '.gov.uk') AS website_url,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('See https://www.council', CAST(c_custkey AS STRING), '.gov.uk/licensing). Thanks')
    WHEN 3 THEN concat('https://www.council', CAST(c_custkey AS STRING), '.gov.uk/business/licensing') WHEN 4 THEN 'https://example.com/register'
    ELSE concat('https://www.b', CAST(c_custkey AS STRING), '.gov.uk/reg.;') END AS licence_register_url,
  CASE WHEN c_custkey % 2 = 0 THEN 'England' ELSE 'Unknown' END AS region,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS scrape_successful,
  CASE WHEN c_custkey % 5 <> 0 THEN CAST('2001-06-30 00:00:00' AS {timestamp}) - (c_custkey % 90) * INTERVAL 1 DAY END AS last_scraped
FROM {customer}
"""

REGISTER_FILES = """
SELECT c_custkey AS seq,
  concat('/registers/local-authority-', CASE c_custkey % 4 WHEN 0 THEN 'eng' WHEN 1 THEN 'sct' WHEN 2 THEN 'wls' ELSE 'nir' END, '/records.json') AS path,
  concat('{{"R', CAST(c_custkey AS STRING), '": {{"entry": {{',
    CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat('"official-name": "', CASE WHEN c_custkey % 11 = 0 THEN '' ELSE concat('Royal Borough of ', c_mktsegment, '-', CAST(c_custkey % 300 AS STRING), ' Council') END, '", ') END,
    CASE WHEN c_custkey % 2 = 0 THEN concat('"local-authority-eng": "E', CAST(c_custkey AS STRING), '", ') ELSE '' END,
    '"name": "', c_mktsegment, '"}}}}, "X', CAST(c_custkey AS STRING), '": {{}}}}') AS value
FROM {customer}
"""

DIRECTORY_PAGES = """
SELECT c_custkey AS page_id,
  concat('<ul><li><a href="https://www.area', CAST(c_custkey % 300 AS STRING), '.gov.uk"> Area ', CAST(c_custkey % 300 AS STRING), ' Council </a></li>',
    '<li><a href="www.', lower(c_mktsegment), CAST(c_custkey % 90 AS STRING), '.org/city">', c_mktsegment, ' &amp; ', CAST(c_custkey % 90 AS STRING), '</a></li>',
    '<li><a href="/about">About us</a></li></ul>') AS html
FROM {customer}
"""

RESULTS = """
SELECT c_custkey AS seq, concat('Council ', CAST(c_custkey AS STRING)) AS council_name, c_custkey % 3 <> 0 AS success,
  CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 20 END AS INT) AS licences_found,
  CASE WHEN c_custkey % 3 = 0 THEN 'No licence data found' END AS error_message,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DOUBLE) ELSE CAST(c_custkey % 64 AS DOUBLE) / 4 END AS scraping_duration
FROM {customer}
"""

# What a reader says about single cards, and about the texts of pages; some of it is about pages that need no reader.
CARD_ANSWERS = """
SELECT o_orderkey + 1000000000 AS page_id, item,
  CASE WHEN o_orderkey % 3 = 0 THEN 'No licence here.'
    WHEN item = 0 THEN concat('{{"premises_name": "Red Lion ', CAST(o_custkey % 40 AS STRING), '", "premises_address": "', CAST(o_custkey % 200 AS STRING), ' High Street, Leeds", "licence_status": "granted"}}')
    ELSE concat('It says: {{"premises_name": "Kebab House", "premises_address": ', CASE WHEN o_orderkey % 7 = 0 THEN 'null' ELSE '"12 Mill Road, York"' END, '}}') END AS response
FROM {orders} JOIN (SELECT 0 AS item UNION ALL SELECT 1 AS item) AS items ON item = 0 OR o_orderkey % 2 = 1
"""
TEXT_ANSWERS = """
SELECT page_id, concat('[{{"premises_name": "Text Inn ', CAST(o_custkey % 7 AS STRING), '", "premises_address": "', CAST(o_custkey AS STRING), ' Low Rd"}}',
    CASE WHEN o_orderkey % 2 = 0 THEN ', {{"premises_name": "", "premises_address": "nowhere"}}' ELSE '' END, ']') AS response
FROM (SELECT o_orderkey AS page_id, o_orderkey, o_custkey FROM {orders} UNION ALL SELECT o_orderkey + 1000000000, o_orderkey, o_custkey FROM {orders}) AS asked
"""

ANSWERS = """
SELECT name, CAST(CASE WHEN min(seq) % 5 = 0 THEN 404 ELSE 200 END AS INT) AS status,
  CASE min(seq) % 4 WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN concat('The page is https://www.c', CAST(min(seq) AS STRING), '.gov.uk/licensing, I think') WHEN 2 THEN 'https://example.com/placeholder' ELSE 'no idea' END AS answer
FROM ({councils}) GROUP BY name
"""


def _fill(text: str, names: dict) -> str:
    items = ", ".join(f"CASE WHEN o_orderkey % 23 >= {i} THEN {LIST_ITEM.format(i=i)} END" for i in range(23))
    extra = {"card_one": CARD_ONE, "card_two": CARD_TWO, "items": f"{names['list']}({items})"}
    return text.format(**names, **extra)


_SPREAD = {"orders", "customer", "pages", "documents", "events"}
_NARROW = {"orders", "customer"}
ROWS = 100_000
_JOINS = {"customer": "o_custkey = c_custkey", "nation": "c_nationkey = n_nationkey"}
_TABLES = ["orders", "customer", "nation", "pages", "documents", "events", "supplier"]
_DUCK = {**{t: t for t in _TABLES}, "timestamp": "TIMESTAMP", "list": "list_value"}


def duck(text: str) -> str:
    """The DuckDB text of a derived table."""
    return _fill(text, {**_DUCK, "councils": _fill(COUNCILS, {**_DUCK, "councils": ""})})


def _braced(sql: str, used) -> str:
    """Double the literal braces of a text for ``spark.sql``, which fills in the named tables."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        sql = sql.replace("{{" + t + "}}", "{" + t + "}")
    return sql


class Tables:
    """The driver's tables of one scale factor and the tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        """A driver table; one that is read in fewer splits than there are cores is spread over all of them.

        A small file is one split and would keep one core busy. Large tables come in enough splits and stay as they are,
        but for those with narrow rows, from which wide ones are made.
        """
        df = self.read(name)
        if name in _NARROW:
            return self.spread(df, df)
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if name in _SPREAD and df.rdd.getNumPartitions() < cores else df

    def spread(self, df: DataFrame, like: DataFrame) -> DataFrame:
        """Rows in tasks of about ``ROWS`` rows of ``like``, a stored table, and in as many tasks as there are cores at least.

        Neither the splits of a compressed file nor the partitions behind a join tell how much work its rows will be.
        """
        return df.repartition(max(self.spark.sparkContext.defaultParallelism, -(-like.count() // ROWS)))

    def joined(self, *names: str) -> DataFrame:
        """The orders with what they are joined to, spread while they are narrow."""
        df = orders = self.read("orders")
        for name in names:
            df = df.join(self.read(name), F.expr(_JOINS[name]))
        return self.spread(df, orders)

    def derived(self, text: str) -> DataFrame:
        joins = {"_".join(("orders", *names)): names for names in (("customer", "nation"), ("customer",))}
        for joined, names in joins.items():
            text = text.replace(" ".join(["{orders}", *(f"JOIN {{{name}}} ON {_JOINS[name]}" for name in names)]), "{" + joined + "}")
        used = [t for t in [*_TABLES, *joins, "councils"] if "{" + t + "}" in text]
        names = {t: "{" + t + "}" for t in used} | {"timestamp": "TIMESTAMP_NTZ", "list": "array"}
        frames = {t: self.derived(COUNCILS) if t == "councils" else self.joined(*joins[t]) if t in joins else self.table(t) for t in used}
        sql = _fill(text.replace("({councils})", "{councils}"), {**dict.fromkeys(_TABLES, ""), "councils": "", **names})
        return self.spark.sql(_braced(sql, used).replace("array_to_string(", "array_join("), **frames)

    @property
    def raw(self) -> DataFrame:
        hours = "CASE WHEN hours_text IS NOT NULL THEN str_to_map(hours_text, ';', '=') END"
        return self.derived(RAW_LICENCES).selectExpr("*", f"{hours} AS opening_hours").drop("hours_text")

    register_pages = property(lambda self: self.derived(REGISTER_PAGES))
    card_pages = property(lambda self: self.derived(CARD_PAGES))
    responses = property(lambda self: self.derived(RESPONSES))
    list_responses = property(lambda self: self.derived(LIST_RESPONSES))
    councils = property(lambda self: self.derived(COUNCILS))
    register_files = property(lambda self: self.derived(REGISTER_FILES))
    directory_pages = property(lambda self: self.derived(DIRECTORY_PAGES))
    results = property(lambda self: self.derived(RESULTS))
    card_answers = property(lambda self: self.derived(CARD_ANSWERS))
    text_answers = property(lambda self: self.derived(TEXT_ANSWERS))
    answers = property(lambda self: self.derived(ANSWERS))

    @property
    def enriched(self) -> DataFrame:
        return process_licences(self.raw, as_of=AS_OF)
