"""Files and streams: what is written and read back, or streamed, equals the batch result."""

from datetime import datetime

from pyspark.sql import functions as F

from checks import sql as Q
from checks import stages as S
from checks.page_queries import CASCADE, EXTRACTED, all_pages, analyses_of, councils_with_cards
from checks.registry import ORACLES, query
from checks.report_queries import COUNCIL_ANALYSIS, COUNCIL_CTE, ENDED, STARTED
from checks.tables import AS_OF
from licensum import schemas
from licensum.functions import text
from licensum.operators import clean
from licensum.operators import councils as C
from licensum.plans import discovery, reporting, runs
from licensum.session import kept, shared_folder
from licensum.sources import readers, snapshots, writers
from licensum.sources.page_store import PageStore
from licensum.streaming import ingest, upsert, weekly


def _nested_results(t):
    """Extraction results with the licences of one council and thousand of numbers each."""
    raw = t.raw
    fields = [f for f in schemas.LICENCE.names if f in raw.columns]
    batch = F.floor(F.col("seq") / 1000).alias("batch")
    groups = raw.groupBy("council_name", batch).agg(F.collect_list(F.struct(*fields)).alias("licences_extracted"))
    return groups.select(
        "council_name",
        F.lit(True).alias("success"),
        F.size("licences_extracted").alias("licences_found"),
        "licences_extracted",
        F.lit(1.5).alias("scraping_duration"),
        text.as_ntz(AS_OF).alias("scraped_at"),
    )


@query("s1_read_extraction_results", f"WITH {S.RAW} SELECT seq, licence_id, premises_name, application_date, granted_date, len(licensable_activities) AS n_activities FROM raw")
def _(t):
    path = f"{shared_folder(t.spark)}/results"
    writers.write_json_records(_nested_results(t), path)
    rows = clean.licences_of_results(readers.read_extraction_results(t.spark, path, lines=True))
    n = F.size("licensable_activities").cast("bigint").alias("n_activities")
    return rows.select("seq", "licence_id", "premises_name", "application_date", "granted_date", n)


@query("s2_read_processed", S.over(S.ENRICHED, "SELECT seq, premises_name, business_type, CAST(risk_score AS INTEGER) AS risk_score FROM enriched"))
def _(t):
    path = f"{shared_folder(t.spark)}/processed"
    enriched = t.enriched
    cols = [c for c in schemas.LICENCE_ENRICHED.names if c in enriched.columns]
    part = F.floor(F.col("seq") / 1000).alias("part")
    docs = enriched.groupBy(part).agg(F.collect_list(F.struct(*cols)).alias("licences")).drop("part")
    writers.write_json_records(docs, path)
    licences, _ = readers.read_processed(t.spark, path, lines=True)
    return licences.select("seq", "premises_name", "business_type", "risk_score")


@query("s3_read_councils", f"WITH {COUNCIL_CTE} SELECT name, code, licence_register_url, scrape_successful, last_scraped FROM councils")
def _(t):
    path = f"{shared_folder(t.spark)}/councils"
    writers.write_json_records(t.councils.drop("seq"), path)
    out = readers.read_councils(t.spark, path, lines=True)
    return out.select("name", "code", "licence_register_url", "scrape_successful", "last_scraped")


@query("s4_read_page_analyses", "SELECT url, page_id % 2 = 0 AS search_functionality, '/a;/b' AS urls FROM pages")
def _(t):
    path = f"{shared_folder(t.spark)}/analyses"
    analyses = t.table("pages").select(
        F.lit("x").alias("council_name"), "url", (F.col("page_id") % 2 == 0).alias("search_functionality"),
        F.array(F.lit("/a"), F.lit("/b")).alias("potential_licence_urls"),
    )
    writers.write_json_records(analyses, path)
    out = readers.read_page_analyses(t.spark, path, lines=True)
    return out.select("url", "search_functionality", F.array_join("potential_licence_urls", ";").alias("urls"))


@query("s8_s9_latest_snapshot", S.over(S.ENRICHED, "SELECT seq, premises_name, effective_ts FROM enriched"))
def _(t):
    path = shared_folder(t.spark)
    writers.write_snapshot(t.enriched.filter("seq % 2 = 0"), t.enriched.agg(F.count("*").alias("n")), path, "2001-06-23")
    writers.write_snapshot(t.enriched, t.enriched.agg(F.count("*").alias("n")), path, "2001-06-30")
    return readers.latest_partition(writers.read_snapshots(t.spark, path)).select("seq", "premises_name", "effective_ts")


@query("s10_append_batches", f"WITH {S.RAW} SELECT CAST(seq % 3 AS INTEGER) AS batch_id, count(*) AS n FROM raw GROUP BY 1")
def _(t):
    path = f"{shared_folder(t.spark)}/batches"
    for i in (0, 1, 2, 1):
        writers.append_batch(t.raw.filter(F.col("seq") % 3 == i), path, i)
    return t.spark.read.parquet(path).groupBy("batch_id").agg(F.count("*").alias("n"))


@query("s12_report_sheets", S.over(S.ENRICHED, COUNCIL_ANALYSIS))
def _(t):
    # Stored once: every sheet is a scan of its own.
    path, enriched = shared_folder(t.spark), kept(t.enriched)
    writers.write_sheets(reporting.full_report(enriched, as_of=AS_OF), path)
    return t.spark.read.parquet(f"{path}/council_analysis")


@query("l7_l8_process_and_report", S.over(S.ENRICHED, "SELECT seq, premises_name, business_type FROM enriched"))
def _(t):
    stored = runs.process_and_report(t.spark, t.raw, as_of=AS_OF, path=shared_folder(t.spark))
    return stored.select("seq", "premises_name", "business_type")


@query("s8_newest_of_log", S.over(S.ENRICHED, "SELECT seq, premises_name FROM enriched WHERE seq % 3 = 1"))
def _(t):
    path, enriched = shared_folder(t.spark), kept(t.enriched.select("seq", "premises_name"))
    # Committed last but older; then two of one time, of which the second counts.
    for name, at, rest in (("a", AS_OF, 0), ("b", AS_OF, 1), ("old", datetime(2001, 6, 1), 2)):
        snapshots.commit_snapshot(enriched.filter(F.col("seq") % 3 == rest), path, name, at=at)
    return snapshots.newest_snapshot(t.spark, path)


# What a reader of council sites says about their registers: a number in the name leads to the site of that number.
_SITE_NO = "regexp_extract(name, '([0-9]+)', 1)"
_ANSWER = f"CASE WHEN {_SITE_NO} <> '' THEN concat('The page is https://www.council', {_SITE_NO}, '.gov.uk/business/licensing, I think') ELSE 'NOT_FOUND' END AS answer"
_ANSWERED = f"CASE WHEN {_SITE_NO} LIKE '%9' THEN 404 ELSE 200 END AS status"
_FOUND = f"""discovered AS ({ORACLES['l4_discover_councils'].replace('SELECT council_key, name,', 'SELECT src_rank, ord_a, ord_b, council_key, name,', 1)}),
chosen AS (SELECT *, 'https://www.council' || {_SITE_NO} || '.gov.uk/business/licensing' AS licence_register_url FROM discovered WHERE {_SITE_NO} <> '' AND {_SITE_NO} NOT LIKE '%9')"""


def _raw_of(extracted):
    """Extracted licences as raw rows, then the stages of processing."""
    raw = f"""raw AS (SELECT row_number() OVER (ORDER BY {extracted[1]}) AS seq, NULL::VARCHAR AS licence_id, council_name, NULL::VARCHAR AS council_code, premises_name, premises_address, NULL::VARCHAR AS postcode,
  'new' AS licence_type, licence_status, NULL::TIMESTAMP AS application_date, NULL::TIMESTAMP AS granted_date, []::VARCHAR[] AS licensable_activities, []::VARCHAR[] AS conditions,
  NULL::VARCHAR AS designated_premises_supervisor, NULL::VARCHAR AS hours_text, url AS source_url, {S.AS_OF} AS scraped_at FROM ({extracted[0]}))"""
    return S.ENRICHED.replace(S.RAW, raw, 1)


_FULL = f"""{_FOUND}, {CASCADE}, {_raw_of((f"SELECT * FROM (SELECT DISTINCT ON (name, lower(premises_name), lower(premises_address)) name AS council_name, src_rank, ord_a, ord_b, c.* FROM chosen JOIN cascade c ON c.url = licence_register_url ORDER BY name, lower(premises_name), lower(premises_address), page_id)", "src_rank, ord_a, ord_b, page_id"))}"""


def _full_inputs(t):
    registers, directory, seeds = C.parse_register(t.register_files), C.parse_directory(t.directory_pages), readers.seed_councils(t.spark)
    names = kept(discovery.discover_councils(registers, directory, seeds).select("name"))
    answers = names.selectExpr("name", _ANSWERED, _ANSWER)
    pages = kept(t.register_pages)
    return {"registers": registers, "directory": directory, "seeds": seeds, "answers": answers, "pages": pages}


def _full_run(t, path, until=None):
    inputs = _full_inputs(t)
    when = {"as_of": AS_OF, "started": STARTED, "ended": ENDED, "path": path}
    for stop in (until, None) if until else (None,):
        try:
            return runs.full_run(t.spark, **inputs, card_answers=t.card_answers, text_answers=t.text_answers, **when, until=stop)
        except runs.Stopped:
            pass


@query("l8_full_run", f"WITH {_FULL} SELECT match_key, premises_name, premises_address, business_type, CAST(copies AS BIGINT) AS copies FROM enriched")
def _(t):
    # Stopped behind the extraction and started again.
    licences = _full_run(t, shared_folder(t.spark), until="extraction")
    return licences.select("match_key", "premises_name", "premises_address", "business_type", F.col("copies").cast("bigint").alias("copies"))


@query(
    "s11_run_summary",
    f"""WITH {_FULL}, results AS (SELECT name, count(premises_name) AS licences_found FROM chosen LEFT JOIN raw ON name = council_name GROUP BY 1)
SELECT 'full' AS run_type, TIMESTAMP '2001-06-30 08:00:00' AS start_time, TIMESTAMP '2001-06-30 09:30:15' AS end_time, (SELECT count(*) FROM discovered) AS councils_discovered, (SELECT count(*) FROM chosen) AS councils_with_registers,
  (SELECT count(*) FROM chosen JOIN orders ON licence_register_url = 'https://www.council' || o_custkey || '.gov.uk/business/licensing') AS successful_analyses, (SELECT count(*) FROM results) AS extraction_results,
  (SELECT count(*) FILTER (licences_found > 0) FROM results) AS successful_extractions, (SELECT count(*) FROM raw) AS total_licences_extracted, (SELECT count(*) FROM enriched) AS final_processed_licences, 2 AS reports_generated""",
)
def _(t):
    path = shared_folder(t.spark)
    _full_run(t, path)
    names = ["councils_discovered", "councils_with_registers", "successful_analyses", "extraction_results", "successful_extractions", "total_licences_extracted", "final_processed_licences", "reports_generated"]
    return runs.read_run_summaries(t.spark, path).select("run_type", "start_time", "end_time", *names)


_RECENT = f"coalesce(scrape_successful, false) AND last_scraped > {S.AS_OF} - INTERVAL 30 DAY AND coalesce(licence_register_url, '') <> ''"
_UPDATE = f"""{EXTRACTED.replace('edges AS (', f'picked AS (SELECT * FROM asked WHERE {_RECENT}), edges AS (', 1).replace('FROM asked WHERE', 'FROM picked WHERE').replace('FROM asked JOIN', 'FROM picked JOIN').replace('FROM picked WHERE coalesce(scrape', 'FROM asked WHERE coalesce(scrape', 1)}"""


@query("l7_incremental_update", f"WITH {_UPDATE}, {_raw_of(('SELECT council_name, premises_name, premises_address, licence_status, url, page_id FROM extracted', 'council_name, page_id'))} SELECT match_key, premises_name, premises_address, CAST(copies AS BIGINT) AS copies FROM enriched")
def _(t):
    path = shared_folder(t.spark)
    store = PageStore(f"{path}/pages", buckets=16)
    councils, analyses, pages = councils_with_cards(t), analyses_of(t), all_pages(t)
    # Every fourth page first has an old content, from which it is read once.
    old = F.when(F.col("page_id") % 4 == 0, F.replace("html", F.lit("Red Lion"), F.lit("Old Lion"))).otherwise(F.col("html"))
    answers = {"card_answers": t.card_answers, "text_answers": t.text_answers}
    store.fetched(pages.withColumn("html", old), 0)
    runs.incremental_update(t.spark, councils, analyses, store, version=0, as_of=AS_OF, path=f"{path}/first", **answers)
    store.fetched(pages.filter("page_id % 4 = 0"), 1)
    out = runs.incremental_update(t.spark, councils, analyses, store, version=1, as_of=AS_OF, path=f"{path}/second", **answers)
    return out.select("match_key", "premises_name", "premises_address", F.col("copies").cast("bigint").alias("copies"))


@query("t1_stream_ingest", S.over(S.VALID, "SELECT seq, premises_name, premises_address, postcode FROM valid"))
def _(t):
    path = shared_folder(t.spark)
    writers.write_json_records(_nested_results(t), f"{path}/in")
    stream = ingest.clean_stream(ingest.stream_results(t.spark, f"{path}/in", lines=True), as_of=AS_OF)
    ingest.run_to_files(stream, f"{path}/out", f"{path}/state")
    return t.spark.read.parquet(f"{path}/out").select("seq", "premises_name", "premises_address", "postcode")


@query("t2_stream_upsert", S.over(S.ENRICHED, "SELECT match_key, seq, premises_name, first_seq, copies, business_type FROM enriched"))
def _(t):
    path, raw = shared_folder(t.spark), t.raw
    raw.write.parquet(f"{path}/in")
    source = t.spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 3).parquet(f"{path}/in")
    # The few files of a batch are as many tasks; their rows are dealt to all cores before they are cleaned.
    source = source.repartition(t.spark.sparkContext.defaultParallelism)
    table = upsert.entity_table(f"{path}/best", buckets=16)
    upsert.run_upserts(clean.valid_licences(clean.clean_licences(source), as_of=AS_OF), table, f"{path}/state")
    out = upsert.current_entities(t.spark, table)
    return out.select("match_key", "seq", "premises_name", "first_seq", "copies", "business_type")


@query(
    "t3_suppress_repeats",
    f"WITH {S.RAW} SELECT DISTINCT council_name, lower({Q.strip('premises_name')}) AS name, lower({Q.strip('premises_address')}) AS address FROM raw",
)
def _(t):
    path = shared_folder(t.spark)
    t.raw.unionByName(t.raw.filter("seq % 2 = 0")).write.parquet(f"{path}/in")
    source = t.spark.readStream.schema(t.raw.schema).option("maxFilesPerTrigger", 5).parquet(f"{path}/in")
    ingest.run_to_files(ingest.suppress_repeats(source), f"{path}/out", f"{path}/state")
    key = lambda c: F.lower(F.trim(F.col(c)))
    return t.spark.read.parquet(f"{path}/out").select("council_name", key("premises_name").alias("name"), key("premises_address").alias("address"))


# Rows in three batches by their number, their times a day apart for each hundred of them; those of the last batch are late
# if they lie more than a week behind the latest of the first two.
_TIMED = f"""{S.RAW}, timed AS (SELECT council_name, lower({Q.strip('premises_name')}) AS name, lower({Q.strip('premises_address')}) AS address, seq, seq % 3 AS batch,
  TIMESTAMP '2001-01-01 00:00:00' + CAST((seq * 7919) % 20 AS INTEGER) * INTERVAL 1 DAY AS ts FROM raw),
marked AS (SELECT *, (SELECT max(ts) - INTERVAL 7 DAY FROM timed p WHERE p.batch < b.n) AS mark FROM timed JOIN (SELECT unnest([0, 1, 2]) AS n) b ON batch = n)"""


def _suppressed(t):
    path = shared_folder(t.spark)
    at = F.lit(datetime(2001, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(((F.col("seq") * 7919) % 20).cast("int"))
    rows = t.raw.withColumn("scraped_at", at)
    target = ingest.Suppressed(path, buckets=16)
    # The batches of a stream, each given twice as after a failure.
    for n in (0, 1, 1, 2):
        target.merge_batch(rows.filter(F.col("seq") % 3 == n), n)
    return target


@query("t3_late_counts", f"WITH {_TIMED} SELECT batch AS batch_id, count(*) FILTER (ts < mark) AS late_rows FROM marked GROUP BY 1")
def _(t):
    return _suppressed(t).counts(t.spark).select("batch_id", "late_rows")


# A key hides copies until a week behind its first row, by the watermark of the batches before.
_FIRST = f"""{_TIMED}, firsts AS (SELECT council_name, name, address, batch, any_value(mark) AS mark, arg_min(seq, (ts, seq)) AS seq, min(ts) AS ts FROM marked WHERE mark IS NULL OR ts >= mark GROUP BY ALL),
b0 AS (SELECT * FROM firsts WHERE batch = 0), b1 AS (SELECT * FROM firsts WHERE batch = 1), b2 AS (SELECT * FROM firsts WHERE batch = 2),
m1 AS (SELECT max(mark) AS m FROM marked WHERE batch = 1), m2 AS (SELECT max(mark) AS m FROM marked WHERE batch = 2),
s1 AS (SELECT * FROM b0 WHERE ts + INTERVAL 7 DAY >= (SELECT m FROM m1)), e1 AS (SELECT * FROM b1 ANTI JOIN s1 USING (council_name, name, address)),
s2 AS (SELECT * FROM (SELECT * FROM s1 UNION ALL SELECT * FROM e1) WHERE ts + INTERVAL 7 DAY >= (SELECT m FROM m2)), e2 AS (SELECT * FROM b2 ANTI JOIN s2 USING (council_name, name, address))"""


@query("t3_first_rows", f"WITH {_FIRST} SELECT seq FROM b0 UNION ALL SELECT seq FROM e1 UNION ALL SELECT seq FROM e2")
def _(t):
    return _suppressed(t).first(t.spark).select("seq")


_WEEKS = "SELECT date_trunc('week', ts)::TIMESTAMP AS week_start, date_trunc('week', ts)::TIMESTAMP + INTERVAL 7 DAY AS week_end, event_type, count(*) AS n FROM events GROUP BY ALL"


@query("t4_weekly_counts", _WEEKS)
def _(t):
    return weekly.weekly_counts(t.table("events"), "ts", "event_type")


@query("t4_stream_weekly_counts", _WEEKS)
def _(t):
    path = shared_folder(t.spark)
    # Files in the order of time, one a batch, so that early weeks leave the state while later ones come.
    t.table("events").repartitionByRange(4, "ts").write.parquet(f"{path}/in")
    source = t.spark.readStream.schema(t.table("events").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    table = weekly.week_table(f"{path}/weeks", "event_type")
    weekly.run_weeks(weekly.weekly_counts(source, "ts", "event_type", delay="60 days"), table, f"{path}/state")
    return table.read(t.spark).drop("bucket")
