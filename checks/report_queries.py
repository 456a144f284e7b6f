"""Report tables and run metrics."""

from datetime import datetime

from pyspark.sql import functions as F

from checks import stages as S
from checks.registry import ORACLES, query
from checks.tables import AS_OF, COUNCILS, RESULTS, duck
from licensum import vocab
from licensum.operators import facets, runs
from licensum.operators import reports as R
from licensum.plans import reporting


def over(select):
    return S.over(S.ENRICHED, select)


FIRST_MENTION = "min(seq * 256 + i)"
MOST_COMMON = "arg_max({x}, (n, -p))"


@query("a1_processing_summary", over("SELECT o AS original_count, f AS final_count, (o - f) / o AS reduction_rate FROM (SELECT (SELECT count(*) FROM raw) AS o, (SELECT count(*) FROM enriched) AS f)"))
def _(t):
    return R.processing_summary(t.raw, t.enriched)


@query("a2_council_counts", over("SELECT council_name, count(*) AS n FROM enriched GROUP BY 1"))
def _(t):
    return R.council_counts(t.enriched)


@query("a3_business_type_counts", over("SELECT business_type, count(*) AS n FROM enriched GROUP BY 1"))
def _(t):
    return R.business_type_counts(t.enriched)


@query("a4_status_counts", over("SELECT licence_status, count(*) AS n FROM enriched GROUP BY 1"))
def _(t):
    return R.status_counts(t.enriched)


@query("a5_date_range", over("SELECT min(d) AS earliest, max(d) AS latest, CAST(epoch(max(d) - min(d)) // 86400 AS BIGINT) AS span_days FROM (SELECT coalesce(granted_date, application_date) AS d FROM enriched)"))
def _(t):
    return R.date_range(t.enriched)


@query("a6_top_activities", over(f"SELECT activity, count(*) AS n FROM mentions GROUP BY 1 ORDER BY n DESC, {FIRST_MENTION} LIMIT 10"))
def _(t):
    return R.activity_counts(t.enriched)


def _domain(values, column, table):
    return " UNION ALL ".join(f"SELECT '{v}' AS {column}, count(*) FILTER ({column} = '{v}') AS n FROM {table}" for v in values)


@query("a7_type_counts", over(_domain(vocab.LICENCE_TYPES, "licence_type", "week")))
def _(t):
    return R.type_counts(R.week_of(t.enriched, AS_OF))


@query("a8_status_counts_filled", over(_domain(vocab.LICENCE_STATUSES, "licence_status", "week")))
def _(t):
    return R.status_counts_filled(R.week_of(t.enriched, AS_OF))


@query("a9_top_councils", over("SELECT council_name, count(*) AS n FROM enriched GROUP BY 1 ORDER BY n DESC, min(seq) LIMIT 10"))
def _(t):
    return R.top_councils(t.enriched)


WEEK_FLAG = f"(effective_ts >= {S.WEEK} AND effective_ts < {S.WEEK} + INTERVAL 7 DAY)"
STATS = f"""SELECT a AS total_licences, w AS new_licences, CASE WHEN a > w THEN (w - (a - w)) / (a - w) * 100 ELSE 0.0 END AS weekly_change_percent,
  unique_postcodes, coalesce(acts, 0.0) AS avg_activities_per_licence, premises_with_conditions, premises_with_hours, coalesce(risk, 5.0) AS avg_risk_score, high_risk_premises
FROM (SELECT count(*) AS a, count(*) FILTER ({WEEK_FLAG}) AS w, count(DISTINCT postcode) FILTER ({WEEK_FLAG} AND postcode <> '') AS unique_postcodes,
  avg(len(licensable_activities)) FILTER ({WEEK_FLAG}) AS acts, count(*) FILTER ({WEEK_FLAG} AND len(conditions) > 0) AS premises_with_conditions,
  count(*) FILTER ({WEEK_FLAG} AND hours_text IS NOT NULL) AS premises_with_hours, avg(risk_score) FILTER ({WEEK_FLAG}) AS risk,
  count(*) FILTER ({WEEK_FLAG} AND risk_score >= 8) AS high_risk_premises FROM enriched)"""


@query("a10_weekly_stats", over(STATS))
def _(t):
    return R.weekly_stats(t.enriched, as_of=AS_OF)


@query(
    "a10_weekly_trend",
    over("""SELECT a.week_start, a.n, coalesce(b.n, 0) AS previous, (a.n - b.n) / b.n * 100 AS change_percent
FROM (SELECT date_trunc('week', effective_ts)::TIMESTAMP AS week_start, count(*) AS n FROM enriched GROUP BY 1) a
LEFT JOIN (SELECT date_trunc('week', effective_ts)::TIMESTAMP + INTERVAL 7 DAY AS week_start, count(*) AS n FROM enriched GROUP BY 1) b ON a.week_start = b.week_start"""),
)
def _(t):
    return R.weekly_trend(t.enriched)


@query(
    "a11_weekly_header",
    over(f"""SELECT {S.WEEK} AS period_start, {S.WEEK} + INTERVAL 7 DAY AS period_end, count(*) AS total_licences, count(*) FILTER ({WEEK_FLAG}) AS new_licences,
  count(DISTINCT council_name) AS councils_scraped, count(DISTINCT council_name) FILTER (council_name <> '') AS councils_successful FROM enriched"""),
)
def _(t):
    return R.weekly_header(t.enriched, as_of=AS_OF)


_EXEC = [
    ("New Licences This Week", "new_licences"),
    ("Total Licences in Database", "total_licences"),
    ("Councils Monitored", "(SELECT count(DISTINCT council_name) FROM enriched)"),
    ("Weekly Change", "weekly_change_percent"),
    ("Average Activities per Licence", "avg_activities_per_licence"),
    ("Premises with Operating Conditions", "premises_with_conditions"),
    ("High Risk Premises (Score ≥8)", "high_risk_premises"),
    ("Average Risk Score", "avg_risk_score"),
]


@query(
    "a12_executive_summary",
    over(
        " UNION ALL ".join(
            f"SELECT 'metrics' AS section, {i} AS ord, '{label}' AS metric, CAST({c} AS DOUBLE) AS value FROM ({STATS})"
            for i, (label, c) in enumerate(_EXEC, 1)
        )
        + """ UNION ALL SELECT 'top_councils', CAST(row_number() OVER (ORDER BY n DESC, p) AS INTEGER), council_name, CAST(n AS DOUBLE)
FROM (SELECT council_name, count(*) AS n, min(seq) AS p FROM week GROUP BY 1 ORDER BY n DESC, p LIMIT 5)"""
    ),
)
def _(t):
    return R.executive_summary(t.enriched, as_of=AS_OF)


def _share(table):
    return f"SELECT business_type, count(*) AS n, count(*) / (SELECT count(*) FROM {table}) * 100 AS percentage FROM {table} GROUP BY 1"


@query("a13_weekly_business_types", over(_share("week")))
def _(t):
    return R.weekly_business_type_share(t.enriched, as_of=AS_OF)


@query("a13_business_types", over(_share("enriched")))
def _(t):
    return R.business_type_share(t.enriched)


@query(
    "a14_weekly_top_activities",
    over(f"SELECT activity, count(*) AS n, count(*) || ' premises' AS premises FROM mentions WHERE {WEEK_FLAG} GROUP BY 1 ORDER BY n DESC, {FIRST_MENTION} LIMIT 10"),
)
def _(t):
    return R.weekly_top_activities(t.enriched, as_of=AS_OF)


@query(
    "a15_trends",
    over(f"""SELECT 'Licences per Week' AS metric, CAST(count(*) FILTER ({WEEK_FLAG}) AS DOUBLE) AS this_week, CAST(CASE WHEN count(*) > 52 THEN count(*) // 52 ELSE count(*) END AS DOUBLE) AS all_time FROM enriched
UNION ALL SELECT 'Average Risk Score', coalesce(avg(risk_score) FILTER ({WEEK_FLAG}), 0.0), avg(risk_score) FROM enriched
UNION ALL SELECT 'Avg Activities per Licence', coalesce(avg(len(licensable_activities)) FILTER ({WEEK_FLAG}), 0.0), avg(len(licensable_activities)) FROM enriched"""),
)
def _(t):
    return R.trends(t.enriched, as_of=AS_OF)


@query(
    "a16_dataset_summary",
    over("""SELECT count(*) AS total_licences, count(DISTINCT council_name) AS councils_covered, count(DISTINCT postcode) AS unique_postcodes,
  strftime(min(coalesce(granted_date, application_date)), '%Y-%m-%d') || ' to ' || strftime(max(coalesce(granted_date, application_date)), '%Y-%m-%d') AS date_range FROM enriched"""),
)
def _(t):
    return R.dataset_summary(t.enriched)


COUNCIL_ANALYSIS = f"""SELECT council_name, count(*) AS total_licences, count(*) FILTER (licence_status = 'granted') AS granted,
  count(*) FILTER (licence_status = 'pending') AS pending, count(DISTINCT business_type) AS unique_business_types, avg(risk_score) AS avg_risk_score,
  count(*) FILTER (len(conditions) > 0) AS with_conditions, count(*) FILTER (granted_date > {S.AS_OF} - INTERVAL 30 DAY) AS recent_activity FROM enriched GROUP BY 1"""


@query("l1_a17_council_analysis", over(COUNCIL_ANALYSIS))
def council_analysis(t):
    return R.council_analysis(t.enriched, as_of=AS_OF)


@query(
    "a18_business_type_analysis",
    over("""SELECT b.*, coalesce(m.act, 'None') AS most_common_activity FROM (SELECT business_type, count(*) AS n, avg(risk_score) AS avg_risk_score,
  avg(len(conditions)) AS avg_conditions, count(DISTINCT area) AS geographic_areas, count(*) / (SELECT count(*) FROM enriched) * 100 AS percentage FROM enriched GROUP BY 1) b
LEFT JOIN (SELECT business_type, arg_max(activity, (n, -p)) AS act FROM (SELECT business_type, activity, count(*) AS n, min(seq * 256 + i) AS p FROM mentions GROUP BY 1, 2) GROUP BY 1) m
ON b.business_type = m.business_type"""),
)
def _(t):
    return R.business_type_analysis(t.enriched)


@query(
    "a19_activity_analysis",
    over("""SELECT b.*, m.bt AS most_common_business_type FROM (SELECT activity, count(*) AS n, avg(risk_score) AS avg_risk_score, count(DISTINCT council_name) AS councils,
  count(DISTINCT business_type) AS business_types, count(*) / (SELECT count(*) FROM mentions) * 100 AS percentage FROM mentions GROUP BY 1) b
JOIN (SELECT activity, arg_max(business_type, (n, -p)) AS bt FROM (SELECT activity, business_type, count(*) AS n, min(seq) AS p FROM mentions GROUP BY 1, 2) GROUP BY 1) m ON b.activity = m.activity"""),
)
def _(t):
    return R.activity_analysis(t.enriched)


@query(
    "a20_geographic_analysis",
    over("""SELECT b.*, m.bt AS most_common_business_type, a.unique_activities FROM (SELECT area AS postcode_area, count(*) AS n, avg(risk_score) AS avg_risk_score,
  count(DISTINCT council_name) AS councils, count(DISTINCT business_type) AS business_types FROM enriched WHERE area IS NOT NULL GROUP BY 1) b
JOIN (SELECT area, arg_max(business_type, (n, -p)) AS bt FROM (SELECT area, business_type, count(*) AS n, min(seq) AS p FROM enriched GROUP BY 1, 2) GROUP BY 1) m ON postcode_area = m.area
JOIN (SELECT area, count(DISTINCT activity) AS unique_activities FROM mentions GROUP BY 1) a ON postcode_area = a.area"""),
)
def _(t):
    return R.geographic_analysis(t.enriched)


@query(
    "a21_most_common_per_group",
    """SELECT user_id, arg_max(event_type, (n, -p)) AS most_common, max(n) AS n
FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS p FROM events GROUP BY 1, 2) GROUP BY 1""",
)
def _(t):
    return facets.most_common_per_group(t.table("events").withColumn("seq", F.col("event_id")), "user_id", "event_type")


@query(
    "s15_licence_listing",
    over("""SELECT council_name AS council, premises_name, premises_address AS address, coalesce(postcode, '') AS postcode, business_type, licence_type, licence_status AS status,
  coalesce(strftime(application_date, '%Y-%m-%d'), '') AS application_date, coalesce(strftime(granted_date, '%Y-%m-%d'), '') AS granted_date,
  array_to_string(licensable_activities[1:3], ', ') || CASE WHEN len(licensable_activities) > 3 THEN '...' ELSE '' END AS activities, CAST(risk_score AS INTEGER) AS risk_score,
  coalesce(designated_premises_supervisor, '') AS dps, CAST(len(conditions) AS INTEGER) AS conditions_count, coalesce(source_url, '') AS source_url FROM enriched"""),
)
def _(t):
    return R.licence_listing(t.enriched)


@query("s15_no_licences_message", over("SELECT 'No new licences found for this period' AS message WHERE NOT EXISTS (SELECT 1 FROM enriched WHERE effective_ts >= TIMESTAMP '1990-01-01' AND effective_ts < TIMESTAMP '1990-01-08')"))
def _(t):
    return R.no_licences_message(R.week_of(t.enriched, datetime(1990, 1, 3)))


@query(
    "s14_raw_export",
    over("""SELECT licence_id, council_name AS council, coalesce(council_code, '') AS council_code, premises_name, premises_address AS address, coalesce(postcode, '') AS postcode, business_type,
  licence_type, licence_status AS status, strftime(application_date, '%Y-%m-%dT%H:%M:%S') AS application_date, coalesce(strftime(granted_date, '%Y-%m-%dT%H:%M:%S'), '') AS granted_date,
  '' AS effective_date, array_to_string(licensable_activities, '|') AS activities, '' AS alcohol_hours, coalesce(designated_premises_supervisor, '') AS dps, '' AS dps_licence_number,
  array_to_string(conditions, '|') AS conditions, '' AS variations, CAST(risk_score AS INTEGER) AS risk_score, array_to_string(licence_categories, '|') AS licence_categories,
  coalesce(source_url, '') AS source_url, strftime(scraped_at, '%Y-%m-%dT%H:%M:%S') AS scraped_at FROM enriched"""),
)
def _(t):
    # Opening hours are JSON of a map, whose order the twin does not know; c7 compares them.
    return R.raw_export(t.enriched).drop("opening_hours")


def _twin(name, table="enriched"):
    """The text of a twin above without its stages, over all licences or those of the week."""
    return ORACLES[name].removeprefix(over("").strip()).replace("FROM enriched", f"FROM {table}")


def _fields(sheets):
    """Every field of every sheet: of a row as JSON, each key with its value as text or number."""

    def one(sheet, select):
        item = f"j ->> '{reporting.ROW_NAMES[sheet]}'" if sheet in reporting.ROW_NAMES else "CAST(NULL AS VARCHAR)"
        return f"SELECT '{sheet}' AS sheet, {item} AS item, unnest(json_keys(j)) AS field, j FROM (SELECT to_json(r) AS j FROM ({select}) AS r)"

    cells = " UNION ALL ".join(one(sheet, select) for sheet, select in sheets.items())
    value = "json_extract(j, '$.\"' || field || '\"')"
    return over(f"""SELECT sheet, item, field, CASE WHEN t = 'VARCHAR' THEN v ->> '$' END AS text, CASE WHEN t IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(v AS DOUBLE) END AS number
FROM (SELECT *, {value} AS v, json_type({value}) AS t FROM ({cells}))""")


@query(
    "l2_weekly_report",
    _fields(
        {
            "header": _twin("a11_weekly_header"),
            "summary_stats": _twin("a10_weekly_stats"),
            "executive_summary": _twin("a12_executive_summary"),
            "new_licences": _twin("s15_licence_listing", "week"),
            "new_licences_message": "SELECT 'No new licences found for this period' AS message WHERE NOT EXISTS (SELECT 1 FROM week)",
            "licences_by_type": _twin("a7_type_counts"),
            "licences_by_status": _twin("a8_status_counts_filled"),
            "top_councils": _twin("a9_top_councils", "week"),
            "business_types": _twin("a13_weekly_business_types"),
            "top_activities": _twin("a14_weekly_top_activities"),
            "trends": _twin("a15_trends"),
            "weekly_trend": _twin("a10_weekly_trend"),
        }
    ),
)
def _(t):
    return reporting.report_fields(reporting.weekly_report(t.enriched, as_of=AS_OF))


@query(
    "l3_full_report",
    _fields(
        {
            "licences": _twin("s15_licence_listing"),
            "summary": _twin("a16_dataset_summary"),
            "business_types": _twin("a13_business_types"),
            "council_analysis": _twin("l1_a17_council_analysis"),
            "business_type_analysis": _twin("a18_business_type_analysis"),
            "activity_analysis": _twin("a19_activity_analysis"),
            "geographic_analysis": _twin("a20_geographic_analysis"),
            "raw_export": _twin("s14_raw_export"),
        }
    ),
)
def _(t):
    # Opening hours are JSON of a map, whose order the twin does not know; c7 compares them.
    return reporting.report_fields(reporting.full_report(t.enriched, as_of=AS_OF)).filter("field <> 'opening_hours'")


@query(
    "a1_a6_processing_report",
    _fields(
        {
            "totals": _twin("a1_processing_summary"),
            "councils": _twin("a2_council_counts"),
            "business_types": _twin("a3_business_type_counts"),
            "licence_statuses": _twin("a4_status_counts"),
            "date_range": _twin("a5_date_range"),
            "top_activities": _twin("a6_top_activities"),
        }
    ),
)
def _(t):
    return reporting.report_fields(reporting.processing_report(t.raw, t.enriched))


# --- Run metrics ---
STARTED, ENDED = datetime(2001, 6, 30, 8, 0, 0), datetime(2001, 6, 30, 9, 30, 15)
COUNCIL_CTE = f"councils AS ({duck(COUNCILS)})"
RESULT_CTE = f"results AS ({duck(RESULTS)})"
ANALYSIS = "SELECT page_id, page_id % 3 <> 0 AS licence_register_found, page_id % 5 = 0 AS javascript_required FROM {pages}"


def _analyses(t):
    return t.derived(ANALYSIS)


_EXTRACTION = """count(*) AS extraction_results, count(*) FILTER (success) AS successful_extractions, CAST(sum(licences_found) AS BIGINT) AS total_licences_extracted,
  avg(scraping_duration) FILTER (scraping_duration > 0) AS avg_extraction_time, sum(scraping_duration) FILTER (scraping_duration > 0) AS total_extraction_time"""
_QUALITY = """count(*) AS final_processed_licences, count(*) FILTER (coalesce(postcode, '') <> '') AS licences_with_postcodes,
  avg(CASE WHEN coalesce(postcode, '') <> '' THEN 1 ELSE 0 END) AS postcode_completion_rate, avg(len(licensable_activities)) AS avg_activities_per_licence,
  count(*) FILTER (len(conditions) > 0) AS licences_with_conditions"""


@query(
    "a22_run_summary",
    S.over(
        f"{S.ENRICHED}, {COUNCIL_CTE}, {RESULT_CTE}",
        f"""SELECT 'full' AS run_type, TIMESTAMP '2001-06-30 08:00:00' AS start_time, TIMESTAMP '2001-06-30 09:30:15' AS end_time, CAST(5415 AS DOUBLE) AS duration_seconds,
  5415 / 60 AS duration_minutes, c.*, a.*, r.*, q.*, 2 AS reports_generated
FROM (SELECT count(*) AS councils_discovered, count(*) FILTER (coalesce(licence_register_url, '') <> '') AS councils_with_registers FROM councils) c,
  (SELECT count(*) FILTER (page_id % 3 <> 0) AS successful_analyses FROM pages) a, (SELECT {_EXTRACTION} FROM results) r, (SELECT {_QUALITY} FROM enriched) q""",
    ),
)
def _(t):
    return runs.run_summary(t.councils, _analyses(t), t.results, t.enriched, started=STARTED, ended=ENDED)


@query(
    "a23_discovery_metrics",
    f"WITH {COUNCIL_CTE} SELECT count(*) AS councils_discovered, count(*) FILTER (coalesce(licence_register_url, '') <> '') AS councils_with_registers, count(*) FILTER (scrape_successful) AS councils_successful FROM councils",
)
def _(t):
    return runs.council_metrics(t.councils)


@query("a23_analysis_metrics", f"SELECT count(*) AS analyses, count(*) FILTER (licence_register_found) AS successful_analyses, count(*) FILTER (javascript_required) AS javascript_required FROM ({duck(ANALYSIS)})")
def _(t):
    return runs.analysis_metrics(_analyses(t))


@query(
    "a23_extraction_metrics",
    f"WITH {RESULT_CTE} SELECT 'extraction_only' AS step, TIMESTAMP '2001-06-30 08:00:00' AS start_time, CAST(5415 AS DOUBLE) AS duration, {_EXTRACTION} FROM results",
)
def _(t):
    return runs.step_summary("extraction_only", runs.extraction_metrics(t.results), started=STARTED, ended=ENDED)


@query(
    "a24_data_health",
    f"""WITH {COUNCIL_CTE} SELECT *, CASE WHEN age > 168 THEN 'Data is over 1 week old, consider running incremental update' ELSE '' END AS recommendations,
  CASE WHEN age > 168 THEN 'unhealthy' ELSE 'degraded' END AS system_status, age AS latest_data_age_hours FROM (
  SELECT count(*) AS councils_discovered, count(*) FILTER (last_scraped > {S.AS_OF} - INTERVAL 7 DAY) AS recently_scraped_councils,
  (SELECT count(*) FROM events) AS processed_data_files, (SELECT count(*) FROM events WHERE event_type = 'click') AS report_files, (SELECT epoch_us(TIMESTAMP '2024-02-10 00:00:00') - epoch_us(max(ts)) FROM events) / 1000000 / 3600 AS age FROM councils)""".replace(
        "SELECT *, CASE", "SELECT councils_discovered, recently_scraped_councils, processed_data_files, report_files, CASE"
    ).replace(S.AS_OF, "TIMESTAMP '2024-02-10 00:00:00'"),
)
def _(t):
    events = t.table("events")
    files = [F.col("event_id").cast("string").alias("path"), F.col("ts").alias("modified")]
    snapshots, reports = events.select(*files), events.filter("event_type = 'click'").select(*files)
    components = events.select("event_type", F.when(F.col("event_type") == "error", "error: timeout").otherwise("exists").alias("status"))
    out = runs.data_health(t.councils, snapshots, components, as_of=datetime(2024, 2, 10), reports=reports)
    return out.withColumn("recommendations", F.array_join("recommendations", ";"))


@query("a25_quality_metrics", over(f"SELECT {_QUALITY} FROM enriched"))
def _(t):
    return runs.quality_metrics(t.enriched)
