"""Cleaning, validation, resolution, enrichment and the processing job."""

from pyspark.sql import functions as F

from checks import sql as Q
from checks import stages as S
from checks.registry import query
from checks.tables import AS_OF
from licensum.functions import scoring, text
from licensum.operators import clean, enrich, resolve
from licensum.plans import processing

joined = lambda c: F.array_join(c, ";").alias(c)
sql_joined = lambda c: f"array_to_string({c}, ';') AS {c}"


@query("c1_clean_text", f"SELECT doc_id, {Q.clean('text')} AS text FROM documents")
def _(t):
    return t.table("documents").select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query("c2_clean_address", f"WITH {S.RAW} SELECT seq, {Q.address('premises_address')} AS address FROM raw")
def _(t):
    return t.raw.select("seq", text.clean_address(F.col("premises_address")).alias("address"))


@query("c3_extract_postcode", f"WITH {S.RAW} SELECT seq, {Q.postcode('premises_address')} AS postcode FROM raw")
def _(t):
    return t.raw.select("seq", text.extract_postcode(F.col("premises_address")).alias("postcode"))


@query("c3_postcodes_in_documents", f"SELECT doc_id, {Q.postcode('text')} AS postcode FROM documents")
def _(t):
    return t.table("documents").select("doc_id", text.extract_postcode(F.col("text")).alias("postcode"))


@query("c4_clean_person_name", f"WITH {S.RAW} SELECT seq, {Q.person('designated_premises_supervisor')} AS name FROM raw")
def _(t):
    dps = F.col("designated_premises_supervisor")
    return t.raw.select("seq", F.when(dps.isNotNull(), text.clean_person_name(dps)).alias("name"))


@query("c4_title_case", f"SELECT doc_id, {Q.title('text')} AS text FROM documents")
def _(t):
    return t.table("documents").select("doc_id", text.title_case(F.col("text")).alias("text"))


@query("c5_clean_activities", f"WITH {S.RAW} SELECT seq, array_to_string({Q.activities('licensable_activities')}, ';') AS activities FROM raw")
def _(t):
    return t.raw.select("seq", F.array_join(text.clean_activities(F.col("licensable_activities")), ";").alias("activities"))


@query("c6_clean_conditions", f"WITH {S.RAW} SELECT seq, array_to_string({Q.conditions('conditions')}, ';') AS conditions FROM raw")
def _(t):
    return t.raw.select("seq", F.array_join(text.clean_conditions(F.col("conditions")), ";").alias("conditions"))


def _hours_text(c):
    return F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e.key, F.lit("="), e.value))), ";")


@query("c7_standardize_hours", f"WITH {S.RAW} SELECT seq, {Q.hours('hours_text')} AS hours FROM raw WHERE hours_text IS NOT NULL")
def _(t):
    rows = t.raw.filter("opening_hours IS NOT NULL")
    return rows.select("seq", _hours_text(text.standardize_hours(F.col("opening_hours"))).alias("hours"))


_CLEAN_COLUMNS = "seq, council_name, premises_name, premises_address, postcode, designated_premises_supervisor"


@query("c8_clean_licences", S.over(S.CLEANED, f"SELECT {_CLEAN_COLUMNS}, {sql_joined('licensable_activities')}, {sql_joined('conditions')} FROM cleaned"))
def _(t):
    cols = [*_CLEAN_COLUMNS.split(", "), joined("licensable_activities"), joined("conditions")]
    return clean.clean_licences(t.raw).select(*cols)


@query(
    "c8_clean_licences_keep_postcode",
    S.over(S.CLEANED, "SELECT cleaned.seq, coalesce(cleaned.postcode, raw.postcode) AS postcode FROM cleaned JOIN raw ON cleaned.seq = raw.seq"),
)
def _(t):
    return clean.clean_licences(t.raw, keep_supplied_postcode=True).select("seq", "postcode")


@query("c9_normalize_for_matching", f"SELECT doc_id, {Q.matching('text')} AS text FROM documents")
def _(t):
    return t.table("documents").select("doc_id", text.normalize_for_matching(F.col("text")).alias("text"))


@query("c10_postcode_area", S.over(S.ENRICHED, "SELECT seq, area FROM enriched"))
def _(t):
    return t.enriched.select("seq", text.postcode_area(F.col("postcode")).alias("area"))


@query(
    "c11_effective_date",
    f"WITH {S.RAW} SELECT seq, coalesce(granted_date, application_date, scraped_at) AS three, coalesce(granted_date, application_date) AS two FROM raw",
)
def _(t):
    g, a, s = (F.col(c) for c in ("granted_date", "application_date", "scraped_at"))
    return t.raw.select("seq", text.effective_date(g, a, s).alias("three"), text.effective_date(g, a).alias("two"))


@query("c12_week_bounds", "SELECT event_id, date_trunc('week', ts)::TIMESTAMP AS week_start, date_trunc('week', ts)::TIMESTAMP + INTERVAL 7 DAY AS week_end FROM events")
def _(t):
    ts = F.col("ts")
    return t.table("events").select("event_id", text.week_start(ts).alias("week_start"), text.week_end(ts).alias("week_end"))


@query(
    "c13_display_texts",
    r"""SELECT event_id, strftime(ts, '%Y-%m-%d') AS day,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') <> '000000' THEN '.' || strftime(ts, '%f') ELSE '' END AS iso FROM events""",
)
def _(t):
    return t.table("events").select("event_id", text.day_text(F.col("ts")).alias("day"), text.iso_text(F.col("ts")).alias("iso"))


_REASONS = ", ".join(f"CASE WHEN {r} THEN '{reason}' END" for reason, r in S.RULES)


@query(
    "v7_reject_reasons",
    S.over(S.CLEANED, f"SELECT seq, array_to_string(list_filter([{_REASONS}], lambda r: r IS NOT NULL), ';') AS reject_reasons FROM cleaned"),
)
def _(t):
    checked = clean.check_licences(clean.clean_licences(t.raw), as_of=AS_OF)
    return checked.select("seq", joined("reject_reasons"))


_RULE_IDS = ["v1_name", "v2_address", "v3_council", "v4_application_date", "v5_granted_date", "v6_junk_name"]


@query(
    "v1_v6_rule_counts",
    S.over(S.CLEANED, " UNION ALL ".join(f"SELECT '{reason}' AS reason, count(*) FILTER ({r}) AS n FROM cleaned" for reason, r in S.RULES)),
)
def _(t):
    reasons = [reason for reason, _ in S.RULES]
    checked = clean.check_licences(clean.clean_licences(t.raw), as_of=AS_OF)
    counts = checked.agg(*[F.count_if(F.array_contains("reject_reasons", r)).alias(r) for r in reasons])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(r).alias("reason"), F.col(f"`{r}`").alias("n")) for r in reasons])).alias("r")).select("r.*")


@query("v7_valid_licences", S.over(S.VALID, "SELECT seq, premises_name, premises_address, postcode FROM valid"))
def _(t):
    valid = clean.valid_licences(clean.clean_licences(t.raw), as_of=AS_OF)
    return valid.select("seq", "premises_name", "premises_address", "postcode")


@query("v7_quarantine", S.over(S.VALID, "SELECT seq, premises_name FROM cleaned WHERE seq NOT IN (SELECT seq FROM valid)"))
def _(t):
    return processing.quarantine(t.raw, as_of=AS_OF).select("seq", "premises_name")


_V8 = """SELECT raw.council_name, count(*) AS n FROM raw
JOIN (SELECT council_name AS cn, count(*) AS k FROM raw GROUP BY 1) c ON cn = council_name WHERE k % 3 <> 0 GROUP BY 1"""


@query("v8_licences_of_results", f"WITH {S.RAW} {_V8}")
def _(t):
    # Results nest at most one batch of licences, here those of one council and supervisor batch number.
    nested = t.raw.withColumn("batch", F.floor(F.col("seq") / 1000))
    sizes = t.raw.groupBy("council_name").agg((F.count("*") % 3 != 0).alias("success"))
    cols = ["seq", "licence_id", "council_name", "premises_name"]
    results = (
        nested.groupBy("council_name", "batch").agg(F.collect_list(F.struct(*cols)).alias("licences_extracted")).join(sizes, "council_name")
    )
    return clean.licences_of_results(results).groupBy("council_name").agg(F.count("*").alias("n"))


@query(
    "v9_effective_between",
    S.over(S.ENRICHED, "SELECT seq, effective_ts FROM enriched WHERE effective_ts >= TIMESTAMP '1998-01-05' AND effective_ts < TIMESTAMP '1998-02-02'"),
)
def _(t):
    from datetime import datetime

    return clean.effective_between(t.enriched, datetime(1998, 1, 5), datetime(1998, 2, 2)).select("seq", "effective_ts")


@query(
    "d1_drop_exact_copies",
    f"""WITH {S.RAW} SELECT seq, council_name, premises_name FROM (SELECT *, row_number() OVER (PARTITION BY council_name,
  lower({Q.strip('premises_name')}), lower({Q.strip('premises_address')}) ORDER BY seq) AS rn FROM raw) WHERE rn = 1""",
)
def _(t):
    return resolve.drop_exact_copies(t.raw).select("seq", "council_name", "premises_name")


@query("d2_match_key", S.over(S.RESOLVED, "SELECT seq, match_key FROM keyed"))
def _(t):
    valid = clean.valid_licences(clean.clean_licences(t.raw), as_of=AS_OF)
    return resolve.with_match_key(valid).select("seq", "match_key")


@query("d2_resolve_entities", S.over(S.RESOLVED, "SELECT match_key, seq, premises_name, first_seq, copies FROM resolved"))
def _(t):
    valid = clean.valid_licences(clean.clean_licences(t.raw), as_of=AS_OF)
    return resolve.resolve_entities(valid).select("match_key", "seq", "premises_name", "first_seq", "copies")


@query("d3_completeness_score", S.over(S.RESOLVED, "SELECT seq, CAST(score AS INTEGER) AS score FROM keyed"))
def _(t):
    valid = clean.valid_licences(clean.clean_licences(t.raw), as_of=AS_OF)
    return resolve.with_score(valid).select("seq", "score")


@query("e1_business_type", f"WITH {S.RAW} SELECT seq, {Q.business_type('premises_name', 'licensable_activities')} AS business_type FROM raw")
def _(t):
    return t.raw.select("seq", scoring.business_type(F.col("premises_name"), F.col("licensable_activities")).alias("business_type"))


@query("e2_categories", f"WITH {S.RAW} SELECT seq, array_to_string({Q.categories('licensable_activities')}, ';') AS categories FROM raw")
def _(t):
    return t.raw.select("seq", F.array_join(scoring.categories(F.col("licensable_activities")), ";").alias("categories"))


@query("e3_risk_score", S.over(S.ENRICHED, "SELECT seq, CAST(risk_score AS INTEGER) AS risk_score FROM enriched"))
def _(t):
    return t.enriched.select("seq", "risk_score")


@query(
    "e4_enrich_licences",
    S.over(S.CLEANED, f"""SELECT seq, business_type, CAST({Q.risk('business_type', 'licensable_activities', 'conditions')} AS INTEGER) AS risk_score,
  array_to_string({Q.categories('licensable_activities')}, ';') AS licence_categories
FROM (SELECT *, {Q.business_type('premises_name', 'licensable_activities')} AS business_type FROM cleaned)"""),
)
def _(t):
    out = enrich.enrich_licences(clean.clean_licences(t.raw))
    return out.select("seq", "business_type", "risk_score", joined("licence_categories"))


_FINAL = "seq, licence_id, council_name, premises_name, premises_address, postcode, licence_type, licence_status, effective_ts, business_type"


@query(
    "l1_process_licences",
    S.over(S.ENRICHED, f"SELECT {_FINAL}, CAST(risk_score AS INTEGER) AS risk_score, copies, {sql_joined('licensable_activities')}, {sql_joined('conditions')}, {sql_joined('licence_categories')} FROM enriched"),
)
def _(t):
    cols = [*_FINAL.split(", "), "risk_score", "copies"]
    return t.enriched.select(*cols, *map(joined, ("licensable_activities", "conditions", "licence_categories")))


@query(
    "o1_newest_first",
    S.over(S.ENRICHED, "SELECT seq, effective_ts FROM enriched ORDER BY effective_ts DESC, first_seq"),
)
def _(t):
    return processing.presented(t.enriched).select("seq", "effective_ts")


@query(
    "w1_first_per_key",
    f"WITH {S.RAW} SELECT council_name, licence_status, min(seq) AS seq FROM raw GROUP BY ALL",
)
def _(t):
    return resolve.first_per_key(t.raw, ["council_name", "licence_status"], ["seq"]).select("council_name", "licence_status", "seq")


@query(
    "w4_top_per_key",
    f"""WITH {S.RAW} SELECT council_name, rank, seq FROM (SELECT council_name, seq, CAST(row_number() OVER (PARTITION BY council_name
  ORDER BY application_date DESC, seq) AS INTEGER) AS rank FROM raw) WHERE rank <= 3""",
)
def _(t):
    return resolve.top_per_key(t.raw, ["council_name"], [F.col("application_date").desc(), "seq"], 3).select("council_name", "rank", "seq")
