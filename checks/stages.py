"""Common table expressions of the licence job for DuckDB: raw -> cleaned -> valid -> resolved -> enriched."""

from checks import sql as Q
from checks.tables import RAW_LICENCES, duck

AS_OF = "TIMESTAMP '2001-06-30 00:00:00'"
WEEK = "TIMESTAMP '2001-06-25 00:00:00'"

KEPT = "seq, licence_id, council_name, council_code, licence_type, licence_status, application_date, granted_date, hours_text, source_url, scraped_at"

RAW = f"raw AS ({duck(RAW_LICENCES)})"
CLEANED = f"""{RAW}, addressed AS (SELECT * REPLACE ({Q.address('premises_address')} AS premises_address) FROM raw),
cleaned AS (SELECT {KEPT}, {Q.clean('premises_name')} AS premises_name, premises_address,
  {Q.postcode('premises_address')} AS postcode, {Q.activities('licensable_activities')} AS licensable_activities,
  {Q.conditions('conditions')} AS conditions, {Q.person('designated_premises_supervisor')} AS designated_premises_supervisor FROM addressed)"""
RULES = [
    ("Invalid premises name", "length(premises_name) < 3"),
    ("Invalid premises address", "length(premises_address) < 10"),
    ("Missing council name", "coalesce(council_name, '') = ''"),
    ("Invalid application date (too far in future)", f"coalesce(application_date > {AS_OF} + INTERVAL 30 DAY, false)"),
    ("Invalid granted date (too far in future)", f"coalesce(granted_date > {AS_OF} + INTERVAL 30 DAY, false)"),
    ("Premises name appears to be navigation/error text", Q.junk("premises_name")),
]
VALID = f"""{CLEANED}, valid AS (SELECT * FROM cleaned WHERE {' AND '.join(f'NOT ({r})' for _, r in RULES)})"""
MATCH_KEY = f"{Q.matching('premises_name')} || '|' || CASE WHEN coalesce(postcode, '') <> '' THEN postcode ELSE {Q.matching('premises_address')} END"
RESOLVED = f"""{VALID}, keyed AS (SELECT *, {MATCH_KEY} AS match_key, {Q.score()} AS score FROM valid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY match_key ORDER BY score DESC, seq) AS rn,
  min(seq) OVER (PARTITION BY match_key) AS first_seq, count(*) OVER (PARTITION BY match_key) AS copies FROM keyed),
resolved AS (SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1)"""
ENRICHED = f"""{RESOLVED}, typed AS (SELECT *, {Q.business_type('premises_name', 'licensable_activities')} AS business_type FROM resolved),
enriched AS (SELECT *, {Q.categories('licensable_activities')} AS licence_categories,
  {Q.risk('business_type', 'licensable_activities', 'conditions')} AS risk_score,
  coalesce(granted_date, application_date, scraped_at) AS effective_ts,
  CASE WHEN coalesce(postcode, '') <> '' THEN CASE WHEN contains(postcode, ' ') THEN split_part(postcode, ' ', 1) ELSE left(postcode, 3) END END AS area FROM typed),
week AS (SELECT * FROM enriched WHERE effective_ts >= {WEEK} AND effective_ts < {WEEK} + INTERVAL 7 DAY),
mentions AS (SELECT * EXCLUDE (act, i), act AS activity, i FROM (SELECT *, unnest(licensable_activities) AS act, generate_subscripts(licensable_activities, 1) AS i FROM enriched))"""


def over(stage: str, select: str) -> str:
    return f"WITH {stage}\n{select}"
