"""Cleaning and validation of licence rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from licensum import vocab
from licensum.functions import text


def clean_licences(licences: DataFrame, *, keep_supplied_postcode: bool = False) -> DataFrame:
    """Clean names, addresses, people, activities, conditions and hours in one projection.

    The postcode is taken from the cleaned address. ``keep_supplied_postcode`` falls back to the given one when the
    address has none. Columns that the input does not have are left out.
    """
    address = text.clean_address(F.col("premises_address"))
    found = text.extract_postcode(F.col("premises_address"))
    dps = F.col("designated_premises_supervisor")
    cleaned = {
        "premises_name": text.clean_text(F.col("premises_name")),
        "premises_address": address,
        "designated_premises_supervisor": F.when(text.truthy(dps), text.clean_person_name(dps)).otherwise(dps),
        "licensable_activities": text.clean_activities(F.col("licensable_activities")),
        "conditions": text.clean_conditions(F.col("conditions")),
        "opening_hours": text.standardize_hours(F.col("opening_hours")),
        "alcohol_hours": text.standardize_hours(F.col("alcohol_hours")),
    }
    present = {name: expr for name, expr in cleaned.items() if name in licences.columns}
    keep = keep_supplied_postcode and "postcode" in licences.columns
    # The postcode is read from the address in a second projection, so that the address is cleaned once.
    return licences.withColumns(present).withColumn("postcode", F.coalesce(found, F.col("postcode")) if keep else found)


def evaluated(df: DataFrame) -> DataFrame:
    """The same rows with all columns computed at this point, once per row.

    Spark moves a filter in front of the projection it reads from and there repeats the expressions behind the columns.
    A generator stops that. To be put between costly derived columns and a filter on them.
    """
    return df.select(F.inline_outer(F.array(F.struct(*df.columns))))


def _rules(as_of, junk_words) -> list[tuple[str, Column]]:
    """(reason, condition under which a row is rejected)"""
    name, address = F.col("premises_name"), F.col("premises_address")
    latest = text.as_ntz(as_of) + F.expr("INTERVAL 30 DAYS")
    long_enough = lambda c, n: F.coalesce(F.length(text.strip(c)) >= n, F.lit(False))
    return [
        ("Invalid premises name", ~long_enough(name, 3)),
        ("Invalid premises address", ~long_enough(address, 10)),
        ("Missing council name", ~text.truthy(F.col("council_name"))),
        ("Invalid application date (too far in future)", F.col("application_date") > latest),
        ("Invalid granted date (too far in future)", F.col("granted_date") > latest),
        ("Premises name appears to be navigation/error text", text.contains_any(F.lower(name), junk_words)),
    ]


def check_licences(licences: DataFrame, *, as_of, junk_words=vocab.JUNK_NAME_WORDS) -> DataFrame:
    """Add ``reject_reasons``: every rule the row breaks, in rule order; empty for a valid row."""
    reasons = F.array(*[F.when(broken, F.lit(reason)) for reason, broken in _rules(as_of, junk_words)])
    return licences.withColumn("reject_reasons", F.filter(reasons, lambda r: r.isNotNull()))


def valid_licences(licences: DataFrame, *, as_of, junk_words=vocab.JUNK_NAME_WORDS) -> DataFrame:
    """Rows that break no rule. Their columns are computed before the rules are applied."""
    broken = [F.coalesce(b, F.lit(False)) for _, b in _rules(as_of, junk_words)]
    licences = evaluated(licences)
    for b in broken:
        licences = licences.filter(~b)
    return licences


def quarantined_licences(licences: DataFrame, **rules) -> DataFrame:
    """Rows that break at least one rule, with the reasons."""
    return check_licences(licences, **rules).filter(F.size("reject_reasons") > 0)


def licences_of_results(results: DataFrame) -> DataFrame:
    """Flatten successful extraction results into licence rows."""
    kept = results.filter(F.col("success") & text.filled(F.col("licences_extracted")))
    return kept.select(F.explode("licences_extracted").alias("licence")).select("licence.*")


def numbered(licences: DataFrame) -> DataFrame:
    """Number rows that carry no ``seq`` in reading order.

    To be used right after a scan: the number is made before any shuffle, so a repeated task gives the same numbers.
    """
    n = F.monotonically_increasing_id()
    return licences.withColumn("seq", F.coalesce("seq", n) if "seq" in licences.columns else n)


def effective_between(licences: DataFrame, start, end) -> DataFrame:
    """Rows whose effective date lies in ``[start, end)``; a stored ``effective_ts`` is used when there is one."""
    if "effective_ts" in licences.columns:
        when = F.col("effective_ts")
    else:
        when = text.effective_date(F.col("granted_date"), F.col("application_date"), F.col("scraped_at"))
    return licences.filter((when >= text.as_ntz(start)) & (when < text.as_ntz(end)))
