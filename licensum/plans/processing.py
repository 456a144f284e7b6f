"""From raw licence rows to resolved, enriched licences."""

from pyspark.sql import DataFrame

from licensum.operators.clean import clean_licences, evaluated, licences_of_results, numbered, quarantined_licences, valid_licences
from licensum.operators.enrich import enrich_licences
from licensum.operators.resolve import newest_first, resolve_entities


def process_licences(raw: DataFrame, *, as_of, keep_supplied_postcode: bool = False) -> DataFrame:
    """Clean, validate, resolve and enrich. One shuffle, by premises, of rows already reduced in the map tasks."""
    cleaned = clean_licences(raw, keep_supplied_postcode=keep_supplied_postcode)
    return enrich_licences(resolve_entities(valid_licences(cleaned, as_of=as_of)))


def process_results(results: DataFrame, *, as_of, **options) -> DataFrame:
    """As :func:`process_licences`, from extraction results with nested licences."""
    return process_licences(numbered(licences_of_results(results)), as_of=as_of, **options)


def presented(licences: DataFrame) -> DataFrame:
    """Newest first. The only global sort, for output that people read."""
    return newest_first(licences)


def quarantine(raw: DataFrame, *, as_of) -> DataFrame:
    """Rows the validation rejects, with every reason."""
    return quarantined_licences(evaluated(clean_licences(raw)), as_of=as_of)
