"""Declared schemas of the register entities. Readers always use these; nothing is inferred."""

from pyspark.sql import types as T

_S, _B, _I, _L, _D, _TS = (
    T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampNTZType(),
)
_STRINGS = T.ArrayType(_S)
_HOURS = T.MapType(_S, _S)
_LINK = T.StructType([T.StructField("text", _S), T.StructField("url", _S)])


def _struct(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


COUNCIL = _struct(
    ("name", _S), ("code", _S), ("website_url", _S), ("licence_register_url", _S), ("contact_email", _S),
    ("region", _S), ("created_at", _TS), ("last_scraped", _TS), ("scrape_successful", _B), ("error_message", _S),
)

LICENCE = _struct(
    ("licence_id", _S), ("council_name", _S), ("council_code", _S), ("premises_name", _S),
    ("premises_address", _S), ("postcode", _S), ("licence_type", _S), ("licence_status", _S),
    ("application_date", _TS), ("granted_date", _TS), ("effective_date", _TS),
    ("licensable_activities", _STRINGS), ("opening_hours", _HOURS), ("alcohol_hours", _HOURS),
    ("designated_premises_supervisor", _S), ("dps_personal_licence_number", _S), ("conditions", _STRINGS),
    ("variations", _STRINGS), ("source_url", _S), ("scraped_at", _TS), ("raw_data", _S), ("seq", _L),
)

LICENCE_ENRICHED = T.StructType(
    LICENCE.fields
    + [
        T.StructField("business_type", _S),
        T.StructField("licence_categories", _STRINGS),
        T.StructField("risk_score", _I),
    ]
)

NAVIGATION = _struct(
    ("main_menu_items", T.ArrayType(_LINK)), ("breadcrumbs", T.ArrayType(_LINK)),
    ("sidebar_links", T.ArrayType(_LINK)), ("footer_links", T.ArrayType(_LINK)),
)

PAGE_ANALYSIS = _struct(
    ("council_name", _S), ("url", _S), ("licence_register_found", _B), ("potential_licence_urls", _STRINGS),
    ("website_type", _S), ("navigation_structure", NAVIGATION), ("search_functionality", _B),
    ("pagination_detected", _B), ("javascript_required", _B), ("analysis_notes", _S), ("analyzed_at", _TS),
)

EXTRACTION_RESULT = _struct(
    ("council_name", _S), ("success", _B), ("licences_found", _I), ("licences_extracted", T.ArrayType(LICENCE)),
    ("error_message", _S), ("scraping_duration", _D), ("scraped_at", _TS),
)

RESPONSE_OBJECT = _struct(
    ("premises_name", _S), ("premises_address", _S), ("postcode", _S), ("licence_holder", _S),
    ("licence_type", _S), ("licence_status", _S), ("application_date", _S), ("granted_date", _S),
    ("licensable_activities", _STRINGS), ("licensed_hours", _S), ("conditions", _STRINGS),
)

REGISTER_ENTRY = _struct(
    ("official-name", _S), ("name", _S), ("local-authority-eng", _S), ("local-authority-sct", _S),
    ("local-authority-wls", _S),
)

PROCESSING_SUMMARY = _struct(
    ("processing_date", _TS), ("original_count", _L), ("final_count", _L), ("reduction_rate", _D),
    ("councils", T.MapType(_S, _L)), ("business_types", T.MapType(_S, _L)), ("licence_statuses", T.MapType(_S, _L)),
    ("date_range", _struct(("earliest", _TS), ("latest", _TS), ("span_days", _L))),
    ("top_activities", T.MapType(_S, _L)),
)


def wire(schema):
    """The same shape with every timestamp as text, as the JSON files spell them."""
    if isinstance(schema, T.StructType):
        return T.StructType([T.StructField(f.name, wire(f.dataType), f.nullable) for f in schema.fields])
    if isinstance(schema, T.ArrayType):
        return T.ArrayType(wire(schema.elementType))
    if isinstance(schema, T.TimestampNTZType):
        return _S
    return schema
