"""Typed licence rows from the JSON that extraction responses carry inside free text."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from licensum.functions import text
from licensum.schemas import RESPONSE_OBJECT

# JSON nulls in these fields reject the row; a field that is absent gets its default.
_NOT_NULL = ["premises_name", "premises_address", "licensable_activities", "conditions"]
# What a field may be; numbers and booleans are read as their text.
_TYPES = [
    *((name, r"STRING|BIGINT|BOOLEAN|DOUBLE|DECIMAL.*") for name in ("premises_name", "premises_address")),
    *((name, r"ARRAY<(STRING|VOID)>") for name in ("licensable_activities", "conditions")),
]


def object_text(response: Column) -> Column:
    """From the first ``{`` to the last ``}``; NULL when there is none."""
    return F.nullif(F.regexp_extract(response, r"(?s)\{.*\}", 0), F.lit(""))


def array_text(response: Column) -> Column:
    """From the first ``[`` to the last ``]``; NULL when there is none."""
    return F.nullif(F.regexp_extract(response, r"(?s)\[.*\]", 0), F.lit(""))


def _typed(rows: DataFrame) -> DataFrame:
    """Rows with ``payload`` (JSON object text) -> licence columns and ``reject_reason``."""
    carry = [c for c in ("page_id", "item", "council_name", "council_code", "source_url") if c in rows.columns]
    empty = F.array().cast("array<string>")

    def reason(f, v):
        is_null = lambda name: F.coalesce(F.is_variant_null(F.try_variant_get(v, f"$.{name}", "variant")), F.lit(False))
        kind_of = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        # Empty lists are ARRAY<VOID>; absent fields have no type and pass.
        wrong = lambda name, kind: F.coalesce(~kind_of(name).rlike(f"^(VOID|{kind})$"), F.lit(False))
        # A value that was read needs no look for a null, and a text that does not begin like an object or list is a plain value.
        null = lambda name: F.when(f[name].isNull(), is_null(name)).otherwise(F.lit(False))
        nested = lambda name, kind: F.when(f[name].isNull() | f[name].rlike(r"^\s*[\[{]"), wrong(name, kind)).otherwise(F.lit(False)) if kind[0] == "S" else wrong(name, kind)
        return (
            F.when(F.col("payload").isNull(), "no JSON found")
            .when(v.isNull(), "invalid JSON")
            .when(reduce(lambda a, b: a | b, map(null, _NOT_NULL)), "null in a required field")
            .when(reduce(lambda a, b: a | b, [nested(name, kind) for name, kind in _TYPES]), "field of a wrong type")
            .when(~(text.truthy(f.premises_name) & text.truthy(f.premises_address)), "missing name or address")
        )

    def fields(f):
        return F.struct(
            text.surrogate_id(F.col("council_name"), F.lower(f.premises_name), F.lower(f.premises_address)).alias("licence_id"),
            f.premises_name.alias("premises_name"),
            f.premises_address.alias("premises_address"),
            f.postcode.alias("postcode"),
            text.map_licence_type(f.licence_type).alias("licence_type"),
            text.map_licence_status(f.licence_status).alias("licence_status"),
            text.parse_date(f.application_date).alias("application_date"),
            text.parse_date(f.granted_date).alias("granted_date"),
            F.coalesce(f.licensable_activities, empty).alias("licensable_activities"),
            f.licence_holder.alias("designated_premises_supervisor"),
            F.coalesce(f.conditions, empty).alias("conditions"),
            text.let(F.try_parse_json("payload"), lambda v: reason(f, v)).alias("reject_reason"),
        )

    # Each payload is parsed once and all columns are read from the result.
    parsed = text.let(F.from_json("payload", RESPONSE_OBJECT), fields)
    return rows.select(*carry, F.col("payload").alias("raw_data"), F.inline_outer(F.array(parsed)))


def parse_object_responses(responses: DataFrame) -> DataFrame:
    """One licence object per response, which is item 0 unless the responses have numbers of their own."""
    item = F.col("item") if "item" in responses.columns else F.lit(0)
    return _typed(responses.withColumns({"payload": object_text(F.col("response")), "item": item}))


def parse_array_responses(responses: DataFrame, *, max_items: int | None = None) -> DataFrame:
    """A list of licence objects per response, each judged on its own; ``max_items`` keeps the first of a list.

    A response without a readable list gives one rejected row without an item number; an empty list gives none.
    """
    items = F.from_json(array_text(F.col("response")), "array<string>")
    if max_items:
        items = F.slice(items, 1, max_items)
    kept = [c for c in responses.columns if c != "response"]
    # The list is a column of its own: what stands beside a generator is computed for each of its rows.
    listed = responses.select(*kept, items.alias("listed")).select(*kept, "listed", F.col("listed").isNull().alias("unread"))
    staged = listed.select(*kept, "unread", F.posexplode_outer(F.coalesce("listed", F.array(F.lit(None).cast("string")))).alias("item", "payload"))
    staged = staged.filter("item IS NOT NULL").withColumn("item", F.when(~F.col("unread"), F.col("item"))).drop("unread")
    return _typed(staged)


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNotNull())


def parse_analysis_notes(responses: DataFrame) -> DataFrame:
    """Free-form analysis object of a response as a variant; NULL when it is no valid JSON."""
    return responses.withColumn("analysis", F.try_parse_json(object_text(F.col("response"))))


def results_per_council(councils: DataFrame, licences: DataFrame) -> DataFrame:
    """Extraction outcome of every council, also of those without licences.

    Licences are counted per council before the join and stay a table of their own: a council may hold more rows
    than one task should collect into a list.
    """
    found = licences.groupBy("council_name").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return councils.join(found, F.col("name") == F.col("council_name"), "left").select(
        F.col("name").alias("council_name"),
        (n > 0).alias("success"),
        n.alias("licences_found"),
        F.when(n == 0, F.lit("No licence data found")).alias("error_message"),
    )
