"""The two reports: one table per sheet."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from licensum.operators import reports as R


def weekly_report(licences: DataFrame, *, as_of) -> dict[str, DataFrame]:
    """Tables of the weekly report. ``licences`` should be stored: each table scans only the columns it needs."""
    week = R.week_of(licences, as_of)
    return {
        "header": R.weekly_header(licences, as_of=as_of),
        "summary_stats": R.weekly_stats(licences, as_of=as_of),
        "executive_summary": R.executive_summary(licences, as_of=as_of),
        "new_licences": R.licence_listing(week),
        "new_licences_message": R.no_licences_message(week),
        "licences_by_type": R.type_counts(week),
        "licences_by_status": R.status_counts_filled(week),
        "top_councils": R.top_councils(week),
        "business_types": R.business_type_share(week),
        "top_activities": R.weekly_top_activities(licences, as_of=as_of),
        "trends": R.trends(licences, as_of=as_of),
        "weekly_trend": R.weekly_trend(licences),
    }


def full_report(licences: DataFrame, *, as_of) -> dict[str, DataFrame]:
    """Tables of the full dataset report."""
    return {
        "licences": R.licence_listing(licences),
        "summary": R.dataset_summary(licences),
        "business_types": R.business_type_share(licences),
        "council_analysis": R.council_analysis(licences, as_of=as_of),
        "business_type_analysis": R.business_type_analysis(licences),
        "activity_analysis": R.activity_analysis(licences),
        "geographic_analysis": R.geographic_analysis(licences),
        "raw_export": R.raw_export(licences),
    }


def processing_report(raw: DataFrame, licences: DataFrame) -> dict[str, DataFrame]:
    """Tables of the processing summary."""
    return {
        "totals": R.processing_summary(raw, licences),
        "councils": R.council_counts(licences),
        "business_types": R.business_type_counts(licences),
        "licence_statuses": R.status_counts(licences),
        "date_range": R.date_range(licences),
        "top_activities": R.activity_counts(licences),
    }


#: The column that names the rows of a sheet; sheets that are not here have one row.
ROW_NAMES = {
    "executive_summary": "metric",
    "new_licences": "premises_name",
    "licences_by_type": "licence_type",
    "licences_by_status": "licence_status",
    "top_councils": "council_name",
    "business_types": "business_type",
    "top_activities": "activity",
    "trends": "metric",
    "weekly_trend": "week_start",
    "licences": "premises_name",
    "council_analysis": "council_name",
    "business_type_analysis": "business_type",
    "activity_analysis": "activity",
    "geographic_analysis": "postcode_area",
    "raw_export": "licence_id",
    "councils": "council_name",
    "licence_statuses": "licence_status",
}


def report_fields(report: dict[str, DataFrame], *, row_names=ROW_NAMES) -> DataFrame:
    """(sheet, item, field, text, number): all sheets of a report as one table with a row for each field.

    Numbers are doubles, times and other values text; ``item`` is the text of the column that names the row.
    """

    def one(sheet: str, df: DataFrame) -> DataFrame:
        numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
        shown = {f.name: _shown(f) for f in df.schema}
        nothing = F.lit(None).cast("string"), F.lit(None).cast("double")
        cells = [
            F.struct(
                F.lit(c).alias("field"),
                (nothing[0] if c in numeric else shown[c]).alias("text"),
                (F.col(c).cast("double") if c in numeric else nothing[1]).alias("number"),
            )
            for c in df.columns
        ]
        item = shown[row_names[sheet]] if sheet in row_names else nothing[0]
        return df.select(F.lit(sheet).alias("sheet"), item.alias("item"), F.inline(F.array(*cells)))

    return reduce(DataFrame.unionAll, [one(sheet, df) for sheet, df in report.items()])


def _shown(field: T.StructField) -> Column:
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(field.name, "yyyy-MM-dd HH:mm:ss")
    return F.col(field.name).cast("string")
