"""Metrics of runs and of the state of the data."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from licensum.functions import text


def council_metrics(councils: DataFrame) -> DataFrame:
    return councils.agg(
        F.count("*").alias("councils_discovered"),
        F.count_if(text.truthy(F.col("licence_register_url"))).alias("councils_with_registers"),
        F.count_if(F.coalesce("scrape_successful", F.lit(False))).alias("councils_successful"),
    )


def analysis_metrics(analyses: DataFrame) -> DataFrame:
    return analyses.agg(
        F.count("*").alias("analyses"),
        F.count_if("licence_register_found").alias("successful_analyses"),
        F.count_if("javascript_required").alias("javascript_required"),
    )


def extraction_metrics(results: DataFrame) -> DataFrame:
    """Extraction counts, and mean and total time over results that took any."""
    took = F.when(F.col("scraping_duration") > 0, F.col("scraping_duration"))
    return results.agg(
        F.count("*").alias("extraction_results"),
        F.count_if("success").alias("successful_extractions"),
        F.coalesce(F.sum("licences_found"), F.lit(0)).alias("total_licences_extracted"),
        F.avg(took).alias("avg_extraction_time"),
        F.sum(took).alias("total_extraction_time"),
    )


def quality_metrics(licences: DataFrame) -> DataFrame:
    """How complete the final licences are."""
    located = text.truthy(F.col("postcode"))
    return licences.agg(
        F.count("*").alias("final_processed_licences"),
        F.count_if(located).alias("licences_with_postcodes"),
        F.avg(located.cast("int")).alias("postcode_completion_rate"),
        F.avg(text.count_of(F.col("licensable_activities"))).alias("avg_activities_per_licence"),
        F.count_if(text.filled(F.col("conditions"))).alias("licences_with_conditions"),
    )


def run_summary(
    councils: DataFrame, analyses: DataFrame, results: DataFrame, licences: DataFrame, *, started, ended, run_type: str = "full"
) -> DataFrame:
    """One row about a whole run. Each input is aggregated on its own; the one-row results stand side by side."""
    parts = [
        council_metrics(councils).drop("councils_successful"),
        analysis_metrics(analyses).select("successful_analyses"),
        extraction_metrics(results),
        quality_metrics(licences),
    ]
    seconds = text.seconds_between(text.as_ntz(started), text.as_ntz(ended))
    out = parts[0].select(
        F.lit(run_type).alias("run_type"),
        text.as_ntz(started).alias("start_time"),
        text.as_ntz(ended).alias("end_time"),
        seconds.alias("duration_seconds"),
        (seconds / 60).alias("duration_minutes"),
        "*",
    )
    for part in parts[1:]:
        row = part.select(F.struct("*").alias("r")).scalar()
        out = out.withColumn("_r", row).select(*out.columns, "_r.*")
    return out.withColumn("reports_generated", F.when(F.col("final_processed_licences") > 0, 2).otherwise(0))


def step_summary(step: str, metrics: DataFrame, *, started, ended) -> DataFrame:
    """The metrics of a single step with its name and duration."""
    seconds = text.seconds_between(text.as_ntz(started), text.as_ntz(ended))
    return metrics.select(F.lit(step).alias("step"), text.as_ntz(started).alias("start_time"), seconds.alias("duration"), "*")


def data_health(councils: DataFrame, snapshots: DataFrame, components: DataFrame, *, as_of, reports: DataFrame | None = None) -> DataFrame:
    """State of the data: ``snapshots(path, modified)``, ``components(component, status)``, ``reports(path, modified)``.

    Old or missing data give recommendations; a failing component makes the state degraded, with recommendations
    unhealthy.
    """
    now = text.as_ntz(as_of)
    week_ago = now - F.expr("INTERVAL 7 DAYS")
    c = councils.agg(
        F.count("*").alias("councils_discovered"),
        F.count_if(F.col("last_scraped") > week_ago).alias("recently_scraped_councils"),
    )
    s = snapshots.agg(F.count("*").alias("processed_data_files"), F.max("modified").alias("latest"))
    k = components.agg(
        F.coalesce(F.bool_or(F.col("status").contains("error")), F.lit(False)).alias("component_error"),
        F.count_if(F.col("status") == "missing").alias("components_missing"),
    )
    row = c
    for part in (s, k):
        row = row.withColumn("_r", part.select(F.struct("*")).scalar()).select(*row.columns, "_r.*")
    if reports is not None:
        row = row.withColumn("report_files", reports.agg(F.count("*")).scalar())
    age = text.seconds_between(F.col("latest"), now) / 3600
    row = row.withColumn("latest_data_age_hours", age)
    advice = F.array(
        F.when(F.col("components_missing") > 0, "Create missing directories"),
        F.when(F.col("councils_discovered") == 0, "Run council discovery to initialize system"),
        F.when(F.col("latest_data_age_hours") > 168, "Data is over 1 week old, consider running incremental update"),
        F.when(F.col("processed_data_files") == 0, "No processed data found, run full scrape"),
    )
    row = row.withColumn("recommendations", F.filter(advice, lambda x: x.isNotNull()))
    some = F.size("recommendations") > 0
    status = (
        F.when(some & F.col("component_error"), "unhealthy")
        .when(some, "needs_attention")
        .when(F.col("component_error"), "degraded")
        .otherwise("healthy")
    )
    return row.withColumn("system_status", status).drop("latest", "component_error", "components_missing")
