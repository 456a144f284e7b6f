"""Whole runs: everything from discovery to reports, the incremental update, and single steps.

A run is a row of named steps. Each writes its tables below the run's folder, then its name to the ledger; a run that is
started again reads the tables of finished steps and goes on with the first that is missing.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from licensum.functions.text import as_ntz
from licensum.operators import councils as C
from licensum.operators import runs
from licensum.plans import discovery
from licensum.plans.extraction import council_addresses, extract_licences, extraction_results, licences_of_addresses, read_pages
from licensum.plans.processing import process_licences
from licensum.plans.reporting import full_report, processing_report, weekly_report
from licensum.session import kept
from licensum.sources import log
from licensum.sources.page_store import PageStore
from licensum.sources.snapshots import commit_snapshot, newest_snapshot
from licensum.sources.writers import write_run_summary, write_sheets


class Stopped(Exception):
    """The run has ended behind the step that it was asked to end with."""


class Run:
    """The ledger and the tables of one run; ``until`` names the step behind which it stops."""

    def __init__(self, spark: SparkSession, path: str, run_id: str, *, until: str | None = None):
        self.spark, self.path, self.run_id, self.until = spark, path, run_id, until

    def finished(self) -> set[str]:
        rows = log.read(self.spark, f"{self.path}/ledger").filter((F.col("kind") == "step") & (F.col("name").startswith(f"{self.run_id}/")))
        return {r.name.split("/", 1)[1] for r in rows.select("name").collect()}

    def step(self, name: str, build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """The stored tables of a step, built if the ledger does not have it; each is written once and read from then on."""
        folder = f"{self.path}/runs/{self.run_id}/{name}"
        if name not in self.finished():
            tables = build()
            for table, df in tables.items():
                df.write.mode("overwrite").parquet(f"{folder}/{table}")
            log.append(self.spark, f"{self.path}/ledger", {"kind": "step", "name": f"{self.run_id}/{name}", "path": ",".join(tables)})
        listed = log.read(self.spark, f"{self.path}/ledger").filter(F.col("name") == f"{self.run_id}/{name}").select("path").first().path
        found = {table: self.spark.read.parquet(f"{folder}/{table}") for table in listed.split(",") if table}
        if name == self.until:
            raise Stopped(name)
        return found

    def action(self, name: str, do: Callable[[], None]) -> None:
        """A step that leaves files for others instead of tables."""

        def build():
            do()
            return {}

        self.step(name, build)


def write_reports(raw: DataFrame, licences: DataFrame, *, as_of, path: str) -> None:
    """Every report table of stored licences."""
    day = f"{as_of:%Y-%m-%d}"
    write_sheets(processing_report(raw, licences), f"{path}/summaries/snapshot_date={day}")
    write_sheets(weekly_report(licences, as_of=as_of), f"{path}/reports/weekly/snapshot_date={day}")
    write_sheets(full_report(licences, as_of=as_of), f"{path}/reports/full/snapshot_date={day}")


def process_and_report(spark: SparkSession, raw: DataFrame, *, as_of, path: str) -> DataFrame:
    """Process licences, make them the newest snapshot, and write every report table from it.

    Raw rows are stored first, since they are processed and counted. Returns the stored licences.
    """
    raw = kept(raw)
    commit_snapshot(process_licences(raw, as_of=as_of), f"{path}/licences", f"{as_of:%Y-%m-%d}", at=as_of)
    licences = newest_snapshot(spark, f"{path}/licences")
    write_reports(raw, licences, as_of=as_of, path=path)
    return licences


def as_raw(found: DataFrame, as_of) -> DataFrame:
    """Extracted licences as the raw rows that processing takes."""
    return found.withColumns({"scraped_at": as_ntz(as_of), "conditions": F.coalesce("conditions", F.array().cast("array<string>")) if "conditions" in found.columns else F.array().cast("array<string>")})


def full_run(
    spark: SparkSession, *, registers: DataFrame, directory: DataFrame, seeds: DataFrame, answers: DataFrame, pages: DataFrame,
    card_answers: DataFrame | None = None, text_answers: DataFrame | None = None, as_of, started, ended, path: str, run_id: str = "full",
    max_councils: int | None = None, until: str | None = None,
) -> DataFrame:
    """Discovery, analysis, extraction, processing, reports and the summary of the run; returns the processed licences.

    ``answers(name, status, answer)`` are what a reader of council sites says about their registers. A run that stopped
    goes on with the step it had not finished. ``ended`` may be a function, called when the summary is made.
    """
    run = Run(spark, path, run_id, until=until)

    def discover():
        found = discovery.discover_councils(registers, directory, seeds)
        return {"councils": C.apply_register_answers(found, answers, as_of=as_of)}

    councils = run.step("discovery", discover)["councils"]
    analyses = run.step("analysis", lambda: {"analyses": discovery.analyse_councils(councils, pages)})["analyses"]

    def extract():
        chosen = C.eligible_for_extraction(councils, max_councils=max_councils)
        raw = kept(as_raw(extract_licences(chosen, analyses, pages, card_answers=card_answers, text_answers=text_answers), as_of))
        return {"raw": raw, "results": extraction_results(chosen, raw).withColumn("scraping_duration", F.lit(None).cast("double"))}

    extracted = run.step("extraction", extract)
    licences = run.step("processing", lambda: {"licences": process_licences(extracted["raw"], as_of=as_of)})["licences"]
    run.action("snapshot", lambda: commit_snapshot(licences, f"{path}/licences", f"{as_of:%Y-%m-%d}", at=as_of))
    run.action("reports", lambda: write_reports(extracted["raw"], licences, as_of=as_of, path=path))
    run.action(
        "summary",
        lambda: record_run(councils, analyses, extracted["results"], licences, started=started, ended=ended() if callable(ended) else ended, path=path),
    )
    return licences


def incremental_update(
    spark: SparkSession, councils: DataFrame, analyses: DataFrame, store: PageStore, *, version: int, as_of, path: str,
    card_answers: DataFrame | None = None, text_answers: DataFrame | None = None, days: int = 30, limit: int | None = None,
) -> DataFrame:
    """Licences of the councils that worked in the last ``days``, from stored pages; returns the processed licences.

    Only the buckets of these councils' hosts are opened, and of their pages only those are parsed whose content has
    changed since they were last read; ``version`` numbers the updates of the store.
    """
    chosen = C.recently_successful(councils, as_of=as_of, days=days, limit=limit)
    edges = kept(council_addresses(chosen, analyses))
    buckets, pages = store.wanted(spark, edges)
    if pages is None:
        raise FileNotFoundError("no fetched pages of these councils")
    pages = kept(pages.drop("bucket"))
    changed = store.changed(spark, buckets, pages)
    items = read_pages(changed.drop("page_key", "content_hash")).join(changed.select("page_id", "url", "page_key", "content_hash"), ["page_id", "url"])
    store.add_items(items, version)
    current = store.current_items(spark, buckets, pages)
    found = licences_of_addresses(edges, current, card_answers=card_answers, text_answers=text_answers)
    return process_and_report(spark, as_raw(found, as_of), as_of=as_of, path=path)


def record_run(councils, analyses, results, licences, *, started, ended, path: str, run_type="full") -> DataFrame:
    """Write and return the summary row of a run."""
    summary = runs.run_summary(councils, analyses, results, licences, started=started, ended=ended, run_type=run_type)
    write_run_summary(summary, f"{path}/run_summaries")
    return summary


def read_run_summaries(spark: SparkSession, path: str) -> DataFrame:
    """The summaries of all runs below a folder."""
    schema = spark.read.json(f"{path}/run_summaries").schema
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("start_time", "end_time") if c in schema.names}
    return spark.read.schema(schema).json(f"{path}/run_summaries").withColumns(times)


def discovery_only(spark: SparkSession, *, registers, directory, seeds, answers, pages, as_of, started, ended, path: str, run_id: str = "discovery") -> DataFrame:
    """Discovery and analysis alone; returns their metrics. Their tables are those of a full run of the same id."""
    try:
        full_run(spark, registers=registers, directory=directory, seeds=seeds, answers=answers, pages=pages, as_of=as_of, started=started, ended=ended, path=path, run_id=run_id, until="analysis")
    except Stopped:
        pass
    councils, analyses = (spark.read.parquet(f"{path}/runs/{run_id}/{t}") for t in ("discovery/councils", "analysis/analyses"))
    metrics = runs.council_metrics(councils).drop("councils_successful")
    row = runs.analysis_metrics(analyses).select(F.struct("successful_analyses")).scalar()
    return runs.step_summary("discovery_only", metrics.withColumn("_r", row).select(*metrics.columns, "_r.*"), started=started, ended=ended)


def extraction_only(spark: SparkSession, councils: DataFrame, analyses: DataFrame, pages: DataFrame, *, started, ended, card_answers=None, text_answers=None, max_councils=None) -> DataFrame:
    """Extraction alone, from stored councils and analyses; returns its metrics."""
    chosen = C.eligible_for_extraction(councils, max_councils=max_councils)
    licences = kept(extract_licences(chosen, analyses, pages, card_answers=card_answers, text_answers=text_answers))
    results = extraction_results(chosen, licences).withColumn("scraping_duration", F.lit(None).cast("double"))
    metrics = runs.extraction_metrics(results).select(F.col("extraction_results").alias("councils_processed"), "successful_extractions", F.col("total_licences_extracted").alias("total_licences_found"))
    return runs.step_summary("extraction_only", metrics, started=started, ended=ended)


def reports_only(spark: SparkSession, raw: DataFrame, *, as_of, started, ended, path: str) -> DataFrame:
    """Reports alone, from the newest snapshot of processed licences; returns their metrics."""
    licences = newest_snapshot(spark, f"{path}/licences")
    write_reports(raw, licences, as_of=as_of, path=path)
    metrics = licences.agg(F.count("*").alias("licences_processed")).withColumn("reports_generated", F.when(F.col("licences_processed") > 0, 2).otherwise(0))
    return runs.step_summary("reports_only", metrics, started=started, ended=ended)
