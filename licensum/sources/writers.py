"""Writers. Tables are Parquet, partitioned where a reader prunes; summaries are small JSON documents."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from licensum.operators import reports

MAX_RECORDS_PER_FILE = 5_000_000


def write_snapshot(licences: DataFrame, summary: DataFrame, path: str, snapshot_date: str) -> None:
    """Licences below ``licences/snapshot_date=…`` and their summary below ``summaries/snapshot_date=…``.

    A repeated run replaces its own snapshot only.
    """
    part = f"snapshot_date={snapshot_date}"
    licences.write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).parquet(f"{path}/licences/{part}")
    summary.write.mode("overwrite").json(f"{path}/summaries/{part}")


def read_snapshots(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/licences")


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One batch of results; writing the same batch again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def write_json_records(df: DataFrame, path: str) -> None:
    """Records as JSON lines, with timestamps spelled as the readers expect them."""
    df.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").json(path)


def write_run_summary(summary: DataFrame, path: str) -> None:
    """Append a one-row metrics document."""
    summary.write.mode("append").json(path)


def write_sheets(sheets: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One table per report sheet; ``fmt`` is parquet or csv. CSV cells of list columns are joined by commas."""
    for name, df in sheets.items():
        out = df
        if fmt == "csv":
            lists = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
            out = df.withColumns({c: F.array_join(c, ", ") for c in lists}) if lists else df
        writer = out.write.mode("overwrite")
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(f"{path}/{name}")


def export_raw(licences: DataFrame, path: str) -> None:
    reports.raw_export(licences).write.mode("overwrite").option("header", True).csv(path)
