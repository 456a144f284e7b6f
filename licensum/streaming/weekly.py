"""Weekly tumbling counts, Monday to Sunday."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from licensum.sources.buckets import BucketTable

# The epoch was a Thursday; four days later is a Monday.
MONDAY = "4 days"


def weekly_counts(rows: DataFrame, time_column: str, *keys: str, delay: str | None = None) -> DataFrame:
    """Rows per week and key. ``delay`` sets a watermark, which a stream needs to finish a week.

    A watermark is on times of the session's zone, which should be UTC, or weeks begin at another hour.
    """
    if delay:
        rows = rows.withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, delay)
    week = F.window(time_column, "7 days", "7 days", MONDAY)
    counts = rows.groupBy(week.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counts.select(
        F.col("w.start").cast("timestamp_ntz").alias("week_start"), F.col("w.end").cast("timestamp_ntz").alias("week_end"), *keys, "n"
    )


def week_table(path: str, *keys: str, buckets: int = 8) -> BucketTable:
    """Where weekly counts are kept, by week and key."""
    return BucketTable(path, ["week_start", *keys], buckets=buckets)


def merge_weeks(changed: DataFrame, table: BucketTable, batch_id: int) -> None:
    """Put changed weeks in the place of what is stored of them."""
    table.merge(changed, batch_id, lambda old, new: new if old is None else new.unionByName(old.join(new.select(*table.keys), table.keys, "left_anti")))


def run_weeks(counts: DataFrame, table: BucketTable, checkpoint: str) -> None:
    """Merge the weeks that each batch changes into the table, and stop when input is read.

    With a ``delay`` in ``weekly_counts``, weeks behind the watermark leave the state of the stream; their rows in the table stay.
    """
    query = (
        counts.writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: merge_weeks(batch, table, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
