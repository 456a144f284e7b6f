"""Continuous ingest of extraction-result files, with duplicate suppression."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from licensum import schemas
from licensum.functions import text
from licensum.operators.clean import clean_licences, licences_of_results, valid_licences
from licensum.operators.resolve import first_per_key
from licensum.session import kept
from licensum.sources import log
from licensum.sources.buckets import BucketTable
from licensum.sources.readers import _typed


def stream_results(spark: SparkSession, path: str, *, lines: bool = False, files_per_batch: int = 1000) -> DataFrame:
    """Extraction results from files as they arrive."""
    reader = spark.readStream.schema(schemas.wire(schemas.EXTRACTION_RESULT)).option("multiLine", not lines)
    return _typed(reader.option("maxFilesPerTrigger", files_per_batch).json(path), schemas.EXTRACTION_RESULT)


def clean_stream(results: DataFrame, *, as_of) -> DataFrame:
    """Valid cleaned licences of successful results; the same operators as the batch job. Rows carry their ``seq``."""
    return valid_licences(clean_licences(licences_of_results(results)), as_of=as_of)


def repeat_key() -> Column:
    """What copies of a licence share."""
    same = (F.lower(text.strip(F.col(c))) for c in ("premises_name", "premises_address"))
    return F.sha2(F.concat_ws("|", "council_name", *same), 256)


def suppress_repeats(licences: DataFrame, *, delay: str = "7 days") -> DataFrame:
    """Drop copies of a licence that arrive again within ``delay`` of event time, as cumulative files repeat rows.

    Rows behind the watermark are dropped without a trace; ``run_suppressed`` counts and keeps them.
    """
    stamped = licences.withColumns({"event_time": F.col("scraped_at").cast("timestamp"), "_key": repeat_key()})
    return stamped.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key", "event_time")


class Suppressed:
    """First rows, late rows and the keys in between, below one folder.

    Spark's own stateful operators drop late rows before any of their functions sees them, so the state is kept here:
    keys in hash buckets with the time until which they hide copies, and the watermark of every batch in a log. A row is
    late if its time lies before the watermark of the earlier batches, which is their latest time less ``delay``.
    """

    def __init__(self, path: str, *, delay: str = "7 days", buckets: int = 64):
        self.path, self.delay = path.rstrip("/"), F.expr(f"INTERVAL {delay}")
        self.keys = BucketTable(f"{path}/keys", ["_key"], buckets=buckets)

    def merge_batch(self, licences: DataFrame, batch_id: int) -> None:
        spark = licences.sparkSession
        rows = kept(licences.withColumns({"event_time": F.col("scraped_at").cast("timestamp_ntz"), "_key": repeat_key()}))
        mark = log.read(spark, f"{self.path}/log").filter((F.col("kind") == "watermark") & (F.col("version") < batch_id)).agg(F.max("at")).first()[0]
        # Without a time a row cannot be late.
        late = F.coalesce(F.col("event_time") < F.lit(mark).cast("timestamp_ntz"), F.lit(False))
        rows.filter(late).drop("_key", "event_time").write.mode("overwrite").parquet(f"{self.path}/late/batch_id={batch_id}")
        first = kept(first_per_key(rows.filter(~late), ["_key"], [F.col("event_time").asc_nulls_last(), "seq"]))
        fresh = first.select("_key", (F.col("event_time") + self.delay).alias("until"), "event_time")
        holds = F.col("until").isNull() | F.coalesce(F.col("until") >= F.lit(mark).cast("timestamp_ntz"), F.lit(True))
        touched = [r[0] for r in first.select(self.keys.bucket()).distinct().collect()]
        hidden = self.keys.read(spark, touched, before=batch_id)
        new = first if hidden is None else first.join(hidden.filter(holds).select("_key"), "_key", "left_anti")
        new.drop("_key", "event_time").write.mode("overwrite").parquet(f"{self.path}/first/batch_id={batch_id}")

        def combine(old, now):
            now = now.select("_key", "until")
            if old is None:
                return now
            held = old.filter(holds)
            return held.unionByName(now.join(held.select("_key"), "_key", "left_anti"))

        self.keys.merge(fresh.drop("event_time"), batch_id, combine)
        latest, number = rows.agg(F.max(F.col("event_time") - self.delay), F.count_if(late)).first()
        at = max((x for x in (mark, latest) if x is not None), default=None)
        log.append(spark, f"{self.path}/log", {"kind": "watermark", "version": batch_id, "at": at, "number": number})

    def first(self, spark: SparkSession) -> DataFrame:
        """The first row of each licence, and those that came again later than ``delay``."""
        return spark.read.parquet(f"{self.path}/first").drop("batch_id")

    def late(self, spark: SparkSession) -> DataFrame:
        """The rows behind the watermark, with the batch in which they came."""
        return spark.read.parquet(f"{self.path}/late")

    def counts(self, spark: SparkSession) -> DataFrame:
        """(batch_id, late_rows, watermark) of every batch; one that was done again counts once."""
        records = log.read(spark, f"{self.path}/log").filter("kind = 'watermark'")
        return records.groupBy(F.col("version").alias("batch_id")).agg(F.max("number").alias("late_rows"), F.max("at").alias("watermark"))


def run_suppressed(stream: DataFrame, target: Suppressed, checkpoint: str) -> None:
    """Process everything that is there now, batch by batch, and stop."""
    query = stream.writeStream.foreachBatch(target.merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_to_files(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Process everything that is there now into Parquet files, exactly once, and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
