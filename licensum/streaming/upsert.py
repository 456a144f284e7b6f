"""Incremental entity resolution: a keyed merge into hash buckets.

Each batch is reduced to the best row per premises it saw and merged with the stored rows of the same buckets. Choosing
the best row, its first appearance and the number of copies can be merged in any grouping: the table always equals one
batch over all input, and reading it resolves nothing again.
"""

from pyspark.sql import DataFrame, SparkSession

from licensum.operators.enrich import enrich_licences
from licensum.operators.resolve import MATCH_KEY, best_per_key, with_match_key, with_score
from licensum.sources.buckets import BucketTable


def entity_table(path: str, *, buckets: int = 64) -> BucketTable:
    return BucketTable(path, [MATCH_KEY], buckets=buckets)


def merge_batch(licences: DataFrame, table: BucketTable, batch_id: int) -> list[int]:
    """Merge one batch of valid, cleaned licences; returns the buckets that it rewrote."""
    best = best_per_key(with_score(with_match_key(licences)))
    return table.merge(best, batch_id, lambda old, new: new if old is None else best_per_key(old.unionByName(new)))


def current_entities(spark: SparkSession, table: BucketTable) -> DataFrame:
    """Best row per premises over all batches, enriched."""
    rows = table.read(spark)
    if rows is None:
        raise FileNotFoundError(f"no entities below {table.path}")
    return enrich_licences(rows.drop("bucket"))


def run_upserts(stream: DataFrame, table: BucketTable, checkpoint: str) -> None:
    """Merge everything that is there now, batch by batch, and stop."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, batch_id: merge_batch(batch, table, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
