"""Logs of small records in a shared folder: which versions of a table count, and which steps of a run are finished.

An append is one file that Spark's committer moves into place, so a reader sees all of it or nothing. What a record
names is written before the record, so nothing unfinished is ever read.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "kind string, name string, version long, path string, at timestamp_ntz, number long"


def append(spark: SparkSession, path: str, *records: dict) -> None:
    """Adds records, with NULL for fields that they do not name."""
    fields = [f.split()[0] for f in SCHEMA.split(", ")]
    rows = spark.createDataFrame([tuple(r.get(f) for f in fields) for r in records], SCHEMA)
    rows.coalesce(1).write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records; none if nothing was ever appended."""
    try:
        return spark.read.schema(SCHEMA).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)
