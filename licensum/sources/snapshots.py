"""Snapshots of a table behind a log: the newest one is found without looking at any other."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from licensum.sources import log


def commit_snapshot(rows: DataFrame, path: str, name: str, *, at) -> str:
    """Writes rows to a folder of their own and makes it a snapshot of time ``at``; returns the folder.

    A repeated commit of a name is a later version of it. A job that dies before the record leaves a folder that
    nobody reads.
    """
    spark, folder = rows.sparkSession, f"{path}/data/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    last = snapshots(spark, path).agg(F.max("version")).first()[0]
    log.append(spark, f"{path}/log", {"kind": "snapshot", "name": name, "version": (last or 0) + 1, "path": folder, "at": at})
    return folder


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(name, version, path, at) of all snapshots."""
    return log.read(spark, f"{path}/log").filter("kind = 'snapshot'").select("name", "version", "path", "at")


def newest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest snapshot; of equal times the one that was committed last."""
    newest = snapshots(spark, path).orderBy(F.desc("at"), F.desc("version"), F.desc("path")).first()
    if newest is None:
        raise FileNotFoundError(f"no snapshot below {path}")
    return spark.read.parquet(newest.path)
