"""Tables in hash buckets: a batch rewrites the buckets that it touches, or adds to them, and leaves all others as they are."""

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from licensum.session import kept
from licensum.sources import log


class BucketTable:
    """Rows dealt to ``buckets`` by the hash of ``keys``.

    A version holds the buckets that one batch rewrote, or the rows that it added to them; the log says which versions of a
    bucket count. A batch that is done again, as after a lost driver, starts from the versions before its own and replaces
    what it wrote. As many numbers come to the driver as there are buckets and additions to them.

    Where batches are added, rows take the place of those of earlier versions with equal ``same`` columns.
    """

    def __init__(self, path: str, keys: Sequence[str | Column], *, buckets: int = 64, same: Sequence[str] = ()):
        self.path, self.keys, self.buckets, self.same = path.rstrip("/"), list(keys), buckets, list(same)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def folders(self, spark: SparkSession, before: int | None = None) -> dict[int, list[str]]:
        """The folders of each bucket that was ever written: the newest it was rewritten to, and those added since; none if it is empty now."""
        records = log.read(spark, f"{self.path}/log").filter("kind IN ('bucket', 'part')")
        if before is not None:
            records = records.filter(F.col("version") < before)
        whole = F.max(F.when(F.col("kind") == "bucket", F.struct("version", "at", "path"))).alias("whole")
        added = F.collect_set(F.when(F.col("kind") == "part", F.struct("version", "path"))).alias("added")
        later = F.array_sort(F.filter("added", lambda p: F.col("whole").isNull() | (p.version > F.col("whole.version"))))
        newest = records.groupBy("name").agg(whole, added).select("name", "whole.path", later.path.alias("later"))
        return {int(r.name): [p for p in (r.path, *r.later) if p is not None] for r in newest.collect()}

    def parts(self, spark: SparkSession, only: Sequence[int] | None = None, before: int | None = None) -> DataFrame | None:
        """All rows of all buckets or the named ones, with ``bucket`` and ``version``, also those that later ones replace."""
        wanted = None if only is None else set(only)
        paths = [p for b, found in sorted(self.folders(spark, before).items()) if wanted is None or b in wanted for p in found]
        return spark.read.option("basePath", f"{self.path}/data").parquet(*paths) if paths else None

    def newest(self, parts: DataFrame) -> DataFrame:
        """Of rows that are the same those of the newest version. A row with a NULL there is the same as no other."""
        if not self.same:
            return parts
        ranked = parts.withColumn("_newest", F.max("version").over(Window.partitionBy(*self.same)))
        single = F.lit(False)
        for c in self.same:
            single |= F.col(c).isNull()
        return ranked.filter(single | (F.col("version") == F.col("_newest"))).drop("_newest")

    def read(self, spark: SparkSession, only: Sequence[int] | None = None, before: int | None = None) -> DataFrame | None:
        """The rows of all buckets or the named ones, with ``bucket``; None if they hold nothing."""
        found = self.parts(spark, only, before)
        return None if found is None else self.newest(found).drop("version")

    def add(self, batch: DataFrame, version: int) -> list[int]:
        """Puts a batch beside the rows of its buckets; returns their numbers. The batch is evaluated once, and nothing else is read.

        Large buckets are written by several tasks, so none has to sort a whole bucket.
        """
        rows, folder = batch.withColumn("bucket", self.bucket()), f"{self.path}/data/version={version}"
        rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(folder)
        touched = sorted(self._written(rows, folder))
        if touched:
            log.append(rows.sparkSession, f"{self.path}/log", *({"kind": "part", "name": str(b), "version": version, "path": f"{folder}/bucket={b}"} for b in touched))
        return touched

    def merge(self, batch: DataFrame, version: int, combine: Callable[[DataFrame | None, DataFrame], DataFrame]) -> list[int]:
        """Puts ``combine(rows of the touched buckets, batch)`` in the place of these buckets; returns their numbers.

        The first argument is None where nothing is held yet. Neither of the two has ``bucket``, nor needs the result.
        """
        spark = batch.sparkSession
        batch = kept(batch.withColumn("bucket", self.bucket()))
        touched = sorted(r.bucket for r in batch.select("bucket").distinct().collect())
        if touched:
            old = self.read(spark, touched, before=version)
            self._write(combine(old.drop("bucket") if old is not None else None, batch.drop("bucket")), version, touched)
        return touched

    def _write(self, rows: DataFrame, version: int, touched: list[int]) -> None:
        spark, folder = rows.sparkSession, f"{self.path}/data/version={version}"
        rows = rows.withColumn("bucket", self.bucket())
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        full = self._written(rows, folder)
        log.append(spark, f"{self.path}/log", *({"kind": "bucket", "name": str(b), "version": version, "path": f"{folder}/bucket={b}" if b in full else None} for b in touched))

    @staticmethod
    def _written(rows: DataFrame, folder: str) -> set[int]:
        """The buckets that have files in a folder."""
        files = rows.sparkSession.read.schema(rows.schema).parquet(folder).inputFiles()
        return {int(m[1]) for f in files if (m := re.search(r"/bucket=(\d+)/", f))}
