"""Crawled pages and what was read from them, in hash buckets of their hosts."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from licensum.functions import urls
from licensum.session import kept, shared_folder
from licensum.sources.buckets import BucketTable

#: What makes a page the same one at another time.
SAME = ["page_id", "page_key"]
#: A bucket of fetched pages to which this many batches were added is rewritten by the next.
PARTS = 8


def host_of(page_key: Column) -> Column:
    return F.regexp_extract(page_key, "^[a-z]+://([^/?#]*)", 1)


class PageStore:
    """``crawl``: the pages as they were last fetched. ``read``: the items of every page that was ever parsed, with the
    hash of the content they were read from.

    Both are dealt by host, so a job that wants some councils opens the buckets of their hosts only. Fetched pages are
    added to what is there and not written again with each batch; whole pages travel once, when they are fetched.
    """

    def __init__(self, path: str, *, buckets: int = 64):
        self.crawl = BucketTable(f"{path}/crawl", [host_of(F.col("page_key"))], buckets=buckets, same=SAME)
        self.items = BucketTable(f"{path}/items", [host_of(F.col("page_key"))], buckets=buckets)

    def fetched(self, pages: DataFrame, version: int) -> list[int]:
        """Stores fetched pages (page_id, url, html); pages with the same number and address replace older ones."""
        rows = pages.withColumns({"page_key": urls.normalize_url(F.col("url")), "content_hash": F.sha2("html", 256)})
        held = self.crawl.folders(pages.sparkSession, before=version)
        if max(map(len, held.values()), default=0) < PARTS:
            return self.crawl.add(rows, version)
        return self.crawl.merge(rows, version, lambda old, new: new if old is None else new.unionByName(old.join(new.select(*SAME), SAME, "left_anti")))

    def wanted(self, spark: SparkSession, addresses: DataFrame) -> tuple[list[int], DataFrame | None]:
        """Buckets of ``addresses`` (page_key), and the fetched pages that they lead to.

        Pages are first compared with the hashes of their own bucket's addresses, a stored table of its own and so small
        that Spark sends it to the pages instead of dealing whole pages by address; what is left is compared by address.
        """
        path, hashed = shared_folder(spark), F.xxhash64("page_key").alias("_hash")
        addresses.select(self.crawl.bucket().alias("bucket"), hashed).distinct().repartition("bucket").write.partitionBy("bucket").parquet(path)
        keys = spark.read.schema("_hash long, bucket int").parquet(path)
        buckets = sorted(r.bucket for r in keys.select("bucket").distinct().collect())
        hashes = lambda b: spark.read.schema("_hash long").parquet(f"{path}/bucket={b}")
        pages = self.crawl.parts(spark, buckets)
        if pages is None:
            return buckets, None
        rows = pages.withColumn("_hash", hashed)
        near = reduce(DataFrame.unionByName, [rows.filter(F.col("bucket") == b).join(hashes(b), "_hash", "left_semi") for b in buckets])
        found = near.drop("_hash").join(addresses.select("page_key"), "page_key", "left_semi")
        return buckets, self.crawl.newest(found).drop("version")

    def changed(self, spark: SparkSession, buckets: Sequence[int], pages: DataFrame) -> DataFrame:
        """Those of the wanted pages that were never read with their present content."""
        read = self.items.read(spark, buckets)
        same = ["page_id", "page_key", "content_hash"]
        return pages if read is None else pages.join(read.select(*same), same, "left_anti")

    def add_items(self, items: DataFrame, version: int) -> list[int]:
        """Puts new items of pages in the place of older ones."""
        return self.items.merge(items, version, lambda old, new: new if old is None else new.unionByName(old.join(new.select(*SAME), SAME, "left_anti")))

    def current_items(self, spark: SparkSession, buckets: Sequence[int], pages: DataFrame) -> DataFrame:
        """Items of the wanted pages as they are now."""
        same = ["page_id", "page_key", "content_hash"]
        return kept(self.items.read(spark, buckets).join(pages.select(*same), same, "left_semi").drop("bucket", "page_key", "content_hash"))
