"""The store of fetched pages: what is added replaces older pages, and whole pages are dealt once."""

import re

import pytest
from pyspark.sql import functions as F

from licensum.functions import urls
from licensum.sources import page_store
from licensum.sources.page_store import PageStore

SCHEMA = "page_id long, url string, html string"
# Fetched one after the other: pages that come twice, again, without a number or without an address.
BATCHES = [
    [(1, "https://a.uk/p", "one"), (2, "https://a.uk/p", "two"), (2, "https://a.uk/p", "two again"), (3, "https://b.uk/p", "three"), (None, "https://a.uk/p", "no number"), (4, None, "no address")],
    [(2, "https://a.uk/p", "new"), (None, "https://a.uk/p", "no number, new"), (5, "https://c.uk/p", "five"), (4, None, "no address, new")],
    [(2, "https://a.uk/p/", "newest"), (3, "https://b.uk/p", "three")],
    [(1, "https://a.uk/p", "one, last"), (2, "https://c.uk/p", "another")],
]


def stored(store, spark):
    return sorted((str(r.page_id), str(r.page_key), r.html) for r in store.crawl.read(spark).collect())


def expected(batches):
    """Each batch in the place of what has its number and address."""
    held = []
    for batch in batches:
        keys = {(r[0], r[1]) for r in batch if None not in r[:2]}
        held = [r for r in held if (r[0], r[1]) not in keys] + batch
    return sorted((str(i), str(u), h) for i, u, h in held)


def normalized(spark, batch):
    rows = spark.createDataFrame(batch, SCHEMA).withColumn("url", urls.normalize_url(F.col("url")))
    return [tuple(r) for r in rows.collect()]


@pytest.mark.parametrize("parts", [8, 1, 2])
def test_fetched_pages_replace_older_ones(spark, tmp_path, monkeypatch, parts):
    monkeypatch.setattr(page_store, "PARTS", parts)
    store = PageStore(str(tmp_path), buckets=4)
    for version, batch in enumerate(BATCHES):
        store.fetched(spark.createDataFrame(batch, SCHEMA), version)
        assert stored(store, spark) == expected([normalized(spark, b) for b in BATCHES[: version + 1]])
    # A batch that is done again replaces itself; an empty one changes nothing.
    store.fetched(spark.createDataFrame(BATCHES[-1], SCHEMA), len(BATCHES) - 1)
    assert store.fetched(spark.createDataFrame([], SCHEMA), len(BATCHES)) == []
    assert stored(store, spark) == expected([normalized(spark, b) for b in BATCHES])
    addresses = spark.createDataFrame([("https://a.uk/p",), ("https://a.uk/p",), (None,)], "page_key string")
    _, found = store.wanted(spark, addresses)
    assert sorted((str(r.page_id), str(r.page_key), r.html) for r in found.collect()) == [r for r in stored(store, spark) if r[1] == "https://a.uk/p"]


def test_a_batch_is_stored_once(spark, tmp_path):
    store = PageStore(str(tmp_path), buckets=4)
    pages = lambda mark, ids: spark.createDataFrame([(i, f"https://c{i % 20}.uk/p", f"<p>{mark} {i}</p>") for i in ids], SCHEMA)
    store.fetched(pages("one", range(100)), 0)
    store.fetched(pages("two", range(0, 100, 4)), 1)
    rows = [spark.read.parquet(f"{tmp_path}/crawl/data/version={v}").count() for v in (0, 1)]
    assert rows == [100, 25] and store.crawl.read(spark).count() == 100


def test_wanted_pages_are_not_dealt_by_address(spark, tmp_path):
    store = PageStore(str(tmp_path), buckets=4)
    store.fetched(spark.range(5000).selectExpr("id AS page_id", "concat('https://c', id, '.uk/p') AS url", "repeat('x', 200) AS html"), 0)
    addresses = spark.range(0, 10000, 2).selectExpr("concat('https://c', id, '.uk/p') AS page_key")
    name, was = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # More than one bucket's hashes of addresses, less than all of them.
    spark.conf.set(name, "30k")
    try:
        _, found = store.wanted(spark, addresses)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert found.count() == 2500
    finally:
        spark.conf.set(name, was)
    union = plan[plan.index("Union") :]
    assert len(re.findall("BroadcastHashJoin", union)) == 4
