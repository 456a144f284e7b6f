from datetime import datetime

import pytest
from pyspark.sql import functions as F

from licensum.plans import runs
from licensum.sources import log, snapshots
from licensum.sources.buckets import BucketTable
from licensum.sources.page_store import PageStore
from licensum.streaming import upsert


def test_batches_rewrite_only_the_buckets_they_touch(spark, tmp_path):
    table = BucketTable(str(tmp_path), ["k"], buckets=8)
    rows = lambda ks, v: spark.createDataFrame([(k, v) for k in ks], "k long, v string")
    replace = lambda old, new: new if old is None else new.unionByName(old.join(new.select("k"), "k", "left_anti"))
    assert table.read(spark) is None
    table.merge(rows(range(100), "a"), 0, replace)
    before = table.folders(spark)
    touched = table.merge(rows([5], "b"), 1, replace)
    after = table.folders(spark)
    assert len(before) == 8 and len(touched) == 1
    assert {b for b in before if before[b] != after[b]} == set(touched)
    # The same batch again changes nothing; an empty one touches nothing.
    table.merge(rows([5], "b"), 1, replace)
    assert table.merge(rows([], "c"), 2, replace) == []
    got = table.read(spark)
    assert {(r.k, r.v) for r in got.collect()} == {(k, "b" if k == 5 else "a") for k in range(100)}
    assert got.count() == 100
    one = table.read(spark, touched)
    assert {f.split("/bucket=")[1].split("/")[0] for f in one.inputFiles()} == {str(touched[0])}


def test_buckets_can_become_empty(spark, tmp_path):
    table = BucketTable(str(tmp_path), ["k"], buckets=2)
    rows = spark.createDataFrame([(k,) for k in range(10)], "k long")
    table.merge(rows, 0, lambda old, new: new)
    table.merge(rows, 1, lambda old, new: old.filter("k < 0"))
    assert table.read(spark) is None


def test_better_copies_come_later(spark, tmp_path):
    table = upsert.entity_table(str(tmp_path), buckets=4)
    columns = "seq long, council_name string, premises_name string, premises_address string, postcode string, licensable_activities array<string>, conditions array<string>, designated_premises_supervisor string, application_date timestamp_ntz, granted_date timestamp_ntz, scraped_at timestamp_ntz, licence_type string, licence_status string"
    row = lambda seq, name, holder: (seq, "C", name, "1 High Street, Leeds", "LS1 1AA", ["Sale"], [], holder, None, None, None, "new", "granted")
    for batch, rows in enumerate([[row(1, "Red Lion", None), row(2, "Blue Bar", None)], [row(3, "Red Lion", None)], [row(4, "Red Lion", "A Holder")]]):
        upsert.merge_batch(spark.createDataFrame(rows, columns), table, batch)
    got = {r.premises_name: (r.seq, r.first_seq, r.copies) for r in table.read(spark).collect()}
    assert got == {"Red Lion": (4, 1, 3), "Blue Bar": (2, 2, 1)}


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    built = []

    def steps(until):
        run = runs.Run(spark, str(tmp_path), "r1", until=until)

        def build(n):
            built.append(n)
            return {"t": spark.range(n)}

        a = run.step("a", lambda: build(1))["t"]
        b = run.step("b", lambda: build(a.count() + 1))["t"]
        run.action("c", lambda: built.append("c"))
        return b.count()

    with pytest.raises(runs.Stopped):
        steps("a")
    with pytest.raises(runs.Stopped):
        steps("b")
    assert built == [1, 2]
    assert steps(None) == steps(None) == 2
    assert built == [1, 2, "c"]
    assert runs.Run(spark, str(tmp_path), "r").finished() == set()


def test_a_failed_step_is_not_finished(spark, tmp_path):
    run = runs.Run(spark, str(tmp_path), "r1")
    broken = lambda: {"t": spark.range(3).select(F.raise_error(F.lit("broken")).cast("int").alias("x"))}
    with pytest.raises(Exception, match="broken"):
        run.step("a", broken)
    assert run.finished() == set()
    assert run.step("a", lambda: {"t": spark.range(3)})["t"].count() == 3


def test_only_changed_pages_are_read_again(spark, tmp_path):
    store = PageStore(str(tmp_path), buckets=8)
    pages = lambda mark, ids: spark.createDataFrame([(i, f"https://c{i % 20}.uk/p", f"<p>{mark if i % 5 == 0 else 'same'} {i}</p>") for i in ids], "page_id long, url string, html string")
    store.fetched(pages("one", range(100)), 0)
    wanted = spark.createDataFrame([(f"https://c{i}.uk/p",) for i in (0, 1, 2)], "page_key string")
    buckets, found = store.wanted(spark, wanted)
    assert {int(f.split("/bucket=")[1].split("/")[0]) for f in found.inputFiles()} <= set(buckets)
    assert len(buckets) < 8 and {r.page_id for r in found.collect()} == {i for i in range(100) if i % 20 < 3}
    read = lambda rows: rows.select("page_id", "url", "page_key", "content_hash", F.lit("text").alias("step"))
    changed = store.changed(spark, buckets, found)
    assert changed.count() == 15
    store.add_items(read(changed), 0)
    store.fetched(pages("two", range(0, 100, 2)), 1)
    buckets, found = store.wanted(spark, wanted)
    changed = store.changed(spark, buckets, found)
    assert {r.page_id for r in changed.collect()} == {0, 20, 40, 60, 80}
    store.add_items(read(changed), 1)
    assert store.current_items(spark, buckets, found).count() == 15


def test_newest_snapshot(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        snapshots.newest_snapshot(spark, path)
    for n, day in enumerate([3, 5, 5, 4]):
        snapshots.commit_snapshot(spark.range(n, n + 1), path, f"s{day}", at=datetime(2024, 1, day))
    got = snapshots.newest_snapshot(spark, path)
    assert got.first().id == 2
    assert len(got.inputFiles()) <= spark.sparkContext.defaultParallelism
    # A folder that no record names, as a job leaves it that died, does not count.
    spark.range(9).write.parquet(f"{path}/data/s9-dead")
    assert snapshots.newest_snapshot(spark, path).first().id == 2


def test_log_without_a_folder(spark, tmp_path):
    assert log.read(spark, str(tmp_path / "none")).count() == 0
