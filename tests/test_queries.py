"""Registered queries over tables that a test builds."""

import time
from datetime import datetime

from pyspark.sql import functions as F

import checks.tables
from checks.all_queries import QUERIES
from checks.tables import Tables
from licensum.operators import responses
from licensum.plans import processing
from licensum.streaming import upsert


def tables(spark, tmp_path, **rows):
    """A folder with the given tables; a table is its rows and their schema."""
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_join_analyses_keeps_the_last_analysis(spark, tmp_path):
    # Councils 0, 50 and 100 share a name; 50 and 100 have an analysis, and the last one counts for all three.
    folder = tables(spark, tmp_path, customer=([(i,) for i in (0, 4, 5, 6, 50, 100)], "c_custkey long"))
    got = {r.seq: (r.analysed, r.strategy) for r in QUERIES["j1_j4_join_analyses"](spark, folder).collect()}
    assert got == {0: (True, "rendered"), 50: (True, "rendered"), 100: (True, "rendered"), 4: (True, "rendered"), 5: (True, "plain"), 6: (False, "plain")}


def test_derived_rows_are_dealt_to_more_tasks_as_they_grow(spark, tmp_path, monkeypatch):
    order = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string"
    rows = [(i, i % 7, "F", datetime(1996, 1, 2), "2-HIGH") for i in range(400)]
    folder = tables(
        spark, tmp_path, orders=(rows, order), customer=([(i, i % 3) for i in range(7)], "c_custkey long, c_nationkey long"),
        nation=([(i, f"N{i}") for i in range(3)], "n_nationkey long, n_name string"),
    )
    monkeypatch.setattr(checks.tables, "ROWS", 20)
    t = Tables(spark, folder)
    for df in (t.register_pages, t.card_pages, t.raw, t.list_responses):
        sizes = df.select("*").rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
        assert len(sizes) == 20
        assert sum(sizes) == 400
        assert max(sizes) < 100


def test_a_long_list_is_read_once(spark):
    """Each item used to read the whole list again."""
    item = '{"premises_name": "Inn", "premises_address": "1 Low Rd", "conditions": [], "licensable_activities": []}'
    values = [(1, "x", f"[{', '.join([item] * 5000)}]"), (2, "x", "none"), (3, "x", "[null]"), (4, "x", "[]"), (5, "x", None)]
    df = spark.createDataFrame(values, "page_id long, council_name string, response string")
    start = time.perf_counter()
    got = responses.parse_array_responses(df).groupBy("page_id", "reject_reason").agg(F.count("*"), F.max("item")).collect()
    assert time.perf_counter() - start < 60
    assert {tuple(r) for r in got} == {(1, None, 5000, 4999), (2, "no JSON found", 1, None), (3, "no JSON found", 1, 0), (5, "no JSON found", 1, None)}


ORDER = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string"


def licence_tables(spark, tmp_path, n=60):
    rows = [(i, i % 7, "FOP"[i % 3], datetime(1996, 1, 2), "2-HIGH") for i in range(n)]
    return tables(
        spark, tmp_path, orders=(rows, ORDER), customer=([(i, i % 3) for i in range(7)], "c_custkey long, c_nationkey long"),
        nation=([(i, f"N{i}") for i in range(3)], "n_nationkey long, n_name string"),
    )


def rows_cleaned(spark, monkeypatch, run):
    """How many rows are cleaned while ``run`` runs; one that is cleaned twice counts twice."""
    counted = spark.sparkContext.accumulator(0)
    whole = processing.clean_licences
    mark = F.udf(lambda x: counted.add(1) or x, "string")
    monkeypatch.setattr(processing, "clean_licences", lambda raw, **options: whole(raw.withColumn("council_name", mark("council_name")), **options))
    run()
    return counted.value


def test_report_sheets_and_log_clean_each_row_once(spark, tmp_path, monkeypatch):
    folder = licence_tables(spark, tmp_path)
    for name in ("s12_report_sheets", "s8_newest_of_log"):
        with monkeypatch.context() as patch:
            assert rows_cleaned(spark, patch, lambda: QUERIES[name](spark, folder).collect()) == 60, name


def test_upsert_deals_a_batch_to_all_cores(spark, tmp_path, monkeypatch):
    seen = []
    whole = upsert.merge_batch
    monkeypatch.setattr(upsert, "merge_batch", lambda batch, *rest: seen.append(batch.rdd.getNumPartitions()) or whole(batch, *rest))
    QUERIES["t2_stream_upsert"](spark, licence_tables(spark, tmp_path)).collect()
    assert seen
    assert min(seen) == spark.sparkContext.defaultParallelism
