"""Physical plans of the jobs that run on all data."""

import pytest

from checks.all_queries import QUERIES
from licensum.operators import pages
from licensum.operators.resolve import drop_exact_copies
from licensum.plans.processing import process_licences
from tests.test_licences import AS_OF, many

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path):
    many(spark).write.parquet(str(tmp_path / "raw"))
    return spark.read.parquet(str(tmp_path / "raw"))


def test_processing_has_one_shuffle_with_partial_aggregation(stored):
    text = plan(process_licences(stored, as_of=AS_OF))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Exchange") == 1
    assert "partial_min_by" in text and "Python" not in text


def test_copies_are_dropped_before_the_shuffle(stored):
    text = plan(drop_exact_copies(stored))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange") == 1


def test_links_need_no_shuffle(spark):
    text = plan(pages.scored_links(spark.read.parquet(f"{SF}/pages.parquet")))
    assert "Exchange" not in text and "Python" not in text


def test_period_filter_reaches_the_stored_table(spark, tmp_path, stored):
    from datetime import datetime

    from licensum.operators.clean import effective_between

    process_licences(stored, as_of=AS_OF).write.parquet(str(tmp_path / "done"))
    done = spark.read.parquet(str(tmp_path / "done"))
    text = plan(effective_between(done, datetime(2024, 1, 1), datetime(2024, 2, 1)).select("seq"))
    assert "GreaterThanOrEqual(effective_ts" in text and "ReadSchema: struct<seq:bigint,effective_ts" in text


@pytest.mark.parametrize("name", ["l1_a17_council_analysis", "a20_geographic_analysis", "a18_business_type_analysis", "l6_extract_licences", "k10_recently_successful"])
def test_no_cross_join_and_no_single_task_window(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text


@pytest.mark.parametrize("name", ["a18_business_type_analysis", "a19_activity_analysis", "a20_geographic_analysis"])
def test_exploded_entries_are_hashed(spark, name):
    """What is exploded goes into a hash aggregation; only the counts behind it may be sorted."""
    lines = [x for x in plan(QUERIES[name](spark, SF)).splitlines() if "Generate explode" in x or "Aggregate(" in x]
    above = [i - 1 for i, x in enumerate(lines) if "Generate explode" in x and i and "Generate explode" not in lines[i - 1]]
    assert above and all("HashAggregate(" in lines[i] and "partial_count" in lines[i] for i in above)
