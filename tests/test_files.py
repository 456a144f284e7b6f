import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from licensum.operators import clean, councils, runs
from licensum.operators import responses as R
from licensum.sources import readers, writers
from tests.test_licences import AS_OF, licence, table

STAMP = "2024-06-12 10:00:00.000250"


def result(name, n, success=True):
    rows = [{"licence_id": f"{name}{i}", "council_name": name, "premises_name": "P", "premises_address": "A", "licence_type": "new", "licence_status": "granted", "scraped_at": STAMP, "raw_data": {"a": 1}} for i in range(n)]
    return {"council_name": name, "success": success, "licences_found": n, "licences_extracted": rows, "scraping_duration": 1.5, "scraped_at": STAMP}


def test_result_documents(spark, tmp_path):
    path = tmp_path / "extraction_results_1.json"
    path.write_text(json.dumps([result("a", 2), result("b", 1, False), result("c", 0)], indent=2))
    results = readers.read_extraction_results(spark, str(path))
    rows = clean.numbered(clean.licences_of_results(results)).collect()
    assert [r.licence_id for r in sorted(rows, key=lambda r: r.seq)] == ["a0", "a1"]
    assert rows[0].scraped_at == datetime(2024, 6, 12, 10, 0, 0, 250) and json.loads(rows[0].raw_data) == {"a": 1}


def test_missing_and_broken_files(spark, tmp_path):
    assert readers.read_councils(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "x.json").write_text('{"name": "a", "website_url": "u"}\n{"name": ')
    out = readers.read_councils(spark, str(tmp_path / "x.json"), lines=True).cache()
    assert out.filter("_corrupt_record IS NULL").count() == 1 and out.count() == 2


def test_processed_document(spark, tmp_path):
    doc = {"summary": {"original_count": 3, "final_count": 1, "councils": {"a": 1}}, "licences": result("a", 1)["licences_extracted"]}
    (tmp_path / "p.json").write_text(json.dumps(doc, indent=2))
    licences, summary = readers.read_processed(spark, str(tmp_path / "p.json"))
    assert licences.count() == 1 and summary.first().councils == {"a": 1}


def test_latest_snapshot_is_the_newest_file(spark, tmp_path):
    import os

    for i, name in enumerate(["processed_2.json", "processed_1.json"]):
        (tmp_path / name).write_text("{}")
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    assert readers.latest_snapshot(spark, str(tmp_path), "processed_*.json").endswith("processed_1.json")
    with pytest.raises(FileNotFoundError):
        readers.latest_snapshot(spark, str(tmp_path), "nothing_*")


def test_sheets_and_run_summary(spark, tmp_path):
    df = table(spark, [licence(1)])
    writers.write_sheets({"a": df.select("seq", "conditions")}, str(tmp_path / "csv"), "csv")
    assert spark.read.csv(str(tmp_path / "csv/a"), header=True).columns == ["seq", "conditions"]
    for _ in range(2):
        writers.write_run_summary(spark.range(1), str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs")).count() == 2


def test_register_files(spark, tmp_path):
    folder = tmp_path / "local-authority-sct"
    folder.mkdir()
    records = {"A": {"entry": {"official-name": "Royal Borough of X Council", "local-authority-sct": "S1"}}, "B": {"entry": {"name": "only"}}, "C": {}}
    (folder / "records.json").write_text(json.dumps(records))
    row = readers.read_register_files(spark, str(folder / "records.json")).collect()
    # "eng" is not part of this path, so the region is read from "sct".
    assert [(r.name, r.code, r.website_url, r.region) for r in row] == [("Royal Borough of X Council", "S1", "https://www.royalofx.gov.uk", "Scotland")]


@pytest.mark.parametrize("value", ["plain", "it's", 'say "x"', "it's \"x\"", "back\\slash", None, "tab\t"])
def test_printed_length(one, value):
    assert one(councils.printed_length(F.col("c")), value) == len(repr(value))


def test_responses_are_judged_one_by_one(spark):
    good, bad = '{"premises_name": "A", "premises_address": "B"}', '{"premises_name": null, "premises_address": "B"}'
    df = spark.createDataFrame([(1, "c", f"text [{bad}, 5, {good}] more"), (2, "c", "nothing"), (3, "c", "[ broken")], "page_id long, council_name string, response string")
    assert [(r.page_id, r.item) for r in R.accepted(R.parse_array_responses(df)).collect()] == [(1, 2)]
    one_each = spark.createDataFrame([(1, "c", f"so: {good}."), (2, "c", "nothing"), (3, "c", "{ broken }")], df.schema)
    parsed = R.parse_object_responses(one_each)
    assert {r.page_id: r.reject_reason for r in parsed.collect()} == {1: None, 2: "no JSON found", 3: "invalid JSON"}


def test_health_states(spark):
    some = spark.createDataFrame([(AS_OF,)], "last_scraped timestamp_ntz")
    files = lambda when: spark.createDataFrame([("p", when)], "path string, modified timestamp_ntz")
    parts = lambda s: spark.createDataFrame([("c", s)], "component string, status string")
    state = lambda *a: runs.data_health(*a, as_of=AS_OF).first().system_status
    assert state(some, files(AS_OF), parts("exists")) == "healthy"
    assert state(some, files(AS_OF), parts("error: x")) == "degraded"
    assert state(some, files(datetime(2024, 6, 1)), parts("exists")) == "needs_attention"
    assert state(some.limit(0), files(AS_OF), parts("error: x")) == "unhealthy"
