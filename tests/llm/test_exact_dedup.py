import hashlib
import re
from collections import defaultdict

import pytest

from licensum.llm.exact_dedup import exact_dedup
from licensum.llm.queries import QUERIES
from tests.llm.helpers import ODD, documents, folder


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[norm(r[1])].append((-len(r[1] or ""), r[0] is None, r[0], i))
    best = {k: min(v) for k, v in groups.items()}
    return {(r[0], best[norm(r[1])][2], len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows}


@pytest.mark.parametrize("rows", [ODD, [], ODD[1:2], [(i, "same text", None, None) for i in range(50)] + [(99, "same  text", None, None)]])
def test_groups(spark, tmp_path, rows):
    got = QUERIES["op10_exact_dedup"](spark, folder(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got} == brute(rows)
    assert sorted((r.keep_id is None, r.keep_id) for r in got if r.kept) == sorted({(r.keep_id is None, r.keep_id) for r in got})


def test_same_beginning_needs_the_whole_content(spark):
    rows = [(1, "a" * 200 + "b", None, None), (2, "a" * 200 + "c", None, None), (3, "a" * 200 + " c", None, None)]
    got = {r.row.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(documents(spark, rows)).collect()}
    assert got == {1: (1, 1, True), 2: (3, 2, False), 3: (3, 2, True)}


def test_all_columns_travel(spark):
    df = documents(spark, ODD)
    kept = exact_dedup(df).filter("kept").select("row.*")
    assert kept.columns == df.columns
    assert kept.count() == 5
