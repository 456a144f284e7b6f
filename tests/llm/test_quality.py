import random
import re
from collections import Counter

import pytest

from licensum.llm import quality
from licensum.llm.queries import QUERIES
from tests.llm.helpers import ODD, folder, words


def base(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def random_text(rng):
    text = " ".join(rng.choice(["a", "b", "c d", "e\n", "f|", "\n", "g##", "ü\t"]) for _ in range(rng.randint(0, 60)))
    return text + rng.choice(["", "\n", text])


@pytest.fixture
def labels(spark, tmp_path):
    spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))


@pytest.mark.parametrize("kind", ["odd", "empty", "random"])
def test_counts(spark, tmp_path, labels, kind):
    rng = random.Random(1)
    rows = {"odd": ODD, "empty": [], "random": [(i, random_text(rng), None, None) for i in range(120)]}[kind]
    got = QUERIES["op5_quality_rules"](spark, folder(spark, tmp_path, rows)).collect()
    order = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=order) == sorted(((r[0], *base(r[1])) for r in rows), key=order)
    assert not any(r.kept and r.base_failed for r in got)


def test_verdict_follows_trusted_text(spark, tmp_path, labels):
    rng = random.Random(2)
    prose = lambda: " ".join(rng.choices("the river runs past an old mill and under a stone bridge".split(), k=40)).capitalize() + "."
    junk = lambda: " ".join(w + "$$$" for w in rng.choices("win cash now click here".split(), k=40))
    rows = [(i, prose() if i % 2 == 0 or i > 150 else junk(), None, None) for i in range(200)]
    got = QUERIES["op5_quality_rules"](spark, folder(spark, tmp_path, rows)).collect()
    sound = {r.doc_id for r in got if not r.base_failed}
    assert len(sound) > 100
    assert {r.doc_id for r in got if r.kept} == {i for i in sound if i % 2 == 0 or i > 150}


def test_no_labels(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = QUERIES["op5_quality_rules"](spark, folder(spark, tmp_path, ODD)).collect()
    assert {r.ratio for r in got} == {0.0}
    assert all(r.kept != r.base_failed for r in got)


def test_features_are_made_once_for_the_weights(spark):
    docs = spark.createDataFrame([(1, "One two")], "doc_id long, text string")
    plan = quality.log_ratios(docs, docs.select("doc_id"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan
    assert "size(" not in plan
