import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from licensum.llm import maxent_lm
from licensum.llm.queries import QUERIES
from tests.llm.helpers import ODD, folder


def base(rows):
    tokens = {i: [*(r[1] or "").encode().lower().split(), b"\n"] for i, r in enumerate(rows)}
    train = [i for i, r in enumerate(rows) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10]
    c = Counter(t for i in train for t in tokens[i])
    n, v = sum(c.values()), len(c)
    return n, [(rows[i][0], len(x), sum(c[t] > 0 for t in x), sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in x)) for i, x in tokens.items()]


def two_tongues(n):
    rng = random.Random(1)
    tongues = ["red green blue white black", "eins zwei drei vier sieben"]
    return [(i, " ".join(rng.choices(tongues[i % 2].split(), k=30)), None, None) for i in range(n)]


@pytest.mark.parametrize("rows", [ODD, two_tongues(300), []])
def test_query(spark, tmp_path, rows):
    got = QUERIES["op9_lm_scores"](spark, folder(spark, tmp_path, rows)).collect()
    n, want = base(rows)
    assert {r.train_tokens for r in got} <= {n}
    key = lambda r: (str(r[0]), *r[1:])
    for r, w in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=key), sorted(want, key=key), strict=True):
        assert r[:3] == w[:3]
        assert r[3] == pytest.approx(w[3])
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in got)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    if len(rows) == 300:
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_add_up():
    model = np.random.default_rng(0).normal(size=(maxent_lm.CELLS, maxent_lm.CLASSES)).astype(np.float32)
    cells = maxent_lm.feature_cells(np.arange(1, 50, dtype=np.uint64), np.arange(49) % 7 == 0)
    assert cells.min() >= 0
    assert cells.max() < maxent_lm.CELLS
    each = sum(10 ** maxent_lm.class_log10(model, cells, np.full(49, k)) for k in range(maxent_lm.CLASSES))
    assert each == pytest.approx(1, abs=1e-4)


def test_sums_over_cells():
    rng = np.random.default_rng(1)
    cells = np.stack([np.zeros(9000, np.int64), *(rng.integers(1, 40, 9000) for _ in range(3))], axis=1)
    classes = rng.integers(0, maxent_lm.CLASSES, 9000)
    model = rng.normal(size=(maxent_lm.CELLS, maxent_lm.CLASSES)).astype(np.float32)
    seen, due = np.zeros(model.shape), np.zeros(model.shape)
    maxent_lm.add_observed(seen, cells, classes)
    maxent_lm.add_expected(due, cells, model)
    want, want_due = np.zeros(model.shape), np.zeros(model.shape)
    for row, k in zip(cells, classes, strict=True):
        scores = np.exp((model[row].sum(axis=0)).astype(np.float64))
        for cell in row:
            want[cell, k] += 1
            want_due[cell] += scores / scores.sum()
    assert (seen == want).all()
    assert np.abs(due - want_due).max() < 1e-2


def chain(n, seed=3):
    """Texts in which each word has few successors."""
    rng = random.Random(seed)
    words = [a + b for a in "abcdefgh" for b in ("la", "me", "ni", "po", "ru", "ty")]
    after = {w: rng.sample(words, 3) for w in words}
    rows = []
    for i in range(n):
        text = [rng.choice(words)]
        for _ in range(39):
            text.append(rng.choice(after[text[-1]]))
        rows.append((i, " ".join(text), None, None))
    return rows


def test_learning_does_not_depend_on_tasks_and_goes_on(spark):
    rows = spark.createDataFrame([r[:2] for r in chain(400)], "doc_id long, text string")
    gain = {}
    for files, rounds in ((1, 1), (32, 1), (32, 3)):
        got = maxent_lm.score(rows.repartition(files), rounds=rounds).filter("held_out").groupBy().sum("score", "base_score", "n_tokens").first()
        gain[files, rounds] = (got[0] - got[1]) / got[2]
    assert gain[1, 1] > 0.3
    assert gain[32, 1] == pytest.approx(gain[1, 1], rel=1e-3)
    assert gain[32, 3] > gain[32, 1]


def test_default_learning_goes_beyond_the_constant(spark, monkeypatch):
    """The first round alone knows its expectations without a look at the texts; by default the model is asked for them."""
    rows = spark.createDataFrame([r[:2] for r in chain(400)], "doc_id long, text string")
    asked = []
    whole = maxent_lm._summed
    monkeypatch.setattr(maxent_lm, "_summed", lambda docs, add: asked.append(add) or whole(docs, add))
    held = lambda **options: maxent_lm.score(rows, **options).filter("held_out").groupBy().sum("score").first()[0]
    default = held()
    assert len(asked) > 1
    assert default > held(rounds=1)


def test_expected_sums_cost_little_more_than_the_scores():
    """Rows are summed by class, not by cell: most cells have one row, and a call for each costs more than all scores."""
    rng = np.random.default_rng(4)
    cells = np.stack([np.zeros(60_000, np.int64), *(rng.integers(1, maxent_lm.CELLS, 60_000) for _ in range(3))], axis=1)
    model = rng.normal(size=(maxent_lm.CELLS, maxent_lm.CLASSES)).astype(np.float32)
    sums = np.zeros(model.shape, order="F")

    def cost(do):
        start = time.process_time()
        do()
        return time.process_time() - start

    scores = lambda: [maxent_lm.logits(model, cells[i : i + maxent_lm.TOKENS]) for i in range(0, len(cells), maxent_lm.TOKENS)]
    assert min(cost(lambda: maxent_lm.add_expected(sums, cells, model)) for _ in range(3)) < 8 * min(cost(scores) for _ in range(3))


def test_words_are_numbered_in_order():
    words = maxent_lm.Vocabulary()
    first, _ = maxent_lm.gathered([b"b a B", b""], words)
    words.arrays()
    second, counts = maxent_lm.gathered([b"a c"], words)
    hashes, classes = words.arrays()
    assert (first.tolist(), second.tolist(), counts.tolist()) == ([0, 1, 0, 2, 2], [1, 3, 2], [3])
    assert hashes.tolist() == [xxhash.xxh64_intdigest(w) for w in (b"b", b"a", b"\n", b"c")]
    assert classes.tolist() == [maxent_lm.word_class(w) for w in (b"b", b"a", b"\n", b"c")]


def test_words_are_hashed_as_arrays():
    texts = [b"", b" ", b"a", b"\n", b" A b\x0bC\x1c d\x00 ", b"x" * 31 + b" " + b"y" * 32 + b" " + b"Z" * 300 + b"\xff", "Ü É\x85x".encode(), *(bytes([65 + k % 26]) * k for k in range(40))]
    hashes, classes, counts = maxent_lm.hashed(texts)
    want = [t for text in texts for t in maxent_lm.tokens(text)]
    assert hashes.tolist() == [xxhash.xxh64_intdigest(t) for t in want]
    assert classes.tolist() == [maxent_lm.word_class(t) for t in want]
    assert counts.tolist() == [len(maxent_lm.tokens(text)) for text in texts]
    assert [len(x) for x in maxent_lm.hashed([])] == [0, 0, 0]


def test_equal_contexts_are_expected_once(monkeypatch):
    cells = np.stack([np.zeros(9000, np.int64), *(np.arange(9000) % 10 + 20 * i for i in (1, 2, 3))], axis=1)
    model = np.random.default_rng(5).normal(size=(maxent_lm.CELLS, maxent_lm.CLASSES)).astype(np.float32)
    asked, whole = [], maxent_lm.logits
    monkeypatch.setattr(maxent_lm, "logits", lambda m, c: asked.append(len(c)) or whole(m, c))
    sums = np.zeros(model.shape)
    maxent_lm.add_expected(sums, cells, model)
    assert sum(asked) == 10
    assert sums[cells[:10, 1]].sum() == pytest.approx(9000, rel=1e-5)


def test_small_partitions_share_the_task_that_gives_sums(spark, monkeypatch):
    rows = spark.createDataFrame([r[:2] for r in two_tongues(200)], "doc_id long, text string").repartition(200)
    most = 2 * spark.sparkContext.defaultParallelism
    parts, frame = [], type(rows)
    whole = frame.coalesce
    monkeypatch.setattr(frame, "coalesce", lambda df, n: parts.append(n) or whole(df, n))
    assert maxent_lm._summed(rows, maxent_lm.add_observed)[0].sum() == 200 * 31
    assert parts == [max(most, 50)]
