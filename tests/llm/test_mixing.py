import random
from collections import defaultdict

import pytest

from licensum.llm import mixing
from licensum.llm.queries import QUERIES
from tests.llm.helpers import ODD, folder, words


def targets(sizes):
    """Shares by weight, again and again, until none is above twice its source."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, out, rest = 1.5 * sum(sizes.values()), {}, set(order)
    while rest:
        level = (total - sum(out.values())) / sum(weight[s] for s in rest)
        above = {s for s in rest if weight[s] * level > 2 * sizes[s]}
        if not above:
            return out | {s: weight[s] * level for s in rest}
        out |= {s: 2.0 * sizes[s] for s in above}
        rest -= above
    return out


def mixture(n):
    rng = random.Random(4)
    return [(i, " ".join(["w"] * int(rng.paretovariate(1.1) * 20)), None, rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(n)]


@pytest.mark.parametrize("rows", [mixture(600), ODD, [], [(i, "", None, "a") for i in range(3)]])
def test_query(spark, tmp_path, rows):
    path = folder(spark, tmp_path, rows)
    got = QUERIES["op8_entropy_mixing"](spark, path).collect()
    size = {i: len(words(r[1])) for i, r in enumerate(rows)}
    sizes = defaultdict(int)
    for i, r in enumerate(rows):
        sizes[r[3]] += size[i]
    want, source = targets(sizes), {r[0]: r[3] for r in rows}
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), size[i]) for i, r in enumerate(rows))
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    if len(rows) == 600:
        assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] for s in want)
        assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in QUERIES["op8_entropy_mixing"](spark, path).collect()}
        # The dual is solved: rates, before rounding, meet the target.
        rates = defaultdict(float)
        for r in got:
            rates[source[r.doc_id]] += r.rate * r["size"]
        assert all(rates[s] == pytest.approx(want[s], rel=1e-6) for s in want)


def test_steps_that_do_not_reach_the_targets_are_an_error(spark):
    cells = spark.createDataFrame([("a", 10, 5), ("a", 900, 2), ("b", 7, 40)], "source string, size long, n long")
    goals = spark.createDataFrame([("a", 1850, 3000.0), ("b", 280, 100.0)], "source string, source_size long, target double")
    assert {r.source for r in mixing.tilts(cells, goals).collect()} == {"a", "b"}
    with pytest.raises(RuntimeError, match="after 1 steps"):
        mixing.tilts(cells, goals, steps=1)
