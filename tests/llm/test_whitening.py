import numpy as np
import pytest

from licensum.llm import whitening
from licensum.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


def graded(n, steps):
    q, _ = np.linalg.qr(np.random.default_rng(n).standard_normal((n, n)))
    return np.diag(steps) @ q


@pytest.mark.parametrize(
    "r",
    [np.random.default_rng(0).standard_normal((64, 64)), np.eye(20), np.diag([5.0, 5, 5, 3, 3, 1, 1e-9, 0]), graded(30, 10.0 ** -np.arange(0, 7.5, 0.25)), np.ones((9, 9)), np.triu(np.ones((40, 40))), np.array([[3.0]]), np.diag(1 + 1e-13 * np.arange(16))],
)
def test_directions(r):
    values, vectors = whitening.directions(r, len(r))
    own = r.T @ r
    singular = np.linalg.svd(r, compute_uv=False)[: len(values)]
    assert np.allclose(np.sqrt(values), singular, rtol=0, atol=1e-13 * singular[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(own @ vectors - vectors * values).max() < 1e-13 * np.abs(own).sum()


def test_nothing_to_whiten():
    assert whitening.directions(np.zeros((4, 4)), 4)[1].shape == (4, 0)


def test_small_values_keep_their_accuracy():
    a = 10.0 ** -np.arange(20)
    found = np.sqrt(whitening.squares(a * a, (a[:-1] / 2) ** 2))
    assert np.prod(found) == pytest.approx(np.prod(a), rel=1e-13)


def brute(rows, most=4):
    kept = [(i, [int(np.floor(np.float64(np.float32(c)) * 256)) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-values)[:most]
    out = []
    for i, x in kept:
        dev = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        own = np.array([(n * c - s) / n for c, s in zip(x, sums, strict=True)])
        out += [(i, k + 1, n, dev, own @ vectors[:, o] / np.sqrt(values[o]), values[o] / values.sum()) for k, o in enumerate(order)]
    return out


def vectors(spark, tmp_path, rows):
    spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, label int, component double").write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def random_rows(n, d, seed=3):
    x = np.random.default_rng(seed).standard_normal((n, d)) * (1 + np.arange(d)) / d
    return [(i, v) for i, v in enumerate(x.tolist())]


ROWS = [
    random_rows(500, 12),
    [*random_rows(60, 5), *random_rows(60, 5), (None, [0.1, 0.2, 0.3, 0.4, 0.5]), (7, None), (8, []), (9, [1.0, None, 1.0, 1.0, 1.0]), (10, [NAN, 0.0, 0.0, 0.0, 0.0]), (11, [INF, 0.0, 0.0, 0.0, 0.0])],
    [(i, [100.0 * i, -0.0]) for i in range(20)] + [(1, [5.0, 1.0])],
    [(i, [float(v[0])] * 1) for i, v in random_rows(50, 1)] + [(5, [0.001])] * 400,
]


@pytest.mark.parametrize("rows", ROWS)
def test_query(spark, tmp_path, rows):
    got = QUERIES["op13_whitened_embeddings"](spark, vectors(spark, tmp_path, rows)).collect()
    want = brute(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4]))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    # Either sign, but the same for all rows.
    for k in {r[1] for r in want}:
        ours, theirs = (np.array([r[4] for r in x if r[1] == k]) for x in (got, want))
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-9
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert {r[6] for r in got} == {got[0][6]}
    assert got[0][6] < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [NAN])], [(1, [1.0, 2.0])] * 5])
def test_no_variance(spark, tmp_path, rows):
    assert QUERIES["op13_whitened_embeddings"](spark, vectors(spark, tmp_path, rows)).collect() == []


def test_large_entries(spark):
    rows = spark.createDataFrame([(1, [1e12, 0.0]), (2, [0.0, 1e12]), (3, [3.0, 4.0]), (4, [1e300, 0.0])], "vec_id string, embedding array<double>")
    got = whitening.whiten(rows).collect()
    assert {(r.vec_id, r.n, r.deviation) for r in got} == {("1", 3, None), ("2", 3, None), ("3", 3, None)}
    assert max(abs(r.identity_error) for r in got) < 1e-9


def test_lengths_must_agree(spark):
    with pytest.raises(ValueError, match="lengths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))
