import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash

from licensum.llm import simhash
from licensum.llm.components import connected
from licensum.llm.queries import QUERIES
from tests.llm.helpers import ODD, folder


def fingerprint(text, size=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, fps, radius=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(fps)):
        members[find(i)].append(rows[i][0])
    return [min((x for x in members[find(i)] if x is not None), default=None) for i in range(len(fps))]


def near_rows(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], None
    for i in range(n):
        if i % 8 == 0:
            base = rng.choices(vocabulary, k=rng.choice([3, 60, 300]))
        text = base.copy()
        for _ in range(i % 8 // 2):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((i, " ".join(text), "en", "s"))
    return rows


@pytest.mark.parametrize("rows", [ODD, [], near_rows(160, 1)])
def test_query(spark, tmp_path, rows):
    got = QUERIES["op2_simhash_near_dedup"](spark, folder(spark, tmp_path, rows)).collect()
    fps = [fingerprint(r[1]) for r in rows]
    want = [(r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components(rows, fps), strict=True)]
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)


def test_majority_over_many_hashes():
    rng = np.random.default_rng(0)
    counts = np.array([0, 1, 254, 255, 256, 1000, 2, 0])
    hashes = rng.integers(0, 2**64, counts.sum(), dtype=np.uint64)
    ends = np.cumsum(counts)
    for n, end, got in zip(counts, ends, simhash.majority(hashes, counts), strict=True):
        own = [int(x) for x in hashes[end - n : end]]
        assert int(got) == sum(1 << b for b in range(64) if own and 2 * sum(h >> b & 1 for h in own) > len(own))


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_every_pair_in_the_radius_collides(radius):
    masks = simhash.covering_masks(tuple(range(64)), radius, 0)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    for _ in range(2000):
        differing = sum(1 << b for b in rng.sample(range(64), rng.randint(1, radius)))
        assert any(differing & m == 0 for m in masks)


def test_refined_buckets_lose_no_link(spark):
    """Dense fingerprints with buckets far above the limit, so that all levels are used."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    nodes = spark.createDataFrame(pd.DataFrame({"fp": signed}))
    roots = {r.node: r.root for r in connected(simhash.links(nodes, bucket=60)).collect()}
    rows = [(v,) for v in signed]
    want = brute_components(rows, [v % 2**64 for v in signed])
    groups = defaultdict(set)
    for v in signed:
        groups[roots.get(v, v)].add(v)
    expected = defaultdict(set)
    for v, c in zip(signed, want, strict=True):
        expected[c].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("(id * 7919) % 1000003 AS a", "((id + 1) * 7919) % 1000003 AS b")
    roots = {r.node: r.root for r in connected(edges).collect()}
    assert len(roots) == 301
    assert set(roots.values()) == {0}
