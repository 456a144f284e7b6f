import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest

from licensum.llm import hilbert_shards
from licensum.llm.queries import QUERIES
from tests.llm.helpers import ODD, folder


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    points = np.array(list(product(range(2**bits), repeat=dims)))
    index = hilbert_shards.hilbert_index(points, bits)
    assert sorted(index.tolist()) == list(range(len(points)))
    along = points[np.argsort(index)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("rows", [ODD, [], [(i, f"text {i % 50} " * (i % 7), ["en", None, "de"][i % 3], f"s{i % 5}") for i in range(333)], [(i, "copy", "en", "s") for i in range(100)]])
def test_query(spark, tmp_path, rows):
    got = QUERIES["op6_hilbert_shards"](spark, folder(spark, tmp_path, rows)).collect()
    want = sorted(((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    shards = defaultdict(list)
    for r in got:
        assert (r.law, r.grown_shard) == ("rows", None)
        shards[r.shard].append((r.slot, r.curve))
    sizes = [len(shards[s]) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    assert all([s for s, _ in sorted(x)] == list(range(len(x))) for x in shards.values())
    curve = [c for s in range(40) for _, c in sorted(shards[s])]
    assert curve == sorted(curve)


def test_written_shards(spark, tmp_path):
    rows = hilbert_shards.assign(spark.read.parquet(folder(spark, tmp_path, ODD) + "/documents.parquet"), shards=3)
    hilbert_shards.write(rows, str(tmp_path / "out"))
    assert sorted(r.shard for r in spark.read.parquet(str(tmp_path / "out")).select("shard").collect()) == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_steps_of_texts_with_one_beginning(spark):
    """Whole values are ordered, however long what they share; a frequent value is one step, and NULL comes first."""
    values = [f"https://www.example.org/{i:03}" for i in range(100)] + ["https://www.example.org/050"] * 300 + [None] * 5
    df = spark.createDataFrame([(v,) for v in values], "source string")
    steps = df.select("source", hilbert_shards.text_steps(df, "source", 3).alias("s")).distinct().collect()
    found = sorted((r.source, r.s) for r in steps if r.source is not None)
    assert [s for _, s in found] == sorted(s for _, s in found)
    assert [(v, s) for v, s in found if s != sum(x is not None and x < v for x in values) * 8 // 400] == []
    assert {r.s for r in steps if r.source is None} == {-1}
