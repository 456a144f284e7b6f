import random
import zlib

import numpy as np

from licensum.llm import language_id
from licensum.llm.queries import QUERIES
from tests.llm.helpers import ODD, folder

WORDS = {"en": "the of and house water think", "de": "der und straße wasser haus denken", "fr": "le des eau maison penser où"}


def corpus(n):
    rng = random.Random(3)
    return [(i, " ".join(rng.choices(WORDS[lang].split(), k=12)), lang, "s") for i in range(n) for lang in [rng.choice(list(WORDS))]]


def plain(rows, dimensions=language_id.DIMENSIONS):
    """Every letter vector turned, multiplied and added one by one."""
    turned = [v.astype(np.int64) for v in language_id.letters(dimensions)]

    def vector(text):
        s = [0]
        for c in f"{text or ''} ":
            slot = int(language_id.slot_of()[ord(c)])
            if slot or s[-1]:
                s.append(slot)
        out = np.zeros(dimensions, np.int64)
        for x, y, z in zip(s, s[1:], s[2:], strict=False):
            if y or (x and z):
                out += turned[0][x] * turned[1][y] * turned[2][z]
        return out

    vectors = [vector(r[1]) for r in rows]
    sums = {}
    for r, v in zip(rows, vectors, strict=True):
        if r[2] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 != 1:
            sums[r[2]] = sums.get(r[2], 0) + v
    out = {}
    for r, v in zip(rows, vectors, strict=True):
        best = max(((float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)), k) for k, p in sums.items()), default=(0, "und")) if v.any() else (0, "und")
        out[r[0]] = (best[1], max(0.0, best[0]))
    return out


def test_query_against_plain_vectors(spark, tmp_path):
    rows = [r for r in corpus(150) + [(1000 + i, *r[1:]) for i, r in enumerate(ODD)] if r[1] is None or len(r[1]) < 1000]
    got = QUERIES["op3_language_id"](spark, folder(spark, tmp_path, rows)).collect()
    want = plain(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert (r.lang_pred, round(r.score, 4)) == (want[r.doc_id][0], round(want[r.doc_id][1], 4))
    assert all(r.lang_pred == rows[r.doc_id][2] for r in got if r.held_out and r.doc_id < 150)


def test_nothing_to_learn_from(spark, tmp_path):
    got = QUERIES["op3_language_id"](spark, folder(spark, tmp_path, ODD[1:4])).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    (tmp_path / "none").mkdir()
    assert QUERIES["op3_language_id"](spark, folder(spark, tmp_path / "none", [])).count() == 0
