import random
import re
import zlib
from collections import Counter

import pytest

from licensum.llm import spelling
from licensum.llm.queries import QUERIES
from tests.llm.helpers import ODD, folder

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if is_near(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = (n, len(near), form, counts.get(form))
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w] = (*out[w], root)
    return out


def random_words(seed, many, letters, longest):
    r = random.Random(seed)
    return {"".join(r.choice(letters) for _ in range(r.randint(1, longest))): r.choice([1, 2, 3, 5, 8, 20, 20, 40]) for _ in range(many)}


SMALL, MORE, ONE_LETTER = random_words(1, 300, "ab", 9), random_words(2, 400, "abcé", 5), random_words(3, 200, "a", 14)
HUGE = {"x" * 30_000: 1, "x" * 30_001: 4, "y" + "x" * 29_999: 2, "x" * 15_000 + "y" + "x" * 15_000: 9}


@pytest.mark.parametrize("words,block", [(SMALL, 20_000), (SMALL, 12), (MORE, 20_000), (MORE, 25), (ONE_LETTER, 1), (HUGE, 20_000), ({}, 20_000), ({"aaaaa": 3}, 1)])
def test_variants(spark, words, block):
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), block=block).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == brute(words)
    assert len(got) == len(words)


def test_pairs_come_once(spark):
    words = SMALL
    got = spelling.near_pairs(spark.createDataFrame(list(words.items()), "word string, n long"), block=30).collect()
    want = {frozenset((a, b)) for a in words for b in words if is_near(a, b)}
    assert len(got) == len(want)
    assert {frozenset(r) for r in got} == want


def test_acceptor_is_minimal():
    own = spelling.Acceptors()
    start = own.add(sorted(["tap", "taps", "top", "tops"]))
    assert len(own.arcs) == 5
    assert own.size[start] == 4


def documents(seed, many):
    r = random.Random(seed)
    words = ["Hello", "hallo", "hullo", "shell", "shelf", "Übung", "übung", "naïve", "naive", "naives", "x×y÷zzz", "abcd"]
    return [(i, " ".join(r.choice(words) + r.choice(["", ",", "-", "1"]) for _ in range(r.randint(0, 60))), None, None) for i in range(many)]


@pytest.mark.parametrize("rows", [[], ODD, documents(5, 400)])
def test_query(spark, tmp_path, rows):
    got = QUERIES["op12_spelling_variants"](spark, folder(spark, tmp_path, rows)).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == brute(counted(rows))
    assert len(got) == len(counted(rows))
