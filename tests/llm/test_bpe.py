import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from licensum.llm import bpe
from licensum.llm.queries import QUERIES
from tests.llm.helpers import ODD, folder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_texts_of_all_kinds(library):
    rng = random.Random(0)
    letters = list("etaoinshr  dlu.,'0123\nABCéß日\U0001f389\x00\x85\u3000\u0301") + ["<|endoftext|>", "'ll", "the", "ing"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)] + ["mississippi" * 20, "a" * 300, "-" * 77, " " * 33]
    own = bpe.tokenizer(PATH)
    ids = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [own.encode(t) for t in texts] == ids
    assert [own.decode(x) for x in ids] == library.decode_batch(ids, skip_special_tokens=False)
    assert own.decode([0, 255, 130, 50256]) == library.decode([0, 255, 130, 50256], skip_special_tokens=False)


def test_small_automaton_against_merging():
    """All words over two letters, against merging the leftmost best pair again and again."""
    merges = [(b"a", b"b"), (b"a", b"a"), (b"ab", b"a"), (b"aa", b"ab"), (b"b", b"b"), (b"aba", b"bb"), (b"aa", b"a")]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys([b"a", b"b", *(x + y for x, y in merges)]))}
    automaton = bpe.Automaton(vocabulary, merges)
    for n in range(1, 11):
        for k in range(2**n):
            word = bytes(b"ab"[k >> i & 1] for i in range(n))
            parts = [bytes([c]) for c in word]
            for x, y in merges:
                out = []
                for p in parts:
                    if out and out[-1] == x and p == y:
                        out[-1] = x + y
                    else:
                        out.append(p)
                parts = out
            assert [automaton.labels[t] for t in automaton.encode(word)] == parts, word


@pytest.mark.parametrize("rows", [ODD, []])
def test_query(spark, tmp_path, library, rows):
    got = QUERIES["op7_bpe_round_trip"](spark, folder(spark, tmp_path, rows)).collect()
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
