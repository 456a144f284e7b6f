import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from licensum.llm import range_coder
from licensum.llm.queries import QUERIES
from tests.llm.helpers import ODD, folder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("top", [1, 4, 60_000, 2**32])
def test_frames_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    docs, lengths, got = range_coder.decode_frame(range_coder.encode_frame([7, None], np.array([n // 2, n - n // 2]), ids))
    assert docs == [7, None]
    assert lengths.tolist() == [n // 2, n - n // 2]
    assert got.tolist() == ids.tolist()


def test_repeats_cost_little_and_damage_is_found():
    phrase = np.random.default_rng(0).integers(0, 40_000, 50)
    ids = np.tile(phrase, 200)
    data = range_coder.encode_frame([1], np.array([len(ids)]), ids)
    assert len(data) < len(ids) * 2 * 0.35
    for place in (40, len(data) - 300):
        broken = bytearray(data)
        broken[place] ^= 16
        with pytest.raises(ValueError):
            range_coder.decode_frame(bytes(broken))


def test_blocks_are_read_alone_and_damage_stays_in_its_block():
    ids = np.random.default_rng(1).zipf(1.3, 5000).astype(np.uint32)
    data = range_coder.encode_frame([1], np.array([len(ids)]), ids)
    assert range_coder.Frame(data).ids([3])[0].tolist() == ids[3072:4096].tolist()
    assert range_coder.Frame(data).ids([4, 0])[0].tolist() == ids[4096:].tolist()
    broken = bytearray(data)
    place = len(data) - len(range_coder.Frame(data).blocks[4]) - 200
    broken[place] ^= 16
    frame = range_coder.Frame(bytes(broken))
    for i in (0, 1, 2, 4):
        assert frame.ids([i])[0].tolist() == ids[i * 1024 : (i + 1) * 1024].tolist()
    with pytest.raises(ValueError, match="damaged block 3"):
        frame.ids([3])


def test_counts_of_a_block_are_a_third_input_that_adapts():
    ids = np.random.default_rng(2).zipf(1.2, 20_000).astype(np.uint32) % 5000
    model = range_coder.Model(1, np.zeros(5000, np.int32))
    weights = [model.weight0[0]]
    for i in ids[:1024].tolist():
        candidate, chance = model.predict()
        model.update(candidate == i, np.array([i], np.int32))
        weights.append(model.weight0[0])
    assert model.counts.max() == model.MOST
    assert len(set(weights)) > 10
    assert len(set(model.chance0.tolist())) > len(set(range_coder.Model(1, np.zeros(1, np.int32)).chance0.tolist()))
    fresh = range_coder.Model(1, np.zeros(5000, np.int32))
    assert not fresh.counts.any() and fresh.weight0[0] == weights[0]


def test_words_are_encoded_like_whole_texts():
    texts = [r[1] or "" for r in ODD] + ["a \x01 b\x01c", "e\u0301 \x1c x\x85y\xa0z", "İstanbul’s 12,345 'LL", "x<|startoftext|>y"]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    got = range_coder.WordIds(PATH, most=3).texts([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


@pytest.mark.parametrize("rows", [ODD, []])
def test_query(spark, tmp_path, rows):
    got = QUERIES["op1_range_coded_ids"](spark, folder(spark, tmp_path, rows)).collect()
    tokenizer, start, want = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0])):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_small_frames_keep_order(spark, tmp_path):
    rows = [(i * 37 % 200, f"text number {i} " * (i % 9), None, None) for i in range(200)]
    df = spark.read.parquet(folder(spark, tmp_path, rows) + "/documents.parquet")
    path = str(tmp_path / "frames")
    range_coder.write(df, path, tokenizer=PATH, end=2, frame=50)
    docs = range_coder.read(spark, path).join(range_coder.frame_starts(spark, path), ["shard", "frame"]).selectExpr("doc_id", "start + before AS at", "octet_length(ids) DIV 4 AS n").orderBy("at").collect()
    assert [r.doc_id for r in docs] == sorted(r[0] for r in rows)
    assert all(a.at + a.n == b.at for a, b in zip(docs, docs[1:], strict=False))


def test_words_with_accents_are_parted_here(monkeypatch):
    """Each plain character in several places; the library's own normaliser and splitter are not asked."""
    words = range_coder.WordIds(PATH)
    characters = [chr(c) for c in range(0x2030) if range_coder.PLAIN.fullmatch(chr(c))]
    texts = [a + c + b for c in characters for a in ("", "Ab9", "É", "'") for b in ("", "'S", "7ÿ", "÷x")]
    want = [e.ids for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    words.normalise = words.part = None
    assert [np.frombuffer(words[t.encode()], "<u4").tolist() for t in texts] == want
