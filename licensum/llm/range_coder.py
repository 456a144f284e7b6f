"""Token ids in compressed blocks: predictions of order 0 to 2 are mixed and drive a range coder; blocks stand alone.

A frame is a number of whole documents: a header, the frequencies of its ids, and blocks of ``BLOCK`` ids each. In a
block, orders 1 and 2 remember which id followed the last one and the last two, and order 0 counts the ids so far. The
better of orders 1 and 2 gives the candidate. The chance that it is right is mixed from three adaptive estimates, one
for each order: by the confidence of order 2, by that of order 1, and by the count of the candidate in the block, with
weights that adapt too. The coder takes hit or miss by that chance, and after a miss the id by its frequency in the
frame. All that adapts is reset at each block, and each block has a CRC-32 of its ids, so any block is read from its
own bytes and the header. Numbers are integers throughout, so that any machine decodes what another wrote. A batch of
blocks is coded at once, one numpy lane for each.
"""

import json
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from licensum.llm.common import offsets, pieces, raw

BLOCK, FRAME = 1024, 4 << 20
MAGIC = b"CMR2"
HEADER = struct.Struct("<4sIIIIIII")
LOW, TOP = 32, 48
NO_ID = -(2**63)

STRETCH = np.round(256 * np.log((np.arange(4096) + 0.5) / (4095.5 - np.arange(4096)))).astype(np.int32)
SQUASH = np.clip(np.round(4096 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 32, 4064).astype(np.int32)


class Model:
    """The predictions of a number of blocks, for one id of each at a time. Ids are numbers of the frame's symbols."""

    SIZE0, SIZE1, SIZE2, MOST = 9, 10, 11, 7

    def __init__(self, lanes: int, frequent: np.ndarray):
        lane = np.arange(lanes)
        self.frequent = frequent
        self.first, self.second = np.zeros(lanes << self.SIZE1, np.int32), np.zeros(lanes << self.SIZE2, np.int32)
        # Ids are numbered without gaps, so their last bits part them well.
        self.counts, self.mask0 = np.zeros(lanes << self.SIZE0, np.int32), (1 << self.SIZE0) - 1
        self.base0, self.base1, self.base2 = lane << self.SIZE0, lane << self.SIZE1, lane << self.SIZE2
        self.chance2 = np.tile(np.array([200, 1400, 2200, 3000], np.int32), lanes)
        self.chance1 = np.tile(np.add.outer([200, 500, 800, 1100, 400, 1500, 2200, 2900], range(0, 400, 50)).ravel().astype(np.int32), lanes)
        self.chance0 = np.tile(np.add.outer([150, 300, 450, 600, 750, 900, 1050, 1200], range(0, 400, 50)).ravel().astype(np.int32), lanes)
        self.base_chance2, self.base_chance1 = lane * 4, lane * 64
        self.weight2, self.weight1, self.weight0 = (np.full(lanes, w, np.int32) for w in (34000, 34000, 6000))
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.step = 0

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Candidate of each lane, and its chance of 4096."""
        self.at1 = self.base1 + ((self.last * 40503 & 0xFFFF) >> (16 - self.SIZE1))
        self.at2 = self.base2 + ((self.before * 0x9E3779B1 + self.last * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - self.SIZE2))
        self.got1, self.got2 = self.first.take(self.at1), self.second.take(self.at2)
        id1, sure2 = self.got1 >> 2, self.got2 & 3
        candidate = np.where(sure2 > 0, self.got2 >> 2, id1)
        usual = self.base_chance1 + self.frequent.take(candidate)
        kind = (self.got1 & 3) + ((id1 == candidate) << 2)
        count = self.counts.take(self.base0 + (candidate & self.mask0))
        self.place2, self.place1, self.place0 = self.base_chance2 + sure2, usual + (kind << 3), usual + (count << 3)
        self.seen2, self.seen1, self.seen0 = self.chance2.take(self.place2), self.chance1.take(self.place1), self.chance0.take(self.place0)
        self.input2, self.input1, self.input0 = STRETCH.take(self.seen2), STRETCH.take(self.seen1), STRETCH.take(self.seen0)
        dot = (self.weight2 * self.input2 + self.weight1 * self.input1 + self.weight0 * self.input0) >> 16
        self.mixed = SQUASH.take(dot + 2047, mode="clip")
        return candidate, self.mixed

    def update(self, hit: np.ndarray, ids: np.ndarray) -> None:
        target = hit.astype(np.int32) << 12
        error = target - self.mixed
        self.weight2 += self.input2 * error >> 11
        self.weight1 += self.input1 * error >> 11
        self.weight0 += self.input0 * error >> 11
        self.step += 1
        if self.step % 16 == 0:
            np.clip(self.weight2, -131072, 131072, out=self.weight2)
            np.clip(self.weight1, -131072, 131072, out=self.weight1)
            np.clip(self.weight0, -131072, 131072, out=self.weight0)
        self.chance2[self.place2] = self.seen2 + (target - self.seen2 >> 4)
        self.chance1[self.place1] = self.seen1 + (target - self.seen1 >> 4)
        self.chance0[self.place0] = self.seen0 + (target - self.seen0 >> 4)
        at0 = self.base0 + (ids & self.mask0)
        self.counts[at0] = np.minimum(self.counts.take(at0) + 1, self.MOST)
        new = ids << 2 | 1
        for table, at, got in ((self.first, self.at1, self.got1), (self.second, self.at2, self.got2)):
            sure = got & 3
            table[at] = np.where(got >> 2 == ids, got + (sure < 3), np.where(sure > 1, got - 1, new))
        self.before, self.last = self.last, ids.astype(np.int64)


def frequencies(counts: np.ndarray, bits: int) -> np.ndarray:
    """Positive integers in proportion to the counts that add up to 2^bits."""
    free = (1 << bits) - len(counts)
    out = 1 + counts * free // counts.sum()
    out[counts.argmax()] += (1 << bits) - out.sum()
    return out


class Table:
    """Order 0: the frequencies of a frame's symbols."""

    def __init__(self, frequency: np.ndarray, bits: int):
        self.bits = bits
        self.size = frequency.astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.slot = np.repeat(np.arange(len(frequency), dtype=np.int32), frequency)
        self.frequent = np.clip(np.log2(frequency).astype(np.int32) - 1, 0, 7)


def lane_sizes(n: int) -> np.ndarray:
    return np.diff(np.append(np.arange(0, n, BLOCK), n))


class Encoder:
    """A range coder for each lane: ``low`` and ``range`` have 48 bits, and 16 of them leave at a time."""

    def __init__(self, lanes: int, most: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, 1 << TOP, np.int64)
        self.width = most
        self.out, self.at = np.zeros(lanes * most, np.uint32), np.arange(lanes) * most

    def put(self, hit, chance, ids, table) -> None:
        """Hit or miss by its chance, and after a miss the id by its frequency; of a hit the id is the whole range."""
        split = (self.range >> 12) * chance
        unit = self.range - split >> table.bits
        start, size = table.start.take(ids), table.size.take(ids)
        self.low += np.where(hit, 0, split + unit * start)
        self.range = np.where(hit, split, unit * size)
        over = np.flatnonzero(self.low >> TOP)
        if len(over):
            self.out[self.at[over] - 1] += 1
            self.low[over] &= (1 << TOP) - 1
        lanes = np.flatnonzero(self.range < 1 << LOW)
        while len(lanes):
            self._shift(lanes)
            lanes = lanes[self.range[lanes] < 1 << LOW]

    def _shift(self, lanes) -> None:
        low, at = self.low[lanes], self.at[lanes]
        self.out[at] = low >> LOW
        self.at[lanes] = at + 1
        self.low[lanes] = (low & (1 << LOW) - 1) << 16
        self.range[lanes] <<= 16

    def finish(self) -> list[bytes]:
        lanes = np.arange(len(self.low))
        for _ in range(3):
            self._shift(lanes)
        out, sizes = self.out.reshape(len(lanes), self.width), self.at - lanes * self.width
        # A carry may run through words that are full.
        for i in range(int(sizes.max(initial=1)) - 1, 0, -1):
            out[:, i - 1] += out[:, i] >> 16
        words = (out & 0xFFFF).astype("<u2")
        return [row[:n].tobytes() for row, n in zip(words, sizes.tolist(), strict=True)]


class Decoder:
    def __init__(self, blocks: list[bytes]):
        sizes = np.array([len(b) // 2 for b in blocks])
        width = int(sizes.max(initial=0)) + 4
        words = np.zeros((len(blocks), width), np.int64)
        for row, b in zip(words, blocks, strict=True):
            row[: len(b) // 2] = np.frombuffer(b, "<u2")
        self.code = words[:, 0] << 32 | words[:, 1] << 16 | words[:, 2]
        self.range = np.full(len(blocks), 1 << TOP, np.int64)
        self.words, self.at = words.ravel(), np.arange(len(blocks)) * width + 3

    def get(self, candidate, chance, table):
        split = (self.range >> 12) * chance
        hit = self.code < split
        unit = self.range - split >> table.bits
        code = self.code - split
        # Both numbers have at most 48 bits and the quotient few, so that the division of floats is exact when cut.
        slot = (code / unit).astype(np.int64)
        found = table.slot.take(slot, mode="clip")
        start, size = table.start.take(found), table.size.take(found)
        self.code = np.where(hit, self.code, code - unit * start)
        self.range = np.where(hit, split, unit * size)
        lanes = np.flatnonzero(self.range < 1 << LOW)
        while len(lanes):
            at = self.at[lanes]
            self.code[lanes] = self.code[lanes] << 16 | self.words.take(at, mode="clip")
            self.at[lanes] = at + 1
            self.range[lanes] <<= 16
            lanes = lanes[self.range[lanes] < 1 << LOW]
        return hit, np.where(hit, candidate, found)


def numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids in order, the number of each id among them, and how often each occurs."""
    if len(ids) == 0 or ids.max() >= 1 << 22:
        symbols, numbers, counts = np.unique(ids, return_inverse=True, return_counts=True)
        return symbols, numbers.astype(np.int32), counts
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    number = np.zeros(len(counts), np.int32)
    number[symbols] = np.arange(len(symbols), dtype=np.int32)
    return symbols.astype(np.uint32), number[ids], counts[symbols]


def encode_frame(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Documents, the numbers of their ids and all ids in a row (below 2^32) as the bytes of one frame."""
    ids = ids.astype(np.uint32)
    symbols, numbers, counts = numbered(ids)
    bits = max(16, len(symbols).bit_length() + 1)
    frequency = frequencies(counts, bits) if len(symbols) else np.zeros(0, np.int64)
    blocks: list[bytes] = []
    if len(ids):
        sizes, table = lane_sizes(len(ids)), Table(frequency, bits)
        lanes = len(sizes)
        padded = np.zeros(lanes * BLOCK, np.int32)
        padded[: len(ids)] = numbers
        grid = np.ascontiguousarray(padded.reshape(lanes, BLOCK).T)
        coder, model = Encoder(lanes, 3 * int(sizes.max()) + 8), Model(lanes, table.frequent)
        # A shorter last block is filled up with the first symbol, which costs next to nothing.
        for step in range(int(sizes.max())):
            candidate, chance = model.predict()
            hit = candidate == grid[step]
            coder.put(hit, chance, grid[step], table)
            model.update(hit, grid[step])
        blocks = coder.finish()
    sums = [zlib.crc32(ids[i : i + BLOCK].astype("<u4").tobytes()) for i in range(0, len(ids), BLOCK)]
    docs = np.array([NO_ID if d is None else d for d in doc_ids], "<i8").tobytes() + lengths.astype("<u4").tobytes()
    tables = zlib.compress(docs + symbols.astype("<u4").tobytes() + frequency.astype("<u4").tobytes(), 6)
    index = np.array([[len(b) for b in blocks], sums], "<u4").tobytes()
    head = HEADER.pack(MAGIC, len(doc_ids), len(ids), BLOCK, bits, len(symbols), len(tables), zlib.crc32(tables + index))
    return b"".join([head, tables, index, *blocks])


class Frame:
    """A frame that is read: its documents and their lengths; blocks are decoded when they are asked for."""

    def __init__(self, data: bytes):
        magic, n_docs, self.n_ids, self.block, self.bits, n_symbols, n_tables, check = HEADER.unpack_from(data)
        n_blocks = -(-self.n_ids // self.block)
        tables, end = data[HEADER.size : HEADER.size + n_tables], HEADER.size + n_tables + 8 * n_blocks
        if magic != MAGIC or zlib.crc32(data[HEADER.size : end]) != check:
            raise ValueError("damaged frame header")
        sizes, self.sums = np.frombuffer(data, "<u4", 2 * n_blocks, HEADER.size + n_tables).reshape(2, n_blocks)
        tables = zlib.decompress(tables)
        self.doc_ids = [None if d == NO_ID else d for d in np.frombuffer(tables, "<i8", n_docs).tolist()]
        self.lengths = np.frombuffer(tables, "<u4", n_docs, 8 * n_docs).astype(np.int64)
        self.symbols = np.frombuffer(tables, "<u4", n_symbols, 12 * n_docs)
        self.frequency = np.frombuffer(tables, "<u4", n_symbols, 12 * n_docs + 4 * n_symbols).astype(np.int64)
        ends = end + np.cumsum(sizes.astype(np.int64))
        self.blocks = [data[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]

    def ids(self, numbers: list[int]) -> list[np.ndarray]:
        """The ids of some blocks, from nothing but their own bytes and the header; ValueError where a checksum does not hold."""
        if not numbers:
            return []
        table = Table(self.frequency, self.bits)
        coder, model = Decoder([self.blocks[i] for i in numbers]), Model(len(numbers), table.frequent)
        grid = np.zeros((self.block, len(numbers)), np.int32)
        for step in range(min(self.block, self.n_ids)):
            candidate, chance = model.predict()
            hit, grid[step] = coder.get(candidate, chance, table)
            model.update(hit, grid[step])
        out = [self.symbols[row[: self.n_ids - i * self.block]] for i, row in zip(numbers, grid.T, strict=True)]
        for i, ids in zip(numbers, out, strict=True):
            if zlib.crc32(ids.astype("<u4").tobytes()) != self.sums[i]:
                raise ValueError(f"damaged block {i}")
        return out


def decode_frame(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The documents, lengths and ids of a frame; ValueError where a checksum does not hold."""
    frame = Frame(data)
    ids = frame.ids(list(range(len(frame.blocks))))
    return frame.doc_ids, frame.lengths, np.concatenate(ids) if ids else np.zeros(0, np.uint32)


# --- tables ---------------------------------------------------------------------------------------------------------


#: Printable ASCII, Latin letters with accents and marks like dashes and quotes: none is composed with its neighbours, each
#: has one lower-case form that does not depend on its place, and none is white space.
PLAIN = re.compile("[!-~\u00c0-\u00ff\u2010-\u2027]+")


class WordIds(dict):
    """Ids of the words of a text that spaces and line ends part, by the library; emptied at ``most`` words.

    For vocabularies that drop white space, where no piece of text reaches across it. The library normalises and parts
    a new word, and its model is asked once for each different piece, as many words share theirs. Words of ``PLAIN``
    characters are lower-cased, parted by the pattern of the vocabulary file and spelled as the library spells bytes
    here, if that is all that the file asks for. Words with an added token are encoded whole.
    """

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.most, self.ids = Tokenizer.from_file(path), most, {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.normalise, self.part = self.tokenizer.model, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        with open(path, encoding="utf-8") as f:
            self.pattern = lower_case_pattern(json.load(f))
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0x2028) if PLAIN.fullmatch(chr(c))}

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned numbers of 32 bits."""
        if len(self) > self.most or len(self.ids) > self.most:
            self.clear()
            self.ids.clear()
        get = self.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if self.added.search(text):
            found = self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        else:
            if self.pattern and text.isascii() and text.isprintable():
                parts = self.pattern.findall(text.lower())
            elif self.pattern and PLAIN.fullmatch(text):
                parts = [p.translate(self.spelling) for p in self.pattern.findall(text.lower())]
            else:
                normal = self.normalise.normalize_str(text) if self.normalise else text
                parts = [p for p, _ in self.part.pre_tokenize_str(normal)] if self.part else [normal]
            found = b"".join([self.ids.get(p) or self._piece(p) for p in parts])
        self[word] = found
        return found

    def _piece(self, piece: str) -> bytes:
        found = self.ids[piece] = self._packed([t.id for t in self.model.tokenize(piece)])
        return found

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)


def lower_case_pattern(file: dict):
    """The pattern of a vocabulary file that lower-cases text and keeps the matches of one pattern as bytes; else None.

    Its other steps (composition, white space as a space) do not touch printable ASCII, nor does the spelling of bytes.
    """
    steps = (file.get("normalizer") or {}).get("normalizers", [])
    splits = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    lowers = {"type": "Lowercase"} in steps and all(s in ({"type": "NFC"}, {"type": "Lowercase"}, spaces) for s in steps)
    if not lowers or [s["type"] for s in splits] != ["Split", "ByteLevel"]:
        return None
    cut, spelled = splits
    kept = cut["behavior"] == "Removed" and cut["invert"] and not spelled["add_prefix_space"] and not spelled["use_regex"]
    return regex.compile(cut["pattern"]["Regex"]) if kept and "Regex" in cut["pattern"] else None


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One memory of words for all tasks of a Python worker."""
    return WordIds(path)


def write(docs: DataFrame, path: str, *, tokenizer: str, end: int, id_column: str = "doc_id", text_column: str = "text", frame: int = FRAME) -> None:
    """Encodes whole texts (NULL as empty) and writes their ids, each document closed by ``end``, in ascending order of ids.

    The folder ``path`` gets Parquet files whose rows (shard, frame, n_docs, n_ids, data) hold one frame each; shards
    follow each other in the order of ids. Spark's committer writes them, so a lost executor leaves no half a file.
    Documents are sorted by range, equal and NULL ids by the hash of their text, NULL first. A frame takes documents
    until it has ``frame`` ids; one document is never parted.
    """

    def run(batches):
        words = word_ids(tokenizer)
        closing = np.array([end], "<u4").tobytes()
        shard, number, held, size = None, 0, [], 0

        def flush():
            lengths = np.array([len(x) // 4 for _, x in held], np.int64)
            data = encode_frame([d for d, _ in held], lengths, np.frombuffer(b"".join(x for _, x in held), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["shard", "frame", "n_docs", "n_ids", "data"])

        for batch in batches:
            for part in pieces(batch, 2):
                shard = part.column(0)[0].as_py()
                for doc, ids in zip(part.column(1).to_pylist(), words.texts(raw(part.column(2))), strict=True):
                    held.append((doc, ids + closing))
                    size += len(ids) // 4 + 1
                    if size >= frame:
                        yield flush()
                        number, held, size = number + 1, [], 0
        if held:
            yield flush()

    order = ["doc_id", "hash"]
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    ranged.mapInArrow(run, "shard int, frame int, n_docs long, n_ids long, data binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(shard, frame, before, doc_id, ids) for every document of a folder: its ids as little-endian unsigned 32 bits, and how many ids stand before it in its frame."""

    def run(batches):
        for batch in batches:
            for shard, frame, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs, lengths, ids = decode_frame(data)
                bytes_, stops = ids.astype("<u4").tobytes(), np.cumsum(lengths)
                begins = stops - lengths
                for i in range(0, len(docs), 2000):
                    own = [bytes_[4 * a : 4 * b] for a, b in zip(begins[i : i + 2000].tolist(), stops[i : i + 2000].tolist(), strict=True)]
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([frame] * n, pa.int32()), pa.array(begins[i : i + n]), pa.array(docs[i : i + n], pa.int64()), pa.array(own, pa.binary())], ["shard", "frame", "before", "doc_id", "ids"])

    return spark.read.parquet(path).select("shard", "frame", "data").mapInArrow(run, "shard int, frame int, before long, doc_id long, ids binary")


def frame_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, frame, start): the number of ids in all frames before; only the numbers in the files are read."""
    frames = spark.read.parquet(path).select("shard", "frame", "n_ids")
    shards = offsets(frames.groupBy("shard").agg(F.sum("n_ids").alias("n")), "shard", "n").select("shard", "before")
    inside = frames.selectExpr("shard", "frame", "sum(n_ids) OVER (PARTITION BY shard ORDER BY frame) - n_ids AS inside")
    return inside.join(shards, "shard").selectExpr("shard", "frame", "before + inside AS start")
