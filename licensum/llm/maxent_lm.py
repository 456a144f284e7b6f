"""Language model scoring: a hashed maximum-entropy model of word classes over n-gram and skip features, and counts within classes."""

import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from licensum.llm.common import pieces, raw, remainder, stored

CLASSES, CELLS, BLOCKS = 64, 1 << 15, 256
# Steps of the first update and of later ones, and the counts that every cell is given beside its own in them: what is left
# to learn after the first is learned only where there is much evidence.
ROUNDS, FIRST, RATE, PRIOR, LATER, TOKENS = 3, 0.7, 0.25, 10.0, 1000.0, 4096
SPAN = 1 << 15  # contexts whose shares are held at once
SHORT = 32  # bytes from which on a word is hashed by the library alone
PIECE = 1_000_000  # bytes of texts whose tokens are held at once, if not one text has more
PER_TASK = 4  # partitions of the texts whose sums are added up in one task
ROWS = 12  # 2^12 rows are a chunk
END = b"\n"
ALPHA = 0.1


def word_class(word: bytes) -> int:
    """Words with the same last two letters share a class; the end of a text has its own."""
    return CLASSES - 1 if word == END else zlib.crc32(word[-2:]) % (CLASSES - 1)


class Vocabulary(defaultdict):
    """Numbers words in order of appearance; gives their hashes and classes."""

    def __init__(self):
        super().__init__(count().__next__)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self), np.uint64, len(self))
        # Only the end is spelled as it is, so the last two letters tell the class.
        known = {ending: word_class(ending) for ending in {word[-2:] for word in self}}
        return hashes, np.fromiter((known[word[-2:]] for word in self), np.int64, len(self))


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


@lru_cache(maxsize=1)
def _classes_of_endings() -> np.ndarray:
    """The class of a word by its last byte and 256 times the one before; behind them, of words of one byte."""
    two = [zlib.crc32(bytes((i >> 8, i & 255))) for i in range(1 << 16)]
    return (np.array(two + [zlib.crc32(bytes((i,))) for i in range(256)], np.int64) % (CLASSES - 1)).astype(np.int64)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _xxh64(windows: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH64 of words of less than ``SHORT`` bytes, from the eight bytes that begin at each byte of a text."""
    one, two, three, four, five = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    # Words of the same length lie beside each other, so that each step takes a slice of them.
    order = np.argsort(sizes.astype(np.uint8), kind="stable")
    at, firsts = begins[order], np.searchsorted(sizes[order], np.arange(SHORT + 1))
    out = sizes[order].astype(np.uint64) + five
    for size in range(1, SHORT):
        own = slice(firsts[size], firsts[size + 1])
        h, place = out[own], at[own]
        if not len(h):
            continue
        done = 0
        while size - done >= 8:
            h ^= _turned(windows.take(place + done) * two, 31) * one
            h = _turned(h, 27) * one + four
            done += 8
        if size - done >= 4:
            h ^= (windows.take(place + done) & np.uint64(0xFFFFFFFF)) * one
            h = _turned(h, 23) * two + three
            done += 4
        while done < size:
            h ^= (windows.take(place + done) & np.uint64(0xFF)) * five
            h = _turned(h, 11) * one
            done += 1
        h ^= h >> np.uint64(33)
        h *= two
        h ^= h >> np.uint64(29)
        h *= three
        out[own] = h ^ h >> np.uint64(32)
    back = np.empty_like(out)
    back[order] = out
    return back


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """XXH64 and class of all tokens of the texts, and how many each text has.

    Words are found and hashed as arrays of bytes, not one by one.
    """
    joined = b"".join([t + END for t in texts]).lower()
    if not joined:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = joined + bytes(SHORT)
    letters = np.frombuffer(joined, np.uint8)
    spaces = (letters == 32) | (letters - np.uint8(9) < 5)
    change = np.flatnonzero(spaces[1:] != spaces[:-1]) + 1
    # The last byte is a space, so every word has its end among the changes.
    changes = change if spaces[0] else np.append(0, change)
    begins, stops = changes[::2], changes[1::2]
    sizes = stops - begins
    words = np.zeros(len(begins), np.uint64)
    short = sizes < SHORT
    windows = np.ascontiguousarray(np.ndarray(len(joined), "<u8", padded, strides=(1,)))
    words[short] = _xxh64(windows, begins[short], sizes[short])
    for i in np.flatnonzero(~short).tolist():
        words[i] = xxhash.xxh64_intdigest(joined[begins[i] : stops[i]])
    last = letters[stops - 1].astype(np.int64)
    classes = _classes_of_endings()[np.where(sizes > 1, letters[np.maximum(stops - 2, 0)].astype(np.int64) << 8 | last, (1 << 16) + last)]
    # Behind the words of each text comes its end.
    counts = np.diff(np.searchsorted(begins, np.cumsum([0] + [len(t) + 1 for t in texts]))) + 1
    ends = np.cumsum(counts) - 1
    inside = np.ones(len(words) + len(texts), bool)
    inside[ends] = False
    out, own = np.full(len(inside), xxhash.xxh64_intdigest(END), np.uint64), np.full(len(inside), CLASSES - 1, np.int64)
    out[inside], own[inside] = words, classes
    return out, own, counts


def feature_cells(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each token four cells: a constant, the word before, the word before that, and both."""
    # Cell 0 is the constant's alone.
    mix = lambda x, n: ((x + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(CELLS - 1) + np.uint64(1)
    place = np.arange(len(hashes))
    since = place - np.maximum.accumulate(np.where(begins, place, 0))
    before = lambda n: np.where(since >= n, np.concatenate([np.zeros(n, np.uint64), hashes[:-n]])[: len(hashes)], np.uint64(n))
    one, two = before(1), before(2)
    # Columns lie one behind the other, since they are read one by one.
    return np.stack([np.zeros(len(hashes), np.int64), *(mix(x, n).astype(np.int64) for x, n in ((one, 1), (two, 2), (one * np.uint64(0xC2B2AE3D27D4EB4F) ^ two, 3)))]).T


def logits(model: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Scores of all classes, a column for each token, with largest score 0. The first cell of all tokens is the constant."""
    rows, more = np.empty((len(cells), CLASSES), np.float32), np.empty((len(cells), CLASSES), np.float32)
    # Clipped, as a checked take copies its result once more.
    np.take(model, cells[:, 1], axis=0, out=rows, mode="clip")
    for i in range(2, cells.shape[1]):
        rows += np.take(model, cells[:, i], axis=0, out=more, mode="clip")
    rows += model[0]
    out = np.ascontiguousarray(rows.T)
    out -= out.max(axis=0)
    return out


def class_log10(model: np.ndarray, cells: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log10 of the probability of each token's class."""
    out = logits(model, cells)
    own = out[classes, np.arange(len(classes))].astype(np.float64)
    return (own - np.log(np.exp(out, out=out).sum(axis=0, dtype=np.float64))) / np.log(10)


def add_observed(sums: np.ndarray, cells: np.ndarray, classes: np.ndarray) -> None:
    """Adds how often each cell met each class. The first cell of all tokens is the constant."""
    sums[0] += np.bincount(classes, minlength=CLASSES)
    for i in range(1, cells.shape[1]):
        sums += np.bincount(classes * CELLS + cells[:, i], minlength=CELLS * CLASSES).reshape(CLASSES, CELLS).T


def add_expected(sums: np.ndarray, cells: np.ndarray, model: np.ndarray) -> None:
    """Adds how often the model expects each cell to meet each class. The first cell of all tokens is the constant.

    Tokens with the same cells are expected alike, so the shares are made once for all of them.
    """
    # Three numbers of cells in one; cells of the word before lie beside each other.
    keys, times = np.unique((cells[:, 1] * CELLS + cells[:, 2]) * CELLS + cells[:, 3], return_counts=True)
    cells = np.stack([np.zeros(len(keys), np.int64), keys // (CELLS * CELLS), keys // CELLS % CELLS, keys % CELLS]).T
    held = np.empty((CLASSES, min(SPAN, len(cells))), np.float32)
    for start in range(0, len(cells), SPAN):
        part, often = cells[start : start + SPAN], times[start : start + SPAN].astype(np.float32)
        for i in range(0, len(part), TOKENS):
            # Small pieces, so that a piece stays in the cache.
            share = logits(model, part[i : i + TOKENS])
            np.exp(share, out=share)
            np.multiply(share, often[i : i + TOKENS] / share.sum(axis=0), out=held[:, i : i + len(share[0])])
        first = np.flatnonzero(np.diff(part[:, 1], prepend=-1))
        before = part[first, 1]
        for k in range(CLASSES):
            shares = held[k, : len(part)].astype(np.float64)
            sums[0, k] += shares.sum()
            sums[before, k] += np.add.reduceat(shares, first)
            for i in (2, 3):
                sums[:, k] += np.bincount(part[:, i], weights=shares, minlength=CELLS)


def gathered(texts: list[bytes], words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all tokens of the texts, and how many each text has."""
    found, counts = [], []
    for text in texts:
        own = tokens(text)
        found += own
        counts.append(len(own))
    return np.fromiter(map(words.__getitem__, found), np.int32, len(found)), np.array(counts, np.int64)


def starts(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(counts.sum(), bool)
    out[np.cumsum(counts) - counts] = True
    return out


def _summed(docs: DataFrame, add) -> np.ndarray:
    """The sums that ``add(sums, cells, classes)`` makes of all texts.

    Every task adds up its documents; Spark adds the sums of the tasks, block by block, as they come. Sums do not depend
    on how the documents are dealt to tasks.
    """
    size = CELLS // BLOCKS

    def run(batches):
        # A column for each class, as they are added up class by class.
        sums, seen = np.zeros((CELLS, CLASSES), np.float32 if CELLS * CLASSES > 1 << 24 else np.float64, order="F"), False
        for batch in batches:
            for part in pieces(batch, 0, most=PIECE):
                hashes, classes, counts = hashed(raw(part.column(0)))
                add(sums, feature_cells(hashes, starts(counts)), classes)
                seen = True
            # Not held while the next batch is read.
            batch = part = None
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([sums[i : i + size].astype(np.float32, order="C").tobytes() for i in range(0, CELLS, size)], pa.binary())], ["block", "sums"])

    def total(batches):
        at, sums = None, None
        for batch in batches:
            for block, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(own.as_py(), np.float32).astype(np.float64)
                if block == at:
                    sums += own
                    continue
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["block", "sums"])
                at, sums = block, own.copy()
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["block", "sums"])

    texts = docs.select("text")
    # A task gives all its sums to the shuffle however few texts it has, so small partitions share a task.
    cores, parts = docs.sparkSession.sparkContext.defaultParallelism, texts.rdd.getNumPartitions()
    texts = texts.coalesce(max(1, min(parts, max(2 * cores, -(-parts // PER_TASK)))))
    parts = texts.mapInArrow(run, "block int, sums binary").repartition("block").sortWithinPartitions("block")
    out = np.zeros((CELLS, CLASSES))
    for r in parts.mapInArrow(total, "block int, sums binary").collect():
        out[r.block * size : (r.block + 1) * size] += np.frombuffer(r.sums, np.float64).reshape(size, CLASSES)
    return out


def train(docs: DataFrame, *, rounds: int = ROUNDS) -> np.ndarray:
    """Class weights for each feature cell, learned from all ``docs`` (doc_id, text).

    A round is one gradient update over all documents: each cell compares how often it met each class with how often
    the model so far expects that, and moves by the logarithm of their quotient, damped by ``PRIOR`` counts, later by ``LATER``. The first
    round starts from the constant alone, whose expectations are known without a pass over the texts; each further
    round reads all texts once more. The model has ``CELLS`` times ``CLASSES`` numbers however large the corpus is; only
    it comes to the driver.
    """
    observed = _summed(docs, add_observed)
    # The constant's cell is met by every token.
    shares = (observed[0] + ALPHA) / (observed[0] + ALPHA).sum()
    model = np.zeros((CELLS, CLASSES), np.float32)
    expected, step = observed.sum(axis=1, keepdims=True) * shares, FIRST
    for number in range(rounds):
        if number:
            shared = docs.sparkSession.sparkContext.broadcast(model)
            expected, step = _summed(docs, lambda sums, cells, classes: add_expected(sums, cells, shared.value)), RATE
            shared.unpersist()
        prior = PRIOR if number == 0 else LATER
        model = model + (step * np.log((observed + prior * shares) / (expected + prior * shares))).astype(np.float32)
        model[0] = np.log(shares)
    return model


def chunked(docs: DataFrame) -> DataFrame:
    """(doc_id, text, train, chunk): documents in chunks of at most 2^ROWS neighbours, so that a chunk fits a task."""
    place = F.monotonically_increasing_id()
    return docs.select("doc_id", "text", "train", (F.shiftright(place, 33) * 2 ** (33 - ROWS) + F.shiftright(place.bitwiseAND(2**33 - 1), ROWS)).alias("chunk"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(chunk, hash, class, c, total, first): each word of each chunk, its count in the training texts of the chunk and of all, and a mark on one row of each word.

    Tasks count the words of their chunks, so a very frequent word is one row for each chunk.
    """

    def run(batches):
        def added(held, hashes, classes, counts):
            hashes, classes, counts = (np.concatenate(x) for x in zip(held, (hashes, classes, counts), strict=True))
            hashes, first, place = np.unique(hashes, return_index=True, return_inverse=True)
            return hashes, classes[first], np.bincount(place, counts, len(hashes)).astype(np.int64)

        def flush():
            hashes, classes, counts = held
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), at)), pa.array(hashes.view(np.int64)), pa.array(classes.astype(np.int32)), pa.array(counts)], ["chunk", "hash", "class", "c"])

        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, held = None, none
        for batch in batches:
            chunk, train = batch.column(2).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, batch.num_rows, 500):
                hashes, classes, n = hashed(raw(batch.column(0).slice(i, 500)))
                counted, of = np.repeat(train[i : i + 500], n), np.repeat(chunk[i : i + 500], n)
                for own in np.unique(chunk[i : i + 500]):
                    if at is not None and own != at:
                        yield flush()
                        held = none
                    at = own
                    inside = of == own
                    held = added(held, hashes[inside], classes[inside], counted[inside])
        if at is not None:
            yield flush()

    each = docs.select("text", "train", "chunk").mapInArrow(run, "chunk long, hash long, class int, c long")
    return each.selectExpr("*", "sum(c) OVER (PARTITION BY hash) AS total", "row_number() OVER (PARTITION BY hash ORDER BY chunk) = 1 AS first")


def score(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", folds: int = 10, held_out: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    A text is its words, A-Z lower-cased, and an end. Learns from rows whose fold, crc32 of the id modulo ``folds``, is
    not ``held_out``; rows without an id are neither learned from nor held out. base_score adds log10 probabilities by
    smoothed counts. score adds log10 probabilities of the model: of the word's class given the two words before, by a
    softmax over hashed features, and of the word within its class, by smoothed counts; a word that was never seen
    takes the share that its class keeps for such words. NULL and blank texts are an end alone; repeated rows are
    scored each and learned as often; an empty table gives none, and other columns of any name are left out.
    """
    fold = remainder(id_column, folds)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.coalesce(fold != held_out, F.lit(False)).alias("train"))
    rows = stored(chunked(rows))
    counts = stored(word_counts(rows))
    sums = {r["class"]: (r.n, r.v) for r in counts.groupBy("class").agg(F.sum("c").alias("n"), F.sum(F.expr("IF(first AND total > 0, 1, 0)")).alias("v")).collect()}
    of_class = np.array([sums.get(k, (0, 0)) for k in range(CLASSES)], np.float64)
    n_all, v_all = of_class.sum(axis=0)
    model = rows.sparkSession.sparkContext.broadcast(train(rows.filter("train"), rounds=rounds))
    total = int(n_all)

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        keys, values = known.column("hash").to_numpy().view(np.uint64), known.column("total").to_numpy()
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        out = []
        for start in range(0, texts.num_rows, 500):
            hashes, own, n = hashed(raw(texts.column("text").slice(start, 500).combine_chunks()))
            words, ids = np.unique(hashes, return_inverse=True)
            c = values[np.minimum(np.searchsorted(keys, words), len(keys) - 1)].astype(np.float64)[ids]
            base = np.log10((c + ALPHA) / (n_all + ALPHA * (v_all + 1)))
            inside = np.log10((c + ALPHA) / (of_class[own, 0] + ALPHA * (of_class[own, 1] + 1)))
            cells = feature_cells(hashes, starts(n))
            each = np.concatenate([class_log10(model.value, cells[i : i + TOKENS], own[i : i + TOKENS]) for i in range(0, len(own), TOKENS)])
            first = np.cumsum(n) - n
            out.append((n, *(np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64), base, each + inside))))
        n, known_tokens, base, whole = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"doc_id": texts.column("doc_id"), "n_tokens": n, "n_known": known_tokens, "train_tokens": np.full(len(n), total), "base_score": base, "score": whole})

    scored = rows.select("doc_id", "text", "chunk").groupBy("chunk").cogroup(counts.select("chunk", "hash", "total").groupBy("chunk")).applyInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("held_out", F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False)))
