"""Near duplicates: SimHash fingerprints, and covering locality-sensitive hashing to find all pairs within a radius."""

import random
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from licensum.llm.common import addressed, pieces, raw, stored
from licensum.llm.components import connected

SHINGLE, RADIUS, SEED, BUCKET = 3, 3, 42, 4096
ONES = np.uint64(0x0101010101010101)


# --- fingerprints ---------------------------------------------------------------------------------------------------


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For consecutive runs of ``counts`` hashes, the bits that are set in over half of a run; 0 for empty runs."""
    full = counts > 0
    out = np.zeros(len(counts), np.uint64)
    n = counts[full]
    if not len(n):
        return out
    starts = np.cumsum(n) - n
    # Eight bits of 255 hashes at most are added in one go, as the bytes of a word.
    parts = -(-n // 255)
    first = np.cumsum(parts) - parts
    chunk = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    found = np.zeros(len(n), np.uint64)
    for shift in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(shift)) & ONES, chunk)
        ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            found |= (2 * ones[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + shift)
    out[full] = found
    return out


def _shingles(words: list[bytes], size: int) -> list[bytes]:
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return words if size == 1 else list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def text_fingerprints(texts: list[bytes], shingle: int) -> np.ndarray:
    digest, seed = xxhash.xxh64_digest, SEED
    hashes, counts = [], []
    for text in texts:
        found = [digest(x, seed) for x in _shingles(text.lower().split(), shingle)]
        hashes.append(b"".join(found))
        counts.append(len(found))
    return majority(np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64), np.array(counts, np.int64))


def fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, columns: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fp, ...) for every row: fp is the SimHash of the whole text as a signed long; ``columns`` are carried along.

    A-Z is lower-cased; the features are runs of ``shingle`` words, repeats included. A text of fewer words is one
    feature; a text without words, NULL included, has fingerprint 0.
    """
    carried = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                fp = text_fingerprints(raw(part.column(1)), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64)), *part.columns[2:]], ["doc_id", "fp", *columns])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), *columns).mapInArrow(run, "doc_id long, fp long" + carried)


# --- covering hashing -----------------------------------------------------------------------------------------------


def covering_masks(positions: tuple[int, ...], radius: int, seed: int) -> list[int]:
    """Masks over bit positions such that two words that differ in ``radius`` of them at most agree under some mask.

    Each position gets a nonzero vector of radius + 1 bits. Mask v (v = 1 .. 2^(radius+1) - 1) keeps the positions
    whose vector has an odd product with v. At most ``radius`` vectors have a common orthogonal v, and mask v then
    hides all differing positions.
    """
    top = 2 ** (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(len(positions))]
    random.Random(seed).shuffle(vectors)
    return [sum(1 << p for p, x in zip(positions, vectors, strict=True) if (x & v).bit_count() & 1) for v in range(1, top)]


@lru_cache(maxsize=4096)
def path_masks(path: int, radius: int) -> tuple[int, ...]:
    """The masks that refine the buckets of table ``path``; path 0 is all words, and a table's parent is path >> (radius + 1)."""
    kept = path_mask(path, radius)
    hidden = tuple(i for i in range(64) if not kept >> i & 1)
    return tuple(kept | m for m in covering_masks(hidden, radius, path))


def path_mask(path: int, radius: int) -> int:
    return path_masks(path >> (radius + 1), radius)[(path & (2 ** (radius + 1) - 1)) - 1] if path else 0


def _expand(rows: DataFrame, radius: int) -> DataFrame:
    """(path, fp) to (path, key, fp): a row for each finer table."""

    def run(batches):
        for batch in batches:
            path, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(path):
                own = fp[path == p]
                for v, mask in enumerate(path_masks(int(p), radius), 1):
                    key = own & np.uint64(mask).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), (int(p) << (radius + 1)) + v)), pa.array(key), pa.array(own)], ["path", "key", "fp"])

    return rows.mapInArrow(run, "path long, key long, fp long")


def _near(values: np.ndarray, radius: int):
    """Row blocks (start, near) of the matrix that says which values differ in ``radius`` bits at most."""
    for i in range(0, len(values), 512):
        yield i, np.bitwise_count(values[i : i + 512, None] ^ values[None, :]) <= radius


def bucket_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is within the radius, at most one for each value: to the smallest value of its component."""
    values = np.sort(values)
    label = np.arange(len(values))
    while True:
        new = label.copy()
        for i, near in _near(values.view(np.uint64), radius):
            new[i : i + len(near)] = np.where(near, label[None, :], len(values)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(len(values)))
    return list(zip(values[member].tolist(), values[label[member]].tolist(), strict=True))


def links(nodes: DataFrame, *, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect the different fingerprints of ``nodes`` (fp) as all pairs within the radius do.

    Every pair within the radius shares a bucket of some table. Buckets of up to ``bucket`` fingerprints are compared
    in one numpy block; larger ones are dealt anew by covering masks over the bits that their table hides, about half
    each time, until they are small (a table that hides h bits has buckets of 2^h fingerprints at most). A bucket gives
    a link for each fingerprint at most.
    """
    rows = nodes.select(F.lit(0).cast("long").alias("path"), "fp")
    found = None

    def run(batches):
        for batch in batches:
            out = [x for values in batch.column(0) for x in bucket_links(np.array(values.values, np.int64), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    while True:
        tables = _expand(rows, radius)
        sizes = stored(tables.groupBy("path", "key").agg(F.count("*").alias("n")).filter("n > 1"))
        small = tables.join(sizes.filter(F.col("n") <= bucket), ["path", "key"]).groupBy("path", "key").agg(F.collect_list("fp").alias("fps"))
        level = small.select("fps").mapInArrow(run, "a long, b long")
        found = level if found is None else found.unionAll(level)
        if sizes.filter(F.col("n") > bucket).isEmpty():
            return found.distinct()
        rows = stored(tables.join(sizes.filter(F.col("n") > bucket), ["path", "key"]).select("path", "fp"))


# --- near duplicates ------------------------------------------------------------------------------------------------


def _rooted(nodes: DataFrame, radius: int, bucket: int) -> DataFrame:
    """``nodes`` (fp, ...) with ``root``, one fingerprint of the component."""
    roots = connected(links(nodes, radius=radius, bucket=bucket)).withColumnsRenamed({"node": "fp"})
    return nodes.join(roots, "fp", "left").select(*nodes.columns, F.coalesce("root", "fp").alias("root"))


def drop_near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others; see ``addressed``) without all but one of each component of near duplicates.

    Components are those of ``simhash_components``; the row with the smallest doc_id stays, a row without an id only if
    no other has one, and of rows equal in this the first by file and line. An empty table stays empty.
    """
    rows = addressed(docs)
    fps = fingerprints(rows.select("row.doc_id", "row.text", "file", "line"), shingle=shingle, columns=["file", "line"])
    fps = stored(fps.select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "file", "line").alias("place"), "fp"))
    nodes = stored(fps.groupBy("fp").agg(F.min("place").alias("least")))
    rooted = _rooted(nodes, radius, bucket)
    keepers = rooted.groupBy("root").agg(F.min("least").alias("keeper"))
    dropped = fps.join(rooted.join(keepers, "root").select("fp", "keeper"), "fp").filter("place <> keeper").select("place.file", "place.line")
    return rows.join(dropped.hint("shuffle_hash"), ["file", "line"], "left_anti").select("row.*")


def simhash_components(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Documents are linked if their fingerprints differ in ``radius`` bits at most; component_id is the smallest doc_id
    that can be reached by links. Equal fingerprints are one node, so copies cost nothing. Texts without words have
    fingerprint 0 and are linked like others. Rows without an id keep a NULL id and never name a component, unless
    nothing else does.
    """
    fps = stored(fingerprints(docs, id_column=id_column, text_column=text_column, shingle=shingle))
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = _rooted(nodes, radius, bucket)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
