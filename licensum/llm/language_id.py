"""Language identification with hyperdimensional profiles."""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from licensum.llm.common import pieces, remainder

DIMENSIONS, SLOTS, SEED, UNKNOWN = 1024, 256, 7, "und"
# Bytes and rows that are counted at once: the counts of many short texts would fill the memory otherwise.
BATCH, ROWS = 500_000, 256


@lru_cache(maxsize=1)
def slot_of() -> np.ndarray:
    """The slot of each code point: 0 for what is no letter; letters of either case share one."""
    out = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        if not 0xD800 <= point < 0xE000 and (c := chr(point)).isalpha():
            low = ord(c.lower()[0])
            out[point] = low if low < SLOTS else 1 + low * 2654435761 % 2**32 % (SLOTS - 1)
    return out


@lru_cache(maxsize=4)
def letters(dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random vector of +1 and -1 for each slot, turned by two places, by one and not at all."""
    v = np.random.default_rng(SEED).integers(0, 2, (SLOTS, dimensions), dtype=np.int8) * 2 - 1
    return np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Document number and code of all trigrams; what lies between words is one symbol, also at both ends."""
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    s = slot_of()[points]
    doc = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0) | (doc[1:] != doc[:-1])
    s, doc = s[keep].astype(np.int32), doc[keep]
    whole = (doc[2:] == doc[:-2]) & ((s[1:-1] != 0) | (s[2:] != 0) & (s[:-2] != 0))
    return doc[2:][whole], (s[:-2] << 16 | s[1:-1] << 8 | s[2:])[whole]


class Encoder:
    """Text vectors: letter vectors are turned by their place and bound (multiplied) into trigrams, which are bundled (added)."""

    def __init__(self, dimensions: int):
        self.letters = letters(dimensions)
        self.number = np.zeros(1 << 24, np.int32)
        self.seen = np.zeros(1 << 24, bool)

    def bundle(self, group: np.ndarray, codes: np.ndarray, groups: int) -> np.ndarray:
        """For each group the sum of the vectors of its trigrams; exact, since all terms are small integers."""
        self.seen[codes] = True
        known = np.flatnonzero(self.seen)
        self.seen[known] = False
        self.number[known] = np.arange(len(known))
        a, b, c = self.letters
        out = np.zeros((groups, a.shape[1]), np.float32)
        at = self.number[codes]
        for start in range(0, len(known), 16384):
            part = known[start : start + 16384]
            inside = slice(None) if len(known) <= 16384 else (at >= start) & (at < start + len(part))
            counts = np.bincount(group[inside] * len(part) + at[inside] - start, minlength=groups * len(part)).reshape(groups, len(part))
            out += counts.astype(np.float32) @ (a[part >> 16] * b[part >> 8 & 255] * c[part & 255]).astype(np.float32)
        return out


def prototypes(docs: DataFrame, dimensions: int) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, the sums of the text vectors of (text, lang), scaled to length 1.

    Each task sums its texts into one vector per language; these are added by Spark. The sums are integers, so their
    order does not matter. What comes to the driver is one vector for each language.
    """

    def run(batches):
        own, sums = Encoder(dimensions), {}
        for batch in batches:
            for part in pieces(batch, 0, BATCH, ROWS):
                langs = part.column(1).to_pylist()
                names = sorted(set(langs))
                doc, codes = trigrams([t or "" for t in part.column(0).to_pylist()])
                found = own.bundle(np.array([names.index(x) for x in langs])[doc], codes, len(names))
                for name, vector in zip(names, found.astype(np.int64), strict=True):
                    sums[name] = sums.get(name, 0) + vector
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "vector"])

    parts = docs.select("text", "lang").mapInArrow(run, "lang string, vector array<long>")
    rows = parts.select("lang", F.posexplode("vector").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    vectors: dict[str, np.ndarray] = {}
    for r in rows.collect():
        vectors.setdefault(r.lang, np.zeros(dimensions))[r.i] = r.x
    names = sorted(k for k, v in vectors.items() if v.any())
    return names, np.array([vectors[k] / np.linalg.norm(vectors[k]) for k in names]).reshape(len(names), dimensions)


def predict(docs: DataFrame, names: list[str], profiles: np.ndarray, *, id_column: str = "doc_id", text_column: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """(doc_id, lang_pred, score) for every row: the language whose prototype has the largest cosine with the text's vector.

    score is that cosine, 0 at least. A text without letters (NULL included) is ``und`` with score 0, as is any text
    when no language was learned; of equal cosines the first language by name wins.
    """
    profiles = profiles.astype(np.float32)

    def run(batches):
        own = Encoder(dimensions)
        for batch in batches:
            for part in pieces(batch, 1, BATCH, ROWS):
                texts = [t or "" for t in part.column(1).to_pylist()]
                doc, codes = trigrams(texts)
                vectors = own.bundle(doc, codes, len(texts))
                length = np.linalg.norm(vectors, axis=1)
                some = (length > 0) & bool(names)
                cosines = vectors @ profiles.T / np.where(length > 0, length, 1)[:, None] if names else np.zeros((len(texts), 1))
                best = cosines.argmax(axis=1)
                score = np.where(some, np.clip(cosines[np.arange(len(texts)), best], 0, 1), 0.0)
                langs = [names[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score.astype(np.float64))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, *, folds: int = 3, held_out: int = 1, dimensions: int = DIMENSIONS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang).

    Learns from rows with a language whose fold, crc32 of the id modulo ``folds``, is not ``held_out``. Rows without
    an id belong to no fold: they are neither learned from nor held out. Repeated rows are learned and judged each, an
    empty table gives none, and other columns, whatever their names, are left out. Letters from U+0100 on share 255 slots
    by their hash.
    """
    fold = remainder("doc_id", folds)
    names, profiles = prototypes(docs.filter(fold.isNotNull() & (fold != held_out) & F.col("lang").isNotNull()), dimensions)
    found = predict(docs, names, profiles, dimensions=dimensions)
    return found.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
