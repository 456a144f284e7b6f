"""Byte-level BPE by a tokenization automaton: merges are compiled into a deterministic automaton over tokens."""

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from licensum.llm.common import pieces

# Fixed value: the pattern that splits text before merges in byte-level vocabularies of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_WORDS, KEPT_STEPS = 250_000, 500_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: itself where printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Remembered(dict):
    """Results of ``make`` by key, at most twice ``most``: a full generation becomes the old one, of which a key that is asked for again is taken over."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Automaton:
    """The token sequences that BPE produces, as a deterministic automaton whose arcs are labelled with tokens.

    Before any merge there is one state with an arc for each byte, back to itself. Each merge ``u v -> w`` is a gadget:
    wherever ``u`` leads to a state with an arc ``v``, an arc ``w`` is added beside ``u`` that leads where ``u v`` led,
    and ``u`` now leads to a copy of its state without the arc ``v``. So the state after a token depends on the token
    alone: ``w`` shares the state of ``v`` as it was at that merge, and later gadgets give each its own copies. A state
    is kept as what was cut from it: ``cut[u, v]`` is the number of the merge that removed ``v`` from the copy for
    ``u``. A merge whose ``u`` has no arc ``v`` can never happen, and adds nothing.
    """

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.labels = {i: label for label, i in vocabulary.items()}
        self.cut: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        self.usable = {i for label, i in vocabulary.items() if len(label) == 1}
        self.steps = Remembered(lambda key: self.arc(key >> 32, key & 0xFFFFFFFF), KEPT_STEPS)
        for number, (left, right) in enumerate(merges, 1):
            u, v, w = vocabulary[left], vocabulary[right], vocabulary[left + right]
            if w in self.usable or u not in self.usable or v not in self.usable or not self.arc(u, v):
                continue
            self.parts[w], self.made[w] = (u, v), number
            self.cut[u, v] = number
            self.usable.add(w)
        self.tokens = {self.labels[i]: i for i in self.usable}
        self.beginnings = {label[:n] for label in self.tokens for n in range(1, len(label) + 1)}

    def arc(self, p: int, t: int) -> bool:
        """Whether the state after token ``p`` has an arc ``t``."""
        owner, before = p, None
        while True:
            # The state after p holds the cuts of p, and those its last part had when p was made, and so on.
            token, until = t, None
            while True:
                # An arc t is a copy of the arc of its first part at the merge that made t; later cuts of that are not inherited.
                number = self.cut.get((owner, token))
                if number is not None and (before is None or number < before) and (until is None or number <= until):
                    return False
                if token not in self.parts:
                    break
                until = self.made[token] if until is None else min(until, self.made[token])
                token = self.parts[token][0]
            if owner not in self.parts:
                return True
            before = self.made[owner] if before is None else min(before, self.made[owner])
            owner = self.parts[owner][1]

    def encode(self, word: bytes) -> tuple[int, ...]:
        """The labels of the one accepted path that spells ``word``."""
        if word in self.tokens:
            return (self.tokens[word],)
        size, path, at, dead, steps = len(word), [], [0], set(), self.steps
        choices = [self._starting(word, 0)]
        while at[-1] < size:
            here, options = at[-1], choices[-1]
            last = path[-1] if path else None
            while options:
                t, end = options.pop()
                if end not in dead and (last is None or steps[last << 32 | t]):
                    path.append(t)
                    at.append(end)
                    choices.append(self._starting(word, end))
                    break
            else:
                # The first tokens of a path are those of its beginning, so no other path reaches this place alive.
                dead.add(here)
                path.pop()
                at.pop()
                choices.pop()
        return tuple(path)

    def _starting(self, word: bytes, start: int) -> list[tuple[int, int]]:
        """Tokens that the word has at a place, the longest last."""
        out, tokens, beginnings = [], self.tokens, self.beginnings
        for end in range(start + 1, len(word) + 1):
            part = word[start:end]
            if part in tokens:
                out.append((tokens[part], end))
            elif part not in beginnings:
                break
        return out


class Tokenizer:
    """Encodes and decodes as the tokenizers library does with the same file, without special tokens around the text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        spelled = lambda s: bytes(letters[c] for c in s)
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        vocabulary = {spelled(t): i for t, i in data["model"]["vocab"].items() if t not in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.automaton = Automaton(vocabulary, [(spelled(a), spelled(b)) for a, b in pairs])
        self.words, self.added = Remembered(lambda word: self.automaton.encode(word.encode()), KEPT_WORDS), added
        labels = self.automaton.labels | {i: t.encode() for t, i in added.items()}
        self.labels = np.full(max(labels) + 1, None, object)
        self.labels[list(labels)] = list(labels.values())
        self.pattern = regex.compile(SPLIT)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def encode(self, text: str) -> list[int]:
        get, split = self.words.__getitem__, self.pattern.findall
        if self.special is None or not self.special.search(text):
            return list(chain.from_iterable(map(get, split(text))))
        ids = []
        for part in self.special.split(text):
            ids += [self.added[part]] if part in self.added else chain.from_iterable(map(get, split(part)))
        return ids

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.labels[ids].tolist()).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode(docs: DataFrame, *, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids) for every row of ``docs``: the token ids of the whole text, an empty list for NULL and empty texts.

    ``path`` is a vocabulary file that every executor has. The automaton is compiled once in each Python worker, and
    words are encoded once as long as the worker remembers them. Repeated rows are encoded each, an empty table gives
    none, and other columns, whatever their names, are left out.
    """

    def run(batches):
        own = tokenizer(path)
        for batch in batches:
            for part in pieces(batch, 1):
                ids = [own.encode(text) if text else [] for text in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, ends[-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["doc_id", "ids"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, *, path: str) -> DataFrame:
    """(doc_id, ids, text) for rows of (doc_id, ids); bytes that are no UTF-8 become U+FFFD, NULL ids are an empty text."""

    def run(batches):
        own = tokenizer(path)
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                flat = part.column(1).flatten().to_numpy()
                ends = np.cumsum([0, *(n or 0 for n in part.column(1).value_lengths().to_pylist())])
                texts = [own.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
