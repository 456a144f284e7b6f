"""Spelling variants by composition: vocabulary acceptor, one-edit transducer, acceptor again, in blocks of initial states."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from licensum.llm.common import stored

#: Words of one block. Larger blocks are dealt anew by one more letter, so this bounds memory and loses nothing.
BLOCK = 20_000

#: What a block shares: its beginning, its end, or all but one letter that is replaced or put in.
PREFIX, SUFFIX, REPLACED, INSERTED = range(4)


def vocabulary(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", drop_every: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): how often the words of the whole texts occur, for words of ``shortest`` code points and ``least`` occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, of which only A-Z are lower-cased. A run whose crc32 with the id of
    its document (``<id>:<run>``; no id: empty) is a multiple of ``drop_every`` loses the code point at that crc32
    modulo its length. NULL texts have no words. Counts are combined in the map tasks.
    """
    lower = F.translate(F.col(text_column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= shortest).select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    cut = F.expr("overlay(run PLACING '' FROM cast(h % length(run) AS int) + 1 FOR 1)")
    words = runs.select(F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


class Acceptors:
    """Minimal acyclic acceptors that share their states: states with the same right language are one state.

    ``arcs`` maps a label to the next state and to how many words of the state come before those behind the arc, so that
    a path spells the rank of its word among the sorted words.
    """

    def __init__(self):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        self.known: dict[tuple, int] = {}

    def add(self, words: list[str]) -> int:
        """The initial state of the acceptor of sorted different words, built word by word."""
        path: list[tuple[bool, dict[str, int]]] = [(False, {})]
        last = ""
        for word in words:
            same = 0
            while same < min(len(last), len(word)) and last[same] == word[same]:
                same += 1
            self._close(path, last, same)
            path += [(False, {}) for _ in word[same:]]
            path[-1] = (True, path[-1][1])
            last = word
        self._close(path, last, 0)
        return self._state(*path[0])

    def _close(self, path, word: str, depth: int) -> None:
        while len(path) > depth + 1:
            done = self._state(*path.pop())
            path[-1][1][word[len(path) - 1]] = done

    def _state(self, final: bool, targets: dict[str, int]) -> int:
        key = (final, *targets.items())
        if key not in self.known:
            arcs, words = {}, int(final)
            for label, target in targets.items():
                arcs[label] = target, words
                words += self.size[target]
            self.known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
            self.size.append(words)
        return self.known[key]


def compose(own: Acceptors, left: int, right: int, inserting: bool, limit: int) -> Iterator[tuple[int, int]]:
    """Ranks of the pairs that acceptor, edit and acceptor take together, each pair once.

    A state of the composition is a pair of states and whether the edit is made. The edit is made at the first letter in
    which the words differ, before ``limit``: one letter is replaced (``right`` has the larger one), or ``right`` has
    one more. Behind it both must go on alike; a pair of equal states accepts all its words at once.
    """
    arcs, final = own.arcs, own.final
    before = [(left, right, 0, 0, 0)]
    while before:
        p, q, i, j, depth = before.pop()
        after = []
        if depth >= limit:
            continue
        for b, (q2, to) in arcs[q].items():
            if inserting:
                if final[p] and final[q2]:
                    yield i, j + to
                for a, (p3, x) in arcs[p].items():
                    if a != b and a in arcs[q2]:
                        q3, y = arcs[q2][a]
                        after.append((p3, q3, i + x, j + to + y))
            else:
                after += [(p2, q2, i + x, j + to) for a, (p2, x) in arcs[p].items() if a < b]
            if b in arcs[p]:
                p2, x = arcs[p][b]
                before.append((p2, q2, i + x, j + to, depth + 1))
        while after:
            p, q, i, j = after.pop()
            if p == q:
                yield from ((i + k, j + k) for k in range(own.size[p]))
                continue
            if final[p] and final[q]:
                yield i, j
            for a, (p2, x) in arcs[p].items():
                if a in arcs[q]:
                    q2, y = arcs[q][a]
                    after.append((p2, q2, i + x, j + y))


def near_in_block(words: list[str], m: int, kind: int, k: int, t: int) -> Iterator[tuple[int, int]]:
    """Places of all near pairs of a block: sorted words of ``m`` and ``m + 1`` letters that share ``k`` letters at the beginning and ``t`` at the end."""
    short, long = [i for i, w in enumerate(words) if len(w) == m], [i for i, w in enumerate(words) if len(w) > m]
    own = Acceptors()
    if not short or len(words) < 2:
        return
    left = own.add([words[i][k : m - t] for i in short])
    limit = m // 2 - k if kind == SUFFIX else m + 2
    if kind != INSERTED and len(short) > 1:
        yield from ((short[i], short[j]) for i, j in compose(own, left, left, False, limit))
    if kind != REPLACED and long:
        right = own.add([words[j][k : m + 1 - t] for j in long])
        yield from ((short[i], long[j]) for i, j in compose(own, left, right, True, limit))


def blocks(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, m, kind, k, t): the blocks of every word; each near pair meets in one of them.

    Of a pair whose shorter word has m letters, the first difference lies in the first m // 2 letters or behind them, so the
    words share their end or their beginning: each is the context in which the composition starts. A block of more than
    ``block`` words is dealt anew: into pairs that share one more letter, and pairs that differ right there, which
    share all other letters.
    """
    size = F.length("word")
    base = words.select("word", "n", F.explode(F.array(size - 1, size)).alias("m"))
    half = F.expr("m DIV 2")
    found = base.select("*", F.explode(F.array(F.struct(F.lit(PREFIX).alias("kind"), half.alias("k"), F.lit(0).alias("t")), F.struct(F.lit(SUFFIX).alias("kind"), F.lit(0).alias("k"), (F.col("m") - half).alias("t")))).alias("b")).select("word", "n", "m", "b.*")
    out = None
    while True:
        keyed = found.withColumn("prefix", F.expr("substring(word, 1, k)")).withColumn("suffix", F.expr("right(word, t)"))
        sizes = keyed.filter(F.col("kind") <= SUFFIX).groupBy("m", "kind", "prefix", "suffix").agg(F.count("*").alias("words"))
        hot = stored(sizes.filter(F.col("words") > block).drop("words"))
        if hot.isEmpty():
            return found if out is None else out.unionByName(found)
        key = ["m", "kind", "prefix", "suffix"]
        fits = keyed.join(hot, key, "left_anti").select(found.columns)
        out = fits if out is None else out.unionByName(fits)
        found = stored(keyed.join(hot, key, "left_semi").select(found.columns).transform(_one_letter_on))


def _one_letter_on(hot: DataFrame) -> DataFrame:
    """The rows of hot blocks as rows of the blocks with one more letter and of those where the pairs differ at this letter."""
    def now(kind, t):
        return F.struct(F.lit(kind).alias("kind"), F.col("k").alias("k"), t.alias("t"))

    size, short = F.length("word"), F.length("word") == F.col("m")
    inside = F.col("k") < size - F.col("t")
    onward = inside & ((F.col("kind") == PREFIX) | (F.expr("k + 1 < m DIV 2")))
    letter, following = F.expr("substring(word, k + 1, 1)"), F.expr("substring(word, k + 2, 1)")
    kinds = F.array(
        F.when(onward, F.struct("kind", (F.col("k") + 1).alias("k"), "t")),
        F.when(short & inside, now(REPLACED, size - F.col("k") - 1)),
        F.when(short, now(INSERTED, size - F.col("k"))),
        F.when(~short & inside & (letter != following), now(INSERTED, size - F.col("k") - 1)),
    )
    return hot.select("word", "n", "m", F.explode(F.filter(kinds, lambda b: b.isNotNull())).alias("b")).select("word", "n", "m", "b.*")


def _by_block(batches):
    """The blocks of sorted batches: (words, counts, m, kind, k, t)."""
    key, words, counts = None, [], []
    for batch in batches:
        for word, n, m, kind, k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = (m, kind, k, t, word[:k], word[len(word) - t :])
            if own != key:
                if len(words) > 1:
                    yield words, counts, *key[:4]
                key, words, counts = own, [], []
            words.append(word)
            counts.append(n)
    if len(words) > 1:
        yield words, counts, *key[:4]


def _dealt(words: DataFrame, block: int) -> DataFrame:
    key = ["m", "kind", "k", "t", F.expr("substring(word, 1, k)").alias("prefix"), F.expr("right(word, t)").alias("suffix")]
    rows = blocks(words, block).repartition(*key).select("*", *key[4:])
    return rows.sortWithinPartitions("m", "kind", "k", "t", "prefix", "suffix", "word").drop("prefix", "suffix")


def _sent(rows: list[tuple], schema: str):
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def near_pairs(words: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(word, near): every pair of different words of ``words`` (word, n) that one replaced or inserted code point parts, once."""

    def run(batches):
        rows = []
        for found, _, m, kind, k, t in _by_block(batches):
            for i, j in near_in_block(found, m, kind, k, t):
                rows.append((found[i], found[j]))
                if len(rows) >= 10_000:
                    yield _sent(rows, "word string, near string")
                    rows = []
        yield _sent(rows, "word string, near string")

    return _dealt(words, block).mapInArrow(run, "word string, near string")


def best_near(words: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best, best_n) for each word of ``words`` (word, n) with near words: how many, and the most frequent of them.

    Pairs are counted in the tasks that find them, so a word leaves a block as one row.
    """
    schema = "word string, n_near long, best string, best_n long"

    def run(batches):
        rows = []
        for found, counts, m, kind, k, t in _by_block(batches):
            own: dict[int, list] = {}
            for pair in near_in_block(found, m, kind, k, t):
                for i, j in (pair, pair[::-1]):
                    seen = own.setdefault(i, [0, (0, "")])
                    seen[0] += 1
                    seen[1] = min(seen[1], (-counts[j], found[j]))
            rows += [(found[i], number, word, -n) for i, (number, (n, word)) in own.items()]
            if len(rows) >= 10_000:
                yield _sent(rows, schema)
                rows = []
        yield _sent(rows, schema)

    parts = _dealt(words, block).mapInArrow(run, schema)
    least = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("least")
    found = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), least)
    return found.select("word", "n_near", F.col("least.word").alias("best"), (-F.col("least.n")).alias("best_n"))


def variants(words: DataFrame, *, times: int = 2, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of ``words`` (word, n; words differ).

    form is the near word with the largest n (of equal ones the first in the order of code points) if it occurs at least
    ``times`` as often, else NULL; root is where the forms of forms end. Forms grow in frequency, so they have no cycles.
    """
    if times < 2:
        raise ValueError("a form occurs at least twice as often, or forms could go round in circles")
    words = stored(words.select("word", F.col("n").cast("long").alias("n")))
    found = words.join(best_near(words, block=block), "word", "left")
    takes = F.col("best_n") >= times * F.col("n")
    found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n")))
    return found.join(_roots(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))), "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(steps: DataFrame) -> DataFrame:
    """(word, root) after following (word, root) to its end; each round doubles the steps of all words."""
    steps = stored(steps)
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        farther = stored(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = farther.drop("moved")
        if farther.filter("moved").isEmpty():
            return steps
