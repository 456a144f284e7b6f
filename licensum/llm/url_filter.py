"""URL filter: listed rules first, then naive Bayes over words that a unigram Viterbi search finds in host names and paths."""

import math
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from licensum.llm.common import stored

TOKENS = 65_536
# Letters by which names meet the words they hold; longer words meet them by their first letters and are then looked for whole.
PIECE = 24
# Share of the whole corpus in the token distribution of a class.
BLUR = 0.1
# Host words that mark the pages to learn from, by class of unwanted hosts.
UNWANTED_CLASSES = {
    "adult": ("adult", "porn", "sex", "xxx"),
    "gambling": ("bet", "bets", "betting", "casino", "gambling", "poker", "slots"),
    "advertising and tracking": ("ads", "adserver", "popunder", "tracker", "tracking"),
    "spam and link farms": ("backlinks", "linkfarm", "spam"),
    "pharmacy": ("cialis", "pharmacy", "pills", "viagra"),
}
UNWANTED = tuple(word for words in UNWANTED_CLASSES.values() for word in words)

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for NULL and without ``://``."""
    part = lambda i: F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", i)
    return F.translate(part(1), LETTERS, LETTERS.lower()), part(2)


def listed(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule ``host/path`` that fits the host or a parent of it and begins the path, and its verdict; NULL if none does."""
    rule = verdict = F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: len(r[0])):
        domain, slash, start = name.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def word_counts(text: Column, frame: DataFrame, most: int | None = None, always: Sequence[str] = ()) -> DataFrame:
    """Words of a-z in all texts with their counts; with ``most``, those above the smallest count at which no more are left.

    That count is read from the number of words of each count. The words ``always`` stay at every count.
    """
    each = frame.select(F.explode(F.split(F.lower(text), "[^a-z]+")).alias("word")).filter("word <> ''")
    counts = stored(each.groupBy("word").agg(F.count("*").alias("n")))
    if most is None:
        return counts
    ranks = counts.groupBy("n").agg(F.count("*").alias("words")).selectExpr("n", "sum(words) OVER (ORDER BY n DESC) AS upto")
    least = ranks.filter(F.col("upto") <= most).agg(F.min("n")).first()[0]
    return counts.filter((F.col("n") >= (least if least is not None else 2**62)) | F.col("word").isin(*always))


class Segmenter:
    """Splits names into their most probable words; an unknown word costs ten times more with every letter."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = math.log((sum(counts.values()) if total is None else total) + 1)
        self.cost = {w: self.total - math.log(n) for w, n in counts.items()}

        self.lengths = sorted({len(w) for w in counts})

    def name(self, name: str) -> tuple[str, ...]:
        letter = math.log(10)
        best, back = [0.0], [0]
        # The best start of an unknown word; it may have any length.
        unknown, since = 0.0, 0
        for end in range(1, len(name) + 1):
            found = [(unknown + self.total + letter * (end - 1), since)]
            for length in self.lengths:
                if length > end:
                    break
                cost = self.cost.get(name[end - length : end])
                if cost is not None:
                    found.append((best[end - length] + cost, end - length))
            cost, start = min(found)
            best.append(cost)
            back.append(start)
            if cost - letter * end < unknown:
                unknown, since = cost - letter * end, end
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return tuple(reversed(words))


def runs(text: str) -> list[str]:
    """All runs of a-z, runs of other letters, and ``0`` for a number."""
    return ["0" if run.isdecimal() else run for run in re.findall(r"[a-z]+|[0-9]+|[^\W\d_]+", text.lower())]


def buckets(tokens: Sequence[str], size: int = TOKENS) -> list[int]:
    return [xxhash.xxh64_intdigest(t) % size for t in tokens]


def segments(names: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(name, words) for every row of ``names`` (different names of a-z), which meet those of the words ``counts`` (word, n) that they hold."""

    def parts(batches):
        """All pieces of the names, a bounded number at a time."""
        ids, found = [], []
        for batch in batches:
            for number, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for start in range(0, len(name), 1000):
                    own = {name[i:j] for i in range(start, min(start + 1000, len(name))) for j in range(i + 1, min(len(name), i + PIECE) + 1)}
                    ids += [number] * len(own)
                    found += own
                    if len(found) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["id", "piece"])
                        ids, found = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["id", "piece"])

    def run(batches):
        for batch in batches:
            known = [{e["word"]: e["n"] for e in x or ()} for x in batch.column(1).to_pylist()]
            words = [Segmenter(k, total).name(name) for name, k in zip(batch.column(0).to_pylist(), known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    # Names travel as numbers; only those that begin a longer word are looked into again.
    names = stored(names.withColumn("id", F.monotonically_increasing_id()))
    met = names.select("id", "name").mapInArrow(parts, "id long, piece string").join(counts.withColumn("piece", F.left("word", F.lit(PIECE))), "piece").select("id", "word", "n").distinct()
    longer = F.length("word") > PIECE
    met = met.filter(~longer).unionAll(met.filter(longer).join(names, "id").filter(F.contains("name", "word")).select("id", "word", "n"))
    held = met.groupBy("id").agg(F.collect_list(F.struct("word", "n")).alias("held"))
    return names.join(held, "id", "left").select("name", "held").mapInArrow(run, "name string, words array<string>")


def segmented(pages: DataFrame, counts: DataFrame, total: int, unwanted: Sequence[str], size: int) -> DataFrame:
    """Adds ``tokens`` (host words marked ``h:``, path words ``p:``), ``marked`` and ``buckets`` to (row, host, path)."""
    bad = frozenset(f"h:{w}" for w in unwanted)

    def split(batches):
        for batch in batches:
            out = []
            for host, path, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(at, i, kind, name) for i, (kind, name) in enumerate([("h:", x) for x in runs(host)] + [("p:", x) for x in runs(path)])]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["address", "i", "kind", "name"])

    def run(batches):
        for batch in batches:
            names = batch.column("tokens").to_pylist()
            marks = [not bad.isdisjoint(x) for x in names]
            numbers = [buckets(x, size) for x in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.bool_()), pa.array(numbers, pa.list_(pa.int32()))], [*batch.schema.names, "marked", "buckets"])

    # Addresses are cut into names once each, and names into words once each.
    addresses = stored(pages.select("host", "path").distinct().withColumn("address", F.monotonically_increasing_id()))
    pieces = stored(addresses.select("host", "path", "address").mapInArrow(split, "address long, i int, kind string, name string"))
    names = stored(pieces.select("name").filter(F.col("name").rlike("^[a-z]+$")).distinct())
    words = pieces.join(segments(names, counts, total), "name", "left").withColumn("words", F.coalesce("words", F.array("name")))
    inorder = F.array_sort(F.collect_list(F.struct("i", F.transform("words", lambda w: F.concat("kind", w)).alias("words"))))
    tokens = words.groupBy("address").agg(F.flatten(inorder["words"]).alias("tokens"))
    known = addresses.join(tokens, "address", "left").select("host", "path", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    rows = pages.join(known, ["host", "path"]).select(*pages.columns, "tokens")
    spark_type = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return stored(rows.mapInArrow(run, f"{spark_type}, marked boolean, buckets array<int>"))


def log_odds(cells: np.ndarray) -> np.ndarray:
    """What each cell says for the second class against the first, from their counts; cells of no example say nothing."""
    both = cells.sum(axis=0) / max(cells.sum(), 1)
    share = [(1 - BLUR) * own / max(own.sum(), 1) + BLUR * both for own in cells]
    return np.log(np.where(both > 0, share[1], 1)) - np.log(np.where(both > 0, share[0], 1))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], *, id_column: str = "page_id", url_column: str = "url", text_column: str = "html", unwanted: Sequence[str] = UNWANTED, dictionary: int | None = None, size: int = TOKENS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, tokens) for every row of ``pages``.

    A listed rule decides where one fits. Else naive Bayes does: host names and paths are split into words by a
    unigram model of the words in ``text_column`` of all pages; pages whose host has an unwanted word are the examples
    of class block, all others of class allow, but for those that a first model blocks. The examples' token counts, in
    ``size`` hashed cells, give the log odds ``score``, and over 0 blocks. Each class's distribution is mixed with that of
    all examples (``BLUR``), so a token that neither class has says nothing, however small a class is. All words are in the
    unigram model unless ``dictionary`` limits it. NULL and unreadable URLs have no tokens: their score is the log odds
    of the classes. With no example all is allowed; an empty table gives none. Repeated rows are judged each and count
    as often. Other columns of ``pages``, whatever their names, are left out.
    """
    text = F.coalesce(F.col(text_column), F.lit("")) if text_column in pages.columns else F.lit("")
    counts = word_counts(text, pages, dictionary, unwanted)
    absent = pages.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, unwanted)).cast("array<string>")).alias("word"), F.lit(1).cast("long").alias("n"))
    counts = stored(counts.unionAll(absent.join(counts, "word", "left_anti")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    host, path = host_and_path(F.col(url_column))
    rows = segmented(pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path")), counts, total, unwanted, size)

    def learned(examples: DataFrame) -> tuple[np.ndarray, float]:
        """Log odds of the cells and of the classes."""
        cells = np.zeros((2, size))
        for r in examples.select("marked", F.explode("buckets").alias("bucket")).groupBy("marked", "bucket").agg(F.count("*").alias("n")).toLocalIterator():
            cells[int(r.marked), r.bucket] = r.n
        prior = {r.marked: r["count"] for r in examples.groupBy("marked").count().collect()}
        if not (prior.get(True, 0) and prior.get(False, 0)):
            return np.zeros(size), -math.inf if not prior.get(True, 0) else math.inf
        return log_odds(cells), math.log(prior[True] / prior[False])

    odds, start = learned(rows)

    def unlike(batches):
        for batch in batches:
            score = np.array([start + sum(odds[b] for b in row) for row in batch.column("buckets").to_pylist()])
            yield batch.filter(pa.array((score <= 0) | batch.column("marked").to_numpy(zero_copy_only=False)))

    # Unmarked pages that resemble marked ones teach neither class.
    if math.isfinite(start):
        again = learned(rows.select("marked", "buckets").mapInArrow(unlike, "marked boolean, buckets array<int>"))
        final = again if math.isfinite(again[1]) else (odds, start)
    else:
        final = odds, start

    def run(batches, odds=final[0], start=final[1]):
        for batch in batches:
            score = [start + sum(odds[b] for b in row) for row in batch.column("buckets").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "tokens")), pa.array(score, pa.float64())], ["page_id", "host", "path", "tokens", "score"])

    kind = pages.schema[id_column].dataType.simpleString()
    scored = rows.mapInArrow(run, f"page_id {kind}, host string, path string, tokens array<string>, score double")
    rule, says = listed(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(says, F.when(F.col("score") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score", "tokens")
