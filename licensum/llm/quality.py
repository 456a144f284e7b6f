"""Quality rules: counts of a text, and a hashed n-gram likelihood ratio between trusted and raw text. Native functions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from licensum.llm.common import SPACES, let, words

BUCKETS, SMOOTHING, TRUSTED, THRESHOLD = 16384, 1.0, 20_000, -0.5
SYMBOLS = "[#*$%&|<>]+"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def shapes(text: Column) -> Column:
    """The words with letters and digits reduced to their kind: ``Don't!! 1,000`` is ``Aa'a!! A,A``."""
    return words(F.regexp_replace(F.regexp_replace(text, "\\p{Ll}+", "a"), "[\\p{Lu}\\p{N}]+", "A"))


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """How many words lie in runs of ``window`` words that a text has twice or more, the first run included."""
    # Bound inside the expression: a column could be computed anew for every element.
    runs_of = lambda h: F.transform(F.slice(h, 1, F.size(h) - (window - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, window))))
    starts = let(hashes, lambda h: F.when(F.size(h) >= window, runs_of(h)))

    def covered(runs):
        placed = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        twice = let(placed, lambda s: F.filter(s, lambda x, k: same(F.get(s, k - 1), x) | same(F.get(s, k + 1), x)))
        at = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))), F.lit(0), lambda a, b: a + b))

    return let(F.coalesce(starts, F.array().cast("array<long>")), lambda runs: F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0)).otherwise(covered(runs)))


def counts(rows: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows of ``text`` and ``hashes``."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    rows = rows.withColumns(
        {
            "n_words": F.size("hashes").cast("long"),
            "word_chars": without("[\\x20\\x09-\\x0D]+").cast("long"),
            "n_symbols": (F.length(text) - without(SYMBOLS)).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeated_words(F.col("hashes")).cast("long"),
        }
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def features(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``hashes`` of the words of ``text``, and ``features``: bucket numbers of the words and of pairs of word shapes."""
    text = F.coalesce("text", F.lit(""))
    rows = rows.withColumn("hashes", F.transform(words(text), lambda w: F.xxhash64(w)))
    single = F.transform("hashes", lambda h: F.pmod(h, F.lit(buckets)))
    pairs = let(shapes(text), lambda s: F.transform(s, lambda x, i: F.pmod(F.xxhash64(F.get(s, i - 1), x), F.lit(buckets))))
    return rows.withColumn("features", F.concat(single, pairs))


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """Ids of up to ``most`` documents that people marked as good, the same at every run; a bounded sample of labelled rows."""
    return labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def log_ratios(docs: DataFrame, trusted: DataFrame, *, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row: ``weights``, for each bucket log p(bucket | trusted) - log p(bucket | raw).

    Raw counts are those of all ``docs``, trusted counts those of the documents in ``trusted`` (doc_id), which is
    bounded and therefore broadcast. Each task sums its n-grams into at most ``buckets`` rows before they are shuffled.
    Without trusted documents all weights are 0.
    """
    marked = docs.join(F.broadcast(trusted.withColumn("good", F.lit(True))), "doc_id", "left")
    # The outer generator: for a plain one Spark tests the size of the array in front of it, and so makes all features twice.
    ngrams = features(marked, buckets).select(F.coalesce("good", F.lit(False)).cast("int").alias("good"), F.explode_outer("features").alias("bucket"))
    each = ngrams.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("good"))
    filled = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(each, "bucket", "left").fillna(0)
    rows = filled.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("rows"), F.sum("raw").alias("n_raw"), F.sum("good").alias("n_good"))
    share = lambda count, total: F.log((count + smoothing) / (total + smoothing * buckets))
    weight = lambda x: F.when(F.col("n_good") > 0, share(x["good"], F.col("n_good")) - share(x["raw"], F.col("n_raw"))).otherwise(0.0)
    return rows.select(F.transform("rows", weight).alias("weights"))


def judge(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, smoothing: float = SMOOTHING, trusted: int = TRUSTED, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``row`` (all its columns), the counts, base_failed, ``ratio`` and ``kept``.

    ratio is the mean over the n-grams of a text of the log of their probability in trusted text over that in the raw
    corpus (all of ``docs``), so it does not depend on length. A text is kept if the base rules hold and ratio is
    ``threshold`` at least; text that is like the corpus as a whole has a ratio near 0. NULL and blank texts have no
    words and fail the base rules; their ratio is 0. ``labels`` has doc_id and quality.
    """
    slim = docs.select(F.col("doc_id"), F.col("text"))
    weights = log_ratios(slim, trusted_ids(labels, trusted), buckets=buckets, smoothing=smoothing).scalar()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    rows = counts(features(rows, buckets)).withColumn("weights", weights)
    total = F.aggregate("features", F.lit(0.0), lambda s, b: s + F.get(F.col("weights"), b.cast("int")))
    rows = rows.withColumn("ratio", F.when(F.size("features") > 0, total / F.size("features")).otherwise(0.0))
    kept = ~F.col("base_failed") & (F.col("ratio") >= threshold)
    rows = rows.withColumn("kept", kept)
    # Behind a generator, so that a later filter on kept is not moved down to repeat all that it depends on.
    return rows.select("row", *COUNTS, "base_failed", "ratio", F.explode(F.array("kept")).alias("kept"))
