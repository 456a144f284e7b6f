"""Exact duplicates by progressive refinement: length, then hash of the beginning, then hash of the whole content."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from licensum.llm.common import stored

PREFIX = 64


def normalised(text: Column) -> Column:
    """The text without spaces, tabs and line ends; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def exact_dedup(docs: DataFrame, *, keep_columns: list[str] | None = None, id_column: str = "doc_id", text_column: str = "text", prefix: int = PREFIX) -> DataFrame:
    """One row per row of ``docs``: ``row`` (a struct of ``keep_columns``, all by default), keep_id, group_size, kept.

    Rows are equal if their normalised texts are. Level 1 counts the lengths of the texts; level 2 counts the hashes of
    the first ``prefix`` characters among lengths that occur twice; level 3 hashes (SHA-256) whole contents, but only of
    rows whose length and beginning occur twice. All counts are combined in the map tasks, so a group with a third of
    all rows needs no task of its own. Of equal rows the one with the most characters in its original text stays, then
    the smallest id; rows without an id come last, and of rows that are equal in all this exactly one stays.
    NULL texts are one group with empty and blank ones. Other columns, whatever their names, travel inside ``row``.
    """
    text = F.col(text_column)
    norm = normalised(text)
    length, head = F.length(norm).alias("length"), F.xxhash64(F.left(norm, F.lit(prefix))).alias("head")
    signatures = stored(docs.select(length, head))
    lengths = signatures.groupBy("length").agg(F.count("*").alias("n")).filter("n > 1").select("length")
    heads = signatures.join(lengths, "length", "left_semi").groupBy("length", "head").agg(F.count("*").alias("n")).filter("n > 1").select("length", "head", F.lit(True).alias("again"))

    rows = docs.select(F.struct(*(keep_columns or docs.columns)).alias("row"), F.col(id_column).cast("long").alias("id"), text.alias("text"), length, head)
    content = F.when(F.col("again"), F.sha2(normalised(F.col("text")), 256)).alias("content")
    points = F.coalesce(F.length("text"), F.lit(0)).alias("points")
    rows = stored(rows.join(heads, ["length", "head"], "left").select("row", "id", "length", content, points, F.monotonically_increasing_id().alias("place")))

    alone = rows.filter("content IS NULL").select("row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    again = rows.filter("content IS NOT NULL")
    # NULL is the least value of a struct field, so rows without an id lose.
    best = F.max(F.struct("points", (-F.col("id")).alias("id"), (-F.col("place")).alias("place")))
    groups = again.groupBy("length", "content").agg(best.alias("best"), F.count("*").alias("group_size"))
    judged = again.join(groups, ["length", "content"]).select("row", (-F.col("best.id")).alias("keep_id"), "group_size", (F.col("place") == -F.col("best.place")).alias("kept"))
    return alone.unionAll(judged)
