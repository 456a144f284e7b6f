"""Council discovery, page analysis and register URL repair."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from licensum.functions import urls
from licensum.operators import councils as C
from licensum.operators import pages as P


def discover_councils(registers: DataFrame, directory: DataFrame, seeds: DataFrame) -> DataFrame:
    """One record per council from official registers, directory pages and built-in councils, in that order.

    All inputs carry the columns their parser in :mod:`licensum.operators.councils` gives. ``seq`` says where a record
    comes from: number of the input, and its place there.
    """
    numbered = lambda df, a, b: df.withColumns({"ord_a": F.col(a) if a else F.lit(0), "ord_b": F.col(b) if b else F.lit(0)})
    union = C.union_sources(
        numbered(registers, "seq" if "seq" in registers.columns else None, "pos").drop("seq", "pos"),
        numbered(directory, "page_id", "pos").drop("page_id", "pos"),
        numbered(seeds, "seq", None).drop("seq"),
    )
    order = ["src_rank", "ord_a", "ord_b"]
    return C.dedupe_councils(union, order).withColumn("seq", F.struct(*order)).drop("info_len", *order)


def analyse_pages(pages: DataFrame) -> DataFrame:
    """Analysis row of every readable page."""
    return P.page_analysis(P.readable_pages(pages))


def analyse_councils(councils: DataFrame, pages: DataFrame) -> DataFrame:
    """Analyses of the register pages of councils, ``seq`` being the page; only such pages are parsed, each once."""
    asked = C.with_register(councils).select(F.col("name").alias("council_name"), urls.normalize_url(F.col("licence_register_url")).alias("page_key"))
    keyed = pages.drop("council_name").withColumn("page_key", urls.normalize_url(F.col("url")))
    found = analyse_pages(keyed.join(asked.select("page_key"), "page_key", "left_semi").drop("page_key"))
    return asked.join(found.withColumn("page_key", urls.normalize_url(F.col("url"))), "page_key").drop("page_key").withColumnRenamed("page_id", "seq")


def repair_register_urls(councils: DataFrame, known: DataFrame) -> DataFrame:
    """Clean messy register URLs, then apply the curated ones."""
    return C.apply_known_urls(C.clean_register_urls(councils), known)
