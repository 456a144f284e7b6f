"""The council dimension: sources, identity, register URLs, selections."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from licensum import vocab
from licensum.functions import text, urls
from licensum.operators.pages import page_links, unnest
from licensum.schemas import REGISTER_ENTRY


# Characters that are printed as \\xNN, \\uNNNN and \\UNNNNNNNN, and how much longer that makes them.
_UNPRINTABLE = [(r"[\x00-\xff&&[\p{C}\p{Z}]&&[^ \t\n\r]]", 3), (r"[\x{100}-\x{ffff}&&[\p{C}\p{Z}]]", 5), (r"[\x{10000}-\x{10ffff}&&[\p{C}\p{Z}]]", 9)]


def printed_length(c: Column) -> Column:
    """Length of a value printed as a quoted literal; an absent value prints as ``None``."""
    count = lambda ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
    escapes = count("\\") + count("\n") + count("\r") + count("\t")
    for pattern, more in _UNPRINTABLE:
        escapes = escapes + more * (F.length(c) - F.length(F.regexp_replace(c, pattern, "")))
    quotes = F.when(c.contains("'") & c.contains('"'), count("'")).otherwise(0)
    return F.when(c.isNull(), F.lit(4)).otherwise(F.length(c) + 2 + escapes + quotes)


def with_info_length(councils: DataFrame, fields: list[str]) -> DataFrame:
    """Add how much a record says: the length of its printed ``{'field': value, ...}`` form."""
    total = F.lit(2 + 2 * (len(fields) - 1) + sum(len(f) + 4 for f in fields))
    for f in fields:
        total = total + printed_length(F.col(f))
    return councils.withColumn("info_len", total)


def parse_register(files: DataFrame) -> DataFrame:
    """Councils of official registers: ``files(value, path[, seq])`` with one JSON object of records per value.

    A name is the official one or, when that field is absent, the plain one. The site is built from the official name
    only, and records without a site are dropped.
    """
    records = T.MapType(T.StringType(), T.StructType([T.StructField("entry", REGISTER_ENTRY)]))
    carry = [c for c in ("seq",) if c in files.columns]
    rows = unnest(files.select("path", "value", *carry), F.map_entries(F.from_json("value", records)), "pos", "record")
    e = lambda name: F.col(f"record.value.entry.`{name}`")
    codes = [e(f"local-authority-{c}") for c, _ in vocab.REGION_CODES]
    out = rows.filter(F.col("record.value.entry").isNotNull()).select(
        *carry,
        "pos",
        F.coalesce(e("official-name"), e("name"), F.lit("")).alias("name"),
        F.coalesce(*codes, F.col("record.key")).alias("code"),
        urls.construct_website_url(F.coalesce(e("official-name"), F.lit(""))).alias("website_url"),
        urls.region_of_source(F.col("path")).alias("region"),
    )
    return with_info_length(out.filter(text.truthy(F.col("website_url"))), ["name", "code", "website_url", "region"])


def is_council_link(href: Column, label: Column, words=vocab.COUNCIL_LINK_WORDS) -> Column:
    return text.contains_any(F.lower(F.concat(href, F.lit(" "), label)), words)


def parse_directory(pages: DataFrame) -> DataFrame:
    """Councils linked from directory pages ``(page_id, html)``."""
    found = page_links(pages.withColumn("url", F.lit("")))
    site = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit("https://"), F.col("href")))
    out = found.filter(is_council_link(F.col("href"), F.col("text"))).select(
        "page_id",
        "pos",
        F.col("text").alias("name"),
        site.alias("website_url"),
        F.lit("Unknown").alias("region"),
    )
    return with_info_length(out, ["name", "website_url", "region"])


def union_sources(*sources: DataFrame) -> DataFrame:
    """All sources one below the other; ``src_rank`` keeps their order."""
    ranked = [s.withColumn("src_rank", F.lit(i)) for i, s in enumerate(sources)]
    out = ranked[0]
    for s in ranked[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def council_key(name: Column) -> Column:
    return F.replace(F.lower(text.strip(name)), F.lit(" council"), F.lit(""))


def dedupe_councils(councils: DataFrame, order: list[str]) -> DataFrame:
    """The most informative record per council name; ties go to the earliest one in ``order`` (numeric columns)."""
    named = councils.filter(F.length(text.strip(F.col("name"))) > 0)
    keyed = named.withColumn("council_key", council_key(F.col("name")))
    rank = F.struct(F.col("info_len"), *[-F.col(c) for c in order])
    cols = [c for c in keyed.columns if c != "council_key"]
    best = keyed.groupBy("council_key").agg(F.max_by(F.struct(*cols), rank).alias("best"))
    return best.select("council_key", "best.*")


def with_register(councils: DataFrame) -> DataFrame:
    return councils.filter(text.truthy(F.col("licence_register_url")))


def eligible_for_extraction(councils: DataFrame, *, max_councils: int | None = None) -> DataFrame:
    """Councils with a register that answered; the first ``max_councils`` by ``seq`` when a number is given."""
    out = with_register(councils).filter(F.coalesce("scrape_successful", F.lit(False)))
    return out.orderBy("seq").limit(max_councils) if max_councils else out


def known_urls(spark, known=vocab.KNOWN_REGISTER_URLS) -> DataFrame:
    return spark.createDataFrame(list(known.items()), "name string, known_url string")


def apply_known_urls(councils: DataFrame, known: DataFrame) -> DataFrame:
    """Replace register URLs by the curated ones and mark those councils as working."""
    joined = councils.join(known, "name", "left")
    fixed = F.col("known_url").isNotNull() & ~F.col("known_url").eqNullSafe(F.col("licence_register_url"))
    return joined.withColumns(
        {
            "licence_register_url": F.coalesce("known_url", "licence_register_url"),
            "scrape_successful": F.when(fixed, F.lit(True)).otherwise(F.col("scrape_successful")),
            "url_fixed": fixed,
        }
    ).drop("known_url")


def clean_register_urls(councils: DataFrame) -> DataFrame:
    """Cut the URL out of a messy answer; a text without a usable URL stays as it is."""
    url = F.col("licence_register_url")
    cleaned = urls.clean_url(url)
    return councils.withColumns(
        {
            "licence_register_url": F.coalesce(cleaned, url),
            "url_cleaned": F.coalesce(cleaned != url, F.lit(False)),
        }
    )


def url_quality(councils: DataFrame) -> DataFrame:
    """Number of councils, of register URLs, and of URLs that look usable."""
    url = F.col("licence_register_url")
    return councils.agg(
        F.count("*").alias("total_councils"),
        F.count_if(text.truthy(url)).alias("with_url"),
        F.count_if(text.truthy(url) & urls.is_clean_url(url)).alias("clean_url"),
        F.count_if(text.truthy(url) & url.startswith("http")).alias("http_url"),
    )


def apply_register_answers(councils: DataFrame, answers: DataFrame, *, as_of) -> DataFrame:
    """Outcome of register discovery: ``answers(name, status, answer)``, one row per council that was asked."""
    url = urls.clean_discovered_url(F.col("answer"))
    ok = F.col("status") == 200
    joined = councils.drop("licence_register_url", "scrape_successful", "error_message", "last_scraped").join(
        answers, "name", "left"
    )
    return joined.withColumns(
        {
            "licence_register_url": F.when(ok, url),
            "scrape_successful": F.when(F.col("status").isNotNull(), ok & url.isNotNull()),
            "error_message": F.when(~ok, F.concat(F.lit("Website returned status "), F.col("status").cast("string"))).when(
                ok & url.isNull(), F.lit("No licence register found")
            ),
            "last_scraped": F.when(F.col("status").isNotNull(), text.as_ntz(as_of)),
        }
    ).drop("status", "answer")


def recently_successful(councils: DataFrame, *, as_of, days: int = 30, limit: int | None = None) -> DataFrame:
    """Councils that worked in the last ``days``; when there are none, all that ever worked; ``limit`` keeps the first."""
    worked = F.coalesce("scrape_successful", F.lit(False))
    since = text.as_ntz(as_of) - F.make_dt_interval(F.lit(days))
    recent = worked & F.coalesce(F.col("last_scraped") > since, F.lit(False))
    any_recent = councils.agg(F.coalesce(F.bool_or(recent), F.lit(False))).scalar()
    fallback = worked & text.truthy(F.col("licence_register_url"))
    out = councils.filter(F.when(any_recent, recent).otherwise(fallback))
    return out.orderBy("seq").limit(limit) if limit else out


def join_analyses(councils: DataFrame, analyses: DataFrame) -> DataFrame:
    """Councils with their page analysis (the last one by ``seq``), NULL when there is none."""
    cols = [c for c in analyses.columns if c not in ("council_name", "seq")]
    last = analyses.groupBy("council_name").agg(F.max_by(F.struct(*cols), F.col("seq")).alias("analysis"))
    return councils.join(last, councils["name"] == last["council_name"], "left").drop("council_name")


def with_strategy(joined: DataFrame) -> DataFrame:
    """How a council has to be read: plain page, rendered page, or rendered page with paging."""
    script = F.coalesce("analysis.javascript_required", F.lit(False))
    paged = F.coalesce("analysis.pagination_detected", F.lit(False))
    return joined.withColumn(
        "strategy", F.when(script & paged, "rendered_paginated").when(script, "rendered").otherwise("plain")
    )
