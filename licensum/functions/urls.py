"""URL cleaning and resolution as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from licensum import vocab
from licensum.functions.text import contains_any, let, truthy


def clean_url(c: Column, tails=vocab.URL_BOILERPLATE_TAILS, rejects=vocab.URL_REJECTS) -> Column:
    """First http(s) URL of a text without trailing punctuation or known boilerplate; NULL when there is none."""
    url = F.rtrim(F.regexp_extract(c, r"(?U)https?://[^\s\])\n]+", 0), F.lit(".,;:!?"))
    for tail in tails:
        url = F.replace(url, F.lit(tail), F.lit(""))
    return let(url, lambda u: F.when(truthy(u) & ~contains_any(u, rejects), u))


def clean_discovered_url(c: Column, **kw) -> Column:
    """As :func:`clean_url`, for an answer that may also say that nothing was found."""
    return F.when(F.trim(c) != "NOT_FOUND", clean_url(c, **kw))


def is_clean_url(c: Column, max_length=200) -> Column:
    return F.coalesce(c.startswith("http") & (F.length(c) < max_length), F.lit(False))


def normalize_url(c: Column) -> Column:
    """Join key of a URL: no fragment, no trailing slash, lower-case scheme and host."""
    bare = F.regexp_replace(F.regexp_replace(c, r"#.*$", ""), r"/$", "")
    origin = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*", 0)
    return F.concat(F.lower(origin), bare.substr(F.length(origin) + 1, F.length(bare)))


def resolve_url(base: Column, href: Column) -> Column:
    """``href`` seen from page ``base``: absolute, scheme-relative, root-relative, relative, query and fragment
    references, with dot segments removed (RFC 3986, section 5)."""
    step = lambda acc, s: (
        F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s)))
    )

    def without_dots(path):
        kept = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
        closed = F.when(path.rlike(r"(^|/)\.\.?$"), F.concat(kept, F.lit("/"))).otherwise(kept)
        return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.regexp_replace(closed, "^/?", "/")).otherwise(path)

    def relative(b):
        folder = F.regexp_extract(b.path, r"^(.*/)?[^/]*$", 1)
        ref_path = F.regexp_extract(href, r"^[^?#]*", 0)
        # Empty inner segments of a relative reference collapse, those of a root-relative one stay.
        below = F.regexp_replace(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), ref_path), "/{2,}", "/")
        full = F.when(href.startswith("/"), ref_path).otherwise(below)
        tail = F.regexp_extract(href, r"(?s)^[^?#]*(.*)$", 1)
        return F.concat(b.origin, let(full, without_dots), tail)

    def against(b):
        return (
            F.when(href.startswith("//"), F.concat(F.regexp_extract(b.origin, r"^[^/]*", 0), href))
            .when(href.startswith("#"), F.concat(b.origin, b.path, b.query, href))
            .when(href.startswith("?"), F.concat(b.origin, b.path, href))
            .otherwise(relative(b))
        )

    part = lambda g: F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)([^?#]*)(\?[^#]*)?", g)
    parts = F.struct(part(1).alias("origin"), part(2).alias("path"), part(3).alias("query"))
    return (
        F.when(~truthy(href), base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .otherwise(let(parts, against))
    )


def construct_website_url(name: Column, noise=vocab.COUNCIL_NAME_NOISE) -> Column:
    """Likely site of a council from its name; NULL for an empty name."""
    slug = F.lower(name)
    for word in noise:
        slug = F.replace(slug, F.lit(word), F.lit(""))
    return F.when(truthy(name), F.concat(F.lit("https://www."), slug, F.lit(".gov.uk")))


def region_of_source(path: Column, codes=vocab.REGION_CODES) -> Column:
    branch = None
    for code, region in codes:
        hit = path.contains(code)
        branch = F.when(hit, region) if branch is None else branch.when(hit, region)
    return branch.otherwise("Unknown")
