"""Text, date, array and map cleaning as Column expressions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from licensum import vocab

# Unicode whitespace, and the separators U+001C..U+001F: as a list for trimming and as a pattern. The pattern spells the
# characters out, which Java matches faster than its Unicode class.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def truthy(c: Column) -> Column:
    """True for a string that is neither NULL nor empty."""
    return F.coalesce(F.length(c) > 0, F.lit(False))


def filled(c: Column) -> Column:
    """True for an array or map that is neither NULL nor empty."""
    return F.coalesce(F.size(c) > 0, F.lit(False))


def count_of(c: Column) -> Column:
    """Number of elements, 0 for NULL."""
    return F.when(c.isNotNull(), F.size(c)).otherwise(F.lit(0))


def let(c: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` mentions it.

    Inside higher-order functions Spark does not share common subexpressions, so the value is bound to a variable.
    """
    return F.get(F.transform(F.array(c), lambda x: body(x)), F.lit(0))


def contains_any(c: Column, words) -> Column:
    """True when any of the words is a substring."""
    return let(c, lambda x: reduce(lambda a, b: a | b, [x.contains(w) for w in words]))


def first_contained(c: Column, phrases, otherwise=None) -> Column:
    """The value of the first (phrase, value) pair whose phrase is a substring of ``c``."""

    def cascade(x):
        (phrase, value), *others = phrases
        branch = F.when(x.contains(phrase), F.lit(value))
        for phrase, value in others:
            branch = branch.when(x.contains(phrase), F.lit(value))
        return branch if otherwise is None else branch.otherwise(F.lit(otherwise))

    return let(c, cascade)


def strip(c: Column) -> Column:
    """Trim Unicode whitespace on both sides."""
    return F.trim(c, F.lit(WS_CHARS))


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest (``o'neil`` -> ``O'Neil``)."""

    def titled(run):
        # A letter whose capital is spelled with two letters keeps only the first one large.
        first = F.upper(F.substring(run, 1, 1))
        return F.concat(F.substring(first, 1, 1), F.lower(F.substring(first, 2, 9)), F.lower(F.substring(run, 2, 2**31 - 1)))

    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, titled), "")


def clean_text(c: Column, entities=vocab.CLEANER_ENTITIES) -> Column:
    """Collapse whitespace, then decode the listed entities in order, drop control characters, trim."""
    x = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WS + "+", " "))
    for entity, char in entities:
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))


def clean_address(c: Column, abbreviations=vocab.ADDRESS_ABBREVIATIONS) -> Column:
    def expanded(x):
        for short, full in abbreviations:
            x = F.regexp_replace(x, rf"(?iU)\b{short}\b", full)
        return x

    # Most addresses hold no abbreviation; one look decides whether the nine replacements run.
    any_short = rf"(?iU)\b(?:{'|'.join(short for short, _ in abbreviations)})\b"
    return let(clean_text(c), lambda x: F.when(x.rlike(any_short), expanded(x)).otherwise(x))


def extract_postcode(c: Column, pattern=vocab.POSTCODE_PATTERN) -> Column:
    """Leftmost postcode of an address, spaced before its last three characters; NULL when there is none."""
    spaced = lambda x: F.when(
        F.length(x) > 0, F.concat(x.substr(F.lit(1), F.length(x) - 3), F.lit(" "), F.right(x, F.lit(3)))
    )
    return let(F.replace(F.regexp_extract(F.upper(c), "(?U)" + pattern, 0), F.lit(" "), F.lit("")), spaced)


def clean_person_name(c: Column, titles=vocab.NAME_TITLES, suffixes=vocab.NAME_SUFFIXES) -> Column:
    drop = [*titles, *suffixes, ""]
    words = F.split(clean_text(c), " +")
    kept = F.filter(words, lambda w: (w != "") & ~F.regexp_replace(F.lower(w), r"[.,]+$", "").isin(drop[:-1]))
    return title_case(F.array_join(kept, " "))


def clean_activities(c: Column, names=vocab.ACTIVITY_NAMES, min_length=6) -> Column:
    """Map activities to standard names.

    Standard names are kept once each, in order of first appearance; other activities of at least ``min_length``
    characters are title-cased and kept every time.
    """

    def tag(low):
        std = first_contained(low, names)
        tagged = lambda v: F.struct(
            v.isNotNull().alias("std"),
            F.coalesce(v, F.when(F.length(low) >= min_length, title_case(low))).alias("value"),
        )
        return let(std, tagged)

    def keep_first(tagged):
        values = F.transform(tagged, lambda t: t.value)
        first = lambda e, i: ~e.std | (F.array_position(values, e.value) == i + 1)
        return F.transform(F.filter(tagged, first), lambda e: e.value)

    lowered = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda a: F.lower(clean_text(a)))
    return let(F.filter(F.transform(lowered, tag), lambda e: e.value.isNotNull()), keep_first)


def clean_conditions(c: Column, min_length=11) -> Column:
    cleaned = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: clean_text(x))
    return F.filter(cleaned, lambda x: F.length(x) >= min_length)


def standardize_hours(c: Column, days=vocab.DAY_NAMES) -> Column:
    """Standard day names and cleaned hours; on colliding days the last value wins at the first position."""
    lookup = F.create_map(*[F.lit(x) for pair in days.items() for x in pair])

    def entry(e):
        day = F.coalesce(F.try_element_at(lookup, F.lower(strip(e.key))), title_case(e.key))
        return F.struct(day.alias("k"), clean_text(e.value).alias("v"))

    def last_wins(entries):
        last = lambda k: F.element_at(F.filter(entries, lambda e: e.k == k), -1).v
        return let(
            F.array_distinct(F.transform(entries, lambda e: e.k)),
            lambda keys: F.map_from_arrays(keys, F.transform(keys, last)),
        )

    entries = F.transform(F.filter(F.map_entries(c), lambda e: truthy(e.value)), entry)
    return F.when(filled(c), let(entries, last_wins)).otherwise(c)


def normalize_for_matching(c: Column, noise=vocab.MATCH_NOISE) -> Column:
    x = F.lower(F.coalesce(c, F.lit("")))
    for word in noise:
        x = F.replace(x, F.lit(word), F.lit(""))
    x = F.regexp_replace(x, r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]", "")
    return F.trim(F.regexp_replace(x, WS + "+", " "))


def postcode_area(c: Column) -> Column:
    """Outward part of a postcode, or its first three characters when it has no space; NULL when empty."""
    outward = lambda x: F.when(x.contains(" "), F.split_part(F.ltrim(x), F.lit(" "), F.lit(1))).otherwise(F.substring(x, 1, 3))
    return let(c, lambda x: F.when(truthy(x), outward(x)))


def effective_date(granted: Column, applied: Column, scraped: Column = None) -> Column:
    """Granted, else application, else (three-argument form) scrape date."""
    return F.coalesce(granted, applied) if scraped is None else F.coalesce(granted, applied, scraped)


def as_ntz(as_of) -> Column:
    """A date, datetime, text or Column as timestamp without time zone; a datetime keeps its clock time."""
    return (as_of if isinstance(as_of, Column) else F.lit(str(as_of))).cast("timestamp_ntz")


def week_start(as_of) -> Column:
    """Monday 00:00 of the week of ``as_of``."""
    day = as_ntz(as_of).cast("date")
    return F.date_sub(day, F.weekday(day)).cast("timestamp_ntz")


def week_end(as_of) -> Column:
    return week_start(as_of) + F.expr("INTERVAL 7 DAYS")


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from one zoneless timestamp to another; no session time zone is involved."""
    gap = end - start
    part = lambda unit: F.extract(F.lit(unit), gap)
    return ((part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")) * 60 + part("SECOND").cast("double")


def whole_days_between(start: Column, end: Column) -> Column:
    return F.extract(F.lit("DAY"), end - start).cast("bigint")


def map_licence_type(c: Column, phrases=vocab.LICENCE_TYPE_PHRASES) -> Column:
    return first_contained(F.lower(F.coalesce(c, F.lit(""))), phrases, "new")


def map_licence_status(c: Column, phrases=vocab.LICENCE_STATUS_PHRASES) -> Column:
    return first_contained(F.lower(F.coalesce(c, F.lit(""))), phrases, "pending")


# shape of the text, Spark date pattern
_DATE_SHAPES = [
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-yyyy"),
    (r"^[0-9]{1,2} [A-Za-z]+ [0-9]{4}$", "d MMMM yyyy"),
    (r"^[0-9]{1,2} [A-Za-z]+ [0-9]{4}$", "d MMM yyyy"),
    (r"^[A-Za-z]+ [0-9]{1,2}, [0-9]{4}$", "MMMM d, yyyy"),
    (r"^[A-Za-z]+ [0-9]{1,2}, [0-9]{4}$", "MMM d, yyyy"),
]


def parse_date(c: Column) -> Column:
    """First of seven spellings that fits the whole text, as midnight of that day; NULL otherwise."""
    first_fit = lambda x: F.coalesce(*[F.when(x.rlike(shape), F.try_to_date(x, fmt)) for shape, fmt in _DATE_SHAPES])
    return let(F.trim(F.regexp_replace(c, WS + "+", " ")), first_fit).cast("timestamp_ntz")


def iso_text(c: Column) -> Column:
    """ISO-8601 text of a timestamp, with microseconds only when there are any; NULL becomes empty."""
    micros = F.date_format(c, "SSSSSS")
    text = F.concat(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise("")
    )
    return F.coalesce(text, F.lit(""))


def day_text(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))


def truncate(c: Column, limit=8000, marker="...") -> Column:
    """Texts longer than ``limit`` are cut there and marked; ``marker=''`` is a hard cut."""
    cut = F.substring(c, 1, limit)
    return F.when(F.length(c) > limit, F.concat(cut, F.lit(marker)) if marker else cut).otherwise(c)


def surrogate_id(*parts: Column) -> Column:
    """Stable id of a row: SHA-256 of its identifying texts."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)
