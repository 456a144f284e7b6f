import itertools
import math
import random
import re
from collections import Counter

import pytest

from licensum.llm import url_filter
from licensum.llm.queries import QUERIES, URL_RULES

URLS = ["http://A.example.org/en/1x", "https://example.org/es/", "https://x.example.org/es", "http://org", "http://org/", "http://notorg/", "ftp://a.com/de/?q", "http://b.com/fr/#t",
        "nothing", None, "", "://", "http://a.b/x://y/z", "http://bestcasino.net/a", "http://x.net?u=http://casino.net/", "HTTP://ÄB.Com/fr/ü\nx"]


def expected(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(n), n, v) for n, v in URL_RULES for d, _, p in [n.partition("/")] if (host == d or host.endswith("." + d)) and path.startswith("/" + p)]
    return host, path, max(fits)[1:] if fits else (None, None)


def test_query(spark, tmp_path):
    rows = [(i, u, "<p>best casino of the land</p>", 1) for i, u in enumerate(URLS)]
    spark.createDataFrame(rows, "page_id long, url string, html string, host int").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in QUERIES["op4_url_filter"](spark, str(tmp_path)).collect()}
    for i, url in enumerate(URLS):
        host, path, (rule, verdict) = expected(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict in ((verdict,) if rule else ("allow", "block"))
    assert got[13].tokens[:2] == ["h:best", "h:casino"]


def test_names_that_were_not_listed_are_learned(spark, tmp_path):
    rng = random.Random(0)
    good = [f"http://{a}{b}.net/news/{rng.randint(1, 99)}" for a in ("green", "blue") for b in ("garden", "river") for _ in range(30)]
    bad = [f"http://{a}{b}.net/play/{rng.randint(1, 99)}" for a in ("casino", "poker") for b in ("lucky", "jackpot") for _ in range(30)]
    rows = list(enumerate([*good, *bad, "http://luckyjackpot.net/play/1", "http://bluegarden.net/news/5"]))
    text = "green blue garden river lucky jackpot " * 3
    spark.createDataFrame([(i, u, text) for i, u in rows], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.verdict for r in QUERIES["op4_url_filter"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(242)] == ["allow"] * 120 + ["block"] * 120 + ["block", "allow"]


@pytest.mark.parametrize("name", ["thetheater", "casinowin", "aaaa", "x", "bluesky", "xyzblue", "qqqblueqqqsky"])
def test_segments_are_the_cheapest(name):
    s = url_filter.Segmenter({"the": 50, "theater": 5, "casino": 3, "win": 8, "blue": 9, "sky": 4, "a": 20, "at": 10})
    cost = lambda w: s.cost.get(w, s.total + math.log(10) * (len(w) - 1))
    cuts = itertools.chain.from_iterable(itertools.combinations(range(1, len(name)), k) for k in range(len(name)))
    best = min(sum(cost(name[a:b]) for a, b in zip((0, *c), (*c, len(name)), strict=True)) for c in cuts)
    assert math.isclose(sum(map(cost, s.name(name))), best)
    assert "".join(s.name(name)) == name


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert QUERIES["op4_url_filter"](spark, str(tmp_path)).count() == 0


def test_dictionary_is_bounded_by_count(spark):
    df = spark.createDataFrame([("a a a b b c c d",)], "t string")
    got = lambda most: {r.word for r in url_filter.word_counts(df.t, df, most).collect()}
    assert [got(n) for n in (0, 1, 2, 3, 9)] == [set(), {"a"}, {"a"}, {"a", "b", "c"}, {"a", "b", "c", "d"}]


def test_unwanted_words_keep_their_counts(spark, tmp_path):
    """The more text there is, the dearer is a word seen once: with its true count, adult stays whole at every size."""
    urls = ["http://bigcasino.net/a", "http://adult.net/a", "http://good.net/a"]
    text = "casino adult ad ul t big good " * 400 + "ad ul t " * 400 + "of the land " * 4000
    rows = [(i, u, text) for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.tokens for r in QUERIES["op4_url_filter"](spark, str(tmp_path)).collect()}
    assert [got[i][:-2] for i in range(3)] == [["h:big", "h:casino"], ["h:adult"], ["h:good"]]


def test_rare_words_split_names_in_large_dictionaries(spark, tmp_path):
    """Words seen once count too, when there are more of them than a fixed dictionary would hold."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    many = " ".join("q" + "".join(x) for x in itertools.islice(itertools.product(letters, repeat=4), 60_000))
    rows = [(0, "http://xylophonezebra.net/a", f"xylophone zebra {many}"), (1, "http://xylophonezebra.net/b", "the land")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.tokens for r in QUERIES["op4_url_filter"](spark, str(tmp_path)).collect()}
    assert got[0][:2] == got[1][:2] == ["h:xylophone", "h:zebra"]


def test_all_classes_of_unwanted_hosts_are_examples(spark, tmp_path):
    """Unmarked pages that resemble marked ones do not teach class allow."""
    names = ["ads-track", "spam-farm", "cheap-pills", "casino-win", "adult-x"]
    bad = [f"http://{n}{i}.biz/offer/{i}" for n in names for i in range(8)] + [f"http://win-x{i}.biz/offer/{i}" for i in range(8)]
    good = [f"http://garden{i}.net/news/{i}" for i in range(60)]
    rows = [(i, u, "ads track spam farm cheap pills casino win adult bargain garden offer news") for i, u in enumerate([*bad, *good])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.verdict, r.score) for r in QUERIES["op4_url_filter"](spark, str(tmp_path)).collect()}
    assert [got[i][0] for i in range(108)] == ["block"] * 48 + ["allow"] * 60


LONG_WORD = "pneumonoultramicroscopicsilicovolcanoconiosis"


def test_words_and_addresses_of_any_length(spark, tmp_path):
    """Words longer than a piece are found whole, an unknown name is one word, and long addresses are read to their end."""
    urls = [f"http://the{LONG_WORD}casino.net/a", "http://" + "q" * 60 + ".net/", "http://x.net/" + "longpath" * 2_000 + "?q", None, "http://the.net/a", "http://the.net/a"]
    rows = [(i, u, f"the {LONG_WORD} casino net a x long path " * 3) for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in QUERIES["op4_url_filter"](spark, str(tmp_path)).collect()}
    assert got[0].tokens[:3] == ["h:the", f"h:{LONG_WORD}", "h:casino"]
    assert got[1].tokens[0] == "h:" + "q" * 60
    assert got[2].tokens[2:] == ["p:long", "p:path"] * 2_000
    assert got[4][1:] == got[5][1:]


def test_given_pages(spark):
    """Where no rule decides, all six kinds of unwanted hosts are blocked and no other, as a plain naive Bayes says."""
    got = QUERIES["op4_url_filter"](spark, "/root/testdata/sf0.01").collect()
    kinds = ("adult-x", "free-bets", "casino-win", "cheap-pills", "spam-farm", "ads-track")
    free = [r for r in got if r.rule is None]
    bad = [r for r in free if any(k in r.host for k in kinds)]
    assert bad and len(bad) < len(free)
    assert [(r.host, r.verdict) for r in free if (r.verdict == "block") != any(k in r.host for k in kinds)] == []

    # The plain model: exact tokens, the same examples, the same mixture.
    marks = {f"h:{w}" for w in url_filter.UNWANTED}
    marked = [not marks.isdisjoint(r.tokens) for r in got]

    def learn(rows):
        counts = [Counter(t for r, m in rows if m == kind for t in r.tokens) for kind in (False, True)]
        sizes = [max(1, sum(c.values())) for c in counts]
        n = [sum(m == kind for _, m in rows) for kind in (False, True)]
        share = lambda t, k: 0.9 * counts[k][t] / sizes[k] + 0.1 * (counts[0][t] + counts[1][t]) / sum(sizes)
        return lambda r: math.log(n[1] / n[0]) + sum(math.log(share(t, 1) / share(t, 0)) for t in r.tokens if counts[0][t] + counts[1][t])

    first = learn(list(zip(got, marked, strict=True)))
    score = learn([(r, m) for r, m in zip(got, marked, strict=True) if m or first(r) <= 0])
    assert max(abs(r.score - score(r)) for r in got) < 1e-6
