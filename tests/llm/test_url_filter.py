import pytest

from salesengine.llm import url_filter
from salesengine.llm.queries import URL_RULES

PAGES = "page_id long, url string, host int, listed string"
URLS = [
    None,
    "",
    "no scheme.com/x",
    "https://A.Example.ORG/es/1?x",
    "http://example.org/en/12#f",
    "http://example.org",
    "http://org/x",
    "http://x.com/de/1",
    "http://x.com/fr/1",
    "http://bad.net/a?b",
    "http://bad.net/a?b",
    "http://good.net/listed/path",
    "http://good.net/other",
    "ftp://" + "h" * 20_000 + "/p",
    "http:///only/path",
    "http://" + "://",
]


def plain(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    host = rest
    for mark in "/?#":
        host = host.split(mark)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return host, path


def expected(url, listed):
    host, path = plain(url)
    fits = [
        r
        for r in URL_RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    best = max(fits, key=lambda r: len(r.text), default=None)
    hit = bool(host) and (host in listed or host + path in listed)
    verdict = best.verdict if best else "block" if hit else "allow"
    return host, path, best and best.text, verdict, hit


@pytest.mark.parametrize("bounds", [(2**24, 2**26), (8, 2**26), (2**24, 0)])
def test_judged_like_plain_python(spark, bounds):
    """With one cascade, with several, and beyond their bound by joins."""
    pages = spark.createDataFrame([(i, u, 7, "clash") for i, u in enumerate(URLS)], PAGES)
    listed = {"bad.net", "good.net/listed/path", "not.there"}
    keys = spark.createDataFrame([(k,) for k in [*listed, "bad.net", None, ""]], "key string")
    out = url_filter.judge(pages, URL_RULES, keys, "url", *bounds).collect()
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict, r.listed) for r in out)
    assert got == [(i, *expected(u, listed)) for i, u in enumerate(URLS)]


@pytest.mark.parametrize("most, parts", [(2**24, 1), (1_500, 4)])
def test_exact_for_every_key(spark, most, parts):
    universe = spark.range(30_000).selectExpr(
        "concat('host', id) AS key", "id % 7 = 0 AS listed"
    )
    cascades = url_filter.build_cascades(universe, most)
    assert len(cascades.parts) >= parts
    for cascade in cascades.parts:
        assert len(cascade.levels) > 1
        assert all(level.bits <= 8 * most for level in cascade.levels)
    wrong = universe.where(cascades.contains(universe.key) != universe.listed)
    assert wrong.count() == 0


def test_bounds(spark):
    """Filters of 10 and 50 million listed keys among a billion; a longer list has none."""
    def parts(count):
        return url_filter._parts(count, 10**9, 1 / 64, url_filter.MAX_FILTER_BYTES, url_filter.MAX_TOTAL_BYTES)

    assert parts(1_000_000) == 1
    assert 1 < parts(20_000_000) <= 4
    assert parts(200_000_000) == 0


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    keys = spark.createDataFrame([], "key string")
    assert url_filter.judge(pages, URL_RULES, keys).collect() == []
    some = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filter.judge(some, URL_RULES, keys).first().verdict == "allow"


def test_longest_rule_wins(spark):
    rules = [
        url_filter.Rule("block", "b.net", "/"),
        url_filter.Rule("allow", "a.b.net", "/"),
        url_filter.Rule("block", "a.b.net", "/x/"),
    ]
    urls = ["http://b.net/", "http://a.b.net/", "http://z.a.b.net/x/1", "http://ab.net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "key string")
    out = {r.page_id: r.verdict for r in url_filter.judge(pages, rules, none).collect()}
    assert out == {0: "block", 1: "allow", 2: "block", 3: "allow"}
