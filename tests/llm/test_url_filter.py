import pytest
from checker import compare

from plotgrid.llm import url_filter as u
from plotgrid.llm.registry import CHECKS, QUERIES


def test_query_matches_sql(spark, duck, sf_dir):
    assert compare(QUERIES["op8_url_filter"](spark, sf_dir), duck, CHECKS["op8_url_filter"]) is None


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    ("http://a.example.org/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("https://EXAMPLE.org/en/17#t", "example.org", "/en/17", "example.org/en/1", "block"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://x.com/FR/", "x.com", "/FR/", None, "allow"),
    ("http://x.com/fr/casino", "x.com", "/fr/casino", "com/fr/", "allow"),
    ("http://x.org?casino", "x.org", "", None, "block"),
    ("http://best-casino.net", "best-casino.net", "", None, "block"),
    ("http://casinos.net/", "casinos.net", "/", None, "allow"),
    ("http://free.net/free/free", "free.net", "/free/free", None, "allow"),
    ("http://FREE.net/cheap", "free.net", "/cheap", None, "block"),
    ("no scheme casino", "", "", None, "block"),
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("://", "", "", None, "allow"),
])
def test_single_urls(spark, url, host, path, rule, verdict):
    row = u.judge_urls(spark.createDataFrame([(1, url, "clash")], "page_id bigint, url string, verdict string")).first()
    assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict)


def test_long_url_repeats_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://x.net/" + "a/" * 50_000 + "xxx")] * 3, "page_id bigint, url string")
    assert [r.verdict for r in u.judge_urls(pages).collect()] == ["block"] * 3
    assert u.judge_urls(pages.where("false")).count() == 0
    assert [r.verdict for r in u.judge_urls(pages, rules=(), strict=(), soft=()).collect()] == ["allow"] * 3


@pytest.mark.parametrize("url,verdict", [
    ("http://shop.net/sale/deals", "allow"), ("http://shop.net/sale/deals?vip=1", "block"),
    ("http://x.net/free/sale", "allow"), ("http://x.net/free/sale/hot", "block"), ("http://x.net/payday-loan", "block"),
    ("http://x.net/hotel/wholesale/vips", "allow"),
])
def test_weights_of_soft_terms(spark, url, verdict):
    assert u.judge_urls(spark.createDataFrame([(1, url)], "page_id bigint, url string")).first().verdict == verdict


def test_vocabulary_from_a_table(spark):
    terms = spark.createDataFrame(
        [("Alpha ", None), ("alpha", 2), ("beta", 2), ("beta", 4), ("gamma", 3), (" ", 9), (None, 1), ("off", 0)],
        "term string, weight int",
    )
    strict, soft = u.vocabulary(terms)
    assert (strict, soft) == (["alpha"], {"beta": 4, "gamma": 3})
    urls = [("http://a.net/ALPHA", "block"), ("http://a.net/beta", "allow"), ("http://a.net/beta/gamma", "block"), ("http://a.net/off/gamma/gamma", "allow")]
    got = u.judge_urls(spark.createDataFrame(urls, "url string, want string"), (), strict, soft)
    assert all(r.verdict == r.want for r in got.collect())
    assert u.vocabulary(terms.filter("false")) == ([], {})
    with pytest.raises(ValueError, match="more than 2"):
        u.vocabulary(terms, most=2)
