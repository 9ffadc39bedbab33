from urllib.parse import urljoin, urlparse, urlunparse

import pytest
from hypothesis import HealthCheck, Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from webloom.fixed_values import UNWANTED_EXTENSIONS
from webloom.functions import urls as ur

PARTS = st.sampled_from([
    "http:", "https:", "HTTP:", "ftp:", "mailto:", "//", "/", "/", "/x-1", "a.Example", "b_c.example:8080", "ü.example", "p", "P.PDF",
    ".css", ".tar.gz", ";", ";x=1", "?", "?q=A", "#", "#f", " ", "\t", "\n", "\x01", " ", "..", ".", "@", "%20",
])
URLS = st.lists(st.lists(PARTS, max_size=8).map("".join), min_size=250, max_size=300)
BATCH = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck), phases=[Phase.generate])


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def normal(url):
    p = urlparse(url.strip())
    if p.scheme not in ("http", "https"):
        return ""
    return urlunparse((p.scheme, p.netloc.lower(), p.path or "/", p.params, p.query, ""))


def check(inputs, got, want):
    assert [(i, g, w) for i, g, w in zip(inputs, got, want, strict=True) if g != w] == []


@BATCH
@given(URLS)
def test_normalize_follows_url_parser(spark, urls):
    check(urls, values(spark, urls, ur.normalize_url(F.col("t"))), [normal(u) for u in urls])


@BATCH
@given(URLS)
def test_host_extension_and_scheme_follow_url_parser(spark, urls):
    check(urls, values(spark, urls, ur.authority(F.col("t"))), [urlparse(u).netloc.lower() for u in urls])
    web = [u for u in urls if urlparse(u).scheme != "mailto"]  # mail addresses have no parameters
    check(web, values(spark, web, ur.has_unwanted_extension(F.col("t"))), [
        urlparse(u).path.lower().endswith(UNWANTED_EXTENSIONS) for u in web])
    check(urls, values(spark, urls, ur.ensure_scheme(F.col("t"))), [
        u.strip() if not u.strip() or urlparse(u.strip()).scheme else "https://" + u.strip() for u in urls])


def test_parameters_of_schemes_without_any(spark):
    urls = ["pp.https:;x=1.tar.gz", "p.pdfhttp:.tar.gz;x=1", "a:/;.css", "http:/a.css;x", "http:/a;x.css", "tel:1.pdf;x", ".css;x", "x;y.css", "MAILTO:a.css;b"]
    check(urls, values(spark, urls, ur.has_unwanted_extension(F.col("t"))), [urlparse(u).path.lower().endswith(UNWANTED_EXTENSIONS) for u in urls])


@BATCH
@given(URLS)
def test_resolve_follows_url_parser(spark, hrefs):
    for base in ("https://H.example/a/b?c", "http://h.example", "mailto:x", ""):
        got = values(spark, hrefs, ur.resolve_url(F.lit(base), F.col("t")))
        check(hrefs, got, [normal(urljoin(base, h)) for h in hrefs])


def test_bad_urls_are_not_followed(spark):
    assert values(spark, ["http://[bad", None], ur.resolve_url(F.lit("https://h.example/"), F.col("t"))) == ["", None]
    assert values(spark, [None], ur.normalize_url(F.col("t"))) == [""]


@pytest.mark.parametrize("url, expected", [
    ("example.com", "https://example.com"), (" a.b/c ", "https://a.b/c"), ("example.com:8080/x", "example.com:8080/x"),
    ("ftp://x", "ftp://x"), ("  ", ""), (None, ""),
])
def test_ensure_scheme(spark, url, expected):
    assert values(spark, [url], ur.ensure_scheme(F.col("t"))) == [expected]


def test_ensure_http_minds_case(spark):
    assert values(spark, ["http://x", "HTTP://x", "x"], ur.ensure_http(F.col("t"))) == [
        "http://x", "https://HTTP://x", "https://x"]


def test_skip_patterns(spark):
    patterns = ur.parse_skip_patterns(" login ,?,*, ^https://b ,")
    assert patterns == ["login", "?", "*", "^https://b"]
    urls = ["https://a/login", "https://a/?x", "https://a/*", "https://b/", "https://a/b"]
    assert values(spark, urls, ur.matches_skip(F.col("t"), patterns)) == [True, True, True, True, False]
    assert values(spark, urls, ur.matches_skip(F.col("t"), [])) == [False] * 5
    odd = ["https://h/ÄB", "https://h/(?P<a>abc)", "https://h/abc", "https://h/خبر"]
    assert values(spark, odd, ur.matches_skip(F.col("t"), [r"/\p{Lu}+$", "(?P<a>abc)"])) == [True, True, False, False]
    assert values(spark, odd, ur.matches_skip(F.col("t"), [r"/\w+$"])) == [True, False, True, True]


def test_navigable(spark):
    hrefs = ["", " ", "#", " # ", "#x", "MAILTO:a", "tel:1", "javascript:;", "data:x", "/a", "maps:x", None]
    assert values(spark, hrefs, ur.is_navigable_href(F.col("t"))) == [
        False, False, False, False, True, False, False, False, False, True, True, False]
