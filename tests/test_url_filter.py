"""The filter over listed URLs, and what it spares."""

import re

import pytest
from pyspark.sql import functions as F

from test_site import files_read
from webloom.operators import url_filter as uf
from webloom.plans.content_extract import content_extract, extract_counts
from webloom.session import materialize, new_folder


@pytest.fixture(scope="module")
def stored(spark):
    """2,000 pages in eight files, sorted by their number."""
    folder = new_folder(spark, "stored-pages")
    html = "concat('<title>t', id, '</title><main>body ', id, repeat(' x', 200), '</main>') html"
    rows = spark.range(2000).selectExpr(
        "id page_id", "concat('https://s.example/', id) url", html, "200 status", "200 first_status", "'text/html' content_type", "CAST(NULL AS STRING) error")
    rows.repartitionByRange(8, "page_id").sortWithinPartitions("page_id").write.parquet(folder)
    return spark.read.parquet(folder)


def urls_of(spark, numbers):
    return materialize(spark.createDataFrame([(f"https://s.example/{n}",) for n in numbers], "url string"), "urls")


@pytest.mark.parametrize("bits", [1 << 12, 1 << 16])
def test_no_listed_url_is_left_out(spark, stored, bits):
    listed = urls_of(spark, range(0, 2000, 7))
    words = uf.bloom_words(listed, bits)
    held = words.first().words
    assert len(held) == bits // 64 and 0 < sum(bin(w % 2**64).count("1") for w in held) <= 5 * listed.count()
    passed = stored.filter(uf.may_be_listed(F.col("url"), materialize(words, "words").scalar(), bits)).select("page_id")
    got = {r.page_id for r in passed.collect()}
    assert set(range(0, 2000, 7)) <= got and len(got) < (900 if bits == 1 << 12 else 320)


def test_null_and_unlisted_urls(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "url string, n int")
    assert [r.n for r in uf.listed_rows(rows, materialize(spark.createDataFrame([("b",), (None,)], "url string"), "urls")).collect()] == [3]
    assert uf.listed_rows(rows, materialize(spark.createDataFrame([], "url string"), "urls")).count() == 0
    assert uf.bits_for(0) == uf.FEWEST_BITS and uf.bits_for(1000) == 1 << 14 and uf.bits_for(10**12) == uf.MOST_BITS


def test_only_files_with_listed_urls_are_read(spark, stored):
    rows = uf.listed_rows(stored, urls_of(spark, [1001, 1002, 1010, 99_999]))
    assert {r.page_id for r in rows.select("page_id").collect()} >= {1001, 1002, 1010}
    assert files_read(rows)[0] <= 2  # one of pages, one of the filter; the others hold no listed URL
    assert uf.listed_rows(stored, urls_of(spark, [99_999])).count() == 0


def test_lists_beyond_the_filter_give_the_same_rows(spark, stored, monkeypatch):
    listed = urls_of(spark, range(500))
    want = {r.page_id for r in stored.join(listed, "url").collect()}
    monkeypatch.setattr(uf, "MOST_URLS", 10)
    assert {r.page_id for r in uf.listed_rows(stored, listed).collect()} == want
    monkeypatch.undo()
    monkeypatch.setattr(uf, "MOST_FILES", 2)
    assert {r.page_id for r in uf.listed_rows(stored, listed).collect()} >= want


def test_no_exchange_carries_html(spark, stored):
    """A list too long to be broadcast: URLs and results are shuffled, pages are not."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        listed = spark.range(0, 3000, 2).selectExpr("concat('https://s.example/', id) link", "id n")
        content = content_extract(listed, stored, keep=("n",))
        rows = {r.n: r for r in content.collect()}
        assert len(rows) == 1500 and rows[10].title == "t10" and rows[10].found and not rows[2998].found
        assert tuple(extract_counts(content).first()) == (1000, 500)
        plan = content._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan and "SortMergeJoin" in plan
        details = content._jdf.queryExecution().explainString(content._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        exchanged = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", details)
        assert exchanged and not any("html" in columns for columns in exchanged)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
