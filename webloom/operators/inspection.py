"""Index-inspection responses, live checks and their combined report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webloom.functions.html import parse_page
from webloom.functions.robots import final_status, has_nofollow, has_noindex, robots_text
from webloom.operators.pages import robots_columns
from webloom.schemas import INSPECTION_JSON


def inspection_flatten(responses: DataFrame) -> DataFrame:
    """One column per inspection field; a failed call has verdict ``ERROR`` and its error text."""
    parsed = responses.withColumn("_r", F.from_json("response_json", INSPECTION_JSON)["inspectionResult"])
    failed = F.col("api_error").isNotNull()
    status = F.col("_r.indexStatusResult")

    def unless_failed(field, name):
        return F.when(~failed, field).alias(name)

    return parsed.select(
        "row_id", "url",
        F.when(failed, "ERROR").otherwise(status["verdict"]).alias("gsc_verdict"),
        unless_failed(status["coverageState"], "coverage_state"),
        unless_failed(status["indexingState"], "indexing_state"),
        unless_failed(status["lastCrawlTime"], "last_crawl_time"),
        unless_failed(status["pageFetchState"], "page_fetch_state"),
        unless_failed(status["robotsTxtState"], "robots_txt_state"),
        unless_failed(status["crawledAs"], "crawled_as"),
        unless_failed(status["googleCanonical"], "google_canonical"),
        unless_failed(status["userCanonical"], "user_canonical"),
        unless_failed(F.col("_r.inspectionResultLink"), "inspection_link"),
        F.col("api_error").alias("gsc_error"),
    )


def inspection_flatten_short(responses: DataFrame) -> DataFrame:
    """The older, shorter record: a missing verdict counts as ``ERROR``."""
    flat = inspection_flatten(responses)
    return flat.select(
        "row_id", "url", F.coalesce("gsc_verdict", F.lit("ERROR")).alias("status"),
        "coverage_state", "last_crawl_time", "page_fetch_state", "robots_txt_state",
        F.col("gsc_error").alias("error"),
    )


def live_checks(fetched: DataFrame) -> DataFrame:
    """Robots directives and availability of fetched pages.

    ``fetched`` has ``row_id, final_url, status, html, x_robots_tag, error``. A failed
    fetch is unavailable, with nothing else known; so is a page that cannot be read.
    """
    ok = F.col("error").isNull()
    page = parse_page(F.col("final_url"), F.when(ok, F.coalesce("html", F.lit(""))), head=True)
    parsed = fetched.select(
        "row_id", "status", "final_url", "error", F.lower("x_robots_tag").alias("_header"), page.alias("page")
    ).select(
        "row_id", "status", "final_url", F.coalesce("error", "page.parse_error").alias("error"), "_header", *robots_columns()
    )
    text = robots_text(F.col("live_meta_robots"), F.col("live_meta_googlebot"), F.col("_header"))

    def if_fetched(col, name):
        return F.when(ok, col).alias(name)

    return parsed.withColumn("_text", text).select(
        "row_id",
        if_fetched(F.col("status"), "live_http_status"),
        if_fetched(F.col("final_url"), "live_final_url"),
        (ok & F.col("status").eqNullSafe(200) & ~has_noindex(F.col("_text"))).alias("live_available"),
        if_fetched(has_noindex(F.col("_text")), "live_noindex"),
        if_fetched(has_nofollow(F.col("_text")), "live_nofollow"),
        if_fetched(F.col("live_meta_robots"), "live_meta_robots"),
        if_fetched(F.col("live_meta_googlebot"), "live_meta_googlebot"),
        if_fetched(F.coalesce("_header", F.lit("")), "live_x_robots_tag"),
        F.col("error").alias("live_error"),
    )


def inspection_report(inspections: DataFrame, live: DataFrame) -> DataFrame:
    """Both records of each input row side by side, with one verdict.

    Joined on the input row, so a URL listed twice is reported twice.
    """
    return inspections.join(live, "row_id").withColumn("final_status", final_status())
