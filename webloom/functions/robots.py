"""Robots directives, HTML responses and the final verdict on a URL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_html(content_type: Column) -> Column:
    return F.coalesce(F.contains(F.lower(content_type), F.lit("html")), F.lit(False))


def robots_text(meta_robots: Column, meta_googlebot: Column, x_robots_tag: Column) -> Column:
    parts = [F.coalesce(F.lower(c), F.lit("")) for c in (meta_robots, meta_googlebot, x_robots_tag)]
    return F.concat_ws(" ", *parts)


def has_noindex(text: Column) -> Column:
    return F.contains(text, F.lit("noindex"))


def has_nofollow(text: Column) -> Column:
    return F.contains(text, F.lit("nofollow"))


def final_status() -> Column:
    """First failing check of an inspection row joined with its live check."""

    def given(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) != ""

    return (
        F.when(given("gsc_error"), "GSC_API_ERROR")
        .when(given("live_error"), "LIVE_CHECK_ERROR")
        .when(~F.col("live_http_status").eqNullSafe(200), "URL_NOT_AVAILABLE_LIVE")
        .when(F.col("live_noindex"), "NOINDEX_LIVE")
        .when(F.col("robots_txt_state") == "DISALLOWED", "BLOCKED_BY_ROBOTS_TXT_GSC")
        .when(F.col("page_fetch_state") != "SUCCESSFUL", "PAGE_FETCH_PROBLEM_GSC")
        .when(~F.col("gsc_verdict").eqNullSafe("PASS"), "GSC_INDEXING_ISSUE")
        .otherwise("OK")
    )
