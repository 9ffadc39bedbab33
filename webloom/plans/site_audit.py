"""Site audit: walk each site, describe its pages, report its content links."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from webloom.fixed_values import NOT_CHECKED
from webloom.functions.html import parse_page
from webloom.functions.urls import normalize_url
from webloom.operators.crawl import crawl_bfs
from webloom.operators.filters import is_parsable
from webloom.operators.links import (
    boilerplate_filter, content_link_array, discovered_targets, link_key_columns, link_status,
)
from webloom.operators.pages import META_COLUMNS, metadata_columns
from webloom.session import materialize


@dataclass(frozen=True)
class SiteAudit:
    visited: DataFrame
    pages: DataFrame
    links: DataFrame


def parse_snapshot(snapshot: DataFrame, skip_patterns: Sequence[str] = (), legacy_rule: bool = False) -> DataFrame:
    """Everything the audit needs of each stored page, without its HTML.

    Only parsable pages reach the parser; the others keep their status and blank
    metadata, so one table holds every page and no union is needed later.
    """
    parsable = is_parsable()
    page = parse_page(F.col("url"), F.when(parsable, F.col("html")), head=True, links=True, legacy_rule=legacy_rule)
    pages = snapshot.select("site", "url", "error", "first_status", parsable.alias("parsable"), page.alias("page"))
    failure = F.coalesce(F.col("error"), F.col("page.parse_error"))
    status = F.when(failure.isNotNull(), F.concat(F.lit("Error: "), failure)).otherwise(F.col("first_status").cast("string"))
    readable = F.col("parsable") & F.col("page.parse_error").isNull()
    parsed = pages.select("site", "url", readable.alias("parsed"), status.alias("status_code"), "page")
    links = F.col("page.links")
    return parsed.select(
        "site", "url", "parsed", "status_code", *metadata_columns(),
        F.coalesce(discovered_targets(links, skip_patterns), F.array().cast("array<string>")).alias("targets"),
        F.coalesce(
            content_link_array(links, skip_patterns, legacy_rule), F.array().cast("array<string>")
        ).alias("content_links"),
    )


def site_audit(snapshot: DataFrame, starts: DataFrame, skip_patterns: Sequence[str] = ()) -> SiteAudit:
    """``snapshot``: one row per (site, url); ``starts``: site, start_url.

    The snapshot is parsed once and written to the shared folder for the walk. The pages
    it reached are joined once and written, too; every report reads that table.
    """
    parsed = materialize(parse_snapshot(snapshot, skip_patterns), "parsed-pages")
    start = starts.select("site", normalize_url(F.col("start_url")).alias("url"))
    adjacency = parsed.filter("parsed").select("site", "url", "targets")
    visited = crawl_bfs(start, adjacency)
    rows = materialize(visited.join(parsed.drop("targets"), ["site", "url"], "left"), "visited-pages")
    return SiteAudit(visited, crawl_report(rows), audit_links(rows))


def crawl_report(rows: DataFrame) -> DataFrame:
    """One row per visited URL; blank metadata where there is no parsed page."""
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in META_COLUMNS]
    return rows.select(
        "site", "url", *blank, F.coalesce("status_code", F.lit(NOT_CHECKED)).alias("status_code"), "depth"
    )


def audit_links(rows: DataFrame) -> DataFrame:
    """Content links of the parsed pages, without sitewide ones, with their destination's status."""
    links = rows.filter("parsed").select(
        "site", F.col("url").alias("source"), F.explode("content_links").alias("_link")
    ).select("site", "source", *link_key_columns(F.col("_link")))
    totals = rows.filter("parsed").groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    statuses = rows.filter(F.col("status_code").isNotNull()).select("site", "url", "status_code")
    return link_status(boilerplate_filter(links, totals), statuses)
