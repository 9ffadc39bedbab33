"""Links of stored pages: discovery, content links, boilerplate and statuses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from webloom.fixed_values import MIN_SITEWIDE_LINK_SOURCES, NOT_CHECKED, SITEWIDE_LINK_PERCENT
from webloom.functions.html import parse_page
from webloom.functions.urls import has_unwanted_extension, matches_skip


def parse_links(pages: DataFrame, keep: Sequence[str], legacy_rule: bool = False) -> DataFrame:
    """Kept columns plus ``page`` with the link facts. ``(site, url)`` identifies a page."""
    facts = parse_page(F.col("url"), F.col("html"), links=True, legacy_rule=legacy_rule)
    return pages.select(*keep, facts.alias("page"))


def _wanted(link: Column, skip_patterns: Sequence[str]) -> Column:
    """Cheap tests first; mail, phone, script and data links have no target."""
    target = link["target"]
    return (
        ~link["href"].isin("", "#")
        & (target != "")
        & link["internal"]
        & ~has_unwanted_extension(target)
        & ~matches_skip(target, skip_patterns)
    )


def discovered_targets(links: Column, skip_patterns: Sequence[str] = ()) -> Column:
    """Distinct crawlable targets of one page as an array."""
    kept = F.filter(links, lambda l: _wanted(l, skip_patterns))
    return F.array_distinct(F.transform(kept, lambda l: l["target"]))


def _in_content(link: Column) -> Column:
    """Inside the content root of highest priority; without any, behind the first heading."""
    return (
        F.when(F.col("page.has_main"), link["in_main"])
        .when(F.col("page.has_named"), link["in_named"])
        .when(F.col("page.has_article"), link["in_article"])
        .when(F.col("page.has_h1"), link["after_h1"])
        .otherwise(True)
    )


def content_link_array(links: Column, skip_patterns: Sequence[str] = (), legacy_rule: bool = False) -> Column:
    """Distinct destination-and-anchor keys of one page's own content as an array.

    A key is one text, since Spark tells texts apart by hashing but compares structs
    pair by pair. A normalised URL holds no line end, so the first one splits the key.
    """

    def kept(link: Column) -> Column:
        inside = F.lit(True) if legacy_rule else _in_content(link)
        return inside & ~link["excluded"] & _wanted(link, skip_patterns)

    keys = F.transform(F.filter(links, kept), lambda l: F.concat(l["target"], F.lit("\n"), l["anchor"]))
    return F.array_distinct(keys)


def link_key_columns(key: Column) -> list[Column]:
    destination = F.substring_index(key, "\n", 1)
    return [destination.alias("destination"), F.substr(key, F.length(destination) + 2).alias("anchor_text")]


def discover_links(pages: DataFrame, skip_patterns: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Every crawlable internal link of the whole document, menus included."""
    parsed = parse_links(pages, [*keep, "url"])
    targets = discovered_targets(F.col("page.links"), skip_patterns)
    return parsed.select(*keep, F.col("url").alias("source"), F.explode(targets).alias("destination"))


def excluded_links(pages: DataFrame, keep: Sequence[str] = (), legacy_rule: bool = False) -> DataFrame:
    """Links standing in headers, footers, menus, sidebars or overlays."""
    parsed = parse_links(pages, [*keep, "url"], legacy_rule)
    found = F.filter(F.col("page.links"), lambda l: l["excluded"])
    return parsed.select(*keep, F.col("url").alias("source"), F.explode(found).alias("link")).select(
        *keep, "source", F.col("link.href").alias("href"), F.col("link.anchor").alias("anchor_text")
    )


def content_roots(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Which kind of content root a page has, and how many of its links stand in it."""
    parsed = parse_links(pages, [*keep, "url"])
    kind = (
        F.when(F.col("page.has_main"), "main")
        .when(F.col("page.has_named"), "named")
        .when(F.col("page.has_article"), "article")
        .when(F.col("page.has_h1"), "after_h1")
        .otherwise("body")
    )
    inside = F.filter(F.col("page.links"), _in_content)
    return parsed.select(
        *keep, "url", kind.alias("root_kind"),
        F.size("page.links").cast("long").alias("links"), F.size(inside).cast("long").alias("root_links"),
    )


def content_links(
    pages: DataFrame, skip_patterns: Sequence[str] = (), keep: Sequence[str] = (), legacy_rule: bool = False
) -> DataFrame:
    """Internal links of the page content, distinct per page by destination and anchor text.

    A page is one row, so the distinct step stays inside the row and needs no shuffle.
    """
    parsed = parse_links(pages, [*keep, "url"], legacy_rule)
    keys = content_link_array(F.col("page.links"), skip_patterns, legacy_rule)
    return parsed.select(*keep, F.col("url").alias("source"), F.explode(keys).alias("link")).select(
        *keep, "source", *link_key_columns(F.col("link"))
    )


def boilerplate_keys(links: DataFrame, parsed_pages: DataFrame) -> DataFrame:
    """(site, destination, anchor_text) found on most parsed pages of a site.

    ``links`` are distinct per page, so counting rows counts sources, and Spark sums the
    counts before the shuffle. ``parsed_pages`` has ``site`` and ``pages``.
    """
    counted = links.groupBy("site", "destination", "anchor_text").agg(F.count(F.lit(1)).alias("sources"))
    frequent = counted.filter(F.col("sources") >= MIN_SITEWIDE_LINK_SOURCES)
    with_total = frequent.join(parsed_pages, "site")
    # sources >= ceil(pages * 60 %) in whole numbers.
    most = F.col("sources") * 100 >= F.col("pages") * SITEWIDE_LINK_PERCENT
    return with_total.filter((F.col("pages") >= MIN_SITEWIDE_LINK_SOURCES) & most).select(
        "site", "destination", "anchor_text"
    )


def boilerplate_filter(links: DataFrame, parsed_pages: DataFrame) -> DataFrame:
    """Links without those repeated on most pages of their site.

    In this join and in ``link_status`` a destination may hold a large share of the links: Spark
    splits such a partition of the links by its measured size (``spark.sql.adaptive.skewJoin``) and
    reads the other side again for the parts only, so cold keys are sent once.
    """
    keys = boilerplate_keys(links, parsed_pages)
    on = ["site", "destination", "anchor_text"]
    return links.join(keys, on, "left_anti").select(*links.columns)


def link_status(links: DataFrame, statuses: DataFrame) -> DataFrame:
    """Status of each link's destination; ``statuses`` has site, url and status_code, one row per URL."""
    known = statuses.select("site", F.col("url").alias("destination"), "status_code")
    joined = links.join(known, ["site", "destination"], "left")
    return joined.select(*links.columns, F.coalesce("status_code", F.lit(NOT_CHECKED)).alias("status_code"))


def unresolved_links(links: DataFrame, statuses: DataFrame) -> DataFrame:
    """Distinct destinations nobody has fetched: the work list of a status probe."""
    wanted = links.select("site", "destination").distinct()
    known = statuses.select("site", F.col("url").alias("destination"))
    return wanted.join(known, ["site", "destination"], "left_anti")
