"""Page facts to page records: metadata, main text and robots directives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webloom.functions.html import parse_page
from webloom.functions.text import clean_text, collapse_ws, strip

META_COLUMNS = ("title", "description", "canonical", "meta_robots", "h1")


def _first(items: Column, condition, field: str) -> Column:
    """Field of the first array element for which the condition holds; null without one."""
    return F.get(F.filter(items, condition), 0)[field]


def _meta(name: str, key: str = "name", exact: bool = False) -> Column:
    def named(meta: Column) -> Column:
        found = meta[key] if exact else F.lower(meta[key])
        return F.coalesce(found == name, F.lit(False))

    return _first(F.col("page.metas"), named, "content")


def _text(col: Column) -> Column:
    return F.coalesce(strip(col), F.lit(""))


def metadata_columns() -> list[Column]:
    """Page metadata, empty text where the page has none. Needs ``page`` with head facts."""
    canonical = _first(
        F.col("page.rel_links"), lambda l: F.coalesce(F.contains(l["rel"], F.lit("canonical")), F.lit(False)), "href"
    )
    return [
        F.coalesce(collapse_ws(F.col("page.title")), F.lit("")).alias("title"),
        _text(_meta("description")).alias("description"),
        _text(canonical).alias("canonical"),
        _text(_meta("robots")).alias("meta_robots"),
        F.coalesce(collapse_ws(F.col("page.h1")), F.lit("")).alias("h1"),
    ]


def metadata_columns_exact() -> list[Column]:
    """The oldest rule: names match case-sensitively, ``rel`` as a whole word, texts are only stripped."""
    canonical = _first(
        F.col("page.rel_links"),
        lambda l: F.coalesce(F.array_contains(F.split(l["rel"], r"\s+"), "canonical"), F.lit(False)),
        "href",
    )
    return [
        _text(F.col("page.title")).alias("title"),
        _text(_meta("description", exact=True)).alias("description"),
        _text(canonical).alias("canonical"),
        _text(_meta("robots", exact=True)).alias("meta_robots"),
        _text(strip(F.col("page.h1_raw"))).alias("h1"),
    ]


def open_graph_columns() -> list[Column]:
    """Title and description where Open Graph wins for the title and stands in for the description."""
    og_title = _meta("og:title", "property", exact=True)
    og_description = _meta("og:description", "property", exact=True)

    def given(col: Column) -> Column:
        return F.when(col != "", col)

    return [
        clean_text(F.coalesce(given(og_title), F.col("page.title"))).alias("title"),
        clean_text(F.coalesce(given(_meta("description")), og_description)).alias("description"),
    ]


def page_metadata(pages: DataFrame, keep: tuple[str, ...], exact: bool = False) -> DataFrame:
    parsed = pages.select(*keep, parse_page(F.col("url"), F.col("html"), head=True).alias("page"))
    return parsed.select(*keep, *(metadata_columns_exact() if exact else metadata_columns()))


def page_metadata_og(pages: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    parsed = pages.select(*keep, parse_page(F.col("url"), F.col("html"), head=True).alias("page"))
    return parsed.select(*keep, *open_graph_columns())


def main_text(pages: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    parsed = pages.select(*keep, parse_page(F.col("url"), F.col("html"), text=True).alias("page"))
    return parsed.select(*keep, clean_text(F.col("page.main_text")).alias("body_content"))


def robots_directives(pages: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """First robots and first googlebot directive in lower case, empty text when absent."""
    parsed = pages.select(*keep, parse_page(F.col("url"), F.col("html"), head=True).alias("page"))
    return parsed.select(*keep, *robots_columns())


def robots_columns() -> list[Column]:
    return [
        F.coalesce(F.lower(_meta("robots")), F.lit("")).alias("live_meta_robots"),
        F.coalesce(F.lower(_meta("googlebot")), F.lit("")).alias("live_meta_googlebot"),
    ]
