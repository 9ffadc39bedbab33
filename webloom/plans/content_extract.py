"""Content extraction: title, description and main text for a list of URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webloom.functions.html import parse_page
from webloom.functions.text import clean_text
from webloom.functions.urls import ensure_scheme
from webloom.operators.filters import parsable_condition
from webloom.operators.pages import open_graph_columns
from webloom.operators.url_filter import listed_rows
from webloom.session import materialize
from webloom.sources.tables import find_url_column


def content_extract(url_table: DataFrame, snapshot: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per non-blank URL of the list; failed or missing pages have blank content and are not ``found``.

    Only listed pages are read and parsed, each once, before their short results meet the list: a
    filter over the listed URLs decides where the pages lie, and no HTML is shuffled. What the filter
    lets through without need finds no partner in the list.
    """
    column = find_url_column(url_table)
    wanted = url_table.select(*keep, ensure_scheme(F.col(column)).alias("page_url")).filter("page_url <> ''")
    urls = materialize(wanted.select(F.col("page_url").alias("url")).distinct(), "listed-urls")
    listed = listed_rows(snapshot.filter(parsable_condition()), urls)
    parsed = listed.select("url", parse_page(F.col("url"), F.col("html"), head=True, text=True).alias("page"))
    content = parsed.select(
        F.col("url").alias("page_url"), *open_graph_columns(),
        clean_text(F.col("page.main_text")).alias("body_content"), F.col("page.parse_error").isNull().alias("found"),
    )
    names = ("title", "description", "body_content")
    return wanted.join(content, "page_url", "left").select(
        *keep, "page_url", *[F.coalesce(c, F.lit("")).alias(c) for c in names],
        F.coalesce("found", F.lit(False)).alias("found"),
    )


def extract_counts(content: DataFrame) -> DataFrame:
    """Pages that could be fetched and read, blank ones too, and the others."""
    return content.agg(F.count_if(F.col("found")).alias("successful"), F.count_if(~F.col("found")).alias("failed"))
