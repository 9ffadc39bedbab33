"""Row filters over URL, keyword and title tables, with their counts and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webloom.functions.robots import is_html
from webloom.functions.text import bound, contains_ci, normalize_persian, regex_search_ci, strip, words_in
from webloom.sources.tables import require_column


def clean_rows(df: DataFrame, column: str, literal: str) -> DataFrame:
    """Rows whose column does not contain the literal; null rows stay."""
    require_column(df, column)
    return df.filter(~contains_ci(F.col(column), literal))


def clean_counts(df: DataFrame, column: str, literal: str) -> DataFrame:
    require_column(df, column)
    hit = contains_ci(F.col(column), literal)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(hit).alias("removed"),
        F.count_if(~hit).alias("kept"),
    )


def removed_examples(df: DataFrame, column: str, literal: str, order: str, count: int = 5) -> DataFrame:
    """The first few removed values in input order."""
    require_column(df, column)
    hits = df.filter(contains_ci(F.col(column), literal))
    return hits.orderBy(order).limit(count).select(order, column)


def _stages_passed(column: str, min_words: int | None, pattern: str | None) -> Column:
    """How many of the filter's stages a keyword passes in turn; it is normalised once for all."""

    def passed(text: Column) -> Column:
        conditions = []
        if min_words is not None:
            conditions.append(words_in(text) >= min_words)
        if pattern:
            conditions.append(regex_search_ci(text, pattern))
        stages = F.lit(0)
        for condition in reversed(conditions):
            stages = F.when(condition, stages + 1).otherwise(0)
        return stages

    return bound(normalize_persian(F.col(column)), passed)


def _stage_names(min_words: int | None, pattern: str | None) -> list[str]:
    return (["after_words"] if min_words is not None else []) + (["after_pattern"] if pattern else [])


def keyword_filter(
    df: DataFrame, column: str, min_words: int | None = None, pattern: str | None = None
) -> DataFrame:
    """Keep keywords with enough words and a pattern match; columns and values stay as they are."""
    require_column(df, column)
    stages = len(_stage_names(min_words, pattern))
    return df.filter(_stages_passed(column, min_words, pattern) == stages) if stages else df


def keyword_funnel(
    df: DataFrame, column: str, min_words: int | None = None, pattern: str | None = None
) -> DataFrame:
    """Rows left after each stage of the keyword filter, counted in one pass."""
    require_column(df, column)
    names = _stage_names(min_words, pattern)
    passed = df.select(_stages_passed(column, min_words, pattern).alias("_stages"))
    counts = [F.count_if(F.col("_stages") >= stage).alias(name) for stage, name in enumerate(names, 1)]
    return passed.agg(F.count(F.lit(1)).alias("loaded"), *counts, F.count_if(F.col("_stages") >= len(names)).alias("saved"))


def non_blank(df: DataFrame, column: str) -> DataFrame:
    """Rows with something left after stripping; the column comes back stripped, nulls are dropped."""
    require_column(df, column)
    return df.withColumn(column, strip(F.col(column))).filter(F.col(column) != "")


def parsable_condition() -> Column:
    """A fetched page whose final response was 200 with HTML; null counts as no in a filter, and reaches the scan."""
    return F.col("error").isNull() & (F.col("status") == 200) & is_html(F.col("content_type"))


def is_parsable() -> Column:
    return F.coalesce(parsable_condition(), F.lit(False))


def parsable_pages(df: DataFrame) -> DataFrame:
    return df.filter(parsable_condition())
