"""Keyword cleaning: filtered table and the counts of each stage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from webloom.operators.filters import keyword_filter, keyword_funnel


@dataclass(frozen=True)
class CleanedKeywords:
    rows: DataFrame
    funnel: DataFrame


def clean_keywords(
    df: DataFrame, column: str, min_words: int | None = None, pattern: str | None = None
) -> CleanedKeywords:
    return CleanedKeywords(
        keyword_filter(df, column, min_words, pattern), keyword_funnel(df, column, min_words, pattern)
    )
