"""Index inspection: stored responses and live checks to one verdict per input URL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from webloom.operators.inspection import inspection_flatten, inspection_report, live_checks


def inspect_urls(responses: DataFrame, fetched: DataFrame) -> DataFrame:
    return inspection_report(inspection_flatten(responses), live_checks(fetched))
