"""Incremental processing state: what is pending, upserts and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def pending_files(files: DataFrame, state: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Files without a state row of the same path and fingerprint."""
    done = state.filter(F.col("processing_status") != "Failed") if retry_failed else state
    return files.join(done.select("path", "fingerprint"), ["path", "fingerprint"], "left_anti")


def state_upsert(state: DataFrame, updates: DataFrame, version: str = "updated_at") -> DataFrame:
    """Newest row per path over both tables, found by a map-side combinable aggregate."""
    columns = state.columns
    rows = state.unionByName(updates.select(*columns))
    rest = [c for c in columns if c not in ("path", version)]
    newest = rows.groupBy("path").agg(F.max(F.struct(version, *rest)).alias("row"))
    return newest.select(*[F.col(c) if c == "path" else F.col(f"row.{c}").alias(c) for c in columns])


def class_counts(report: DataFrame) -> DataFrame:
    """Clips per outcome. A failed clip counts only as Failed, one already processed as Skipped."""
    outcome = F.when(F.col("processing_status") == "Failed", "Failed").when(
        F.col("processing_status") == "Skipped", "Skipped"
    ).otherwise(F.col("classification"))
    return report.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("clips"))
