"""Attempts of a crawl in order: redirect chains, block streaks and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webloom.fixed_values import (
    BACKOFF_BASE_SECONDS, BACKOFF_MAX_SECONDS, BLOCK_STATUSES, MAX_CONSECUTIVE_BLOCKS,
    MAX_RETRIES_PER_URL, RETRY_STATUSES,
)
from webloom.operators.split_windows import PIECE_ROWS, Running, row_numbers, running
from webloom.session import materialize


def redirect_status(hops: DataFrame, keys: tuple[str, ...] = ("site_id", "url")) -> DataFrame:
    """Status of the first and of the last hop of each redirect chain."""
    return hops.groupBy(*keys).agg(
        F.min_by("status", "hop").alias("first_status"), F.max_by("status", "hop").alias("final_status")
    )


def block_streaks(log: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Length of the running streak of blocked attempts per site, up to the stop.

    Any other answer resets the streak; an attempt without an answer (null status) leaves
    it as it is. The attempt that completes the longest allowed streak is still listed;
    the site's later attempts are not.
    """
    blocked, answered = F.col("status").isin(*BLOCK_STATUSES), F.col("status").isNotNull()
    numbered = running(log, ["site_id"], "seq", {"_n": Running("sum", answered.cast("long"))}, piece_rows)
    numbered = materialize(numbered, "numbered-attempts")
    reset = Running("max", F.when(answered & ~blocked, F.col("_n")))
    streaks = running(numbered, ["site_id"], "seq", {"_reset": reset}, piece_rows)
    streaks = streaks.withColumn("streak", F.col("_n") - F.coalesce("_reset", F.lit(0))).drop("_n", "_reset")
    full = Running("sum", (F.col("streak") >= MAX_CONSECUTIVE_BLOCKS).cast("long"), include_current=False)
    cut = running(streaks, ["site_id"], "seq", {"_stopped": full}, piece_rows)
    return cut.filter(F.col("_stopped") == 0).drop("_stopped")


def _seconds(text: Column) -> Column:
    """Numeric Retry-After, null for dates and other text."""
    number = F.trim(text)
    return F.when(number.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), number.try_cast("double"))


def retry_plan(log: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Attempt number and waiting time (without jitter) of each throttled attempt per URL.

    Attempts beyond the allowed retries are listed without a waiting time; so is the one
    that stops a site, if the log comes with its ``streak``.
    """
    throttled = log.filter(F.col("status").isin(*RETRY_STATUSES))
    numbered = row_numbers(throttled, ["site_id", "url"], "seq", "attempt", piece_rows)
    # The wait is capped anyway, so the exponent may be, too.
    doubling = F.pow(F.lit(2.0), F.least(F.col("attempt") - 1, F.lit(16))) * BACKOFF_BASE_SECONDS
    wait = F.least(F.greatest(doubling, _seconds(F.col("retry_after"))), F.lit(float(BACKOFF_MAX_SECONDS)))
    retried = F.col("attempt") <= MAX_RETRIES_PER_URL
    if "streak" in log.columns:
        retried = retried & (F.col("streak") < MAX_CONSECUTIVE_BLOCKS)
    return numbered.select(
        "site_id", "seq", "url", "status", "attempt",
        retried.alias("retried"), F.when(retried, wait).alias("wait_seconds"),
    )
