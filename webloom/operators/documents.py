"""Prompt and reply tables rendered as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webloom.functions.text import build_prompt, markdown_block, safe_filename
from webloom.operators.split_windows import PIECE_ROWS, Running, running


def prompts(titles: DataFrame, base_prompt: str) -> DataFrame:
    return titles.select("row_id", "title", build_prompt(base_prompt.strip(), F.col("title")).alias("prompt"))


def markdown_files(replies: DataFrame) -> DataFrame:
    """One document per file name; of equal names the last row wins.

    ``replies`` has ``row_id, title, reply``. The newest row is kept by a map-side
    combinable aggregate, so a name shared by very many rows is no problem.
    """
    named = replies.select(
        "row_id",
        F.concat(safe_filename(F.col("title"), F.col("row_id")), F.lit(".md")).alias("filename"),
        markdown_block(F.col("title"), F.col("reply"), "file").alias("content"),
    )
    newest = F.max(F.struct("row_id", "content"))
    return named.groupBy("filename").agg(newest.alias("last")).select("filename", "last.row_id", "last.content")


def markdown_document(replies: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The blocks of one long document and where each starts in it.

    The document is the concatenation of the blocks by ``row_id``. It is never built in
    one place: ``start`` tells any writer where its block belongs. Only lengths are ordered and
    summed, the blocks meet their start by ``row_id``. Rows that share an id share its first start.
    """
    blocks = replies.select(
        "row_id", F.lit("document").alias("document"),
        markdown_block(F.col("title"), F.col("reply"), "section").alias("block"),
    )
    length = Running("sum", F.col("length"), include_current=False)
    lengths = blocks.select("row_id", "document", F.length("block").cast("long").alias("length"))
    starts = running(lengths, ["document"], "row_id", {"start": length}, piece_rows)
    starts = starts.groupBy(F.col("row_id").alias("_row_id")).agg(F.min("start").alias("start"))
    return blocks.join(starts, F.col("row_id").eqNullSafe(F.col("_row_id"))).select("row_id", "block", "start")
