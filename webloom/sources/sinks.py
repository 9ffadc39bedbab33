"""Report writers. Spark's commit protocol makes each of them all-or-nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webloom.schemas import LINK_REPORT_HEADERS, PAGE_REPORT_HEADERS


def _csv_columns(df: DataFrame) -> DataFrame:
    """CSV has no nested values: those go out as JSON text."""
    nested = ("array", "struct", "map")
    return df.select(*[
        F.to_json(c).alias(c) if kind.startswith(nested) else F.col(c) for c, kind in df.dtypes
    ])


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV files with header; quotes inside fields are doubled."""
    _csv_columns(df).write.mode(mode).options(header=True, quote='"', escape='"').csv(path)


def write_crawl_report(pages: DataFrame, links: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The two tables of a crawl under one run folder, with report headers."""
    for df, headers, name in (
        (pages, PAGE_REPORT_HEADERS, "crawl_data"), (links, LINK_REPORT_HEADERS, "internal_links"),
    ):
        kept = df.select(*[F.col(c).alias(h) for c, h in headers.items()])
        write_report(kept, f"{path}/{name}", mode)


def _line(column: str) -> Column:
    """The text without its final line end, which the text writer adds itself."""
    return F.substr(column, F.lit(1), F.length(column) - 1).alias("value")


def write_markdown_files(files: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per file name with the Markdown text inside."""
    text = files.select("filename", _line("content"))
    text.write.mode(mode).partitionBy("filename").text(path)


def write_markdown_document(blocks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Part files that form the one document when read in name order."""
    ordered = blocks.repartitionByRange("row_id").sortWithinPartitions("row_id")
    ordered.select(_line("block")).write.mode(mode).text(path)
