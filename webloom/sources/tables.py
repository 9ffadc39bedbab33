"""Reading input tables and finding the column to work on."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from webloom.fixed_values import URL_COLUMN_NAMES

_FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".orc": "orc", ".parquet": "parquet"}


def read_table(
    spark: SparkSession, path: str, schema: StructType | None = None, multi_line: bool = True
) -> DataFrame:
    """Read by file extension; without one, Parquet. CSV files carry a header.

    Quoted CSV fields may span lines; ``multi_line=False`` gives that up so that Spark
    can split one huge CSV file.
    """
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension in (".xls", ".xlsx"):
        raise ValueError("spreadsheets are not read; export the sheet as CSV or Parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    kind = _FORMATS.get(extension, "parquet")
    if kind == "csv":
        reader = reader.options(header=True, multiLine=multi_line, quote='"', escape='"')
    return reader.format(kind).load(path)


def require_column(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        raise ValueError(f"column {name!r} not found; available: {df.columns}")
    return F.col(name)


def find_url_column(df: DataFrame) -> str:
    """The column called like a URL, in a fixed order of preference, else the first."""
    by_name = {re.sub(r"\s+", " ", c.replace("\x00", " ")).strip().casefold(): c for c in df.columns}
    return next((by_name[n] for n in URL_COLUMN_NAMES if n in by_name), df.columns[0])


def read_url_list(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """First column as text, nulls dropped."""
    first = df.columns[0]
    return df.filter(F.col(first).isNotNull()).select(*keep, F.col(first).cast("string").alias("url"))
