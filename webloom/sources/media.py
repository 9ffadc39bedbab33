"""Inventory of media files under a folder tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from webloom.fixed_values import MEDIA_EXTENSIONS
from webloom.functions.files import path_parts

# Where reports about the files are kept, inside the same tree.
REPORT_FOLDER = "motion_reports"


def media_inventory(
    spark: SparkSession,
    root: str,
    extensions: Sequence[str] = MEDIA_EXTENSIONS,
    exclude_dirs: Sequence[str] = (REPORT_FOLDER,),
) -> DataFrame:
    """Path, size and modification time of matching files; contents are never read.

    Folders named in ``exclude_dirs`` (any case) are left out with all they hold.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select(
            F.regexp_replace("path", r"^[a-z0-9]+:/+", "/").alias("path"),
            F.col("length").alias("size"),
            F.unix_micros("modificationTime").alias("mtime"),
        )
    )
    extension = F.lower(path_parts(F.col("path"))["extension"])
    folders = F.split(F.lower(F.col("path")), "/")
    excluded = F.arrays_overlap(
        F.slice(folders, F.lit(1), F.size(folders) - 1), F.array(*[F.lit(d.lower()) for d in exclude_dirs])
    ) if exclude_dirs else F.lit(False)
    return files.filter(extension.isin([e.lower() for e in extensions]) & ~excluded)
