"""File names, fingerprints and path parts."""

from __future__ import annotations

from dataclasses import fields
from datetime import datetime

from pyspark.sql import Column, functions as F

from webloom.config import MotionConfig
from webloom.fixed_values import ALGORITHM_VERSION


def safe_run_name(name: Column) -> Column:
    """Characters that file systems reject become underscores."""
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")


def run_path(folder: str, name: str, stamp: datetime) -> str:
    """Folder of one run; the driver-side twin of ``safe_run_name``."""
    kept = name.translate({ord(c): "_" for c in '<>:"/\\|?*'})
    return f"{folder}/{kept}_{stamp:%Y-%m-%d_%H-%M-%S}"


def run_signature(config: MotionConfig, profile: Column) -> Column:
    """Digest of a camera profile under these settings; another one if either or the algorithm changes."""
    settings = F.struct(*[F.lit(getattr(config, field.name)).alias(field.name) for field in fields(config)])
    described = F.struct(profile.alias("profile"), settings.alias("settings"), F.lit(ALGORITHM_VERSION).alias("algorithm"))
    return F.sha2(F.to_json(described), 256)


def fingerprint(size: Column, mtime: Column, signature: Column) -> Column:
    return F.concat_ws(":", size.cast("string"), mtime.cast("string"), signature)


def file_tag(relative_path: Column, signature: Column, file_fingerprint: Column) -> Column:
    return F.substring(F.sha2(F.concat(relative_path, signature, file_fingerprint), 256), 1, 12)


def relative_path(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def path_parts(relative: Column) -> dict[str, Column]:
    """First folder (the date, empty at top level), file name, stem and extension."""
    name = F.substring_index(relative, "/", -1)
    extension = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    return {
        "date": F.when(F.contains(relative, F.lit("/")), F.substring_index(relative, "/", 1)).otherwise(""),
        "filename": name,
        "stem": F.substr(name, F.lit(1), F.length(name) - F.length(extension)),
        "extension": extension,
    }


def peak_stamp(seconds: Column) -> Column:
    """Zero-padded seconds with milliseconds, safe in file names."""
    return F.replace(F.format_string("%010.3f", seconds), F.lit("."), F.lit("-"))
