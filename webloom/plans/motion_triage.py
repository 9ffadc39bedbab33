"""Motion triage of pending clips, with incremental state."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from webloom.config import MotionConfig
from webloom.functions.files import fingerprint
from webloom.operators.motion import (
    clip_report, clip_samples, frame_sampling, motion_events, profile_check, profile_signatures,
)
from webloom.operators.split_windows import PIECE_ROWS
from webloom.operators.state import pending_files, state_upsert
from webloom.session import materialize


@dataclass(frozen=True)
class Triage:
    events: DataFrame
    report: DataFrame


def triage(
    clips: DataFrame, frames: DataFrame, profiles: Mapping[str, Mapping], config: MotionConfig, root: str,
    piece_rows: int = PIECE_ROWS,
) -> Triage:
    """Events and report of the given clips.

    ``clips`` has one row per file; a clip without frames is reported as failed. Events
    of failed clips are not kept.
    """
    samples = frame_sampling(frames, config)
    checked = profile_check(clips, clip_samples(samples), profiles)
    readable = checked.filter(F.col("failure").isNull()).select("clip_id")
    # Written once: the caller's events and the report both read it.
    events = materialize(motion_events(samples, config, piece_rows).join(readable, "clip_id", "left_semi"), "motion-events")
    return Triage(events, clip_report(checked, events, config, root))


def write_report(report: DataFrame, path: str) -> None:
    """Store a report in the order of its files: a range sort, so that no task sees all rows."""
    report.orderBy("original_path", "clip_id").write.parquet(path)


@dataclass(frozen=True)
class PendingTriage:
    events: DataFrame
    report: DataFrame
    state: DataFrame


def triage_pending(
    clips: DataFrame, frames: DataFrame, state: DataFrame, profiles: Mapping[str, Mapping], config: MotionConfig,
    root: str, run_id: int, retry_failed: bool = False, piece_rows: int = PIECE_ROWS,
) -> PendingTriage:
    """Triage the clips that are new or changed since the runs in ``state``, and bring the state up to date.

    ``clips`` has ``size`` and ``mtime`` beside the columns of ``triage``; ``state`` has ``path,
    fingerprint, processing_status, updated_at``. A clip is pending if its file, its camera profile or the
    settings differ from the run recorded for its path. ``run_id`` grows from run to run.
    """
    signed = clips.join(profile_signatures(clips, profiles, config), "camera_profile", "left")
    signature = F.coalesce("signature", F.lit("no profile"))
    printed = signed.withColumn("fingerprint", fingerprint(F.col("size"), F.col("mtime"), signature)).drop("signature")
    pending = materialize(pending_files(printed, state, retry_failed), "pending-clips")
    some = frames.join(pending.select("clip_id"), "clip_id", "left_semi")
    done = triage(pending.select(*clips.columns), some, profiles, config, root, piece_rows)
    report = materialize(done.report, "clip-report")
    updates = pending.join(report.select("clip_id", "processing_status"), "clip_id").select(
        "path", "fingerprint", "processing_status", F.lit(run_id).cast("long").alias("updated_at"))
    return PendingTriage(done.events, report, materialize(state_upsert(state, updates), "triage-state"))
