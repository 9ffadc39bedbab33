"""Motion triage: frame samples to events, events to clip classes and reports.

Every step works on ``clip_id`` groups of any length: ordered steps use split windows,
everything else is a map-side combinable aggregate.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType

from webloom.config import MotionConfig
from webloom.fixed_values import (
    BOX_TOUCH_PIXELS, ERROR_FRAME_RATE, ERROR_NO_FRAMES, ERROR_RESOLUTION, HIGH_MIN_SAMPLES,
    MIN_CONTOUR_AREA, UNASSESSABLE_RATIO, WARN_DECODE, WARN_FEW_SAMPLES, WARN_TRUNCATED,
    WARN_UNASSESSABLE,
)
from webloom.functions.files import path_parts, peak_stamp, relative_path, run_signature
from webloom.operators.split_windows import Folded, PIECE_ROWS, Running, fold_runs, running, top_rows


# --- samples ----------------------------------------------------------------
def frame_sampling(frames: DataFrame, config: MotionConfig) -> DataFrame:
    """Every n-th frame with its time and the sampling interval; unusable frame rates drop out."""
    usable = (F.col("fps") > 0) & ~F.isnan("fps") & (F.col("fps") != float("inf"))
    step = F.greatest(F.lit(1), F.floor(F.col("fps") / config.sample_fps)).cast("long")
    return (
        frames.filter(usable)
        .withColumn("_step", step)
        .filter(F.col("frame_index") % F.col("_step") == 0)
        .withColumn("interval", F.col("_step") / F.col("fps"))
        .withColumn("ts", F.col("frame_index") / F.col("fps"))
        .drop("_step")
    )


def detections_filtered(detections: DataFrame, config: MotionConfig) -> DataFrame:
    """Contours of at least the minimum area, which grows with the region size."""
    least = F.greatest(
        F.lit(float(MIN_CONTOUR_AREA)), F.col("frame_size") * config.min_area_ratio * config.factor
    )
    return detections.filter(F.col("area") >= least)


def frame_samples(detections: DataFrame, config: MotionConfig) -> DataFrame:
    """Boxes and score of each frame having any contour that is large enough.

    Contours of one frame do not overlap and each covers at least the minimum share of
    it, so a frame holds at most ``1 / (min_area_ratio * factor)`` boxes (1,786 by
    default, 780 at low sensitivity): the list is bounded.
    """
    box = F.struct("x", "y", "w", "h")
    return detections_filtered(detections, config).groupBy("clip_id", "frame_index").agg(
        F.sort_array(F.collect_list(F.struct("k", box.alias("box")))).getField("box").alias("boxes"),
        (F.sum("area") / F.max("frame_size")).alias("score"),
    )


def boxes_touch(first: Column, second: Column, margin: int = BOX_TOUCH_PIXELS) -> Column:
    """Whether any box of one list comes within ``margin`` pixels of any box of the other."""

    def near(a: Column, b: Column, at: str, size: str) -> Column:
        return (a[at] - margin <= b[at] + b[size]) & (b[at] - margin <= a[at] + a[size])

    return F.exists(first, lambda a: F.exists(second, lambda b: near(a, b, "x", "w") & near(a, b, "y", "h")))


# --- events -----------------------------------------------------------------
def _compared(samples: DataFrame, active: Column, piece_rows: int) -> DataFrame:
    """Active samples with ``prev_ts`` of the sample before and ``last``, the active one before.

    The first decoded sample of a clip only primes the comparison: it shows no motion
    itself but counts as a sample before.
    """
    decoded = samples.filter("decoded")
    before = {
        "first_frame": Running("min", F.col("frame_index"), include_current=False),
        "prev_ts": Running("max", F.col("ts"), include_current=False),
        "last": Running(
            "max", F.when(active, F.struct("frame_index", "ts", "boxes")), include_current=False
        ),
    }
    rows = running(decoded, ["clip_id"], "frame_index", before, piece_rows)
    primed = F.col("last.frame_index") == F.col("first_frame")
    return (
        rows.filter(active & F.col("first_frame").isNotNull())
        .withColumn("last", F.when(~primed, F.col("last")))
        .drop("first_frame")
    )


def _events(active: DataFrame, starts: Column, piece_rows: int, min_samples: int) -> DataFrame:
    """One row per event: span, sample count, and the boxes at its first highest score."""
    best = F.struct(
        F.col("score"), (-F.col("frame_index")).alias("earlier"), F.col("ts").alias("peak"), F.col("boxes")
    )
    folded = {
        "_first": Folded("min", F.struct("ts", "interval")),
        "end": Folded("max", F.col("ts")),
        "samples": Folded("sum", F.lit(1).cast("long")),
        "_best": Folded("max", best),
        "uncertain": Folded("any", F.col("uncertain")),
    }
    events = fold_runs(active, ["clip_id"], "frame_index", starts, "event_id", folded, piece_rows)
    return events.filter(F.col("samples") >= min_samples).select(
        "clip_id", "event_id",
        F.greatest(F.lit(0.0), F.col("_first.ts") - F.col("_first.interval")).alias("start"),
        "end", "samples", F.col("_best.score").alias("score"), F.col("_best.peak").alias("peak"),
        "uncertain", F.col("_best.boxes").alias("boxes"),
    )


def motion_events(samples: DataFrame, config: MotionConfig, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Events of boxed samples.

    A boxed sample starts an event when the last boxed one is too long ago, none of its
    boxes touches a box of that one, or an empty sample in between was already further
    away than ``event_gap``. Events of too few samples are dropped.
    """
    boxed = _compared(samples, F.size("boxes") > 0, piece_rows)
    limit = F.greatest(F.lit(config.max_event_gap), F.col("interval") * 1.5)
    starts = (
        F.col("last").isNull()
        | (F.col("ts") - F.col("last.ts") > limit)
        | ~boxes_touch(F.col("last.boxes"), F.col("boxes"))
        | (F.col("prev_ts") - F.col("last.ts") > config.event_gap)
    )
    return _events(boxed, starts, piece_rows, config.min_event_samples)


def motion_events_legacy(samples: DataFrame, config: MotionConfig, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Events by the older rule: boxed or uncertain samples belong together until an
    inactive sample more than ``event_gap`` after the last active one."""
    active = _compared(samples, (F.size("boxes") > 0) | F.col("uncertain"), piece_rows)
    starts = F.col("last").isNull() | (F.col("prev_ts") - F.col("last.ts") > config.event_gap)
    return _events(active, starts, piece_rows, 1)


def top_events(events: DataFrame, config: MotionConfig, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Highest-scored events per clip, ties in event order, with rank and time stamp."""
    order = [F.col("score").desc(), F.col("event_id")]
    split = F.floor(F.col("event_id") / piece_rows)
    best = top_rows(events, ["clip_id"], order, split, int(config.max_screenshots), "rank")
    return best.select("clip_id", "event_id", "rank", "score", peak_stamp(F.col("peak")).alias("stamp"))


def events_json(events: DataFrame) -> DataFrame:
    """Each event as JSON without its boxes, one row per event.

    One text per clip would put all events of a clip into one row, whatever their number.
    """
    fields = ["start", "end", "samples", "score", "uncertain", "peak"]
    return events.select("clip_id", "event_id", F.to_json(F.struct(*fields)).alias("event_json"))


# --- clips ------------------------------------------------------------------
def profile_table(df: DataFrame, profiles: Mapping[str, Mapping]) -> DataFrame:
    """Camera profiles, a driver-side setting, as a small table."""
    rows = [(name, int(p["width"]), int(p["height"])) for name, p in sorted(profiles.items())]
    schema = "camera_profile STRING, profile_width INT, profile_height INT"
    return df.sparkSession.createDataFrame(rows, schema)


def profile_signatures(df: DataFrame, profiles: Mapping[str, Mapping], config: MotionConfig) -> DataFrame:
    """``(camera_profile, signature)``: the signature changes with any setting or detail of the profile."""
    rows = [(name, json.dumps(profile, sort_keys=True)) for name, profile in sorted(profiles.items())]
    described = df.sparkSession.createDataFrame(rows, "camera_profile STRING, details STRING")
    return described.select("camera_profile", run_signature(config, F.struct("camera_profile", "details")).alias("signature"))


def clip_samples(samples: DataFrame) -> DataFrame:
    """Per clip: decoded samples, decode failures, matches with the unavailable view, sizes seen."""
    decoded = F.col("decoded")
    return samples.groupBy("clip_id").agg(
        F.count_if(decoded).alias("sampled"),
        F.count_if(~decoded).alias("decode_failures"),
        F.count_if(decoded & F.col("view_matches")).alias("matched"),
        F.min(F.when(decoded, F.col("width"))).alias("width_min"),
        F.max(F.when(decoded, F.col("width"))).alias("width_max"),
        F.min(F.when(decoded, F.col("height"))).alias("height_min"),
        F.max(F.when(decoded, F.col("height"))).alias("height_max"),
    )


def profile_check(clips: DataFrame, sampled: DataFrame, profiles: Mapping[str, Mapping]) -> DataFrame:
    """Clips with their sample counts and the reason, if any, why they fail.

    Frames are reduced to one row per clip before they meet the profile.
    """
    known = profile_table(clips, profiles)
    rows = clips.join(sampled, "clip_id", "left").join(known, "camera_profile", "left")
    fps_ok = F.coalesce((F.col("fps") > 0) & ~F.isnan("fps") & (F.col("fps") != float("inf")), F.lit(False))
    counted = F.coalesce(F.col("sampled"), F.lit(0))
    same_size = (
        (F.col("width_min") == F.col("profile_width")) & (F.col("width_max") == F.col("profile_width"))
        & (F.col("height_min") == F.col("profile_height")) & (F.col("height_max") == F.col("profile_height"))
    )
    failure = (
        F.when(~fps_ok, ERROR_FRAME_RATE)
        .when((counted > 0) & ~F.coalesce(same_size, F.lit(False)), ERROR_RESOLUTION)
        .when(counted == 0, ERROR_NO_FRAMES)
    )
    return rows.select(
        *clips.columns, counted.alias("sampled"),
        F.coalesce("decode_failures", F.lit(0)).alias("decode_failures"),
        F.coalesce("matched", F.lit(0)).alias("matched"), failure.alias("failure"),
    )


def _warnings(matched: bool) -> Column:
    parts = [
        F.when(
            F.col("decode_failures") > 0,
            F.array_join(F.array_repeat(F.lit(WARN_DECODE), F.col("decode_failures").cast("int")), "; "),
        ),
        F.when(
            (F.col("expected_frames") > 0)
            & (F.col("frames") < F.col("expected_frames") - F.greatest(F.lit(2.0), F.col("fps") * 0.2)),
            WARN_TRUNCATED,
        ),
        F.when(F.col("sampled") < 3, WARN_FEW_SAMPLES),
    ]
    if matched:
        parts.append(F.when(_unassessable(), WARN_UNASSESSABLE))
    return F.concat_ws("; ", *parts)


def _unassessable() -> Column:
    return F.col("matched") / F.col("sampled") >= UNASSESSABLE_RATIO


def clip_warnings(checked: DataFrame) -> DataFrame:
    """Warnings of each readable clip in one text, empty when there are none."""
    return checked.filter(F.col("failure").isNull()).select("clip_id", _warnings(True).alias("warnings"))


def is_high(config: MotionConfig) -> Column:
    return (
        (F.col("samples") >= HIGH_MIN_SAMPLES)
        & (F.col("end") - F.col("start") >= config.high_duration)
        & (F.col("score") >= config.high_score * config.factor)
        & ~F.col("uncertain")
    )


def clip_events(events: DataFrame, config: MotionConfig) -> DataFrame:
    return events.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("events"), F.bool_or(is_high(config)).alias("high"),
        F.min("start").alias("motion_start"), F.max("end").alias("motion_end"),
        F.sum(F.col("end") - F.col("start")).alias("motion_duration"), F.max("score").alias("motion_score"),
    )


def _classified(checked: DataFrame, events: DataFrame, config: MotionConfig, legacy: bool) -> DataFrame:
    rows = checked.join(clip_events(events, config), "clip_id", "left")
    ok = F.col("failure").isNull()
    kind = (
        F.when(F.col("high"), "HIGH_PRIORITY")
        .when((F.coalesce("events", F.lit(0)) > 0) | (_warnings(False) != ""), "REVIEW")
        .otherwise("NO_RELEVANT_MOTION")
    )
    if not legacy:
        kind = F.when(_unassessable(), "UNASSESSABLE").otherwise(kind)
    return rows.withColumn("_ok", ok).withColumn("classification", F.when(ok, kind).otherwise("REVIEW"))


def clip_class(checked: DataFrame, events: DataFrame, config: MotionConfig, legacy: bool = False) -> DataFrame:
    """Class of each clip; a failed clip is for review. The older rule knows no UNASSESSABLE."""
    return _classified(checked, events, config, legacy).select("clip_id", "classification")


def clip_report(checked: DataFrame, events: DataFrame, config: MotionConfig, root: str) -> DataFrame:
    """Report row of each clip; motion columns of a failed clip stay null."""
    rows = _classified(checked, events, config, legacy=False)
    ok = F.col("_ok")
    parts = path_parts(relative_path(F.col("path"), root))
    return rows.select(
        "clip_id", parts["date"].alias("date"), parts["filename"].alias("filename"),
        F.col("path").alias("original_path"), "classification",
        F.when(ok, F.col("motion_start")).alias("motion_start"),
        F.when(ok, F.col("motion_end")).alias("motion_end"),
        F.when(ok, F.coalesce("motion_duration", F.lit(0.0))).alias("motion_duration"),
        F.when(ok, F.coalesce("motion_score", F.lit(0.0))).alias("motion_score"),
        F.when(ok, "Success").otherwise("Failed").alias("processing_status"),
        F.when(ok, _warnings(True)).otherwise(F.col("failure")).alias("error_details"),
        "camera_profile",
    )


# --- unavailable view ---------------------------------------------------------
def reference_match(
    vector: Column, reference: list[float], min_std: float = 5.0, min_correlation: float = 0.98,
    max_difference: float = 12.0,
) -> Column:
    """Whether a scene vector shows the reference view, exposure aside.

    The one reference vector is a setting of the camera profile and travels with the
    function; vectors are compared batch-wise. Median, percentile and correlation of an
    array have no built-in.
    """
    known = np.asarray(reference, np.float64)
    spread_ok = known.size > 0 and np.std(known) >= min_std
    centred = known - known.mean() if known.size else known
    norm = float(np.sqrt((centred ** 2).sum()))

    @F.arrow_udf(BooleanType())
    def matches(vectors: pa.Array) -> pa.Array:
        result = np.zeros(len(vectors), bool)
        sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(sizes == known.size)
        if spread_ok and rows.size:
            flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
            scenes = flat.reshape(rows.size, known.size).astype(np.float64)
            difference = scenes - known
            difference -= np.median(difference, axis=1, keepdims=True)
            varied = scenes.std(axis=1) >= min_std
            own = scenes - scenes.mean(axis=1, keepdims=True)
            scale = np.sqrt((own ** 2).sum(axis=1)) * norm
            correlation = np.divide(own @ centred, scale, out=np.zeros(rows.size), where=scale > 0)
            near = np.percentile(np.abs(difference), 95, axis=1) < max_difference
            result[rows] = varied & (correlation > min_correlation) & near
        return pa.array(result)

    return matches(vector)
