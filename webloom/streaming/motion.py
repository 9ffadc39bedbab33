"""Motion events over a stream of samples, by the whole event rule of the batch job.

The rule compares each boxed sample with the boxed one before, so samples must be seen in frame order,
while a stream delivers them in any order. Each clip keeps the samples that the watermark has not passed;
when it passes them they are final, and run through the rule in order. What stays after that is small:
the last boxed sample, the time of the last sample, the open event and the number of events. An event is
released once: when another one begins, or when the watermark is too far on for any sample to join it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webloom.config import MotionConfig
from webloom.fixed_values import BOX_TOUCH_PIXELS
from webloom.operators.motion import frame_sampling

BOXES = "ARRAY<STRUCT<x: INT, y: INT, w: INT, h: INT>>"
#: Event time of a clip's begin. Not zero: before the first batch the watermark is, and what it has reached is late.
BEGIN_MS = 86_400_000
EVENT = "event_id BIGINT, start DOUBLE, end DOUBLE, samples BIGINT, score DOUBLE, peak DOUBLE, uncertain BOOLEAN, boxes_json STRING"


def _touch(first: list[dict], second: list[dict]) -> bool:
    def near(a: dict, b: dict, at: str, size: str) -> bool:
        return a[at] - BOX_TOUCH_PIXELS <= b[at] + b[size] and b[at] - BOX_TOUCH_PIXELS <= a[at] + a[size]

    return any(near(a, b, "x", "w") and near(a, b, "y", "h") for a in first for b in second)


class Clip:
    """What a clip's samples up to the watermark leave behind, and those beyond it."""

    def __init__(self, config: MotionConfig, text: str | None = None) -> None:
        self.config = config
        self.data = json.loads(text) if text else {"primed": False, "before": None, "last": None, "open": None, "runs": 0, "waiting": []}

    def text(self) -> str:
        return json.dumps(self.data)

    def limit(self, interval: float) -> float:
        return max(self.config.max_event_gap, interval * 1.5)

    def add(self, frame: int, ts: float, interval: float, boxes: list[dict], score: float | None, uncertain: bool | None) -> None:
        self.data["waiting"].append([frame, ts, interval, boxes, score, uncertain])

    def _close(self) -> Iterator[tuple]:
        event, self.data["open"] = self.data["open"], None
        if event and event["samples"] >= self.config.min_event_samples:
            _, score, _, peak, boxes = event["best"]
            yield (event["id"], max(0.0, event["first"][0] - event["first"][1]), event["end"], event["samples"],
                   score if event["best"][0] else None, peak, event["uncertain"], json.dumps(boxes))

    def _take(self, frame: int, ts: float, interval: float, boxes: list[dict], score: float | None, uncertain: bool | None) -> Iterator[tuple]:
        data, before = self.data, self.data["before"]
        data["before"] = ts
        if not data["primed"]:  # the first sample shows no motion itself
            data["primed"] = True
            return
        if not boxes:
            return
        last, data["last"] = data["last"], [ts, interval, boxes]
        best = [score is not None, score or 0.0, -frame, ts, boxes]
        if (last is None or data["open"] is None or ts - last[0] > self.limit(interval) or not _touch(last[2], boxes)
                or before - last[0] > self.config.event_gap):
            yield from self._close()
            data["runs"] += 1
            data["open"] = {"id": data["runs"], "first": [ts, interval], "end": ts, "samples": 1, "best": best, "uncertain": uncertain}
            return
        event = data["open"]
        event["end"], event["samples"] = ts, event["samples"] + 1
        event["best"] = max(event["best"], best, key=lambda b: b[:3])
        known = [u for u in (event["uncertain"], uncertain) if u is not None]
        event["uncertain"] = any(known) if known else None

    def advance(self, seconds: float) -> Iterator[tuple]:
        """Events that are settled when no sample up to this time can come any more."""
        waiting = sorted(self.data["waiting"], key=lambda s: s[0])
        self.data["waiting"] = [s for s in waiting if s[1] > seconds]
        for sample in waiting:
            if sample[1] <= seconds:
                yield from self._take(*sample)
        last = self.data["last"]
        if self.data["open"] and seconds - last[0] > self.limit(last[1]):
            yield from self._close()

    def next_time(self) -> float | None:
        """When there is something to do without a new sample."""
        times = [s[1] for s in self.data["waiting"]]
        if self.data["open"]:
            ts, interval, _ = self.data["last"]
            times.append(ts + self.limit(interval) + 0.001)
        return min(times, default=None)


def stream_motion_events(frames: DataFrame, config: MotionConfig, lateness: str) -> DataFrame:
    """Events of a stream of frames, each released once: ``clip_id, event_id, start, end, samples, score, peak,
    uncertain, boxes`` as ``operators.motion.motion_events`` gives them.

    ``frames`` are as for ``frame_sampling``. A frame's time in its clip is its event time; frames that are
    ``lateness`` behind the newest of all clips are dropped, as Spark drops late rows. A clip has one frame
    rate. Frame numbers are unique in their clip; copies of a frame must be removed before.
    """
    samples = frame_sampling(frames, config).filter("decoded").select(
        "clip_id", "frame_index", "ts", "interval", F.to_json("boxes").alias("boxes"), "score", "uncertain",
        F.timestamp_micros(F.ceil(F.col("ts") * 1_000_000) + BEGIN_MS * 1000).alias("at"))
    kind = samples.schema["clip_id"].dataType.simpleString()

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clip = Clip(config, state.get[0] if state.exists else None)
        if not state.hasTimedOut:
            for part in rows:
                for row in part.itertuples(index=False):
                    score = None if row.score is None or pd.isna(row.score) else float(row.score)
                    uncertain = None if row.uncertain is None or pd.isna(row.uncertain) else bool(row.uncertain)
                    clip.add(int(row.frame_index), float(row.ts), float(row.interval), json.loads(row.boxes or "[]"), score, uncertain)
        watermark = state.getCurrentWatermarkMs()
        events = list(clip.advance((watermark - BEGIN_MS) / 1000))
        state.update((clip.text(),))
        due = clip.next_time()
        if due is not None:
            state.setTimeoutTimestamp(max(watermark + 1, math.ceil(due * 1000) + BEGIN_MS))
        if events:
            yield pd.DataFrame([(key[0], *event) for event in events],
                               columns=["clip_id", "event_id", "start", "end", "samples", "score", "peak", "uncertain", "boxes_json"])

    events = samples.withWatermark("at", lateness).groupBy("clip_id").applyInPandasWithState(
        step, f"clip_id {kind}, {EVENT.replace('end DOUBLE', '`end` DOUBLE')}", "clip STRING", "append", GroupStateTimeout.EventTimeTimeout)
    return events.withColumn("boxes", F.from_json("boxes_json", BOXES)).drop("boxes_json")
