"""The event rule on a stream against the batch job."""

import json
import random

import pytest

from test_motion import frame, random_clips
from webloom.config import MotionConfig
from webloom.operators import motion as mo
from webloom.schemas import FRAMES
from webloom.session import new_folder
from webloom.streaming.motion import Clip, stream_motion_events
from webloom.streaming.sessions import run_to_table

CONFIG = MotionConfig()
FAR = 16 * 86_400


def rows_of(events):
    return sorted((r.clip_id, r.event_id, round(r.start, 9), r.end, r.samples, r.score, r.peak, r.uncertain, [tuple(b) for b in r.boxes])
                  for r in events.collect())


def batch_events(spark, rows):
    return rows_of(mo.motion_events(mo.frame_sampling(spark.createDataFrame(rows, FRAMES), CONFIG), CONFIG))


class Stream:
    def __init__(self, spark, lateness):
        self.spark, self.lateness = spark, lateness
        self.folder, self.path, self.progress = (new_folder(spark, n) for n in ("frames", "events", "progress"))

    def send(self, rows):
        table = self.spark.createDataFrame(rows, FRAMES)
        table.coalesce(1).write.mode("append").parquet(self.folder)
        frames = self.spark.readStream.schema(table.schema).parquet(self.folder)
        events = stream_motion_events(frames, CONFIG, self.lateness)
        run_to_table(events, self.path, self.progress)
        return rows_of(self.spark.read.schema(events.schema).parquet(self.path))


def test_shuffled_arrival_gives_the_batch_events(spark):
    """Every row up to 20 s of clip time late, over four batches and three restarts."""
    rows = random_clips(11, clips=8)
    rng = random.Random(4)
    rows.sort(key=lambda r: r[1] / r[2] + rng.random() * 20)
    stream, quarter = Stream(spark, "25 seconds"), -(-len(rows) // 3)
    seen = []
    for i in range(0, len(rows), quarter):
        got = stream.send(rows[i:i + quarter])
        assert all(e in got for e in seen)  # append: what was released stays
        seen = got
    got = stream.send([frame(99, FAR)])
    want = batch_events(spark, rows)
    assert got == want and len(want) > 10 and len(seen) < len(want)


def test_events_are_released_once_the_watermark_has_passed(spark):
    boxes = [(0, 0, 10, 10)]
    stream = Stream(spark, "1 second")
    assert stream.send([frame(1, i, boxes if i else (), 0.5) for i in range(0, 17, 2)]) == []
    # Clip 2 moves the watermark to 5 s; the event of clip 1 ended at 1 s and comes by its timer.
    got = stream.send([frame(2, 0), frame(2, 96)])
    assert [(e[0], e[1], e[4]) for e in got] == [(1, 1, 8)]
    # Frames behind the watermark are late and change nothing; later ones begin the next event.
    got = stream.send([frame(1, 18, boxes, 0.9), frame(1, 160, boxes, 0.1), frame(1, 162, boxes, 0.2)])
    assert len(got) == 1
    got = stream.send([frame(2, FAR)])
    assert [(e[0], e[1], e[4], e[5]) for e in got] == [(1, 1, 8, 0.5), (1, 2, 2, 0.2)]


@pytest.mark.parametrize("seed", range(20))
def test_any_watermarks_give_the_same_events(seed):
    """Samples in any order, the watermark in any steps behind them, the state written and read each time."""
    rng = random.Random(seed)
    samples = []
    for i in range(rng.randint(1, 80)):
        boxes = [{"x": rng.randrange(0, 60, 15), "y": 0, "w": 10, "h": 10}] if rng.random() < 0.7 else []
        if rng.random() < 0.9:
            samples.append((i, i / 8, 0.125, boxes, rng.randint(0, 4) / 10, rng.random() < 0.2))
    whole = Clip(CONFIG)
    for s in samples:
        whole.add(*s)
    want = list(whole.advance(1e9))
    arriving = sorted(samples, key=lambda s: s[1] + rng.random() * 3)
    text, got, watermark = None, [], -1.0
    for s in arriving:
        clip = Clip(CONFIG, text)
        if s[1] > watermark:
            clip.add(*s)
        watermark = max(watermark, s[1] - 3)
        got += clip.advance(watermark)
        text = clip.text()
    got += Clip(CONFIG, text).advance(1e9)
    assert got == want
    state = json.loads(text)
    assert len(state["waiting"]) <= 3 * 8 + 2  # only what the watermark has not passed


def test_no_frames(spark):
    events = stream_motion_events(spark.readStream.format("rate").load().selectExpr(
        "1 clip_id", "value frame_index", "16.0D fps", "true decoded", "array(named_struct('x',1,'y',1,'w',1,'h',1)) boxes", "0.1D score", "false uncertain"),
        CONFIG, "1 second")
    assert events.columns == ["clip_id", "event_id", "start", "end", "samples", "score", "peak", "uncertain", "boxes"]
    assert events.isStreaming
