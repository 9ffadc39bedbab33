import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.config import MotionConfig
from webloom.fixed_values import (
    ERROR_FRAME_RATE, ERROR_NO_FRAMES, ERROR_RESOLUTION, WARN_DECODE, WARN_FEW_SAMPLES, WARN_TRUNCATED, WARN_UNASSESSABLE,
)
from webloom.functions.files import file_tag, fingerprint, path_parts, peak_stamp, relative_path
from webloom.operators import motion as mo, state as st
from webloom.plans.motion_triage import triage
from webloom.schemas import CLIPS, FRAMES

PROFILES = {"cam": {"width": 320, "height": 240, "rectangle": [0, 0, 160, 240]}}


def frame(clip, index, boxes=(), score=0.0, uncertain=False, fps=16.0, width=320, decoded=True, matches=False):
    return (clip, index, fps, width, 240, decoded, [tuple(b) for b in boxes], float(score), uncertain, matches)


def random_clips(seed, clips=12):
    rng = random.Random(seed)
    rows = []
    for clip in range(clips):
        fps = rng.choice([16.0, 8.0, 3.0])
        busy = rng.random()
        for index in range(0, rng.randint(1, 160)):
            boxes = [(rng.randrange(0, 90, 15), rng.randrange(0, 60, 15), 10, 10) for _ in range(rng.randint(1, 2))]
            rows.append(frame(clip, index, boxes if rng.random() < busy else (), rng.randint(0, 6) / 100,
                              rng.random() < 0.1, fps, decoded=rng.random() < 0.95))
    return rows


def by_clip(rows, cfg):
    """Sampled, decoded rows per clip in order, with the time step."""
    clips = {}
    for r in sorted(rows, key=lambda r: r[:2]):
        step = max(1, int(r[2] / cfg.sample_fps))
        if r[1] % step == 0 and r[5]:
            clips.setdefault(r[0], []).append((r[1], r[1] / r[2], step / r[2], r[6], r[7], r[8]))
    return clips


def touching(one, other):
    def near(a, b, i):
        return a[i] - 12 <= b[i] + b[i + 2] and b[i] - 12 <= a[i] + a[i + 2]
    return any(near(a, b, 0) and near(a, b, 1) for a in one for b in other)


def machine(rows, cfg, legacy=False):
    """The rules as a state machine that sees one sample after another."""
    found = []
    for clip, samples in by_clip(rows, cfg).items():
        current, previous_boxes = None, None
        for _, ts, interval, boxes, score, uncertain in samples[1:]:
            active = bool(boxes) or (legacy and uncertain)
            if not legacy and current is not None:
                late = ts - current["end"] > max(cfg.max_event_gap, interval * 1.5)
                if late or (boxes and not touching(previous_boxes, boxes)):
                    current = None
            if active:
                if current is None:
                    current = {"clip": clip, "start": max(0, ts - interval), "samples": 0, "score": None, "uncertain": False}
                    found.append(current)
                current["end"] = ts
                current["samples"] += 1
                current["uncertain"] |= uncertain
                previous_boxes = boxes
                if current["score"] is None or score > current["score"]:
                    current |= {"score": score, "peak": ts, "boxes": boxes}
            elif current is not None and ts - current["end"] > cfg.event_gap:
                current = None
    least = 1 if legacy else cfg.min_event_samples
    return sorted(
        (e["clip"], e["start"], e["end"], e["samples"], e["score"], e["peak"], e["uncertain"], e["boxes"])
        for e in found if e["samples"] >= least
    )


def collected(events):
    columns = ["clip_id", "start", "end", "samples", "score", "peak", "uncertain", "boxes"]
    return sorted((*r[:-1], [tuple(b) for b in r[-1]]) for r in events.select(*columns).collect())


@pytest.mark.parametrize("piece_rows", [3, 16, 100000])
@pytest.mark.parametrize("cfg", [MotionConfig(), MotionConfig(max_event_gap=1.5, event_gap=0.5, min_event_samples=1)])
def test_events_follow_the_state_machine(spark, piece_rows, cfg):
    rows = random_clips(piece_rows)
    samples = mo.frame_sampling(spark.createDataFrame(rows, FRAMES).repartition(6), cfg)
    assert collected(mo.motion_events(samples, cfg, piece_rows)) == machine(rows, cfg)
    assert collected(mo.motion_events_legacy(samples, cfg, piece_rows)) == machine(rows, cfg, legacy=True)


BOX = (20, 80, 30, 50)
MOVING = [(20 + i, 80, 30, 50) for i in range(60)]


def scenario_frames():
    """Clips by name, after the classes a motion monitor has to tell apart."""
    clips = {
        "static": [frame(0, i) for i in range(48)],
        "moving": [frame(1, i, [MOVING[i]] if i > 2 else (), 0.02) for i in range(48)],
        "short": [frame(2, i, [BOX] if 10 <= i <= 14 else (), 0.02) for i in range(48)],
        "one frame": [frame(3, i, [BOX] if i == 10 else (), 0.02) for i in range(48)],
        "1 fps": [frame(4, i, [MOVING[3 * i]], 0.02, fps=1.0) for i in range(10)],
        "known view": [frame(5, i, [MOVING[i]], 0.02, matches=True) for i in range(48)],
        "uncertain": [frame(6, i, [MOVING[i]], 0.02, uncertain=True) for i in range(48)],
        "faint": [frame(7, i, [MOVING[i]], 0.001) for i in range(48)],
        "other size": [frame(8, i, width=640 if i == 20 else 320) for i in range(48)],
        "no rate": [frame(9, i, fps=0.0) for i in range(48)],
        "undecoded": [frame(10, i, decoded=False) for i in range(48)],
        "tiny": [frame(11, i) for i in range(3)],
        "half decoded": [frame(12, i, decoded=i % 4 == 0) for i in range(16)],
        "flicker apart": [frame(13, i, [(i * 40 % 280, 0, 5, 5)], 0.02) for i in range(48)],
    }
    return clips, [r for rows in clips.values() for r in rows]


def scenario_clips(spark, names):
    rows = [(i, f"/v/2024/{n}.mp4", "cam", 0.0 if n == "no rate" else 1.0 if n == "1 fps" else 16.0, 48, 90 if n == "static" else 48)
            for i, n in enumerate(names)]
    rows.append((99, "/v/broken.mp4", "cam", 16.0, 0, 48))
    return spark.createDataFrame(rows, CLIPS)


def test_scenarios(spark):
    clips, rows = scenario_frames()
    names = list(clips)
    result = triage(scenario_clips(spark, names), spark.createDataFrame(rows, FRAMES), PROFILES, MotionConfig(), "/v")
    report = {r.clip_id: r for r in result.report.collect()}
    kind = {n: report[i].classification for i, n in enumerate(names)}
    assert kind == {
        "static": "REVIEW", "moving": "HIGH_PRIORITY", "short": "REVIEW", "one frame": "NO_RELEVANT_MOTION", "1 fps": "HIGH_PRIORITY",
        "known view": "UNASSESSABLE", "uncertain": "REVIEW", "faint": "REVIEW", "other size": "REVIEW", "no rate": "REVIEW",
        "undecoded": "REVIEW", "tiny": "REVIEW", "half decoded": "REVIEW", "flicker apart": "NO_RELEVANT_MOTION",
    }
    error = {n: report[i].error_details for i, n in enumerate(names)}
    assert error["static"] == WARN_TRUNCATED and error["moving"] == "" and error["known view"] == WARN_UNASSESSABLE
    assert error["other size"] == ERROR_RESOLUTION and error["no rate"] == ERROR_FRAME_RATE
    assert error["undecoded"] == ERROR_NO_FRAMES and report[99].error_details == ERROR_NO_FRAMES
    assert error["tiny"] == WARN_FEW_SAMPLES and error["half decoded"] == "; ".join([WARN_DECODE] * 4)
    failed = {i for i, r in report.items() if r.processing_status == "Failed"}
    assert failed == {names.index("other size"), names.index("no rate"), names.index("undecoded"), 99}
    assert report[99].motion_score is None and report[0].motion_score == 0.0 and report[0].motion_start is None
    assert (report[1].date, report[1].filename, report[99].date) == ("2024", "moving.mp4", "")
    counts = {r.outcome: r.clips for r in st.class_counts(result.report).collect()}
    assert counts == {"Failed": 4, "HIGH_PRIORITY": 2, "UNASSESSABLE": 1, "NO_RELEVANT_MOTION": 2, "REVIEW": 6}


def test_static_without_warnings_has_no_motion(spark):
    rows = [frame(0, i) for i in range(48)]
    clips = spark.createDataFrame([(0, "/v/a.mp4", "cam", 16.0, 48, 48)], CLIPS)
    report = triage(clips, spark.createDataFrame(rows, FRAMES), PROFILES, MotionConfig(), "/v").report.first()
    assert (report.classification, report.date, report.error_details) == ("NO_RELEVANT_MOTION", "", "")


def test_second_run_has_nothing_pending(spark):
    files = spark.createDataFrame([("/v/a.mp4", 10, 5), ("/v/b.mp4", 11, 6)], "path STRING, size BIGINT, mtime BIGINT")
    printed = files.select("path", fingerprint(F.col("size"), F.col("mtime"), F.lit("sig")).alias("fingerprint"))
    empty = spark.createDataFrame([], "path STRING, fingerprint STRING, processing_status STRING, updated_at BIGINT")
    pending = st.pending_files(printed, empty)
    assert pending.count() == 2
    outcome = F.when(F.col("path") == "/v/b.mp4", "Failed").otherwise("Success")
    state = st.state_upsert(empty, pending.withColumn("processing_status", outcome).withColumn("updated_at", F.lit(1).cast("long")))
    assert st.pending_files(printed, state).count() == 0
    assert [r.path for r in st.pending_files(printed, state, retry_failed=True).collect()] == ["/v/b.mp4"]
    again = state.withColumn("updated_at", F.lit(2).cast("long")).withColumn("processing_status", F.lit("Success"))
    merged = st.state_upsert(state, again)
    assert merged.count() == 2 and {r.processing_status for r in merged.collect()} == {"Success"}


def test_frame_samples_and_limit(spark):
    rows = [(1, 0, 0, 56.0, 1, 2, 3, 4, 100000), (1, 0, 1, 55.9, 0, 0, 1, 1, 100000), (1, 0, 2, 60.0, 5, 6, 7, 8, 100000),
            (2, 0, 0, 8.0, 0, 0, 1, 1, 100), (2, 0, 1, 9.0, 0, 0, 1, 1, 100)]
    df = spark.createDataFrame(rows, "clip_id INT, frame_index INT, k INT, area DOUBLE, x INT, y INT, w INT, h INT, frame_size BIGINT")
    got = {r.clip_id: ([tuple(b) for b in r.boxes], r.score) for r in mo.frame_samples(df, MotionConfig()).collect()}
    assert got == {1: ([(1, 2, 3, 4), (5, 6, 7, 8)], 116.0 / 100000), 2: ([(0, 0, 1, 1)], 9.0 / 100)}


def test_top_events_keep_event_order_on_ties(spark):
    events = spark.createDataFrame([(1, i, 0.5 if i % 2 else 0.25, float(i)) for i in range(1, 9)],
                                   "clip_id INT, event_id BIGINT, score DOUBLE, peak DOUBLE")
    got = mo.top_events(events, MotionConfig(max_screenshots=5), piece_rows=2).orderBy("rank").collect()
    assert [(r.event_id, r.rank) for r in got] == [(1, 1), (3, 2), (5, 3), (7, 4), (2, 5)]
    assert got[0].stamp == "000001-000"


def test_reference_match(spark):
    rng = np.random.default_rng(1)
    scene = rng.uniform(0, 200, 400)
    vectors = [scene + 20, scene + rng.normal(0, 1, 400), rng.uniform(0, 200, 400), np.full(400, 9.0), scene[:10], scene * 0.5]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(6, None)]
    df = spark.createDataFrame(rows, "i INT, v ARRAY<DOUBLE>").repartition(3)
    got = {r.i: r.m for r in df.select("i", mo.reference_match(F.col("v"), scene.tolist()).alias("m")).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
    flat = df.select("i", mo.reference_match(F.col("v"), [5.0] * 400).alias("m"))
    assert not any(r.m for r in flat.collect())


def test_settings_and_signature():
    with pytest.raises(ValueError):
        MotionConfig(sample_fps=0)
    with pytest.raises(ValueError):
        MotionConfig(sensitivity="max")


def test_signature_follows_settings_and_profile(spark):
    def of(config=MotionConfig(), profiles=PROFILES):
        return dict(mo.profile_signatures(spark.range(1), profiles, config).collect())

    base = of()
    assert base == of(profiles={n: dict(reversed(p.items())) for n, p in PROFILES.items()}) and all(len(v) == 64 for v in base.values())
    assert base["cam"] != of(MotionConfig(sensitivity="low"))["cam"]
    assert base["cam"] != of(profiles={**PROFILES, "cam": {**PROFILES["cam"], "rectangle": [1, 2, 3, 4]}})["cam"]
    assert base["cam"] != of(profiles={"other": PROFILES["cam"]})["other"]


def test_path_functions(spark):
    df = spark.createDataFrame([("/v/2024/x/clip.a.MP4",), ("/v/top",), ("/v/.hidden",)], "path STRING")
    parts = path_parts(relative_path(F.col("path"), "/v"))
    got = [tuple(r) for r in df.select(*[parts[n] for n in ("date", "filename", "stem", "extension")]).collect()]
    assert got == [("2024", "clip.a.MP4", "clip.a", ".MP4"), ("", "top", "top", ""), ("", ".hidden", ".hidden", "")]
    tag = df.select(file_tag(F.lit("a/b"), F.lit("s"), F.lit("1:2:s")), peak_stamp(F.lit(12.3456))).first()
    import hashlib
    assert tuple(tag) == (hashlib.sha256(b"a/bs1:2:s").hexdigest()[:12], "000012-346")
