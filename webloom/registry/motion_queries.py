"""Queries over motion samples, clips and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.config import MotionConfig
from webloom.fixed_values import (
    ERROR_FRAME_RATE, ERROR_NO_FRAMES, ERROR_RESOLUTION, WARN_DECODE, WARN_FEW_SAMPLES, WARN_TRUNCATED,
    WARN_UNASSESSABLE,
)
from webloom.functions.files import fingerprint
from webloom.operators import motion as mo, state as st
from webloom.plans.motion_triage import triage, triage_pending
from webloom.registry.catalog import query
from webloom.registry.fixtures import PROFILES, SHARED
from webloom.registry.url_queries import PRINT
from webloom.session import materialize, new_folder
from webloom.streaming.intake import intake_results, run_intake
from webloom.streaming.motion import stream_motion_events
from webloom.streaming.sessions import backfill_sessions, read_stream, run_to_table

CONFIG = MotionConfig()
MOTION = "fx_frames fx_clips"

SAMPLES = """s AS (SELECT *, frame_index / fps AS ts, 2 / fps AS interval FROM fx_frames
    WHERE fps > 0 AND frame_index % greatest(1, CAST(floor(fps / 8) AS BIGINT)) = 0)"""
COMPARED = """p AS (SELECT *, lag(ts) OVER (PARTITION BY clip_id ORDER BY frame_index) AS prev_ts FROM s WHERE decoded),
  q AS (SELECT * FROM p WHERE prev_ts IS NOT NULL)"""
BOXED = """b AS (SELECT *, lag(ts) OVER w AS last_ts, lag(x) OVER w AS lx, lag(y) OVER w AS ly FROM q WHERE boxed
    WINDOW w AS (PARTITION BY clip_id ORDER BY frame_index)),
  n AS (SELECT *, CASE WHEN last_ts IS NULL OR ts - last_ts > greatest(0.35::DOUBLE, interval * 1.5)
      OR NOT (lx - 12 <= x + w AND x - 12 <= lx + 20 AND ly - 12 <= y + h AND y - 12 <= ly + 20)
      OR prev_ts - last_ts > 0.7::DOUBLE THEN 1 ELSE 0 END AS starts FROM b),
  i AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY clip_id ORDER BY frame_index
      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event_id FROM n)"""
SUMMARY = """SELECT clip_id, event_id, greatest(0, min(ts) - min(interval)) AS start, max(ts) AS "end", count(*) AS samples,
    max(score) AS score, first(ts ORDER BY score DESC, frame_index) AS peak, bool_or(uncertain) AS uncertain,
    first(CASE WHEN boxed THEN x END ORDER BY score DESC, frame_index) AS box_x,
    first(CASE WHEN boxed THEN y END ORDER BY score DESC, frame_index) AS box_y
    FROM i GROUP BY ALL"""
EVENTS = f"{SAMPLES}, {COMPARED}, {BOXED}, e AS (SELECT * FROM ({SUMMARY}) WHERE samples >= 2)"
CHECKED = f"""k AS (SELECT clip_id, count(*) FILTER (decoded) AS sampled, count(*) FILTER (NOT decoded) AS decode_failures,
      count(*) FILTER (decoded AND view_matches) AS matched, count(*) FILTER (decoded AND width <> 320) AS other_size
      FROM s GROUP BY clip_id),
  c AS (SELECT c.*, coalesce(sampled, 0) AS sampled, coalesce(decode_failures, 0) AS decode_failures,
      coalesce(matched, 0) AS matched, CASE WHEN NOT fps > 0 THEN '{ERROR_FRAME_RATE}'
        WHEN other_size > 0 THEN '{ERROR_RESOLUTION}'
        WHEN coalesce(sampled, 0) = 0 THEN '{ERROR_NO_FRAMES}' END AS failure
      FROM fx_clips c LEFT JOIN k USING (clip_id)),
  d AS (SELECT *, matched / sampled >= 0.95 AS blind, nullif(concat_ws('; ',
      CASE WHEN decode_failures > 0 THEN array_to_string(list_transform(range(decode_failures), lambda j: '{WARN_DECODE}'), '; ') END,
      CASE WHEN expected_frames > 0 AND frames < expected_frames - greatest(2, fps * 0.2::DOUBLE) THEN '{WARN_TRUNCATED}' END,
      CASE WHEN sampled < 3 THEN '{WARN_FEW_SAMPLES}' END), '') AS warned FROM c),
  x AS (SELECT *, concat_ws('; ', warned, CASE WHEN blind THEN '{WARN_UNASSESSABLE}' END) AS warnings FROM d)"""
REPORT = f"""{EVENTS}, {CHECKED},
  y AS (SELECT clip_id, count(*) AS events, bool_or(samples >= 3 AND "end" - start >= 0.5::DOUBLE
        AND score >= 0.012::DOUBLE * 0.7::DOUBLE AND NOT uncertain) AS high,
      min(start) AS motion_start, max("end") AS motion_end, sum("end" - start) AS motion_duration,
      max(score) AS motion_score FROM e GROUP BY clip_id),
  z AS (SELECT *, failure IS NULL AS ok, CASE WHEN failure IS NOT NULL THEN 'REVIEW' WHEN blind THEN 'UNASSESSABLE'
      WHEN high THEN 'HIGH_PRIORITY' WHEN coalesce(events, 0) > 0 OR warned IS NOT NULL THEN 'REVIEW'
      ELSE 'NO_RELEVANT_MOTION' END AS classification FROM x LEFT JOIN y USING (clip_id))"""


def _samples(t):
    return mo.frame_sampling(t.frames(), CONFIG)


def _flat(events):
    """Boxes as two plain columns, comparable across engines."""
    box = F.get(F.col("boxes"), F.lit(0))
    return events.select(
        *[c for c in events.columns if c != "boxes"], box["x"].alias("box_x"), box["y"].alias("box_y")
    )


@query(
    "frame_sampling",
    f"WITH {SAMPLES} SELECT clip_id, frame_index, ts, interval, decoded, score, uncertain FROM s", "fx_frames",
)
def _(t):
    return _samples(t).select("clip_id", "frame_index", "ts", "interval", "decoded", "score", "uncertain")


LARGE = "area >= greatest(9::DOUBLE, frame_size * 0.0008::DOUBLE * 0.7::DOUBLE)"


@query("detections_filtered", f"SELECT * FROM fx_detections WHERE {LARGE}", "fx_detections")
def _(t):
    return mo.detections_filtered(t.detections(), CONFIG)


@query(
    "frame_samples",
    f"""SELECT clip_id, frame_index, sum(area) / max(frame_size) AS score, count(*) AS boxes, min(y) AS first_y
        FROM fx_detections WHERE {LARGE} GROUP BY ALL""", "fx_detections",
)
def _(t):
    rows = mo.frame_samples(t.detections(), CONFIG)
    return rows.select(
        "clip_id", "frame_index", "score", F.size("boxes").cast("long").alias("boxes"),
        F.get(F.col("boxes"), F.lit(0))["y"].alias("first_y"),
    )


@query("motion_events", f"WITH {EVENTS} SELECT * FROM e", "fx_frames")
def motion_events(t):
    return _flat(mo.motion_events(_samples(t), CONFIG))


LEGACY = f"""{SAMPLES}, {COMPARED},
  b AS (SELECT *, lag(ts) OVER (PARTITION BY clip_id ORDER BY frame_index) AS last_ts FROM q WHERE boxed OR uncertain),
  n AS (SELECT *, CASE WHEN last_ts IS NULL OR prev_ts - last_ts > 0.7::DOUBLE THEN 1 ELSE 0 END AS starts FROM b),
  i AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY clip_id ORDER BY frame_index
      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event_id FROM n)"""


@query("motion_events_legacy", f"WITH {LEGACY} {SUMMARY}", "fx_frames")
def _(t):
    return _flat(mo.motion_events_legacy(_samples(t), CONFIG))


@query(
    "top_events",
    f"""WITH {EVENTS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY score DESC, event_id) AS INT) AS rank FROM e)
        SELECT clip_id, event_id, rank, score, replace(printf('%010.3f', peak), '.', '-') AS stamp FROM r WHERE rank <= 8""",
    "fx_frames",
)
def _(t):
    return mo.top_events(mo.motion_events(_samples(t), CONFIG), CONFIG)


# Read back from the JSON text, as its spelling of numbers differs by engine.
EVENT_FIELDS = "start DOUBLE, `end` DOUBLE, samples BIGINT, score DOUBLE, uncertain BOOLEAN, peak DOUBLE"


@query(
    "events_json",
    f"""WITH {EVENTS} SELECT clip_id, event_id, start, "end", samples, score, uncertain, peak FROM e""", "fx_frames",
)
def _(t):
    rows = mo.events_json(mo.motion_events(_samples(t), CONFIG))
    return rows.select("clip_id", "event_id", F.from_json("event_json", EVENT_FIELDS).alias("e")).select("clip_id", "event_id", "e.*")


def _checked(t):
    return mo.profile_check(t.clips(), mo.clip_samples(_samples(t)), PROFILES)


@query(
    "profile_check", f"WITH {SAMPLES}, {CHECKED} SELECT clip_id, camera_profile, sampled, failure FROM c", MOTION,
)
def _(t):
    return _checked(t).select("clip_id", "camera_profile", "sampled", "failure")


@query("clip_warnings", f"WITH {SAMPLES}, {CHECKED} SELECT clip_id, warnings FROM x WHERE failure IS NULL", MOTION)
def _(t):
    return mo.clip_warnings(_checked(t))


@query("clip_class", f"WITH {REPORT} SELECT clip_id, classification FROM z", MOTION)
def _(t):
    return mo.clip_class(_checked(t), mo.motion_events(_samples(t), CONFIG), CONFIG)


@query(
    "clip_class_legacy",
    f"""WITH {LEGACY}, e AS ({SUMMARY}), {CHECKED},
        y AS (SELECT clip_id, bool_or(samples >= 3 AND "end" - start >= 0.5::DOUBLE
          AND score >= 0.012::DOUBLE * 0.7::DOUBLE AND NOT uncertain) AS high, count(*) AS events FROM e GROUP BY clip_id)
        SELECT clip_id, CASE WHEN failure IS NOT NULL THEN 'REVIEW' WHEN high THEN 'HIGH_PRIORITY'
          WHEN coalesce(events, 0) > 0 OR warned IS NOT NULL THEN 'REVIEW' ELSE 'NO_RELEVANT_MOTION' END AS classification
        FROM x LEFT JOIN y USING (clip_id)""", MOTION,
)
def _(t):
    return mo.clip_class(_checked(t), mo.motion_events_legacy(_samples(t), CONFIG), CONFIG, legacy=True)


@query(
    "clip_report",
    f"""WITH {REPORT} SELECT clip_id,
        CASE WHEN contains(substr(path, 4), '/') THEN split_part(path, '/', 3) ELSE '' END AS date,
        regexp_extract(path, '[^/]*$', 0) AS filename, path AS original_path, classification,
        CASE WHEN ok THEN motion_start END AS motion_start, CASE WHEN ok THEN motion_end END AS motion_end,
        CASE WHEN ok THEN coalesce(motion_duration, 0) END AS motion_duration,
        CASE WHEN ok THEN coalesce(motion_score, 0) END AS motion_score,
        CASE WHEN ok THEN 'Success' ELSE 'Failed' END AS processing_status,
        CASE WHEN ok THEN warnings ELSE failure END AS error_details, camera_profile FROM z""", MOTION,
)
def clip_report(t):
    return triage(t.clips(), t.frames(), PROFILES, CONFIG, "/v").report


@query(
    "class_counts",
    f"""WITH {REPORT} SELECT CASE WHEN NOT ok THEN 'Failed' WHEN clip_id % 5 = 2 THEN 'Skipped' ELSE classification END AS outcome,
        count(*) AS clips FROM z GROUP BY ALL""", MOTION,
)
def _(t):
    report = triage(t.clips(), t.frames(), PROFILES, CONFIG, "/v").report
    # Every fifth clip stands for one an earlier run has done.
    done = (F.col("processing_status") == "Success") & (F.col("clip_id") % 5 == 2)
    status = F.when(done, "Skipped").otherwise(F.col("processing_status"))
    return st.class_counts(report.withColumn("processing_status", status))


@query(
    "motion_triage_incremental",
    f"""WITH {REPORT}, r AS (SELECT 1 AS run, path, CASE WHEN ok THEN 'Success' ELSE 'Failed' END AS processing_status FROM z
          WHERE clip_id % 3 <> 1
        UNION ALL SELECT 2, path, CASE WHEN ok THEN 'Success' ELSE 'Failed' END FROM z
          WHERE clip_id % 3 = 1 OR clip_id % 5 = 0 OR camera_profile = 'camera2')
        SELECT run, path, processing_status FROM r""", MOTION,
)
def _(t):
    # The second run sees all clips: a third is new, a fifth has changed on disk, one camera got another
    # profile, whose clips of the first run are done again. A third run has nothing left to do.
    files = t.clips().withColumns({"size": F.col("clip_id") * 10, "mtime": F.col("clip_id").cast("long")})
    files, frames = materialize(files, "clip-files"), t.frames()
    empty = t.spark.createDataFrame([], "path STRING, fingerprint STRING, processing_status STRING, updated_at BIGINT")
    first = triage_pending(files.filter("clip_id % 3 <> 1"), frames, empty, PROFILES, CONFIG, "/v", 1)
    changed = files.withColumn("mtime", F.col("mtime") + F.when(F.col("clip_id") % 5 == 0, 1).otherwise(0))
    moved = {**PROFILES, "camera2": {**PROFILES["camera2"], "rectangle": [0, 0, 320, 200]}}
    second = triage_pending(changed, frames, first.state, moved, CONFIG, "/v", 2)
    third = triage_pending(changed, frames, second.state, moved, CONFIG, "/v", 3)
    runs = [run.report.select(F.lit(n).alias("run"), F.col("original_path").alias("path"), "processing_status")
            for n, run in enumerate((first, second, third), 1)]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


LIMITS = {"min_correlation": 0.2, "max_difference": 30.0}


@query(
    "reference_match",
    """WITH r AS (SELECT unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) * 100 AS r
         FROM embeddings WHERE vec_id = 0),
       v AS (SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) * 100 AS x FROM embeddings),
       m AS (SELECT vec_id, x, r, x - r - median(x - r) OVER (PARTITION BY vec_id) AS d FROM v JOIN r USING (i))
       SELECT vec_id, stddev_pop(x) >= 5 AND stddev_pop(r) >= 5 AND corr(x, r) > 0.2
         AND quantile_cont(abs(d), 0.95) < 30 AS matches FROM m GROUP BY vec_id""",
)
def _(t):
    rows = t.table("embeddings").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double") * 100).alias("scene")
    )
    # The reference view is one vector of the camera profile.
    reference = rows.filter("vec_id = 0").first()["scene"]
    return rows.select("vec_id", mo.reference_match(F.col("scene"), reference, **LIMITS).alias("matches"))


# --- streams ---
@query(
    "stream_sessions",
    """WITH b AS (SELECT user_id AS clip_id, ts, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS last_ts
         FROM events WHERE event_type <> 'error'),
       i AS (SELECT *, sum(CASE WHEN last_ts IS NULL OR ts - last_ts > INTERVAL 6 HOUR THEN 1 ELSE 0 END)
         OVER (PARTITION BY clip_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b)
       SELECT clip_id, min(ts) AS start, max(ts) AS "end", count(*) AS samples, max(value) AS score
       FROM i GROUP BY clip_id, k""",
)
def _(t):
    schema = t.table("events").schema
    events = read_stream(t.spark, t.folder, "events.parquet", schema).filter("event_type <> 'error'")
    samples = events.select(F.col("user_id").alias("clip_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("score"))
    return backfill_sessions(samples, gap="6 hours", lateness="1 hour")


@query("stream_motion_events", f"WITH {EVENTS} SELECT * FROM e", "fx_frames")
def _(t):
    # Frames arrive in files that hold some of every clip, in two batches; one far later frame settles all.
    folder, path = new_folder(t.spark, "frame-stream"), new_folder(t.spark, "stream-events")
    frames = t.frames()
    frames.repartition(8, F.xxhash64("clip_id", "frame_index")).write.parquet(folder)
    stream = t.spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 4).parquet(folder)
    events = stream_motion_events(stream, CONFIG, "30 days")
    progress = new_folder(t.spark, "stream-events-progress")
    run_to_table(events, path, progress)
    late = frames.limit(1).withColumn("clip_id", F.lit(-1).cast(frames.schema["clip_id"].dataType)).withColumn(
        "frame_index", F.lit(16 * 86_400 * 365).cast("long")).withColumn("fps", F.lit(16.0)).withColumn("decoded", F.lit(True))
    late.write.mode("append").parquet(folder)
    run_to_table(events, path, progress)
    return _flat(t.spark.read.schema(events.schema).parquet(path))


@query(
    "stream_intake",
    f"SELECT path, {PRINT} AS fingerprint, 'Success' AS processing_status FROM fx_files", "fx_files",
)
def _(t):
    schema = t.table("pages").select("page_id").schema
    pages = read_stream(t.spark, t.folder, "pages.parquet", schema)
    pages.createOrReplaceTempView("webloom_page_stream")
    files = t.spark.sql(SHARED["fx_files"].replace("FROM pages", "FROM webloom_page_stream"))
    arrived = files.select("path", fingerprint(F.col("size"), F.col("mtime"), F.lit("sig")).alias("fingerprint"))
    state, progress = new_folder(t.spark, "intake-state"), new_folder(t.spark, "intake-progress")

    def process(batch):
        return batch.withColumn("processing_status", F.lit("Success"))

    # The second run starts from the recorded progress and finds nothing new.
    for _ in range(2):
        run_intake(arrived, state, progress, process)
    return intake_results(t.spark, state).drop("batch_id")
