from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webloom.registry import catalog, motion_queries  # noqa: F401
from webloom.session import new_folder
from webloom.streaming.intake import BatchTable, intake_batch, intake_results, run_intake
from webloom.streaming.sessions import backfill_sessions, read_stream, run_to_table, session_events

START = datetime(2024, 1, 1)


def write_samples(spark, folder, rows):
    data = [(clip, START + timedelta(seconds=s), score) for clip, s, score in rows]
    spark.createDataFrame(data, "clip_id INT, ts TIMESTAMP, score DOUBLE").coalesce(1).write.mode("append").parquet(folder)


def spans(df):
    return sorted((r.clip_id, (r.start - START).total_seconds(), (r.end - START).total_seconds(), r.samples, r.score) for r in df.collect())


SAMPLES = [(1, 0, 0.1), (1, 2, 0.3), (1, 4, 0.2), (1, 7, 0.5), (2, 1, 0.1), (2, 30, 0.2)]
# A gap exactly as long as allowed (2 s) does not split.
SESSIONS = [(1, 0.0, 4.0, 3, 0.3), (1, 7.0, 7.0, 1, 0.5), (2, 1.0, 1.0, 1, 0.1), (2, 30.0, 30.0, 1, 0.2)]


def stream(spark, folder):
    return spark.readStream.schema("clip_id INT, ts TIMESTAMP, score DOUBLE").parquet(folder)


def test_backfill_finds_all_sessions(spark):
    folder = new_folder(spark, "samples")
    write_samples(spark, folder, SAMPLES)
    assert spans(backfill_sessions(stream(spark, folder), "2 seconds", "1 second")) == SESSIONS
    assert spans(session_events(spark.read.parquet(folder), "2 seconds")) == SESSIONS


def test_append_mode_releases_closed_sessions_once(spark):
    folder, out, progress = (new_folder(spark, n) for n in ("samples", "sessions", "progress"))
    write_samples(spark, folder, SAMPLES)
    sessions = session_events(stream(spark, folder), "2 seconds", "1 second")
    run_to_table(sessions, out, progress)
    table = spark.read.schema(sessions.schema).parquet(out)
    assert spans(table) == SESSIONS[:3]
    # A later sample moves the watermark on and closes the last one; a late one is ignored.
    write_samples(spark, folder, [(9, 100, 0.0)])
    run_to_table(sessions, out, progress)
    write_samples(spark, folder, [(1, 5, 0.9)])
    run_to_table(sessions, out, progress)
    assert spans(spark.read.schema(sessions.schema).parquet(out)) == SESSIONS


def write_pages(spark, path, ids, files=1):
    spark.createDataFrame([(i, str(i % 3)) for i in ids], "page_id BIGINT, host STRING").repartition(files).write.mode("append").parquet(path)


def test_a_table_of_part_files_is_streamed_whole(spark):
    """Name by name: one file, a folder of files, a partitioned folder; tables beside it are not listed."""
    folder, schema = new_folder(spark, "tables"), "page_id BIGINT, host STRING"
    write_pages(spark, f"{folder}/parts.parquet", range(20), 3)
    write_pages(spark, f"{folder}/other/parts.parquet", range(100, 120))
    spark.read.parquet(f"{folder}/parts.parquet").write.partitionBy("host").parquet(f"{folder}/hosts.parquet")
    one = spark.read.parquet(f"{folder}/parts.parquet").toPandas()
    one.to_parquet(f"{folder}/one.parquet", index=False)

    for name in ("parts.parquet", "hosts.parquet", "one.parquet", "par*.parquet"):
        out, progress = new_folder(spark, "streamed"), new_folder(spark, "progress")
        rows = read_stream(spark, folder, name, schema)
        run_to_table(rows, out, progress)
        assert sorted(map(tuple, spark.read.schema(schema).parquet(out).collect())) == [(i, str(i % 3)) for i in range(20)], name
    # Files that a folder gets later are read by the next run, and nothing else.
    out, progress = new_folder(spark, "streamed"), new_folder(spark, "progress")
    rows = read_stream(spark, folder, "parts.parquet", schema)
    run_to_table(rows, out, progress)
    write_pages(spark, f"{folder}/parts.parquet", [20])
    run_to_table(rows, out, progress)
    assert sorted(r.page_id for r in spark.read.schema(schema).parquet(out).collect()) == list(range(21))


def test_intake_query_reads_every_part_of_the_pages(spark):
    folder = new_folder(spark, "tables")
    write_pages(spark, f"{folder}/pages.parquet", range(60), 4)
    got = catalog.QUERIES["stream_intake"](spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(
        (f"/v/{'' if i % 6 == 0 else f'2024010{1 + i % 5}/'}clip{i}.mp4", f"{1000 + i}:{1700000000000000 + i * 10}:sig", "Success")
        for i in range(60))


def add_files(spark, folder, rows):
    spark.createDataFrame(rows, "path STRING, fingerprint STRING").coalesce(1).write.mode("append").parquet(folder)


def test_intake_processes_each_version_once(spark):
    folder, state, progress = (new_folder(spark, n) for n in ("files", "state", "progress"))
    seen = []

    def process(batch):
        seen.append(sorted(map(tuple, batch.collect())))
        return batch.withColumn("processing_status", F.when(F.col("path") == "bad", "Failed").otherwise("Success"))

    def run(**options):
        files = spark.readStream.schema("path STRING, fingerprint STRING").parquet(folder)
        run_intake(files, state, progress, process, **options)

    add_files(spark, folder, [("a", "1"), ("a", "1"), ("bad", "1")])
    run()
    run()
    add_files(spark, folder, [("a", "1"), ("a", "2"), ("bad", "1")])
    run()
    add_files(spark, folder, [("a", "2"), ("bad", "1")])
    run(retry_failed=True)
    assert seen == [[("a", "1"), ("bad", "1")], [("a", "2")], [("bad", "1")]]


def test_repeated_batch_leaves_the_same_state(spark):
    state = new_folder(spark, "state")
    schema = "path STRING, fingerprint STRING, known BOOLEAN"

    def process(batch):
        return batch.withColumn("processing_status", F.when(F.col("path") == "bad", "Failed").otherwise("Success"))

    first = spark.createDataFrame([("a", "1", False), ("bad", "1", False)], schema)
    second = spark.createDataFrame([("a", "1", True), ("bad", "1", True), ("b", "1", False)], schema)
    for batch_id, arrived in ((0, first), (0, first), (1, second), (1, second)):
        intake_batch(arrived, batch_id, state, process, retry_failed=True)
    assert sorted(map(tuple, intake_results(spark, state).collect())) == [
        ("a", "1", "Success", 0), ("b", "1", "Success", 1), ("bad", "1", "Failed", 0), ("bad", "1", "Failed", 1)]


def success(batch):
    return batch.withColumn("processing_status", F.lit("Success"))


def test_a_restart_after_a_failure_processes_nothing_twice(spark):
    folder, state, progress = (new_folder(spark, n) for n in ("files", "state", "progress"))
    add_files(spark, folder, [("a", "1")])
    files = spark.readStream.schema("path STRING, fingerprint STRING").parquet(folder)
    run_intake(files, state, progress, success)

    def broken(batch):
        raise RuntimeError("lost")

    add_files(spark, folder, [("a", "1"), ("b", "1")])
    with pytest.raises(Exception, match="lost"):
        run_intake(files, state, progress, broken)
    run_intake(files, state, progress, success)
    assert sorted(map(tuple, intake_results(spark, state).drop("batch_id").collect())) == [("a", "1", "Success"), ("b", "1", "Success")]


def test_a_batch_reads_no_history(spark):
    """However much was processed before, a batch neither scans earlier results nor keeps its inputs."""
    folder, state, progress = (new_folder(spark, n) for n in ("files", "state", "progress"))
    read, plans = [], []

    def process(batch):
        read.append({f.split("/state-")[1].split("/", 1)[1].rsplit("/", 1)[0] for f in batch.inputFiles()})
        plans.append(batch._jdf.queryExecution().executedPlan().toString())
        return success(batch)

    for i in range(4):
        add_files(spark, folder, [(f"f{j}", str(k)) for j in range(20) for k in range(i + 1)])
        files = spark.readStream.schema("path STRING, fingerprint STRING").parquet(folder)
        run_intake(files, state, progress, process, merge_batches=2)
    # Only the batch's own rows are read, and nothing is joined or shuffled to find what is new.
    assert read == [{f"inbox/batch_id={i}"} for i in range(4)]
    assert not any("Join" in plan or "Exchange" in plan for plan in plans)
    rows = intake_results(spark, state).collect()
    assert len(rows) == 80 and len({(r.path, r.fingerprint) for r in rows}) == 80
    table = BatchTable(spark, f"{state}/results")
    assert table._folders() == ([2, 3], {1: "merged=0-1"})
    table.merge(3)
    table.merge(3)
    assert table._folders() == ([], {1: "merged=0-1", 3: "merged=2-3"}) and table.read().count() == 80


def test_a_merge_that_was_cut_off_changes_nothing(spark):
    table = BatchTable(spark, new_folder(spark, "results"))
    assert table.read().count() == 0 and table.latest(5).count() == 0
    rows = spark.createDataFrame([("a", "1", "Success")], "path STRING, fingerprint STRING, processing_status STRING")
    for batch in range(3):
        table.write(rows, batch)
    table.read().write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{table.path}/merged=0-1")
    assert table.read().count() == 3  # without its mark of completion the folder does not count
    table.merge(1)
    assert table.read().count() == 3 and table._folders() == ([2], {1: "merged=0-1"})
    assert table.latest(2).count() == 0 and [r.batch_id for r in table.latest(3).collect()] == [2]
