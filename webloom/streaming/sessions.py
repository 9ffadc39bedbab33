"""Motion sessions over a stream of boxed samples, by the gap rule alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from webloom.session import new_folder

# Sessions are merged inside each task before the shuffle, so a busy clip sends few rows.
MERGE_BEFORE_SHUFFLE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def session_events(samples: DataFrame, gap: str, lateness: str | None = None) -> DataFrame:
    """Sessions of ``clip_id, ts, score``: a gap longer than ``gap`` starts a new one.

    Works on a stream and on a table. On a stream give ``lateness``: append mode then
    releases a session, and its state, once the watermark has passed its end.
    """
    rows = samples.withWatermark("ts", lateness) if lateness else samples
    grouped = rows.groupBy("clip_id", F.session_window("ts", gap).alias("session"))
    return grouped.agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"),
        F.count(F.lit(1)).alias("samples"), F.max("score").alias("score"),
    ).drop("session")


def read_stream(spark: SparkSession, folder: str, file_name: str, schema: StructType) -> DataFrame:
    """A growing table of Parquet files with the given name or name pattern: files or folders of part files."""
    # In braces an exact name is a pattern too: Spark then takes a single file as well as a folder, and lists nothing beside it.
    root = folder.rstrip("/")
    return spark.readStream.schema(schema).option("basePath", root).parquet(f"{root}/{{{file_name}}}")


def run_to_table(
    sessions: DataFrame, path: str, checkpoint: str, output_mode: str = "append"
) -> None:
    """Process what has arrived and stop.

    Append mode adds the closed sessions to the table. Complete mode rewrites the table
    with all sessions, open ones included; it is for finite backfills only.
    """
    spark = sessions.sparkSession
    before = spark.conf.get(MERGE_BEFORE_SHUFFLE, "false")
    spark.conf.set(MERGE_BEFORE_SHUFFLE, "true")
    try:
        writer = sessions.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
        if output_mode == "append":
            writer = writer.format("parquet").option("path", path)
        else:
            writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(MERGE_BEFORE_SHUFFLE, before)


def backfill_sessions(samples: DataFrame, gap: str, lateness: str) -> DataFrame:
    """All sessions of a finite stream as a table in the shared folder."""
    spark = samples.sparkSession
    path = new_folder(spark, "sessions")
    sessions = session_events(samples, gap, lateness)
    run_to_table(sessions, path, new_folder(spark, "sessions-progress"), "complete")
    return spark.read.schema(sessions.schema).parquet(path)
