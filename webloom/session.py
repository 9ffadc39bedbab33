"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ARROW_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # HTML rows are wide: keep the batches handed to Python small.
    ARROW_BATCH: "1000",
}


# Per application, the folder of the package's archive; removed when the process ends.
_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def prepare(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, and keep Arrow batches
    small unless the session says otherwise.

    Not needed where the package is installed on every machine or given as ``--py-files``.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    if spark.conf.get(ARROW_BATCH, None) is None:
        spark.conf.set(ARROW_BATCH, SETTINGS[ARROW_BATCH])
    package = os.path.dirname(os.path.abspath(__file__))
    root, name = os.path.split(package)
    folder = _shipped[context.applicationId] = tempfile.TemporaryDirectory(prefix="webloom-package-")
    context.addPyFile(shutil.make_archive(os.path.join(folder.name, name), "zip", root, name))


def build_session(app_name: str = "webloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    prepare(spark)
    return spark


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster the
    other machines could not read it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="webloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Several later steps can then share it without computing it again, and a lost
    executor costs a re-read instead of a re-parse.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a small scan enough partitions to keep all cores busy in Python code.

    Meant for plain scans; one that already has a partition per core is left alone,
    so large inputs are never shuffled for this.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
