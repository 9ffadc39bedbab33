"""Continuous intake: each (path, fingerprint) is processed once, also across restarts.

What has been seen is keyed state of the stream itself, kept by Spark's state store with the
progress of the query. A batch asks for its own keys only, so it costs what has arrived, however long
the history. Results are one folder for each batch, merged into larger ones from time to time; they are
never read to find out what is new. Of earlier results only the files that failed are kept at hand, for
those who want them tried again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

STATE_COLUMNS = ("path", "fingerprint", "processing_status")
STATE_SCHEMA = "path STRING, fingerprint STRING, processing_status STRING, batch_id BIGINT"
#: Result folders that are merged into one.
MERGE_BATCHES = 100
#: On disk, with changes written per batch: the cost of a batch does not grow with the keys.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


# --- what is known ------------------------------------------------------------
def mark_known(files: DataFrame) -> DataFrame:
    """``path, fingerprint, known`` of a stream: each key once per batch, with whether an earlier batch had it."""

    def mark(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        for _ in rows:  # copies within a batch count once
            pass
        known = state.exists
        state.update((True,))
        yield pd.DataFrame({"path": [key[0]], "fingerprint": [key[1]], "known": [known]})

    return files.select("path", "fingerprint").groupBy("path", "fingerprint").applyInPandasWithState(
        mark, "path STRING, fingerprint STRING, known BOOLEAN", "seen BOOLEAN", "update", GroupStateTimeout.NoTimeout)


# --- folders of batches -------------------------------------------------------
class BatchTable:
    """A table in which each batch owns one folder and writes it as a whole.

    ``batch_id=7`` holds one batch, ``merged=100-199`` the batches from 100 to 199. A batch that is repeated
    after a failure leaves the same rows, and a merge that is cut off leaves the batches as they were.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = STATE_SCHEMA) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        self.names = [f.name for f in StructType.fromDDL(schema)]

    def _file_system(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self) -> dict[str, bool]:
        """The folders there are, and whether each is complete."""
        files, path_of = self._file_system()
        if not files.exists(path_of(self.path)):
            return {}
        names = [s.getPath().getName() for s in files.listStatus(path_of(self.path)) if s.isDirectory()]
        return {n: files.exists(path_of(f"{self.path}/{n}/_SUCCESS")) for n in names}

    def _folders(self) -> tuple[list[int], dict[int, str]]:
        """Complete single batches, and complete merged folders by their last batch."""
        done = [name for name, complete in self._names().items() if complete]
        merged = {int(n.rsplit("-", 1)[1]): n for n in done if n.startswith("merged=")}
        return sorted(int(n.split("=")[1]) for n in done if n.startswith("batch_id=")), dict(sorted(merged.items()))

    def _current(self) -> list[str]:
        """The folders that make up the table; a batch that is in a merged folder is not read twice."""
        batches, merged = self._folders()
        last = max(merged, default=-1)
        return [*merged.values(), *(f"batch_id={b}" for b in batches if b > last)]

    def _delete(self, name: str) -> None:
        files, path_of = self._file_system()
        files.delete(path_of(f"{self.path}/{name}"), True)

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        # The number of a batch is a column of its files, so folders of both kinds are read alike.
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*(f"{self.path}/{f}" for f in folders))

    def write(self, rows: DataFrame, batch_id: int) -> None:
        columns = [n for n in self.names if n != "batch_id"]
        rows.select(*columns, F.lit(batch_id).cast("long").alias("batch_id")).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def read(self) -> DataFrame:
        return self._read(self._current())

    def read_batch(self, batch_id: int) -> DataFrame:
        return self._read([f"batch_id={batch_id}"])

    def latest(self, before: int) -> DataFrame:
        """The rows of the last single batch before this one."""
        return self._read([f"batch_id={b}" for b in self._folders()[0] if b < before][-1:])

    def drop(self, below: int) -> None:
        for batch in self._folders()[0]:
            if batch < below:
                self._delete(f"batch_id={batch}")

    def merge(self, upto: int) -> None:
        """One folder for the single batches up to this one, which go once it is complete.

        Earlier merged folders stay as they are: each row is copied once.
        """
        for name, complete in self._names().items():
            if name.startswith("merged=") and not complete:
                self._delete(name)
        batches, merged = self._folders()
        last = max(merged, default=-1)
        single = [b for b in batches if last < b <= upto]
        if single:
            rows = self._read([f"batch_id={b}" for b in single])
            rows.coalesce(1 + len(single) // MERGE_BATCHES).write.parquet(f"{self.path}/merged={single[0]}-{single[-1]}")
            last = single[-1]
        self.drop(last + 1)


# --- batches ------------------------------------------------------------------
def intake_batch(
    arrived: DataFrame, batch_id: int, state_path: str, process: Callable[[DataFrame], DataFrame],
    retry_failed: bool = False, merge_batches: int = MERGE_BATCHES,
) -> None:
    """Process what is new in one micro-batch of ``mark_known`` and record it.

    ``process`` gets the pending files and returns them with ``processing_status``. A file that failed
    before counts as pending again with ``retry_failed``.
    """
    spark = arrived.sparkSession
    results = BatchTable(spark, f"{state_path}/results")
    failures = BatchTable(spark, f"{state_path}/failures")
    inbox = BatchTable(spark, f"{state_path}/inbox", "path STRING, fingerprint STRING, known BOOLEAN, batch_id BIGINT")
    # The stateful part runs once; everything after it goes on from the written rows.
    inbox.write(arrived, batch_id)
    rows = inbox.read_batch(batch_id)
    keys = ["path", "fingerprint"]
    failed = failures.latest(batch_id)
    pending = rows.filter(~F.col("known")).select(*keys)
    if retry_failed:
        again = rows.filter("known").select(*keys).join(failed.select(*keys), keys, "left_semi")
        pending = pending.unionByName(again)
    results.write(process(pending).select(*STATE_COLUMNS), batch_id)
    done = results.read_batch(batch_id)
    still = failed.join(done.select(*keys), keys, "left_anti").unionByName(done.filter("processing_status = 'Failed'"))
    failures.write(still, batch_id)
    # The batch before stays until this one is complete, in case it is repeated.
    failures.drop(batch_id - 1)
    inbox.drop(batch_id - 1)
    if merge_batches and batch_id and batch_id % merge_batches == 0:
        results.merge(batch_id - 1)


def intake_results(spark: SparkSession, state_path: str) -> DataFrame:
    """All results so far: ``path, fingerprint, processing_status, batch_id``."""
    return BatchTable(spark, f"{state_path}/results").read()


def run_intake(
    files: DataFrame, state_path: str, checkpoint: str, process: Callable[[DataFrame], DataFrame],
    retry_failed: bool = False, merge_batches: int = MERGE_BATCHES,
) -> None:
    """Run the intake over everything that has arrived, then stop; progress is kept in ``checkpoint``."""
    spark = files.sparkSession
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        query = (
            mark_known(files).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(lambda batch, n: intake_batch(batch, n, state_path, process, retry_failed, merge_batches))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
