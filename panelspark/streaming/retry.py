"""Extraction with retries (X1, K5): one state a filing, timers for the next try, and an end after so many.

The source called a service for each filing, noted errors and went on; a rerun tried them all again. Here filings
arrive as a file stream; the first try is made when a filing arrives, and a failed one keeps (tries, last
error, text) in the state store and sets a timer. When it fires, the next try is made, later each time. A filing that
failed in all its tries is given up: it goes to the dead letters, its text leaves the state and only the outcome stays.

Each try is one row of a log, written to a folder named by its batch. State, timers and source offsets are committed with
the batch, so a restarted stream loses no filing and repeats none; a filing that arrives again is known by its state.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

DONE, RETRY, GIVEN_UP = "done", "retry", "given_up"
#: One row a try: the filing, which try it was, how it ended, what went wrong, and what was found.
LOG = "key string, tries int, status string, error string, found string"
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Attempts(StatefulProcessor):
    """Tries a filing's extraction now and, where it fails, again by timer. ``attempt``: (text, try) -> found text, or raises."""

    def __init__(self, attempt: Callable[[str, int], str], most: int, delay_ms: int):
        self.attempt, self.most, self.delay_ms = attempt, most, delay_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("filing", "tries int, status string, error string, text string")

    def _try(self, key: str, text: str, tries: int, now: int) -> Row:
        try:
            found, status, error = self.attempt(text, tries), DONE, None
        except Exception as e:  # noqa: BLE001 - whatever went wrong is the filing's outcome
            found, error = None, f"{type(e).__name__}: {e}"
            status = RETRY if tries < self.most else GIVEN_UP
        self.state.update((tries, status, error, text if status == RETRY else None))
        if status == RETRY:  # each wait is twice the one before
            self.handle.registerTimer(now + (self.delay_ms << (tries - 1)))
        return Row(key=key, tries=tries, status=status, error=error, found=found)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            if not self.state.exists():
                yield self._try(key[0], r["text"], 1, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        tries, status, _, text = self.state.get()
        if status == RETRY:
            yield self._try(key[0], text, tries + 1, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def retry_extraction(spark: SparkSession, in_path: str, schema: T.StructType | str, key: str, text: str, attempt: Callable[[str, int], str], out_path: str, checkpoint: str,
                     tries: int = 3, delay_ms: int = 1000, fmt: str = "parquet", max_files_per_trigger: int | None = None, patience_s: float = 3600) -> DataFrame:
    """Take in all files of ``in_path``, try and retry each filing until it is done or given up, and return the log's last row of each.

    Call it again when files have come, or after a crash: it goes on where the checkpoint is. Filings without a key are left out; a null
    text is tried like any other. Filings still waiting when ``patience_s`` is over are tried by the next call.
    """
    before = spark.conf.get(_PROVIDER[0], None)
    spark.conf.set(*_PROVIDER)  # timers and value states live in RocksDB
    pending = {"n": _waiting(log(spark, out_path))}

    def write(batch: DataFrame, batch_id: int) -> None:
        path = f"{out_path}/batch={batch_id}"
        was = 0
        if batch_id in seen:  # a replayed batch overwrites itself
            was = _waiting(spark.read.schema(LOG).parquet(path))
        batch.write.mode("overwrite").parquet(path)
        seen.add(batch_id)
        pending["n"] += _waiting(spark.read.schema(LOG).parquet(path)) - was

    seen = {int(r[0]) for r in log(spark, out_path).select("batch").distinct().collect()}  # one row a batch
    try:
        reader = spark.readStream.schema(schema).format(fmt)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        rows = reader.load(in_path).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key is not null")
        q = (rows.groupBy("key").transformWithState(Attempts(attempt, tries, delay_ms), LOG, "Append", "ProcessingTime")
             .writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).start())
        try:
            end, first = time.monotonic() + patience_s, None
            # empty batches run as long as timers may wait; the first may be one that the stop before cut off, done again
            # without the files that came since; a later one, or a wait for data, has seen all files
            while time.monotonic() < end and not q.awaitTermination(0.2):
                p = q.lastProgress
                first = p["batchId"] if p and first is None else first
                waits = q.status["message"]
                idle = p["numInputRows"] == 0 and (p["batchId"] > first or waits.startswith("Waiting for data")) if p else waits.startswith("Waiting")
                if idle and not pending["n"]:
                    break
        finally:
            q.stop()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER[0])
        else:
            spark.conf.set(_PROVIDER[0], before)
    return outcomes(spark, out_path)


def _waiting(rows: DataFrame) -> int:
    """Filings that these tries leave waiting: first tries that failed less later ones that ended it."""
    first = F.when((F.col("tries") == 1) & (F.col("status") == RETRY), 1)
    last = F.when((F.col("tries") > 1) & (F.col("status") != RETRY), -1)
    return rows.agg(F.sum(F.coalesce(first, last, F.lit(0)))).first()[0] or 0


def log(spark: SparkSession, out_path: str) -> DataFrame:
    """All tries so far, with their batch; empty where there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{LOG}, batch long")
    return spark.read.schema(f"{LOG}, batch long").option("basePath", out_path).parquet(out_path)


def outcomes(spark: SparkSession, out_path: str) -> DataFrame:
    """(key, tries, status, error, found) of each filing's last try; one partial aggregate."""
    last = log(spark, out_path).groupBy("key").agg(F.max_by(F.struct("tries", "status", "error", "found"), "tries").alias("last"))
    return last.select("key", "last.*")
