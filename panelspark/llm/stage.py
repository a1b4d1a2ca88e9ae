"""Written intermediate tables in the cluster's shared checkpoint folder, and the size of Arrow batches."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """The table written as Parquet under ``spark.checkpoint.dir`` and read back: its plan runs once,
    and a lost executor costs no more than reading it again. ``narrow``: of a few numbers a row, for which
    four files a core are enough."""
    path = scratch_path(df.sparkSession, name)
    if narrow:
        df = df.coalesce(max(32, 4 * df.sparkSession.sparkContext.defaultParallelism))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Like ``written``, in as many hash buckets of the keys as shuffles have partitions: a later join on the
    keys reads the buckets where they lie and shuffles its other side only."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"{name}_{path.rsplit('-', 1)[1]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, *keys).saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved now; the catalog's entry for the files isn't needed any more
    spark.sql(f"DROP TABLE {table}")
    return out


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Have Arrow batches hold at most so many rows: whole texts are long, and a worker holds a batch at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def by_value(spark: SparkSession, thing: Any) -> Callable[[], Any]:
    """A broadcast of ``thing`` with its classes' code, for workers without a copy of the package: a broadcast alone sends
    classes by name. Workers call the result for the thing, made once a worker process."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    made: list[Any] = []

    def get() -> Any:
        if not made:
            made.append(pickle.loads(shared.value))
        return made[0]

    return get
