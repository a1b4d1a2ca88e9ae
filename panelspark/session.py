"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: AQE re-plans joins and skewed partitions at
# runtime, ANSI stays on (we use try_* functions where input may be dirty),
# and the session clock is UTC so dates never shift.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "8192",
    # delete a reliable checkpoint's files once its DataFrame is garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "panelspark", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the cluster's shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    ``local[...]`` session gets a folder of its own and any other raises.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a remote (Connect) session has no SparkContext
        sc = None
    d = (sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)) if sc else None
    if not d:
        try:
            d = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            d = None
    if not d:
        if not fallback and not (sc and sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = fallback or os.path.join("/tmp", f"panelspark-ckpt-{uuid.uuid4().hex[:8]}")  # one machine: tests
        if sc is None:
            spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return (sc.getCheckpointDir() if sc is not None else None) or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location; ``clear_scratch`` deletes it."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/scratch/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


_SCRATCH: list[str] = []


def clear_scratch(spark: SparkSession) -> None:
    """Delete this process's scratch folders, once no result that reads them is needed any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)


def materialize(df, by: str | None = None):
    """Cut lineage at a fan-out point: the rows are written once, in one job, as Parquet
    under the cluster's ``spark.checkpoint.dir`` and read back. Later stages read the files,
    so the upstream plan runs once and a lost executor costs no more than reading again.

    ``by``: in as many hash buckets of that column as shuffles have partitions, among which the caller has dealt out the rows;
    a later join on it reads the buckets where they lie and shuffles its other side only."""
    spark = df.sparkSession
    path = scratch_path(spark, "rows")
    out = df.write.option("compression", "zstd")
    if by is None:
        out.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    table = f"rows_{path.rsplit('-', 1)[1]}"
    out.option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).saveAsTable(table)
    found = spark.table(table)
    found.schema  # resolved now; the catalog's entry for the files isn't needed any more
    spark.sql(f"DROP TABLE {table}")
    return found
