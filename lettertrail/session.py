"""Session settings shared by tests, the bench and batch jobs."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


# Rows and bytes per Arrow batch: a body may run to megabytes, so batches are kept well under Spark's 10,000 rows.
ARROW_ROWS, ARROW_BYTES = "1000", "8m"

COLLECT_EVERY = 5.0  # seconds

_scratch: str | None = None
_collected = time.monotonic()


def build_session(app: str = "lettertrail", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        .config("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> None:
    """Runtime settings every job here relies on, for sessions made elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the cluster's ``spark.checkpoint.dir``.

    Only a local master may do without the setting; it gets a scratch folder that all of its threads see.
    """
    global _scratch
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _scratch = _scratch or tempfile.mkdtemp(prefix="spark-")
    return _scratch


def materialise(df: DataFrame, every: float = COLLECT_EVERY) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder (survives executor loss).

    Spark removes the shuffle files of tables that nothing refers to any more (and their checkpoints, with
    spark.cleaner.referenceTracking.cleanCheckpoints) once the driver has collected its garbage. Long jobs of many
    rounds would fill the disks before that happens by chance, so it is asked for, but not more often than `every` so
    many seconds: a collection costs more than a short job.
    """
    global _collected
    context = df.sparkSession.sparkContext
    if time.monotonic() - _collected > every:
        gc.collect()
        context._jvm.System.gc()
        _collected = time.monotonic()
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
