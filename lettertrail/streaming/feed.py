"""A mail folder as a feed: each refresh reads only files that are new by content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import FILES
from ..sources.files import classify_files, with_sha256


def read_feed(spark: SparkSession, root: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(root)


def stream_new_files(
    spark: SparkSession, root: str, target: str, checkpoint: str, case_id: int, process: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Append files not yet in `target` (Parquet: case_id, sha, path, status, ...) and stop when caught up.

    Whether content is known is asked of the target table, not of stream state, so state does not grow. A batch
    that is replayed after a failure overwrites its own folder and adds nothing twice.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        files = classify_files(with_sha256(batch)).withColumn("case_id", F.lit(case_id).cast("long"))
        out = files if process is None else process(files)
        session = batch.sparkSession
        try:
            known = session.read.parquet(target).filter((F.col("case_id") == case_id) & (F.col("batch_id") != batch_id)).select("sha").distinct()
            out = out.join(known, "sha", "left_anti")
        except Exception as error:  # first batch: nothing stored yet
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        out.drop("content").write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (
        read_feed(spark, root).writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
