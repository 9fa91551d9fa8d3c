"""Pages of a stored order: a page reads the leaves it lies in, not the rows before it.

An order is written once in leaves of neighbouring rows, one directory each, beside a list of the leaves' sizes. Rows that
go are noted per leaf; a page's place follows from the sizes less what has gone, so no row is numbered again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scan import ranked

# Rows of a leaf; a page reads the leaves it touches, the list of leaves has one row for each.
LEAF_ROWS = 1_000_000
# Fixed value: rows of a page at most.
PAGE_ROWS = 500


def write_order(rows: DataFrame, order: list[Column], path: str, leaf_rows: int = LEAF_ROWS) -> None:
    """Write `rows` (with a distinct `id`) under `path` in leaves of `leaf_rows` neighbours by `order`.

    Columns `leaf` and `place` are added, replacing those of these names. No rows: an empty order.
    """
    placed = ranked(rows.drop("leaf", "place"), order, out="place").withColumn("leaf", F.floor((F.col("place") - 1) / leaf_rows).cast("long"))
    # a leaf is one shuffle partition's, so it is one file, in order
    placed.repartition("leaf").sortWithinPartitions("leaf", "place").write.mode("overwrite").partitionBy("leaf").parquet(f"{path}/rows")
    # rows of no leaf leave no file to tell the columns
    placed.limit(0).write.mode("overwrite").parquet(f"{path}/columns")
    stored = _rows(rows.sparkSession, path)
    stored.groupBy("leaf").agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{path}/sizes")
    stored.select("id", "leaf").limit(0).write.mode("overwrite").parquet(f"{path}/gone")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")


def take_out(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Note that rows have gone. `ids`: id; ids that are unknown, null, repeated or gone already change nothing."""
    known = _rows(spark, path).select("id", "leaf").join(ids.select("id"), "id", "left_semi")
    known.join(spark.read.parquet(f"{path}/gone"), ["id", "leaf"], "left_anti").write.mode("append").parquet(f"{path}/gone")


def leaves(spark: SparkSession, path: str) -> DataFrame:
    """(leaf, live, before): rows of a leaf that are still there and in the leaves before it. One row per leaf."""
    gone = spark.read.parquet(f"{path}/gone").groupBy("leaf").agg(F.count("*").alias("gone"))
    live = spark.read.parquet(f"{path}/sizes").join(gone, "leaf", "left").select("leaf", (F.col("rows") - F.coalesce("gone", F.lit(0))).alias("live"))
    before = Window.orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    return live.withColumn("before", F.coalesce(F.sum("live").over(before), F.lit(0)))


def read_page(spark: SparkSession, path: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """The rows from `offset` on in the stored order, at most `limit` (1 to PAGE_ROWS), with `position` (from 0), `total` and `has_more`.

    The list of leaves tells which leaves to read, at most one a row of the page; only their files are read.
    """
    size, skip = min(PAGE_ROWS, max(1, int(limit))), max(0, int(offset))
    sizes = leaves(spark, path)
    touched = sizes.filter((F.col("live") > 0) & (F.col("before") < skip + size) & (F.col("before") + F.col("live") > skip))
    numbers = [r["leaf"] for r in touched.select("leaf").collect()]
    gone = spark.read.parquet(f"{path}/gone").filter(F.col("leaf").isin(numbers)).select("id")
    there = _rows(spark, path).filter(F.col("leaf").isin(numbers)).join(gone, "id", "left_anti")
    local = there.withColumn("_local", F.row_number().over(Window.partitionBy("leaf").orderBy("place")))
    at = local.join(sizes.select("leaf", "before"), "leaf").withColumn("position", F.col("before") + F.col("_local") - 1)
    page = at.filter((F.col("position") >= skip) & (F.col("position") < skip + size)).drop("_local", "before", "leaf", "place")
    total = sizes.agg(F.coalesce(F.sum("live"), F.lit(0)).alias("total"))
    return page.withColumn("total", total.scalar()).withColumn("has_more", F.lit(skip + size) < F.col("total")).orderBy("position")
