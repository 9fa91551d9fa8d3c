"""Ordered scans that stay parallel when one key holds much of the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def prefix_max(df: DataFrame, keys: list[str], bucket: Column, order: list, value: Column, out: str, inclusive: bool = False) -> DataFrame:
    """Add `out`: the largest `value` over the earlier rows of the key, earlier by (bucket, order).

    The scan runs inside (key, bucket) groups; what earlier buckets contribute comes from one summary row per
    bucket, so a key with very many rows is spread over its buckets. `bucket` must not decrease along `order`.
    """
    work = df.withColumn("_bucket", bucket).withColumn("_value", value).repartition(*keys, "_bucket")
    seen = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = work.withColumn("_local", F.max("_value").over(seen))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = work.groupBy(*keys, "_bucket").agg(F.max("_value").alias("_top"))
    carried = heads.withColumn("_carry", F.max("_top").over(before)).drop("_top")
    joined = local.join(carried, [*keys, "_bucket"])
    return joined.withColumn(out, F.greatest("_local", "_carry")).drop("_bucket", "_value", "_local", "_carry")


def ranked(df: DataFrame, order: list, within: list[str] | None = None, out: str = "position") -> DataFrame:
    """Add the 1-based position of every row in a total order, within each `within` group.

    Rows are range-partitioned by the order itself, numbered inside their range and shifted by the sizes of
    the ranges before; the range assignment is checkpointed so that both uses see the same one.
    """
    within = within or []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(df.repartitionByRange(parts, *within, *order).withColumn("_part", F.spark_partition_id()))
    numbered = placed.withColumn("_local", F.row_number().over(Window.partitionBy("_part", *within).orderBy(*order)))
    sizes = placed.groupBy("_part", *within).agg(F.count("*").alias("_n"))
    # one row per range and group; without groups that is one row per partition of the shuffle
    key = within or [F.lit(0)]
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifted = sizes.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = numbered.join(shifted, _same(numbered, shifted, ["_part", *within])).select(numbered["*"], "_shift")
    return joined.withColumn(out, F.col("_local") + F.col("_shift")).drop("_part", "_local", "_shift")


def first_seen_index(df: DataFrame, key: str, order: list[str], within: list[str] | None = None, out: str = "seen_index", colours: int | None = None) -> DataFrame:
    """(within..., key, out): 0-based index of each key by where it first appears; `colours` wraps it."""
    within = within or []
    first = df.groupBy(*within, key).agg(F.min(F.struct(*order)).alias("_first"))
    index = ranked(first, ["_first"], within, out).withColumn(out, F.col(out) - 1).drop("_first")
    return index.withColumn(out, F.col(out) % colours) if colours else index
