"""Pages of a stored order against the sorted rows."""

import re

from pyspark.sql import functions as F

from lettertrail.operators import pages

SCHEMA = "id long, leaf string, v int"


def test_pages_after_rows_have_gone(spark, tmp_path):
    rows = [(i, "x", None if i % 5 == 0 else i * 37 % 11) for i in range(60)]
    path = str(tmp_path / "order")
    pages.write_order(spark.createDataFrame(rows, SCHEMA), [F.asc_nulls_last("v"), F.col("id")], path, 8)
    want = [r[0] for r in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0]))]
    got = lambda limit, offset: [(r["id"], r["position"], r["total"], r["has_more"]) for r in pages.read_page(spark, path, limit, offset).collect()]
    assert got(7, 13) == [(want[at], at, 60, True) for at in range(13, 20)]
    lost = set(want[8:16]) | {want[0], want[59], want[20]}
    gone = spark.createDataFrame([(i,) for i in lost] + [(None,), (999,), (want[0],)], "id long")
    pages.take_out(spark, path, gone)
    pages.take_out(spark, path, gone)
    left = [i for i in want if i not in lost]
    for limit, offset in [(5, 5), (500, 0), (20, 40), (1, 48), (9999, -3)]:
        size, skip = min(500, limit), max(0, offset)
        assert got(limit, offset) == [(i, skip + k, len(left), skip + size < len(left)) for k, i in enumerate(left[skip : skip + size])]
    assert got(10, 49) == [] and got(0, 2) == [(left[2], 2, 49, True)]


def test_a_page_reads_its_leaves_only(spark, tmp_path):
    path = str(tmp_path / "order")
    pages.write_order(spark.range(1000).withColumn("v", F.col("id") % 10), [F.col("v"), F.col("id")], path, 50)
    page = pages.read_page(spark, path, 10, 495)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*leaf#\d+L IN \(9,10\)", plan)
    assert [r["id"] for r in page.collect()] == [4 + 10 * k for k in range(95, 100)] + [5 + 10 * k for k in range(5)]


def test_empty_order(spark, tmp_path):
    path = str(tmp_path / "order")
    pages.write_order(spark.createDataFrame([], SCHEMA), [F.col("id")], path)
    pages.take_out(spark, path, spark.createDataFrame([(1,)], "id long"))
    assert pages.read_page(spark, path).collect() == []
