"""The audit log's hash tree against a plain computation, and what it shows."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lettertrail.operators import audit as A
from lettertrail.session import materialise

SCHEMA = "id long, case_id long, action string, created_at timestamp, payload string"


def events(spark, n, start=0):
    """Two thirds of the events lie in one case; times repeat."""
    rows = [(i, 0 if i % 3 else 1, "edit", datetime(2024, 1, 1, 0, (i * 7) % 60), f'{{"n":{i}}}') for i in range(start, start + n)]
    return spark.createDataFrame(rows, SCHEMA)


def sha(*parts):
    return hashlib.sha256("\n".join(str(p) for p in parts).encode()).hexdigest()


def plain(batches, width, levels):
    """{(case, level, node): hash} of batches of (case, created_at, id, payload)."""
    out, cases = {}, {}
    for batch in batches:
        for case, _, _, body in sorted(batch):
            cases.setdefault(case, []).append(body)
    for case, bodies in cases.items():
        row = [sha("0", case, at, body) for at, body in enumerate(bodies)]
        for level in range(levels + 1):
            out.update({(case, level, node): h for node, h in enumerate(row)})
            row = [sha(level + 1, *row[at : at + width]) for at in range(0, len(row), width)]
    return out


def rows_of(df):
    return [(r["case_id"], r["created_at"], r["id"], r["payload"]) for r in df.collect()]


def tree(log, nodes):
    found = {(r["case_id"], 0, r["position"]): r["event_hash"] for r in log.collect()}
    return found | {(r["case_id"], r["level"], r["node"]): r["node_hash"] for r in A.latest_nodes(nodes).collect()}


def in_batches(parts, width, levels):
    log = nodes = None
    for number, part in enumerate(parts, 1):
        more = [materialise(x) for x in A.append_audit(log and (log, nodes), part, number, width, levels)]
        log, nodes = (more[0], more[1]) if log is None else (log.unionByName(more[0]), nodes.unionByName(more[1]))
    return log, nodes


@pytest.mark.parametrize("sizes", [(60,), (9, 51), (27, 6, 27)])
def test_tree_is_that_of_all_events(spark, sizes):
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    parts = [events(spark, n, start) for n, start in zip(sizes, starts)]
    log, nodes = in_batches(parts, 3, 4)
    assert tree(log, nodes) == plain([rows_of(p) for p in parts], 3, 4)
    assert A.broken_hashes(log).count() == 0 and A.broken_nodes(log, nodes, 3, 4).count() == 0


def test_faults_are_found_where_they_are(spark):
    log, nodes = (materialise(x) for x in A.append_audit(None, events(spark, 60), 1, 3, 4))
    changed = log.withColumn("payload", F.when(F.col("id") == 7, F.lit("{}")).otherwise(F.col("payload")))
    assert [r["id"] for r in A.broken_hashes(changed).collect()] == [7]
    broken = lambda l, n: sorted(tuple(r) for r in A.broken_nodes(l, n, 3, 4).collect())
    assert broken(log.filter("NOT (case_id = 0 AND position = 10)"), nodes) == [(0, 1, 3)]
    assert broken(log.filter("NOT (case_id = 0 AND position = 39)"), nodes) == [(0, 1, 13)]
    assert broken(log, nodes.filter("NOT (case_id = 1 AND level = 2 AND node = 1)")) == [(1, 2, 1), (1, 3, 0)]
    moved = log.withColumn("position", F.when((F.col("case_id") == 0) & F.col("position").isin(3, 4), 7 - F.col("position")).otherwise(F.col("position")))
    assert broken(moved, nodes) == [(0, 1, 1)] and A.broken_hashes(moved).count() == 2


def test_proofs(spark):
    log, nodes = (materialise(x) for x in A.append_audit(None, events(spark, 60), 1, 3, 4))
    roots = nodes.filter("level = 4").select("case_id", F.col("node_hash").alias("root"))
    proofs = A.inclusion_proofs(log, nodes, log, 3, 4).cache()
    assert proofs.count() == 240
    said = lambda e, p, r: {(x["case_id"], x["position"]) for x in A.proven(e, p, r, 4).filter("proven").collect()}
    every = {(r["case_id"], r["position"]) for r in log.collect()}
    assert said(log, proofs, roots) == every
    assert said(log.withColumn("payload", F.lit("x")), proofs, roots) == set()
    assert said(log, proofs.filter("level < 4"), roots) == set() and said(log, proofs, roots.filter("case_id = 1")) == {k for k in every if k[0] == 1}
    elsewhere = log.withColumn("position", F.col("position") + 1)
    assert said(elsewhere, proofs, roots) == set()


def test_proofs_of_many_events_hold_each_node_once(spark):
    log, nodes = (materialise(x) for x in A.append_audit(None, events(spark, 60), 1, 3, 4))
    roots = nodes.filter("level = 4").select("case_id", F.col("node_hash").alias("root"))
    found = A.proof_nodes(log, nodes, log, 3, 4).cache()
    assert found.count() == nodes.count() and max(len(r["hashes"]) for r in found.collect()) == 3
    said = lambda e, p, r: {(x["case_id"], x["position"]) for x in A.proven_by_nodes(e, p, r, 3, 4).filter("proven").collect()}
    every = {(r["case_id"], r["position"]) for r in log.collect()}
    assert said(log, found, roots) == every and A.proven_by_nodes(log, found, roots, 3, 4).count() == 60
    assert said(log.withColumn("payload", F.lit("x")), found, roots) == set()
    assert said(log.withColumn("position", F.col("position") + 1), found, roots) == set()
    assert said(log, found.filter("level < 4"), roots) == set() and said(log, found, roots.filter("case_id = 1")) == {k for k in every if k[0] == 1}
    # a node that isn't the one its parent names proves none of the events below it
    forged = found.withColumn("hashes", F.when(F.expr("case_id = 0 AND level = 2 AND node = 1"), F.reverse("hashes")).otherwise(F.col("hashes")))
    assert said(log, forged, roots) == {k for k in every if k[0] != 0 or k[1] // 9 != 1}


def test_nulls_repeats_and_limits(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, 4, "a", None, "x" * 100_000), (1, 4, "a", None, "x" * 100_000)]
    log, nodes = (materialise(x) for x in A.append_audit(None, spark.createDataFrame(rows, SCHEMA).withColumn("position", F.lit(9)), 1, 2, 3))
    assert sorted((r["case_id"], r["position"]) for r in log.collect()) == [(-1, 0), (-1, 1), (4, 0), (4, 1)]
    assert A.broken_hashes(log).count() == 0 and A.broken_nodes(log, nodes, 2, 3).count() == 0
    empty = A.append_audit((log, nodes), spark.createDataFrame([], SCHEMA), 2, 2, 3)
    assert empty[0].count() == 0 and empty[1].count() == 0
    with pytest.raises(Exception, match="holds at most 8 events"):
        A.append_audit((log, nodes), spark.createDataFrame([(i, 4, "a", None, "y") for i in range(7)], SCHEMA), 2, 2, 3)
    kept = spark.createDataFrame([("t" * 500, ["u" * 401] * 30, None)], "t string, l array<string>, n long")
    out = kept.select(A.payload(["n"], ["t"], ["l"]).alias("p")).first()["p"]
    assert out == '{"n":null,"t":"' + "t" * 400 + '...","l":[' + ",".join(['"' + "u" * 400 + '..."'] * 20) + "]}"
