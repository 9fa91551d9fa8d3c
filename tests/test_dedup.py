"""Duplicate review against brute force and on hand-made cases."""

import itertools
import random
import unicodedata
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from lettertrail.functions import fingerprint as P
from lettertrail.functions import text as T
from lettertrail.operators import dedup as D
from lettertrail.operators import reconcile as R
from lettertrail.operators.components import connected_components
from lettertrail.session import materialise

SCHEMA = """id long, case_id long, source_kind string, source_sha string, message_id string, subject string, from_addr string,
date_utc timestamp, body_text string, deleted_at timestamp, superseded_at timestamp"""


def mail(id_, body, **kw):
    row = {"case_id": 1, "source_kind": "standalone", "source_sha": f"s{id_}", "message_id": f"m{id_}", "subject": f"t{id_}", "from_addr": f"p{id_}", "date_utc": None}
    row.update(kw)
    return (id_, row["case_id"], row["source_kind"], row["source_sha"], row["message_id"], row["subject"], row["from_addr"], row["date_utc"], body, None, None)


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(100000)}" for _ in range(n)]


def scored(spark, rows):
    emails = spark.createDataFrame(rows, SCHEMA)
    return {(r["email_a_id"], r["email_b_id"]): (r["score"], [x["code"] for x in r["reasons"]]) for r in D.duplicate_pairs(emails).collect()}


def test_scores_per_rule(spark):
    long = " ".join(words(200, 1))
    near = " ".join(words(200, 1)[:198] + ["changed", "end"])
    host = " ".join(words(300, 9) + words(200, 1))
    short = "the quick brown fox jumps over the lazy dog and runs away from the very angry bear"
    got = scored(
        spark,
        [
            mail(1, "alpha", source_sha="x"), mail(2, "beta", source_sha="x"),
            mail(3, "gamma", message_id="<A@b>"), mail(4, "delta", message_id="a@B"),
            mail(5, long), mail(6, long), mail(7, near), mail(8, host, subject="t5", from_addr="p5"),
            mail(9, short, subject="s", from_addr="q"), mail(10, short + "!", subject="Re: s", from_addr="Q"),
            mail(11, "tiny", subject="", from_addr=""), mail(12, "tiny", subject="", from_addr=""),
        ],
    )
    assert got[(1, 2)] == (1.0, ["same_source_sha256"])
    assert got[(3, 4)] == (0.99, ["same_message_id"])
    assert got[(5, 6)] == (0.97, ["same_body_hash"])
    assert got[(5, 7)][1] == ["body_shingle_jaccard"] and 0.94 <= got[(5, 7)][0] <= 0.96
    assert got[(5, 8)] == (0.93, ["body_containment", "same_subject", "same_sender"])
    assert got[(9, 10)][1] == ["body_shingle_jaccard", "same_subject", "same_sender"]
    assert got[(11, 12)] == (0.97, ["same_body_hash"])


@pytest.mark.parametrize("n", [399, 1000])
def test_blocks_of_any_size(spark, n):
    """One rule whatever the number of rows: a shared subject is no evidence, copies hang together by the first of them."""
    rows = [mail(i, f"unlike {i}", subject="same", from_addr="same", source_sha="pair" if i < 2 else f"s{i}") for i in range(n)]
    copies = " ".join(words(50, 3))
    rows += [mail(10_000 + i, copies, case_id=2) for i in range(n)]
    pairs = D.duplicate_pairs(spark.createDataFrame(rows, SCHEMA)).cache()
    found = pairs.filter("case_id = 1").collect()
    assert [(r["email_a_id"], r["email_b_id"]) for r in found] == [(0, 1)]
    assert {(r["email_a_id"], r["email_b_id"]) for r in pairs.filter("case_id = 2").collect()} == {(10_000, 10_000 + i) for i in range(1, n)}


def sets(spark, seed, n, prefix):
    rng = random.Random(seed)
    base = [rng.sample(range(60), rng.randrange(1, 25)) for _ in range(n)]
    base += [b[: max(1, len(b) - 1)] for b in base[: n // 2]] + [b + rng.sample(range(60, 90), 5) for b in base[: n // 2]]
    rows = [(f"{prefix}{i:03d}", list(dict.fromkeys(b))) for i, b in enumerate(base)]
    return rows, spark.createDataFrame(rows, "key string, hashes array<long>")


def test_containment_equals_brute_force(spark):
    a, da = sets(spark, 1, 60, "a")
    b, db = sets(spark, 2, 40, "b")
    want = set()
    for (ka, sa), (kb, sb) in itertools.combinations(a, 2):
        small, large = sorted([(len(sa), ka, set(sa)), (len(sb), kb, set(sb))])
        if small[0] >= 5 and len(small[2] & large[2]) / small[0] >= 0.9:
            want.add((small[1], large[1]))
    got = {(r["small_key"], r["large_key"]) for r in D.containment_within(da, "key").collect()}
    assert got == want and want
    want2 = {
        (ka, kb) for (ka, sa), (kb, sb) in itertools.product(a, b)
        if min(len(sa), len(sb)) >= 5 and len(set(sa) & set(sb)) / min(len(sa), len(sb)) >= 0.6
    }
    got2 = {(r["left_key"], r["right_key"]) for r in D.containment_between(da, db, "key", "key", share=0.6).collect()}
    assert got2 == want2 and want2


def test_chance_meetings_are_not_compared(spark, monkeypatch):
    draw = random.Random(3)
    sets = {k: draw.sample(range(20_000), 100) for k in range(200)}
    sets |= {1000 + k: sets[k][:40] + draw.sample(range(20_000, 30_000), n) for k in range(20) for n in [k % 8]}
    want = {(a, b) for a, x in sets.items() for b, y in sets.items() if a != b and (len(x), a) < (len(y), b) and len(set(x) & set(y)) >= 0.9 * len(x)}
    compared, met = [], D._met
    monkeypatch.setattr(D, "_met", lambda *args: compared.append(met(*args)) or compared[-1])
    got = D.containment_within(spark.createDataFrame(list(sets.items()), "key long, hashes array<long>"), "key").collect()
    assert {(r["small_key"], r["large_key"]) for r in got} == want and len(want) == 14
    assert compared[0].count() < 100


@pytest.mark.parametrize("shape", ["random", "path", "star"])
def test_components_equal_union_find(spark, shape):
    rng = random.Random(4)
    edges = {
        "random": [(rng.randrange(120), rng.randrange(120)) for _ in range(90)],
        "path": [(i, i + 1) for i in range(130)],
        "star": [(0, i) for i in range(1, 200)],
    }[shape]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            lo, hi = sorted((find(u), find(v)))
            parent[hi] = lo
    want = {(x, find(x)) for x in parent}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {(r["id"], r["root"]) for r in connected_components(df, "a", "b").collect()} == want


def test_merge_keeps_decisions(spark):
    old = spark.createDataFrame([(1, 1, 2, 0.95, "r", "pending"), (1, 3, 4, 0.95, "r", "dissimilar"), (1, 5, 6, 0.95, "r", "pending")], "case_id long, email_a_id long, email_b_id long, score double, reasons string, status string")
    new = spark.createDataFrame([(1, 1, 2, 0.99, "n"), (1, 3, 4, 0.99, "n"), (1, 7, 8, 0.93, "n")], "case_id long, email_a_id long, email_b_id long, score double, reasons string")
    got = {(r["email_a_id"], r["score"], r["status"]) for r in D.merge_pairs(old, new).collect()}
    assert got == {(1, 0.99, "pending"), (3, 0.95, "dissimilar"), (7, 0.93, "pending")}


def test_canonical_order(spark):
    rows = [(1, "quoted", 900, None), (2, "attached", 10, datetime(2024, 1, 1)), (3, "attached", 20, None), (4, "attached", 20, datetime(2024, 1, 2)), (5, "attached", 20, datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "id long, source_kind string, norm_len int, date_utc timestamp").withColumn("g", F.lit(1))
    assert D.suggest_canonical(df, ["g"]).first()["suggested_canonical_id"] == 5


def test_reconcile(spark):
    base = words(120, 7)
    text = " ".join(base)
    close = " ".join(base[:110] + words(10, 8))
    rows = [
        mail(1, text), mail(2, text.upper() + "\n--\nsig", source_kind="quoted"), mail(3, close, source_kind="quoted"),
        mail(4, " ".join(words(120, 11)), source_kind="quoted"), mail(5, text, source_kind="quoted", case_id=2), mail(6, "hi there", source_kind="quoted"),
        mail(7, "hi there you", case_id=1),
    ]
    emails = spark.createDataFrame(rows, SCHEMA)
    # a two-word body goes only where it is equal
    assert {r["id"] for r in R.reconcile_quoted(emails).select("id").collect()} == {1, 4, 5, 6, 7}


# ---- sets are worked out once


def _counted_sets(spark, rows, key):
    """A table of hash sets, and how many of its rows were worked out so far."""
    seen = spark.sparkContext.accumulator(0)

    def made(values):
        seen.add(len(values))
        return values

    column = pandas_udf(made, ArrayType(LongType())).asNondeterministic()
    return spark.createDataFrame(rows, f"{key} long, h array<bigint>").select(key, column("h").alias("hashes")), seen


def test_containment_reads_each_set_once(spark):
    small, seen_small = _counted_sets(spark, [(i, list(range(10 * i, 10 * i + 10))) for i in range(20)], "item")
    large, seen_large = _counted_sets(spark, [(i, list(range(20 * i, 20 * i + 20))) for i in range(15)], "doc")
    got = D.containment_between(small, large, "item", "doc").collect()
    assert sorted((r["left_key"], r["right_key"], r["contained"]) for r in got) == [(i, i // 2, 1.0) for i in range(20)]
    assert (seen_small.value, seen_large.value) == (20, 15)


def test_only_changed_rows_are_signed_again(spark):
    emails = spark.createDataFrame([(i, 1, f"body of number {i} with several words more") for i in range(9)], "id long, case_id long, body_text string")
    old = materialise(D.fingerprint_table(emails))
    edited = emails.withColumn("body_text", F.when(F.col("id") == 4, F.lit("another text")).when(F.col("id") == 5, F.lit("")).otherwise(F.col("body_text")))
    now = D.refresh_fingerprints(edited, old.filter("id <> 6"))
    # bodies are normalised once and signed in one place
    plan = now._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [_fold_compatibility(") == 1 and plan.count("ArrowEvalPython [_signature(") == 1
    rows = {r["id"]: r for r in now.collect()}
    assert {i for i, r in rows.items() if r["recomputed"]} == {4, 5, 6} and len(rows) == 9
    fresh = {r["id"]: r for r in D.fingerprint_table(edited).collect()}
    assert all((rows[i]["hashes"], rows[i]["signature"]) == (fresh[i]["hashes"], fresh[i]["signature"]) for i in rows)


def test_hashes_are_those_of_the_shingles(spark):
    texts = ["", " ", "one", "a b c d e", "a b c d e f a b c d e f", "double  space and   more ", "ä ß 漢 字 é ü x y", " ".join(map(str, range(900))), None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    plain = F.array_distinct(F.transform(P.shingles(F.col("t")), P.hash28))
    want = {r[0]: r[1] for r in rows.select("id", F.coalesce(plain, F.array().cast("array<bigint>"))).collect()}
    assert {r[0]: r[1] for r in rows.select("id", P.shingle_hashes(F.col("t"))).collect()} == want
    hashes = np.array([0, 1, 2**28 - 1, *range(10**6, 10**6 + 1500)])
    exact = [min((a * int(h) + b) % P.PRIME for h in hashes) for a, b in P.coefficients()]
    assert P._signature(pd.Series([hashes])).iloc[0].tolist() == exact


def test_only_texts_that_nfkc_may_change_are_folded(spark):
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c, f"a{chr(c)}b") for c in points], "c int, t string")
    folded = {r["c"]: r["n"] for r in rows.select("c", T.nfkc(F.col("t")).alias("n")).collect()}
    assert all(folded[c] == unicodedata.normalize("NFKC", f"a{chr(c)}b") for c in points)


def _shuffled(spark):
    """Bytes shuffled so far."""
    sc = spark.sparkContext
    new = sc._gateway.new_array
    empty = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(empty, False, False, new(sc._jvm.double, 0), empty)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_containment_shuffles_each_hash_once(spark):
    # 400 bodies of 500 hashes, and copies of them; every tenth lies inside the one before it
    rng = random.Random(8)
    sets = [rng.sample(range(1 << 28), 500) for _ in range(400)]
    for i in range(10, 400, 10):
        sets[i] = sets[i - 1][:470] + sets[i][:10]
    rows = [(i, i % 2 if i % 10 else (i - 1) % 2, f"{i % 400:064x}", values) for i, values in enumerate(sets * 2)]
    prints = materialise(spark.createDataFrame(rows, "id long, case_id long, body_hash string, hashes array<long>").repartition(8))
    before = _shuffled(spark)
    got = {(r["left_id"], r["right_id"]) for r in D.contained_bodies(prints).collect()}
    assert _shuffled(spark) - before < 14 * 500 * 400
    assert got == {pair for i in range(10, 400, 10) for pair in ((i, i - 1), (i - 1, i))}


def test_reconciling_shuffles_no_texts(spark):
    rows = [mail(i, " ".join(words(1000, i - i % 2)) + (" more" if i % 2 else ""), source_kind="quoted" if i % 2 else "standalone") for i in range(200)]
    emails = materialise(spark.createDataFrame(rows, SCHEMA).repartition(8))
    size = sum(len(r[8]) for r in rows)
    before = _shuffled(spark)
    assert {r["id"] for r in R.reconcile_quoted(emails).select("id").collect()} == set(range(0, 200, 2))
    assert _shuffled(spark) - before < 5 * size
