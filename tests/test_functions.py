"""Text, fingerprint and date functions on hand-made rows."""

import unicodedata
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from lettertrail.functions import dates as D
from lettertrail.functions import fingerprint as P
from lettertrail.functions import text as T
from lettertrail.operators.spans import percent


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, expected",
    [
        (" RE: re： Fwd:回复：  Hello   World ", "hello world"),
        ("回复客户的问题", "回复客户的问题"),
        ("Re:", "no-subject"),
        (None, "no-subject"),
        ("轉發: FW: x", "x"),
    ],
)
def test_subject(spark, raw, expected):
    assert one(spark, raw, T.norm_subject) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Ｈello “x” – it’s​!", 'hello "x" - it\'s!'),
        ("a\n---\nb", "a --- b"),
        ("a\n--\nsignature", "a"),
        ("a\n-- \nsignature", "a"),
        ("a\n> Sent from my iPhone\nb", "a b"),
        ("é ﬁne", unicodedata.normalize("NFKC", "é ﬁne")),
        ("", ""),
        (None, ""),
    ],
)
def test_canonical_body(spark, raw, expected):
    assert one(spark, raw, T.canonical_body) == expected


def test_small_columns(spark):
    assert one(spark, " <A@b.C> ", T.norm_msgid) == "a@b.c"
    assert one(spark, "<>", T.norm_msgid) is None
    assert one(spark, "=1+1", T.safe_cell) == "'=1+1"
    assert one(spark, "  -x", T.safe_cell) == "'  -x"
    assert one(spark, "plain", T.safe_cell) == "plain"
    assert one(spark, "a<br/>b<p x>c</p>d>e<f", T.html_to_text) == "a\nbcde"
    assert one(spark, "> a  \n>> b\n  > c\n\n", T.strip_quote_prefix) == "a\n> b\nc"
    assert one(spark, "a, b;c ;", T.split_addresses) == ["a, b", "c"]
    assert one(spark, "hi\n> Date: Mon 1\nSent: z", T.leading_date) == "Mon 1"
    assert one(spark, "a\\..\\b//c", T.clean_path) == "a/b/c"
    assert one(spark, "not base64!!", T.conv_root) is None


def test_minhash_of_a_text_with_itself(spark):
    body = " ".join(f"word{i}" for i in range(60))
    rows = P.with_fingerprints(spark.createDataFrame([(1, body), (2, ""), (3, "short")], "id int, body_norm string"))
    got = {r["id"]: r for r in rows.select("id", "signature", P.minhash_jaccard(F.col("signature"), F.col("signature")).alias("j")).collect()}
    assert got[1]["j"] == 1.0 and len(got[1]["signature"]) == P.PERMUTATIONS
    assert got[2]["signature"] is None and got[2]["j"] == 0.0
    assert got[3]["j"] == 1.0


DATES = [
    ("Fri, Mar 19, 2021 at 2:47 PM", "2021-03-19 06:47:00"),
    ("Friday, March 19, 2021 at 2:47 PM", "2021-03-19 06:47:00"),
    ("Friday, 19 March 2021 at 2:47 PM", "2021-03-19 06:47:00"),
    ("Friday, 19 March 2021 at 14:47", "2021-03-19 06:47:00"),
    ("19 March 2021 at 2:47:05 PM", "2021-03-19 06:47:05"),
    ("Friday 19 March 2021 14:47", "2021-03-19 06:47:00"),
    ("3/19/2021 2:47 PM", "2021-03-19 06:47:00"),
    ("Mar 19, 2021 2:47 PM", "2021-03-19 06:47:00"),
    ("19 Mar 2021 12:10 AM", "2021-03-18 16:10:00"),
    ("19 Mar 2021 2:47 PM +0000", "2021-03-19 14:47:00"),
    ("Fri, 19 Mar 2021 12:05:10 PM EST", "2021-03-19 17:05:10"),
    ("19/03/2021 14:47", "2021-03-19 06:47:00"),
    ("03/19/2021 14:47", "2021-03-19 06:47:00"),
    ("19/03/68 14:47", "2068-03-19 06:47:00"),
    ("19/03/71 14:47", "1971-03-19 07:17:00"),
    ("19 Mar 2021 14:47 SGT", "2021-03-19 06:47:00"),
    ("Fri, 19 Mar 2021 14:47:00 -0000", "2021-03-19 06:47:00"),
    ("Fri, 19 Mar 2021 14:47:00 +0000", "2021-03-19 14:47:00"),
    ("Fri, 19 Mar 2021 14:47:00 EST", "2021-03-19 19:47:00"),
    ("2021-03-19T14:47:00Z", "2021-03-19 14:47:00"),
    ("2021年3月19日 周五 2:47 下午", "2021-03-19 06:47:00"),
    ("2021年3月19日 12:05 上午", "2021-03-18 16:05:00"),
    ("星期五, 三月 19, 2021 2:47 下午", "2021-03-19 06:47:00"),
    ("31/02/2021 10:00", None),
    ("junk", None),
    (None, None),
]


def test_dates(spark):
    df = spark.createDataFrame([(r, "Asia/Singapore", e) for r, e in DATES], "raw string, tz string, want string")
    got = df.select("raw", "want", F.date_format(D.parse_date(F.col("raw"), D.valid_zone(F.col("tz"))), "yyyy-MM-dd HH:mm:ss").alias("got")).collect()
    assert {r["raw"]: r["got"] for r in got} == {r["raw"]: r["want"] for r in got}


def test_zone_change_moves_only_dates_without_offset(spark):
    emails = spark.createDataFrame(
        [(1, 1, "19/03/2021 14:47", datetime(2021, 3, 19, 14, 47)), (2, 1, "Fri, 19 Mar 2021 14:47:00 +0000", datetime(2021, 3, 19, 14, 47)), (3, 1, "junk", None)],
        "id long, case_id long, date_raw string, date_utc timestamp",
    )
    cases = spark.createDataFrame([(1, "Asia/Singapore")], "id long, default_tz string")
    out = {r["id"]: r for r in D.rederive_dates(emails, cases).collect()}
    assert [out[i]["changed"] for i in (1, 2, 3)] == [True, False, False]
    assert out[1]["date_utc"] == datetime(2021, 3, 19, 6, 47)


def test_entry_errors(spark):
    rows = ["19/03/2021 14:47 GMT+8", "31/02/2021 10:00", "1/13/2021 10:00", "", "x", "19/03/2021 14:47 GMT+15", "19/03/2021 24:00"]
    out = D.parse_entry_dates(spark.createDataFrame([(r,) for r in rows], "raw string")).collect()
    assert [(r["iso"], r["error"] is None) for r in out] == [
        ("2021-03-19T14:47:00+08:00", True), (None, False), (None, False), (None, True), (None, False), (None, False), (None, False)
    ]


def test_round_even_follows_sql(spark):
    rows = [(c, t) for t in (160, 400, 2000, 3200) for c in range(1, t)]
    got = [r[0] for r in spark.createDataFrame(rows, "c long, t long").select(percent(F.col("c"), F.col("t"))).collect()]
    want = duckdb.execute(f"SELECT [round_even(x[1]::HUGEINT / x[2]::HUGEINT * 100, 1) FOR x IN {[list(r) for r in rows]}]").fetchall()[0][0]
    assert got == want and got[rows.index((17, 2000))] == 0.8
