"""Interval and thread operators against brute force and on hand-made cases."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lettertrail.operators import quotes
from lettertrail.operators import cards as C
from lettertrail.operators import scan
from lettertrail.operators import spans as S
from lettertrail.operators import threads as G
from lettertrail.session import materialise

SPANS = "source_email_id long, source_field string, start_offset long, end_offset long, field_length long, stale boolean"


def covered(rows):
    out = {}
    for key, s, e, n, stale in rows:
        if not stale:
            out.setdefault(key, set()).update(range(max(0, s), min(n, e)))
    return out


def test_merge_and_gaps_cover_every_character(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_CHARS", 16)  # several buckets per field
    rng = random.Random(5)
    lengths = {k: rng.randrange(20, 200) for k in range(12)}
    rows = [(k, a := rng.randrange(-3, n), a + rng.randrange(0, 30), n, rng.random() < 0.1) for k, n in lengths.items() for _ in range(rng.randrange(0, 12))]
    df = spark.createDataFrame([(k, "body", s, e, n, st) for k, s, e, n, st in rows], SPANS)
    want = covered(rows)
    merged = S.merge_ranges(df)
    got = {}
    for r in merged.collect():
        cells = set(range(r["start_offset"], r["end_offset"]))
        assert not cells & got.setdefault(r["source_email_id"], set())
        assert r["start_offset"] - 1 not in got[r["source_email_id"]]
        got[r["source_email_id"]] |= cells
    assert got == {k: v for k, v in want.items() if v}
    fields = spark.createDataFrame([(k, "body", n) for k, n in lengths.items()], "source_email_id long, source_field string, field_length long")
    gaps = {}
    for r in S.gap_ranges(merged, fields).collect():
        gaps.setdefault(r["source_email_id"], set()).update(range(r["start_offset"], r["end_offset"]))
    assert {k: gaps.get(k, set()) | want.get(k, set()) for k in lengths} == {k: set(range(n)) for k, n in lengths.items()}
    cover = {r["source_email_id"]: r for r in S.coverage(merged, fields, ["source_email_id"]).collect()}
    assert all(cover[k]["covered_chars"] == len(want.get(k, ())) for k in lengths)


def test_ranked_is_a_dense_order(spark):
    rows = [(i % 3, (i * 37) % 101, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, v int, id int")
    got = sorted((r["g"], r["position"], r["v"], r["id"]) for r in scan.ranked(df, ["v", "id"], ["g"]).collect())
    want = []
    for g in range(3):
        want += [(g, n, v, i) for n, (v, i) in enumerate(sorted((v, i) for gg, v, i in rows if gg == g), 1)]
    assert got == sorted(want)


def test_chain_conflicts_on_hand_made_chain(spark, monkeypatch):
    monkeypatch.setattr(G, "CHAIN_BUCKET", 2)
    day = lambda d: datetime(2024, 1, d) if d else None
    rows = [(i, 1, i, day(d)) for i, d in enumerate([5, None, 4, 6, 3, 6, 7])]
    df = spark.createDataFrame(rows, "id long, chain_source_id long, chain_position int, date_utc timestamp")
    latest, want = None, set()
    for i, _c, _p, d in rows:
        if d and latest and d > latest[1]:
            want |= {i, latest[0]}
        if d and (latest is None or d > latest[1]):
            latest = (i, d)
    assert {r["id"] for r in G.chain_conflicts(df).collect()} == want == {0, 3, 6}


THREAD = "id long, case_id long, message_id string, in_reply_to string, references array<string>, subject string, date_utc timestamp"


def test_threads_with_long_chain_and_cycles(spark):
    at = datetime(2024, 1, 1)
    rows = [(i, 1, f"<c{i}>", f"<C{i - 1}>" if i else None, None, "chain", at + timedelta(minutes=i)) for i in range(70)]
    rows += [(100, 1, "<x>", "<y>", None, "Re: loop x", at + timedelta(days=2)), (101, 1, "<y>", "<z>", None, "loop y", at + timedelta(days=1)), (102, 1, "<z>", "<x>", None, "loop z", at + timedelta(days=3))]
    rows += [(103, 1, "<tail>", "<x>", None, "tail", at), (104, 1, "<tail2>", "<tail>", None, "tail", at)]
    rows += [(105, 1, "<self>", "<self>", None, "Self", at), (106, 1, None, None, ["<r0>", "<gone>"], "ref", at), (107, 1, None, None, None, "Re: bare", at)]
    out = {r["id"]: r for r in G.assign_threads(spark.createDataFrame(rows, THREAD)).collect()}
    assert {out[i]["thread_id"] for i in range(70)} == {"msg:c0"}
    assert {out[i]["thread_id"] for i in (100, 101, 102, 103, 104)} == {"subj:loop y"}
    assert out[105]["thread_id"] == "subj:self" and out[106]["thread_id"] == "msg:r0" and out[107]["thread_id"] == "subj:bare"
    assert out[5]["parent_id"] == 4 and out[0]["parent_id"] is None


def test_threads_of_rows_that_share_an_id(spark):
    at = datetime(2024, 1, 1)
    rows = [(c * 100 + k, c % 5, f"<{c}.{k}>", f"<{c}.{k - 1}>" if k else None, None, "long", at + timedelta(minutes=k)) for c, n in ((1, 250), (2, 8), (3, 8)) for k in range(n)]
    out = G.assign_threads(spark.createDataFrame(rows, THREAD), ("message_id",)).collect()
    assert len(out) == len(rows)
    assert all(r["thread_id"] == f"msg:{r['message_id'][1:].split('.')[0]}.0" for r in out)
    assert all(r["parent_id"] == (None if r["message_id"].endswith(".0>") else r["id"] - 1) for r in out)


def test_rounds_do_not_grow_with_the_number_of_cycles(spark, monkeypatch):
    at, rounds = datetime(2024, 1, 1), []
    monkeypatch.setattr(G, "materialise", lambda df: rounds.append(1) or materialise(df))
    ring = lambda n, size: [(n * 10 + k, 1, f"<{n}.{k}>", f"<{n}.{(k + 1) % size}>", None, f"ring {n}", at + timedelta(minutes=-k)) for k in range(size)]
    rows = [row for n in range(300) for row in ring(n, n % 7 + 1)]
    out = {r["id"]: r for r in G.assign_threads(spark.createDataFrame(rows, THREAD)).collect()}
    assert all(out[i]["thread_id"] == f"subj:ring {i // 10}" for i in out) and len(out) == len(rows)
    assert len(rounds) < 10


def test_text_blocks(spark):
    df = spark.createDataFrame([(1, "body", "  one\nmore\n\n\ntwo"), (2, "body", "a\n \nb"), (3, "body", "x\n\nlast \n")], "source_email_id long, source_field string, text string")
    got = {}
    for r in S.text_blocks(df).orderBy("source_email_id", "start_offset").collect():
        got.setdefault(r["source_email_id"], []).append((r["start_offset"], r["end_offset"]))
    # the second has no paragraph break, the third's last paragraph does not end in a letter: both fall back to lines
    assert got == {1: [(2, 10), (13, 16)], 2: [(0, 1), (4, 5)], 3: [(0, 1), (3, 8)]}


EMAIL = """id long, case_id long, message_id string, subject string, from_addr string, body_text string, date_utc timestamp,
created_at timestamp, deleted_at timestamp, superseded_at timestamp"""


def email(id_, body, deleted=None):
    return (id_, 1, f"<m{id_}>", "Subj", "me@x", body, datetime(2024, 1, 1), datetime(2024, 1, 1), deleted, None)


def test_split_bodies(spark):
    bodies = {1: "😀 one\r\ntwo", 2: "abcdef", 3: "abcdef", 4: "abc   \n  def", 5: "abcdef"}
    cuts = {1: [6, 6], 2: [0, 3], 3: [6], 4: [7], 5: [5]}
    emails = spark.createDataFrame([email(k, v) for k, v in bodies.items()], EMAIL)
    offsets = spark.createDataFrame(list(cuts.items()), "id long, offsets array<int>")
    parts, refused = C.split_bodies(emails, offsets)
    got = {(r["source_email_id"], r["part_index"]): (r["body_text"], r["start_offset"], r["end_offset"]) for r in parts.collect()}
    assert got == {(1, 1): ("😀 one", 0, 5), (1, 2): ("two", 6, 9), (4, 1): ("abc", 0, 3), (4, 2): ("def", 9, 12)}
    assert {r["id"] for r in refused.collect()} == {2, 3, 5}


def test_snip_reads_headers_and_drafts(spark):
    body = "Top text here\nFrom: q@x\nSent: 19/03/2021 14:47\nSubject: Old\n\nquoted words"
    emails = spark.createDataFrame([email(1, body), email(2, "first part, second part")], EMAIL)
    offsets = spark.createDataFrame([(1, [14]), (2, [11])], "id long, offsets array<int>")
    cases = spark.createDataFrame([(1, "Asia/Singapore")], "id long, default_tz string")
    parts = {(r["source_email_id"], r["part_index"]): r for r in C.snip(emails, offsets, cases)["parts"].collect()}
    second = parts[(1, 2)]
    assert (second["from_addr"], second["subject"], second["body_text"], second["date_utc"]) == ("q@x", "Old", "quoted words", datetime(2021, 3, 19, 6, 47))
    assert second["parse_confidence"] == "med" and second["references"] == ["<m1>"] and second["message_id"] is None
    assert parts[(2, 2)]["flags"][-1] == "manual_snip_needs_review" and parts[(2, 1)]["message_id"] == "<m2>"
    draft = "source_email_id long, part_index int, approved boolean, from_addr string, to array<string>, cc array<string>, date_raw string, subject string, body_text string"
    drafts = spark.createDataFrame([(2, 1, True, "a", [], [], "", "", "one two"), (2, 2, True, "b", [], [], "never", "S", "three")], draft)
    out = C.snip(emails.filter("id = 2"), offsets.filter("id = 2"), cases, drafts)
    rows = {r["part_index"]: r for r in out["parts"].collect()}
    assert rows[2]["date_utc"] is None and rows[2]["body_text"] == "three" and rows[1]["subject"] == "(no subject)"
    wrong = drafts.withColumn("approved", F.col("part_index") == 1)
    assert [r["id"] for r in C.snip(emails.filter("id = 2"), offsets.filter("id = 2"), cases, wrong)["refused"].collect()] == [2]


def test_group_with_a_bad_range_is_refused(spark):
    emails = spark.createDataFrame([email(1, "hello world"), email(2, "other text")], EMAIL)
    fields = spark.createDataFrame([(1, "body", "hello world", 11), (2, "body", "other text", 10)], "source_email_id long, source_field string, text string, field_length long")
    picks = spark.createDataFrame([(1, 0, 1, "body", 0, 6), (1, 1, 2, "body", 0, 5), (2, 0, 1, "body", 0, 5), (2, 1, 2, "body", 4, 40), (3, 0, 1, "body", 0, 2)],
                                  "group_id long, seq int, source_email_id long, source_field string, start_offset long, end_offset long")
    cards, mappings, refused = C.cards_from_selections(emails, fields, picks)
    assert [r["body_text"] for r in cards.collect()] == ["hello\n\nother"]
    assert sorted((r["target_start_offset"], r["target_end_offset"]) for r in mappings.collect()) == [(0, 5), (7, 12)]
    assert {r["group_id"] for r in refused.collect()} == {2, 3}


def test_printed_headers_are_read_once(spark):
    texts = spark.createDataFrame([(1, "From: a@x\nSent: 1 Jan 2024 10:00\nTo: b@x; c@x\nSubject: s\n\nhello"), (2, "no header")], "id long, text string")
    found = quotes.detect_printed_email(texts)[0]
    # the openings are looked for in one place, however many fields are taken out of them
    assert found._jdf.queryExecution().optimizedPlan().toString().count("zip_with(") == 1
    assert [(r["id"], r["from_addr"], r["to"], r["date_raw"], r["subject"], r["body_text"]) for r in found.collect()] == [(1, "a@x", ["b@x", "c@x"], "1 Jan 2024 10:00", "s", "hello")]
