"""Mail files, quotes, pages, streaming, bundles and the audit log."""

import email
import email.policy
import random
from datetime import datetime
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from lettertrail.operators import audit as A
from lettertrail.operators import quotes as K
from lettertrail.operators import search as Q
from lettertrail.plans import ingest_job
from lettertrail.sources import eml, export, files, pages
from lettertrail.streaming import feed


def message(subject="Hi", body="text", **headers):
    m = EmailMessage()
    m["Subject"] = subject
    m["From"] = headers.pop("sender", "Ann <a@x>")
    for name, value in headers.items():
        m[name.replace("_", "-")] = value
    m.set_content(body)
    return m


def nested(depth):
    inner = message(f"level {depth}", f"body {depth}", Message_ID=f"<l{depth}>", Date="Fri, 19 Mar 2021 14:47:00 +0800")
    for level in range(depth - 1, -1, -1):
        outer = message(f"level {level}", f"body {level}", Message_ID=f"<l{level}>", Date="Fri, 19 Mar 2021 14:47:00 +0800")
        outer.add_attachment(inner)
        inner = outer
    return inner


@pytest.fixture(scope="module")
def parsed(spark):
    many = message("many", Message_ID="<many>", Date="Fri, 19 Mar 2021 14:47:00 +0800")
    for i in range(60):
        many.add_attachment(message(f"child {i}"))
    both = message("=?utf-8?b?5Lit5paH?=", "plain", Message_ID="<both>", Date="19 Mar 2021 14:47", To="b@x, Bob <c@x>", References="<a> <b>", Thread_Index="AAAA")
    both.add_alternative("<p>html</p>", subtype="html")
    both.add_attachment(b"data", maintype="application", subtype="pdf", filename="f.pdf")
    rows = [
        ("plain.eml", b"Subject: x\nMessage-ID: <p>\nDate: junk\n\ntext"), ("nodate.eml", message().as_bytes()), ("both.eml", both.as_bytes()),
        ("deep.eml", nested(6).as_bytes()), ("many.eml", many.as_bytes()), ("cut.eml", both.as_bytes()[:120]), ("none.eml", b""),
    ]
    return eml.parse_eml(spark.createDataFrame(rows, "path string, content binary"), "Asia/Singapore").cache()


def test_parse_messages(parsed):
    rows = {(r["path"], r["node"]): r for r in parsed.collect()}
    both = rows[("both.eml", 0)]
    assert both["subject"] == "中文" and both["to"] == ["b@x", "Bob <c@x>"] and both["references"] == ["<a>", "<b>"]
    assert both["body_text"] == "plain" and both["body_html"].strip() == "<p>html</p>" and both["date_utc"] == datetime(2021, 3, 19, 6, 47)
    assert [(a["filename"], a["size"], a["is_email"]) for a in both["attachments"]] == [("f.pdf", 4, False)] and both["parse_confidence"] == "high"
    assert rows[("plain.eml", 0)]["date_flags"] == ["malformed_date"] and rows[("plain.eml", 0)]["parse_confidence"] == "low"
    assert rows[("nodate.eml", 0)]["date_flags"] == ["missing_date", "missing_message_id"]
    assert ("cut.eml", 0) in rows and ("none.eml", 0) in rows


def test_attached_messages_to_any_depth(parsed):
    deep = eml.explode_attached(parsed.filter("path = 'deep.eml'")).orderBy("depth").collect()
    assert [r["subject"] for r in deep] == [f"level {i}" for i in range(1, 7)] and [r["parent_node"] for r in deep] == [0, 1, 2, 3, 4, 5]
    assert parsed.filter("path = 'many.eml' AND depth = 1").count() == 60
    assert [r["body_text"] for r in deep] == [f"body {i}" for i in range(1, 7)]
    assert eml.message_attachments(parsed.filter("path = 'both.eml'")).count() == 1


def test_transfer_codings_and_charsets(spark):
    mails = [
        b"Subject: =?iso-8859-1?Q?caf=E9_a?= =?utf-8?B?w6k=?=\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: quoted-printable\n\ncaf=E9 =\nau lait",
        "Subject: x\nContent-Type: text/plain; charset=gb2312\n\n中文".encode("gb2312"),
        b"From: \"Smith, Ann\" <a@x>\nTo: b@x,\n Bob <c@x>\n\nfolded",
    ]
    rows = {r["path"]: r for r in eml.parse_eml(spark.createDataFrame([(str(i), m) for i, m in enumerate(mails)], "path string, content binary")).collect()}
    assert (rows["0"]["subject"], rows["0"]["body_text"]) == ("café aé", "café au lait")
    assert rows["1"]["body_text"] == "中文"
    assert rows["2"]["from_addr"] == "Smith, Ann <a@x>" and rows["2"]["to"] == ["b@x", "Bob <c@x>"]


ORIGINAL = "Thanks, noted and agreed with all of it.\n\n-----Original Message-----\nFrom: Bob <b@x>\nSent: 19/03/2021 14:47\nTo: a@x; c@x\nSubject: Plan\n\n> The plan is to meet at noon.\n> Bring the files."
ON_WROTE = "Sure thing, see you there at the usual place.\n\nOn Fri, Mar 19, 2021 at 2:47 PM Bob B. Smith <b@x>\nwrote:\n> Shall we meet?\n> Bob"
HEADER = "New text on top of the other one, long enough.\n\nFrom: Bob\nDate: 19 Mar 2021 14:47\nTo: a@x\nSubject: Old\n\nBody of the old mail, nothing more."
NO_TO = "New text.\n\nFrom: Bob\nDate: 19 Mar 2021 14:47\nSubject: Old\n\nBody of the old mail."
CHINESE = "新的内容在这里，请看下面的邮件。\n\n发件人: 王 <w@x>\n发送时间: 2021年3月19日 14:47\n收件人: a@x\n主题: 计划\n\n旧的内容。"
NO_DATE = "新的内容。\n\n发件人: 王 <w@x>\n收件人: a@x\n主题: 计划\n\n旧的内容。"
REQUOTE = "On Fri, Mar 19, 2021 at 2:47 PM Bob <b@x> wrote:\n" + "\n".join(f"> line {i} of a long message that is quoted whole" for i in range(40))


def test_quotes(spark):
    texts = [ORIGINAL, ON_WROTE, HEADER, NO_TO, CHINESE, NO_DATE, REQUOTE, "nothing here", None]
    df = spark.createDataFrame([(i, t, "Asia/Singapore") for i, t in enumerate(texts)], "id long, body_text string, default_tz string")
    got = {}
    for r in K.extract_quotes(df).collect():
        got.setdefault(r["id"], []).append(r)
    assert sorted(got) == [0, 1, 2, 4]
    assert all(len(rows) == 1 for rows in got.values())
    a, b, c, d = (got[i][0] for i in (0, 1, 2, 4))
    noon = datetime(2021, 3, 19, 6, 47)
    assert (a["from_addr"], a["to"], a["subject"], a["date_utc"], a["body_text"]) == ("Bob <b@x>", ["a@x", "c@x"], "Plan", noon, "The plan is to meet at noon.\nBring the files.")
    assert (b["from_addr"], b["date_raw"], b["date_utc"], b["confidence"]) == ("Bob B. Smith <b@x>", "Fri, Mar 19, 2021 at 2:47 PM", noon, "med")
    assert (c["method"], c["subject"], c["date_utc"]) == ("outlook_header", "Old", noon)
    assert (d["method"], d["from_addr"], d["subject"], d["confidence"]) == ("localized_header", "王 <w@x>", "计划", "low")
    assert all(texts[r["id"]][r["start"] : r["end"]].strip() for r in (a, b, c, d)) and b["end"] == len(ON_WROTE)
    emails = df.withColumn("case_id", F.lit(1)).withColumn("message_id", F.lit("<m>")).withColumn("subject", F.lit("Top")).withColumn("references", F.array(F.lit("<r>"), F.lit("<m>")))
    rows = {r["parent_email_id"]: r for r in K.quoted_rows(emails, K.extract_quotes(df)).collect()}
    assert rows[1]["subject"] == "Top" and rows[1]["references"] == ["<r>", "<m>"] and rows[1]["in_reply_to"] == "<m>"


def test_printed_documents(spark):
    docs = [
        ("letterhead", "ACME LTD\n1 Road\n\nFrom: Bob\nSent: 19 Mar 2021 14:47\nTo: a@x\nSubject: Hi\n\nBody"), ("cc", "From: Bob\nCc: a@x\n\nBody"),
        ("contract", "This agreement is made\nbetween the parties."), ("letter", "From: The Office\nDate: 19 Mar 2021 14:47\n\nDear Sir"),
    ]
    emails, skipped = K.detect_printed_email(spark.createDataFrame(docs, "doc string, text string"))
    got = {r["doc"]: r for r in emails.collect()}
    assert set(got) == {"letterhead", "letter"} and {r["doc"] for r in skipped.collect()} == {"cc", "contract"}
    assert got["letter"]["parse_confidence"] == "low" and got["letter"]["subject"] == "(no subject)" and got["letterhead"]["body_text"] == "Body"


def test_pages_keep_interior_lines(spark):
    text = ["CONFIDENTIAL\nsee page 3\nship-\nment\nAcme - Page 1 of 2", "CONFIDENTIAL\nAcme - Page 9 of 9\nend\nAcme - Page 2 of 2"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(text, 1)] + [("e", 1, "CONFIDENTIAL\nalone\n1")], "doc_id string, page_no int, text string")
    got = {r["doc_id"]: r["text"] for r in pages.clean_pages(df).collect()}
    assert got == {"d": "see page 3\nshipment\nAcme - Page 9 of 9\nend", "e": "CONFIDENTIAL\nalone"}


def test_folder_scan_and_feed(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "b.eml").write_bytes(b"one")
    (root / "sub" / "A.EML").write_bytes(b"two")
    (root / "note.txt").write_bytes(b"three")
    listed = files.with_sha256(files.scan_files(spark, str(root)))
    assert [r["display"] for r in listed.collect()] == ["b.eml", "sub/A.EML"]
    assert [r["display"] for r in files.scan_files(spark, str(root), recursive=False).collect()] == ["b.eml"]
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    feed.stream_new_files(spark, str(root), out, mark, 1).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    (root / "again.eml").write_bytes(b"one")
    (root / "new.eml").write_bytes(b"four")
    feed.stream_new_files(spark, str(root), out, mark, 1).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in rows) == ["A.EML", "b.eml", "new.eml", "note.txt"]
    assert {r["status"] for r in rows if r["path"].endswith("txt")} == {"failed"}


def test_bundle_round_trip(spark, tmp_path):
    make = spark.createDataFrame
    tables = {
        "cases": make([(1, "One", "p1"), (2, "Two", "p2")], "id long, name string, public_id string"),
        "emails": make([(10, 1, None, 10, 5), (11, 1, 10, 10, None), (12, 1, 99, None, None), (20, 2, None, None, None)], "id long, case_id long, parent_email_id long, chain_source_id long, derived_from_attachment_id long"),
        "tags": make([(3, 1, "Hot"), (4, 2, "Cold")], "id long, case_id long, name string"),
        "email_tags": make([(10, 3), (11, 4), (20, 4)], "email_id long, tag_id long"),
        "attachments": make([(5, 10, "a.pdf"), (6, 20, "b.pdf")], "id long, email_id long, filename string"),
        "email_duplicate_candidates": make([(1, 1, 10, 11, None), (2, 1, 10, 20, None)], "id long, case_id long, email_a_id long, email_b_id long, canonical_email_id long"),
    }
    path = str(tmp_path / "bundle")
    export.export_case(tables, 1, path)
    seen = {r["table"]: (r["rows"], r["supported"]) for r in export.preview_export(spark, path).collect()}
    assert seen["emails"] == (3, True) and seen["email_tags"] == (2, True) and seen["attachments"] == (1, True)
    back = export.import_case(spark, path, {"emails": 1000, "tags": 500, "attachments": 70, "email_duplicate_candidates": 9}, 7)
    emails = {r["id"]: r for r in back["emails"].collect()}
    assert set(emails) == {1010, 1011, 1012} and {r["case_id"] for r in emails.values()} == {7}
    assert emails[1011]["parent_email_id"] == 1010 and emails[1012]["parent_email_id"] is None and emails[1010]["derived_from_attachment_id"] == 75
    assert [tuple(r) for r in back["email_tags"].collect()] == [(1010, 503)]
    assert [(r["email_a_id"], r["email_b_id"]) for r in back["email_duplicate_candidates"].collect()] == [(1010, 1011)]
    assert back["cases"].first()["id"] == 7 and back["cases"].first()["public_id"] != "p1"


def test_audit_links(spark):
    simple = lambda rows: {r["id"]: (r["link"], r["successors"]) for r in A.verify_links(spark.createDataFrame(rows, "id long, prev_hash string, event_hash string")).collect()}
    assert simple([(1, None, "a"), (2, "a", "b"), (3, "a", "c"), (4, "gone", "d"), (5, None, "e")]) == {
        1: ("genesis", 2), 2: ("linked", 0), 3: ("linked", 0), 4: ("missing", 0), 5: ("genesis", 0)
    }


def test_search_rules(spark):
    rows = [(1, "合同 signed", "100% of it"), (2, "Plan", 'say "hello" NEAR you'), (3, None, "ab"), (4, "x", "Ab c")]
    emails = spark.createDataFrame(rows, "id long, subject string, body_text string")
    index = Q.build_trigrams(emails)
    hits = lambda q: sorted(r["id"] for r in Q.search(emails, q).collect())
    for q, want in {"合同": [1], "0% o": [1], '"HELLO" near': [2], "ab": [3, 4], "收": [], "b c": [4], "": [1, 2, 3, 4]}.items():
        assert hits(q) == want
        if q:
            assert sorted(r["id"] for r in Q.search_indexed(index, emails, q).collect()) == want


def test_doc_codes_are_unique_and_shared(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("case_id"), F.floor(F.col("id") / 6).alias("root_id"), "id")
    out = files.assign_doc_ids(df)
    assert out.groupBy("case_id", "root_id").agg(F.count_distinct("doc_id").alias("n")).filter("n <> 1").count() == 0
    assert out.select("case_id", "root_id").distinct().count() == out.select("case_id", "doc_id").distinct().count()


def test_ingest_job(spark):
    old = "The plan is to meet at noon in the usual place, and everybody should bring the files we talked about last week."
    first = message("Plan", old, Message_ID="<1>", Date="Fri, 19 Mar 2021 10:00:00 +0800", To="a@x")
    quote = "\n".join(f"> {line}" for line in [old])
    reply = message("Re: Plan", f"Agreed, see you there.\n\nOn Fri, Mar 19, 2021 at 10:00 AM Ann <a@x> wrote:\n{quote}\n", Message_ID="<2>", In_Reply_To="<1>", Date="Fri, 19 Mar 2021 11:00:00 +0800")
    other = message("FW: x", "See below please, this is for your information only and nothing else.\n\n-----Original Message-----\nFrom: z@x\nSent: 18 Mar 2021 10:00\nSubject: x\n\nA quite different text that nobody else has sent.\n", Message_ID="<3>", Date="Fri, 19 Mar 2021 12:00:00 +0800")
    other.add_attachment(message("Inner", "inner body", Message_ID="<4>", Date="Fri, 19 Mar 2021 09:00:00 +0800"))
    rows = [("a.eml", first), ("b.eml", reply), ("c.eml", other), ("copy.eml", first), ("d.txt", first)]
    df = spark.createDataFrame([(p, len(m.as_bytes()), m.as_bytes()) for p, m in rows], "path string, length long, content binary")
    out = ingest_job.ingest(df, None, 1, "Asia/Singapore", first_id=100)
    emails = {(r["path"], r["source_kind"]): r for r in out["emails"].collect()}
    # the reply's quote repeats a standalone message and goes; the other file keeps its quote and attached message
    assert set(emails) == {("a.eml", "standalone"), ("b.eml", "standalone"), ("c.eml", "standalone"), ("c.eml", "quoted"), ("c.eml", "attached"), ("copy.eml", "standalone")}
    assert emails[("b.eml", "standalone")]["thread_id"] == emails[("a.eml", "standalone")]["thread_id"] == "msg:1"
    top = emails[("c.eml", "standalone")]
    assert (emails[("c.eml", "quoted")]["chain_position"], emails[("c.eml", "attached")]["chain_position"]) == (1, 2)
    assert emails[("c.eml", "quoted")]["parent_email_id"] == top["id"] == emails[("c.eml", "attached")]["parent_email_id"]
    assert {r["doc_id"] for k, r in emails.items() if k[0] == "c.eml"} == {top["doc_id"]}
    pairs = out["pairs"].collect()
    assert any({r["email_a_id"], r["email_b_id"]} == {emails[("a.eml", "standalone")]["id"], emails[("copy.eml", "standalone")]["id"]} and r["score"] == 1.0 for r in pairs)
    assert {r["path"]: r["status"] for r in out["files"].collect()} == {"a.eml": "parsed", "b.eml": "parsed", "c.eml": "parsed", "copy.eml": "parsed", "d.txt": "failed"}
    assert out["jobs"].first()["status"] == "completed" and out["attachments"].count() == 1
    known = spark.createDataFrame([(1, emails[("a.eml", "standalone")]["source_sha"], None)], "case_id long, source_sha string, deleted_at timestamp")
    again = ingest_job.ingest(df.filter("path IN ('a.eml', 'b.eml')"), known, 1)
    assert {r["path"]: r["status"] for r in again["files"].collect()} == {"a.eml": "skipped", "b.eml": "parsed"}


def _walked(raw: bytes) -> list[tuple]:
    """(depth, subject, text, attached names and sizes) of each message, depth first, by the standard library."""
    out = []

    def walk(mail, depth):
        texts, held, inner = [], [], []
        parts = [mail]
        while parts:
            part = parts.pop(0)
            if part.get_content_type() == "message/rfc822" and part is not mail:
                held.append(part.get_payload(0).get("Subject") + ".eml")
                inner.append(part.get_payload(0))
            elif part.is_multipart():
                parts = list(part.iter_parts()) + parts
            elif part.get_filename():
                held.append(part.get_filename())
                if part.get_filename().endswith(".eml"):
                    inner.append(email.message_from_bytes(part.get_payload(decode=True), policy=email.policy.default))
            elif part.get_content_type() == "text/plain":
                texts.append(part.get_content().replace("\r\n", "\n").strip())
        out.append((depth, mail["Subject"], "\n\n".join(texts), held))
        for one in inner:
            walk(one, depth + 1)

    walk(email.message_from_bytes(raw, policy=email.policy.default), 0)
    return out


def _random_mail(rng, depth):
    mail = message(f"s{rng.randrange(10**6)}", "\n".join(rng.choice(["text", "-- ", "--x", "-----Original Message-----", "", "--==", "boundary=q"]) for _ in range(rng.randrange(1, 8))))
    for _ in range(rng.randrange(3)):
        mail.add_attachment(rng.randbytes(30), maintype="application", subtype="x", filename=f"f{rng.randrange(99)}.bin")
    for _ in range(rng.randrange(3) if depth else 0):
        inner = _random_mail(rng, depth - 1)
        if rng.random() < 0.3:
            mail.add_attachment(inner.as_bytes(), maintype="application", subtype="octet-stream", filename=f"m{rng.randrange(99)}.eml")
        else:
            mail.add_attachment(inner)
    return mail


def test_structure_against_the_standard_library(spark):
    rng = random.Random(4)
    mails = [_random_mail(rng, rng.randrange(5)).as_bytes() for _ in range(25)]
    mails = [m.replace(b"\n", b"\r\n") if i % 3 == 0 else m for i, m in enumerate(mails)]
    rows = eml.parse_eml(spark.createDataFrame([(str(i), m) for i, m in enumerate(mails)], "path string, content binary")).collect()
    for i, raw in enumerate(mails):
        got = [(r["depth"], r["subject"], r["body_text"], [a["filename"] for a in r["attachments"]]) for r in sorted(rows, key=lambda r: r["node"]) if r["path"] == str(i)]
        assert got == _walked(raw), i


def test_broken_and_repeated_boundaries(spark):
    inner = "Subject: inner\nContent-Type: multipart/mixed; boundary=same\n\n--same\n\none\n--same\nContent-Disposition: attachment; filename=a.txt\n\nA\n"
    part = "Content-Type: message/rfc822\n\n" + inner
    rows = [
        # the inner boundary is never closed, and comes twice; the outer fence ends it
        ("twice", f"Subject: top\nContent-Type: multipart/mixed; boundary=\"out er\"\n\npreamble\n--out er\n\nhello\n--same\nstill hello\n--out er\n{part}--out er\n{part}--same--\n--out er--\nepilogue"),
        ("open", f"Subject: cut\nContent-Type: multipart/mixed; boundary=b\n\n--b\n\nbody\n--b\n{part}"),
        ("none", "Subject: n\nContent-Type: multipart/mixed; boundary=b\n\nno fence at all\n--c\n"),
    ]
    parsed = eml.parse_eml(spark.createDataFrame([(p, t.encode()) for p, t in rows], "path string, content binary"))
    got = {}
    for r in sorted(parsed.collect(), key=lambda r: (r["path"], r["node"])):
        got.setdefault(r["path"], []).append((r["depth"], r["parent_node"], r["subject"], r["body_text"], [(a["filename"], a["is_email"]) for a in r["attachments"]]))
    held = (1, 0, "inner", "one", [("a.txt", False)])
    assert got["twice"] == [(0, None, "top", "hello\n--same\nstill hello", [("inner.eml", True)] * 2), held, held]
    assert got["open"] == [(0, None, "cut", "body", [("inner.eml", True)]), held]
    assert got["none"] == [(0, None, "n", "", [])]
