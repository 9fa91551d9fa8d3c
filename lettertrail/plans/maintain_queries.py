"""Tag, edit, trash, case and audit queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import maintain as M
from ..session import materialise
from . import checksql as Q
from .registry import query
from .text_queries import STAMP, stamp

_NOW = datetime(2024, 4, 15)
_MATCH = "e.case_id = t.case_id"


def _case_tags(t):
    """One tag per case and language."""
    rows = t.documents.select((F.col("doc_id") % 5).alias("case_id"), F.col("lang").alias("name")).distinct()
    rank = F.array_position(F.array(F.lit("de"), F.lit("en"), F.lit("es"), F.lit("fr")), F.col("name"))
    return rows.select((F.col("case_id") * 10 + rank).cast("long").alias("id"), "case_id", "name", F.lit("#111").alias("color"))


_CASE_TAGS = "SELECT DISTINCT (doc_id % 5) * 10 + CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 WHEN 'fr' THEN 4 ELSE 0 END AS id, doc_id % 5 AS case_id, lang AS name FROM documents"


@query(
    "tags_upserted",
    f"""WITH t AS ({_CASE_TAGS}), i AS (SELECT DISTINCT doc_id % 5 AS case_id, lower(source) AS k FROM documents WHERE n_chars % 2 = 0)
        SELECT case_id, lower(name) AS tag, true AS known FROM t UNION ALL SELECT case_id, k, false FROM i""",
)
def _(t):
    shout = F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source"))
    name = F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit(" "), shout, F.lit(" "))).otherwise(F.upper("lang"))
    incoming = t.documents.select((F.col("doc_id") % 5).alias("case_id"), name.alias("name"), F.lit("").alias("color"))
    return M.upsert_tags(_case_tags(t), incoming).select("case_id", F.lower("name").alias("tag"), (F.col("color") == "#111").alias("known"))


@query("tags_renamed", f"SELECT id, CASE WHEN name = 'en' THEN 'English' ELSE name END AS name FROM ({_CASE_TAGS}) t")
def _(t):
    tags = _case_tags(t)
    changes = tags.filter("name IN ('en', 'fr')").select("id", F.when(F.col("name") == "en", " English ").otherwise("DE").alias("name"), F.lit(None).cast("string").alias("color"))
    return M.rename_tags(tags, changes).select("id", "name")


@query("tag_links_after_delete", "SELECT email_id, tag_id FROM fx_email_tags WHERE tag_id NOT IN (SELECT id FROM fx_tags WHERE name = 'Hot')")
def _(t):
    return M.delete_tags(t.fx_tags, t.fx_email_tags, t.fx_tags.filter("name = 'Hot'"))[1].select("email_id", "tag_id")


def _links(t):
    return t.documents.filter("n_chars % 3 = 0").select(F.col("doc_id").alias("email_id"), (F.col("doc_id") % 5 * 10 + 2).alias("tag_id"))


_LINKS = "SELECT doc_id AS email_id, doc_id % 5 * 10 + 2 AS tag_id FROM documents WHERE n_chars % 3 = 0"


@query(
    "tags_attached",
    f"""WITH l AS ({_LINKS}), t AS ({_CASE_TAGS}), w AS (SELECT doc_id AS email_id, CASE WHEN doc_id % 2 = 0 THEN doc_id % 5 ELSE doc_id % 3 END * 10 + 2 AS tag_id FROM documents)
        SELECT email_id, tag_id FROM l UNION SELECT w.email_id, w.tag_id FROM w JOIN t ON t.id = w.tag_id WHERE t.case_id = w.email_id % 5""",
)
def _(t):
    case = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 5).otherwise(F.col("doc_id") % 3)
    wanted = t.documents.select(F.col("doc_id").alias("email_id"), (case * 10 + 2).alias("tag_id"))
    return M.attach_tags(_links(t), wanted, t.fx_emails, _case_tags(t))


@query("tags_detached", f"SELECT * FROM ({_LINKS}) l WHERE email_id % 4 <> 1")
def _(t):
    return M.detach_tags(_links(t), _links(t).filter("email_id % 4 = 1"))


@query(
    "upload_tagged",
    f"""WITH l AS ({_LINKS}) SELECT email_id, tag_id FROM l UNION SELECT id, case_id * 10 + 2 FROM fx_emails WHERE source_kind IN ('standalone', 'attached')""",
)
def _(t):
    emails = t.fx_emails.withColumn("ingest_job_id", F.col("case_id"))
    tags = _case_tags(t)
    jobs = tags.filter("name = 'en'").select(F.col("case_id").alias("ingest_job_id"), F.col("id").alias("tag_id"))
    return M.tag_job(emails, _links(t), jobs, tags)


@query(
    "undated_synced",
    f"""WITH l AS ({_LINKS}) SELECT email_id, CAST(tag_id AS VARCHAR) AS tag FROM l UNION SELECT id, 'Undated' FROM fx_emails WHERE date_utc IS NULL AND deleted_at IS NULL""",
)
def _(t):
    tags, links = M.sync_undated(t.fx_emails, _case_tags(t), _links(t))
    named = tags.select(F.col("id").alias("tag_id"), F.when(F.col("name") == "Undated", "Undated").otherwise(F.col("id").cast("string")).alias("tag"))
    return links.join(named, "tag_id").select("email_id", "tag")


@query("links_copied", f"WITH l AS ({_LINKS}) SELECT email_id, tag_id FROM l UNION SELECT email_id + 1000000 + k, tag_id FROM l, (SELECT unnest([1, 2]) AS k) p")
def _(t):
    parts = t.documents.select(F.col("doc_id").alias("source_email_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("part_index"))
    parts = parts.withColumn("id", F.col("source_email_id") + 1000000 + F.col("part_index"))
    return M.copy_links(_links(t), parts)


@query("attachments_copied", "SELECT page_id AS email_id, path AS filename FROM fx_files UNION ALL SELECT page_id + 1000001, path FROM fx_files")
def _(t):
    files = t.fx_files.select(F.col("page_id").alias("id"), F.col("page_id").alias("email_id"), F.col("path").alias("filename"))
    parts = files.select(F.col("email_id").alias("source_email_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("part_index"))
    parts = parts.withColumn("id", F.col("source_email_id") + 1000000 + F.col("part_index"))
    return M.copy_attachments(files, parts).select("email_id", "filename")


# ---- edits

_EDITED = """l AS (SELECT email_id, field, arg_max(new_value, row(ts, edit_id)) AS v FROM fx_edits GROUP BY 1, 2),
   e AS (SELECT id, from_addr, CASE WHEN id % 3 = 0 THEN 'v1' ELSE subject END AS subject, body_text, 'v2' AS notes, deleted_at FROM fx_emails),
   j AS (SELECT e.*, (SELECT v FROM l WHERE email_id = e.id AND field = 'from_addr') AS nf, (SELECT v FROM l WHERE email_id = e.id AND field = 'subject') AS ns,
     (SELECT v FROM l WHERE email_id = e.id AND field = 'body_text') AS nb, (SELECT v FROM l WHERE email_id = e.id AND field = 'notes') AS nn FROM e),
   k AS (SELECT *, deleted_at IS NULL AND nf IS NOT NULL AND nf <> from_addr AS cf, deleted_at IS NULL AND ns IS NOT NULL AND ns <> subject AS cs,
     deleted_at IS NULL AND nb IS NOT NULL AND nb <> body_text AS cb, deleted_at IS NULL AND nn IS NOT NULL AND nn <> notes AS cn FROM j)"""


def _edited(t):
    emails = t.fx_emails.withColumn("subject", F.when(F.col("id") % 3 == 0, "v1").otherwise(F.col("subject"))).withColumn("notes", F.lit("v2"))
    return M.apply_edits(emails, t.fx_edits)


@query(
    "edits_applied",
    f"""WITH {_EDITED} SELECT id, CASE WHEN cf THEN nf ELSE from_addr END AS from_addr, CASE WHEN cs THEN ns ELSE subject END AS subject, md5(CASE WHEN cb THEN nb ELSE body_text END) AS body_md5,
        CASE WHEN cn THEN nn ELSE notes END AS notes, (cf OR cs OR cb OR cn) AND (nf IS NOT NULL OR ns IS NOT NULL OR nb IS NOT NULL) AS user_edited FROM k""",
)
def _(t):
    out = _edited(t)[0]
    return out.select("id", "from_addr", "subject", F.md5(F.col("body_text").cast("binary")).alias("body_md5"), "notes", "user_edited")


@query(
    "edits_logged",
    f"""WITH {_EDITED} SELECT id AS email_id, 'from_addr' AS field, md5(from_addr) AS old_md5, nf AS new_value FROM k WHERE cf UNION ALL SELECT id, 'subject', md5(subject), ns FROM k WHERE cs
        UNION ALL SELECT id, 'body_text', md5(body_text), nb FROM k WHERE cb UNION ALL SELECT id, 'notes', md5(notes), nn FROM k WHERE cn""",
)
def _(t):
    return _edited(t)[1].select("email_id", "field", F.md5(F.col("old_value").cast("binary")).alias("old_md5"), "new_value")


@query(
    "manual_emails_added",
    f"""SELECT d.id, CASE WHEN d.id % 5 = 0 THEN '(no subject)' ELSE 'S' END AS subject, strftime(CASE d.id % 4 WHEN 0 THEN try_strptime(date_raw, '%d/%m/%Y %H:%M') AT TIME ZONE default_tz AT TIME ZONE 'UTC'
        WHEN 1 THEN try_strptime(substr(date_raw, 1, 19), '%Y-%m-%dT%H:%M:%S') - INTERVAL 8 HOUR ELSE try_strptime(regexp_replace(date_raw, ' -0500$', ''), '%d %b %Y %H:%M:%S') + INTERVAL 5 HOUR END, '{STAMP}') AS utc
        FROM fx_dates d JOIN fx_cases c ON c.id = d.case_id WHERE d.id % 4 <> 3""",
)
def _(t):
    rows = t.fx_dates.withColumn("subject", F.when(F.col("id") % 5 == 0, "  ").otherwise(" S ")).withColumn("from_addr", F.lit("a@x")).withColumn("body_text", F.lit(" hi "))
    return M.add_manual(rows, t.fx_cases)[0].select("id", "subject", stamp("date_utc").alias("utc"))


@query("manual_emails_rejected", "SELECT id FROM fx_dates WHERE date_raw = 'not a date'")
def _(t):
    rows = t.fx_dates.withColumn("subject", F.lit("S")).withColumn("from_addr", F.lit("a@x")).withColumn("body_text", F.lit(" hi "))
    return M.add_manual(rows, t.fx_cases)[1].select("id")


# ---- trash and cases


@query("emails_trashed", f"SELECT id, strftime(CASE WHEN id % 6 = 0 AND deleted_at IS NULL THEN TIMESTAMP '2024-04-15' ELSE deleted_at END, '{STAMP}') AS deleted FROM fx_emails")
def _(t):
    return M.trash_emails(t.fx_emails, t.documents.filter("doc_id % 6 = 0").select(F.col("doc_id").alias("id")), _NOW).select("id", stamp("deleted_at").alias("deleted"))


@query("emails_restored", f"SELECT id, strftime(CASE WHEN deleted_at >= TIMESTAMP '2024-04-15' - INTERVAL 30 DAY THEN NULL ELSE deleted_at END, '{STAMP}') AS deleted FROM fx_emails")
def _(t):
    return M.restore_emails(t.fx_emails, t.documents.select(F.col("doc_id").alias("id")), _NOW).select("id", stamp("deleted_at").alias("deleted"))


@query("cases_trashed", f"SELECT c.id, strftime(CASE WHEN c.deleted_at IS NULL AND e.n > 0 THEN TIMESTAMP '2024-04-15' ELSE c.deleted_at END, '{STAMP}') AS deleted FROM fx_cases c LEFT JOIN (SELECT case_id, count(*) AS n FROM fx_emails GROUP BY 1) e ON e.case_id = c.id")
def _(t):
    return M.trash_cases(t.fx_cases, t.fx_emails.select(F.col("case_id").alias("id")), _NOW).select("id", stamp("deleted_at").alias("deleted"))


@query("cases_restored", "SELECT c.id, c.deleted_at IS NULL OR c.id IN (SELECT case_id FROM fx_emails) AS live FROM fx_cases c")
def _(t):
    return M.restore_cases(t.fx_cases, t.fx_emails.select(F.col("case_id").alias("id"))).select("id", F.col("deleted_at").isNull().alias("live"))


@query("emails_after_purge", "SELECT id FROM fx_emails WHERE case_id NOT IN (SELECT id FROM fx_cases WHERE deleted_at IS NOT NULL)")
def _(t):
    out = M.purge_cases({"cases": t.fx_cases, "emails": t.fx_emails, "email_tags": t.fx_email_tags}, t.fx_cases.select("id", "name"))
    return out["emails"].select("id")


@query("tag_links_after_purge", "SELECT email_id, tag_id FROM fx_email_tags WHERE email_id NOT IN (SELECT id FROM fx_emails WHERE case_id IN (SELECT id FROM fx_cases WHERE deleted_at IS NOT NULL))")
def _(t):
    out = M.purge_cases({"cases": t.fx_cases, "emails": t.fx_emails, "email_tags": t.fx_email_tags}, t.fx_cases.select("id", "name"))
    return out["email_tags"].select("email_id", "tag_id")


@query("cjk_rolled_up", "SELECT c.id, coalesce(max(n_chars) > 3000, false) AS has_cjk_content FROM fx_cases c LEFT JOIN documents d ON d.doc_id % 5 = c.id GROUP BY c.id")
def _(t):
    jobs = t.documents.select((F.col("doc_id") % 5).alias("case_id"), (F.col("n_chars") > 3000).alias("contains_cjk"))
    return M.rollup_cjk(t.fx_cases.withColumn("has_cjk_content", F.lit(False)), jobs).select("id", "has_cjk_content")


@query("cases_updated", "SELECT c.id, CASE WHEN n % 2 = 0 THEN concat('Matter ', n) ELSE name END AS name, CASE WHEN n % 3 = 0 THEN 'Asia/Tokyo' ELSE default_tz END AS default_tz FROM fx_cases c JOIN (SELECT doc_id % 5 AS id, count(*) AS n FROM documents GROUP BY 1) d ON d.id = c.id")
def _(t):
    sizes = t.documents.groupBy((F.col("doc_id") % 5).alias("id")).agg(F.count("*").alias("n"))
    changes = sizes.select("id", F.when(F.col("n") % 2 == 0, F.concat(F.lit(" Matter "), F.col("n").cast("string"))).otherwise(" ").alias("name"), F.when(F.col("n") % 3 == 0, "Asia/Tokyo").otherwise("No/Zone").alias("default_tz"))
    return M.update_cases(t.fx_cases, changes).select("id", "name", "default_tz")


@query(
    "cases_added",
    """WITH n AS (SELECT source AS name, CASE WHEN count(*) % 2 = 0 THEN 'Europe/Paris' ELSE 'UTC' END AS default_tz FROM documents GROUP BY 1), k AS (SELECT name, default_tz, 4 + row_number() OVER (ORDER BY name) AS id FROM n)
       SELECT id, name, default_tz, substr(sha256(concat(id, ':', name)), 1, 16) AS public_id FROM k UNION ALL SELECT id, name, default_tz, NULL FROM fx_cases""",
)
def _(t):
    sizes = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    rows = sizes.select(F.concat(F.lit(" "), "source").alias("name"), F.when(F.col("n") % 2 == 0, "Europe/Paris").otherwise("bad").alias("default_tz"))
    return M.add_cases(t.fx_cases, rows).select("id", "name", "default_tz", "public_id")


@query("email_snapshots", """SELECT id, concat('{"id":', id, ',"case_id":', case_id, ',"from_addr":"', from_addr, '","deleted_at":', CASE WHEN deleted_at IS NULL THEN 'null' ELSE concat('"', strftime(deleted_at, '%Y-%m-%dT%H:%M:%S.000Z'), '"') END, '}') AS snapshot FROM fx_emails""")
def _(t):
    return M.snapshot(t.fx_emails, ["id", "case_id", "from_addr", "deleted_at"]).select("id", "snapshot")


# ---- audit


@query(
    "audit_values_compacted",
    "SELECT doc_id, md5(CASE WHEN length(text) > 400 THEN concat(substr(text, 1, 400), '...') ELSE text END) AS value_md5, least(20, len(string_split(text, ' '))) AS n_items FROM documents",
)
def _(t):
    return t.documents.select("doc_id", F.md5(A.compact_text(F.col("text")).cast("binary")).alias("value_md5"), F.size(A.compact_list(F.split("text", " "))).cast("long").alias("n_items"))


@query(
    "audit_links_verified",
    """SELECT a.id, CASE WHEN a.prev_hash IS NULL THEN 'genesis' WHEN p.id < a.id THEN 'linked' ELSE 'missing' END AS link, (SELECT count(*) FROM fx_audit n WHERE n.prev_hash = a.event_hash) AS successors
       FROM fx_audit a LEFT JOIN fx_audit p ON p.event_hash = a.prev_hash""",
)
def _(t):
    return A.verify_links(t.fx_audit)


@query("audit_chain_verdict", "SELECT count(*) AS events, count(*) FILTER (prev_hash = 'broken') AS missing, CAST(0 AS BIGINT) AS forks, count(*) FILTER (prev_hash IS NULL) AS genesis, count(*) FILTER (prev_hash = 'broken') = 0 AS intact FROM fx_audit")
def _(t):
    return A.chain_verdict(A.verify_links(t.fx_audit))


def _events(t):
    return t.fx_audit.select("id", "case_id", "action", "created_at", A.payload(["case_id", "action", "id"], texts=["props"]).alias("payload"))


def _tree(log: DataFrame, nodes: DataFrame) -> DataFrame:
    leaves = log.select("case_id", F.lit(0).alias("level"), F.col("position").alias("node"), "id", F.col("event_hash").alias("hash"))
    return leaves.unionByName(nodes.select("case_id", "level", "node", F.lit(None).cast("long").alias("id"), F.col("node_hash").alias("hash")))


def _levels(batch: str) -> str:
    """SQL of the tree over all events, numbered by `batch` first."""
    return f"""WITH RECURSIVE placed AS (SELECT id, case_id, row_number() OVER (PARTITION BY case_id ORDER BY {batch}, created_at, id) - 1 AS node,
         concat('{{"case_id":', case_id, ',"action":"', action, '","id":', id, ',"props":', coalesce(CAST(to_json(CASE WHEN length(props) > 400 THEN concat(substr(props, 1, 400), '...') ELSE props END) AS VARCHAR), 'null'), '}}') AS payload FROM fx_audit),
       l0 AS (SELECT case_id, 0 AS level, node, id, sha256(concat('0', chr(10), case_id, chr(10), node, chr(10), payload)) AS hash FROM placed),
       tree AS (SELECT case_id, level, node, id, hash FROM l0 UNION ALL
         SELECT case_id, level + 1, node // {A.WIDTH}, CAST(NULL AS BIGINT), sha256(concat(level + 1, chr(10), string_agg(hash, chr(10) ORDER BY node))) FROM tree WHERE level < {A.LEVELS} GROUP BY case_id, level, node // {A.WIDTH})"""


@query("audit_appended", _levels("0") + " SELECT case_id, level, node, id, hash FROM tree")
def _(t):
    return _tree(*A.append_audit(None, _events(t), 1))


def _two_batches(t, first: Column):
    """Log and nodes after the events of `first` and, as a second batch, the others."""
    log, nodes = (materialise(part) for part in A.append_audit(None, _events(t).filter(first), 1))
    more_log, more_nodes = A.append_audit((log, nodes), _events(t).filter(~first), 2)
    return log.unionByName(more_log), nodes.unionByName(more_nodes)


@query("audit_in_batches", _levels("id % 3 <> 0") + " SELECT case_id, level, node, id, hash FROM tree")
def _(t):
    """Two batches leave the tree that all events in that order have at once."""
    log, nodes = _two_batches(t, F.col("id") % 3 == 0)
    return _tree(log, A.latest_nodes(nodes))


@query("audit_log_faults", "SELECT 'hash' AS fault, 2 * count(*) AS n FROM events WHERE event_id % 50 = 7")
def _(t):
    """A log of two batches in which some payloads were changed afterwards."""
    log, nodes = (materialise(part) for part in A.append_audit(None, _events(t), 1))
    more_log, more_nodes = A.append_audit((log, nodes), _events(t).withColumn("id", F.col("id") + 1_000_000), 2)
    both, tree = log.unionByName(more_log), nodes.unionByName(more_nodes)
    both = both.withColumn("payload", F.when(F.col("id") % 50 == 7, F.lit("{}")).otherwise(F.col("payload")))
    bad = A.broken_hashes(both).select(F.lit("hash").alias("fault")).union(A.broken_nodes(both, tree).select(F.lit("node").alias("fault")))
    return bad.groupBy("fault").agg(F.count("*").alias("n"))


@query(
    "audit_nodes_broken",
    f"""WITH p AS (SELECT id, case_id, row_number() OVER (PARTITION BY case_id ORDER BY created_at, id) - 1 AS place FROM fx_audit)
       SELECT DISTINCT case_id, CAST(1 AS INTEGER) AS level, place // {A.WIDTH} AS node FROM p WHERE id % 997 = 5
       UNION ALL SELECT DISTINCT case_id, CAST(unnest([2, 3]) AS INTEGER), CAST(0 AS BIGINT) FROM p WHERE case_id = 3""",
)
def _(t):
    """A log that has lost some events, and a stored node that was changed: it differs from what is below it, the one above from it."""
    log, nodes = (materialise(part) for part in A.append_audit(None, _events(t), 1))
    changed = (F.col("case_id") == 3) & (F.col("level") == 2) & (F.col("node") == 0)
    return A.broken_nodes(log.filter("id % 997 <> 5"), _with_hash(nodes, changed))


def _with_hash(nodes: DataFrame, changed: Column) -> DataFrame:
    return nodes.withColumn("node_hash", F.when(changed, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.col("node_hash")))


@query("audit_events_proven", "SELECT id, id % 200 <> 0 AS proven FROM fx_audit WHERE id % 100 = 0")
def _(t):
    """Every hundredth event is proven against the root; half of them say something else than was logged."""
    log, nodes = (materialise(part) for part in A.append_audit(None, _events(t), 1))
    asked = log.filter("id % 100 = 0").withColumn("payload", F.when(F.col("id") % 200 == 0, F.lit("{}")).otherwise(F.col("payload")))
    roots = A.latest_nodes(nodes).filter(F.col("level") == A.LEVELS).select("case_id", F.col("node_hash").alias("root"))
    found = A.proven_by_nodes(asked, A.proof_nodes(log, nodes, asked), roots)
    return asked.join(found, ["case_id", "position"]).select("id", "proven")
