"""File, page, quote, card and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cards as C
from ..operators import quotes as K
from ..operators import reconcile as R
from ..sources import eml as M
from ..sources import export as E
from ..sources import files as S
from ..sources import pages as P
from . import checksql as Q
from .registry import query
from .span_queries import _map, body_fields
from .text_queries import stamp

# ---- files


def _files(t):
    return t.fx_files.withColumn("length", F.col("size"))


@query("files_hashed", "SELECT page_id, sha256(content) AS sha FROM fx_files")
def _(t):
    return S.with_sha256(t.fx_files).select("page_id", "sha")


@query(
    "files_classified",
    """SELECT page_id, CASE WHEN size > 3000 THEN 'skipped' WHEN page_id % 5 = 1 THEN 'failed' ELSE 'ready' END AS status,
       CASE WHEN size > 3000 THEN 'File exceeds the 3000 byte limit' WHEN page_id % 5 = 1 THEN 'Unsupported file type: .txt' END AS error FROM fx_files""",
)
def _(t):
    return S.classify_files(_files(t).drop("status"), max_bytes=3000).select("page_id", "status", "error")


@query("files_within_limit", "SELECT page_id FROM fx_files WHERE size <= 3000")
def _(t):
    return S.partition_by_size(_files(t), 3000)[0].select("page_id")


_KNOWN = "SELECT digest FROM fx_files WHERE page_id % 3 = 0 AND page_id % 2 = 0"


def _known(t):
    deleted = F.when(F.col("page_id") % 2 == 1, F.current_timestamp())
    emails = t.fx_files.filter("page_id % 3 = 0").select(F.lit(1).alias("case_id"), F.col("digest").alias("source_sha"), deleted.alias("deleted_at"))
    return S.new_files(t.fx_files.withColumnRenamed("digest", "sha"), emails, 1)


@query("files_new", f"SELECT page_id FROM fx_files WHERE digest NOT IN ({_KNOWN})")
def _(t):
    return _known(t)[0].select("page_id")


@query("files_known", f"SELECT page_id FROM fx_files WHERE digest IN ({_KNOWN})")
def _(t):
    return _known(t)[1].select("page_id")


@query("sources_stored", "SELECT substr(sha256(text), 1, 2) AS shard, count(DISTINCT sha256(text)) AS contents FROM documents GROUP BY 1")
def _(t):
    files = t.documents.select(F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return S.store_sources(files).groupBy("shard").agg(F.count("*").alias("contents"))


@query("sources_relinked", "SELECT id, (SELECT min(concat('/moved/', lpad(CAST(doc_id AS VARCHAR), 8, '0'))) FROM documents d WHERE md5(d.text) = e.source_sha) AS source_file FROM fx_emails e")
def _(t):
    files = t.documents.select(F.md5(F.col("text").cast("binary")).alias("sha"), F.concat(F.lit("/moved/"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("path"))
    return S.relink_sources(t.fx_emails, files)


@query(
    "job_status",
    """SELECT job_id, count(*) AS total_files, count(*) FILTER (status = 'parsed') AS processed_files, count(*) FILTER (status = 'failed') AS failed_files,
       CASE WHEN count(*) = count(*) FILTER (status = 'failed') THEN 'failed' ELSE 'completed' END AS status FROM fx_files GROUP BY job_id""",
)
def _(t):
    return S.job_status(t.fx_files)


@query(
    "ingest_summary",
    """SELECT f.job_id, f.n AS file_count, f.first AS first_file, coalesce(e.n, 0) AS email_count, coalesce(e.q, 0) AS quoted FROM (SELECT job_id, count(*) AS n, min(path) AS first FROM fx_files GROUP BY 1) f
       LEFT JOIN (SELECT id % 10 AS job_id, count(*) AS n, count(*) FILTER (source_kind = 'quoted') AS q FROM fx_emails GROUP BY 1) e ON e.job_id = f.job_id""",
)
def _(t):
    out = S.ingest_summary(t.fx_emails.withColumn("job_id", F.col("id") % 10), t.fx_files)
    return out.select("job_id", "file_count", "first_file", "email_count", F.coalesce(F.try_element_at("counts", F.lit("quoted")), F.lit(0)).alias("quoted"))


@query("jobs_with_files", "SELECT c.id, f.path AS file_path, f.status AS file_status FROM fx_cases c LEFT JOIN fx_files f ON f.job_id = c.id")
def _(t):
    return S.jobs_with_files(t.fx_cases.select("id"), t.fx_files)


def _guarded(t):
    files = t.fx_files.select(F.col("page_id").alias("email_id"), F.col("path").alias("filename"), "size")
    return S.guard_attachments(files, 3000)


@query("attachments_kept", "SELECT page_id AS email_id, path AS filename FROM fx_files WHERE size <= 3000")
def _(t):
    return _guarded(t)[0].select("email_id", "filename")


@query("attachment_warnings", "SELECT page_id AS email_id, concat('attachment_too_large:', path) AS warning FROM fx_files WHERE size > 3000")
def _(t):
    return _guarded(t)[1]


@query(
    "chain_numbered",
    """SELECT conv_id, turn, CASE WHEN turn = 0 THEN 0 WHEN turn % 2 = 1 THEN (turn + 1) // 2 ELSE turn // 2 + count(*) FILTER (turn % 2 = 1) OVER (PARTITION BY conv_id) END AS chain_position FROM conversations""",
)
def _(t):
    kind = F.when(F.col("turn") == 0, "standalone").when(F.col("turn") % 2 == 1, "quoted").otherwise("attached")
    item = F.when(F.col("turn") % 2 == 1, F.expr("(turn + 1) div 2")).otherwise(F.expr("turn div 2"))
    rows = t.conversations.select("conv_id", "turn", F.col("conv_id").cast("string").alias("path"), kind.alias("source_kind"), item.alias("item"))
    return S.number_chain(rows).select("conv_id", "turn", F.col("chain_position").cast("long").alias("chain_position"))


@query("doc_codes", "SELECT case_id, count(DISTINCT source_sha) AS documents, count(DISTINCT source_sha) AS codes, count(*) AS cards FROM fx_emails GROUP BY 1")
def _(t):
    coded = S.assign_doc_ids(t.fx_emails.withColumn("root_id", F.col("source_sha")))
    return coded.groupBy("case_id").agg(F.count_distinct("root_id").alias("documents"), F.count_distinct("doc_id").alias("codes"), F.count("*").alias("cards"))


@query(
    "pages_cleaned",
    rf"""WITH l AS (SELECT doc_id, page_no, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM fx_page_text),
        b AS (SELECT doc_id, page_no, min(i) AS lo, max(i) AS hi FROM l WHERE {Q.strip('x')} <> '' GROUP BY 1, 2),
        k AS (SELECT l.*, i IN (lo, hi) AS edge, CASE WHEN regexp_matches({Q.strip('x')}, '(?i)^\s*(?:page\s+)?[-–]?\s*\d+\s*(?:of\s+\d+)?\s*[-–]?\s*$') THEN '#' ELSE regexp_replace({Q.strip('x')}, '(?i)page\s+\d+(?:\s+of\s+\d+)?', '#', 'g') END AS key FROM l JOIN b USING (doc_id, page_no)),
        c AS (SELECT doc_id, key, count(*) AS c FROM k WHERE edge GROUP BY 1, 2), n AS (SELECT doc_id, count(*) AS n FROM fx_page_text GROUP BY 1),
        o AS (SELECT c.doc_id, key FROM c JOIN n USING (doc_id) WHERE n >= 2 AND c >= greatest(2, (n + 1) // 2)),
        r AS (SELECT k.* FROM k LEFT JOIN o ON o.doc_id = k.doc_id AND o.key = k.key AND k.edge WHERE o.key IS NULL AND NOT regexp_matches(x, '(?i)^\s*(?:page\s+)?[-–]?\s*\d+\s*(?:of\s+\d+)?\s*[-–]?\s*$'))
        SELECT n.doc_id, md5(coalesce({Q.strip("regexp_replace(replace(string_agg(x, chr(10) ORDER BY page_no, i), chr(173), ''), '([A-Za-zÀ-ɏ])-' || chr(10) || '([a-zÀ-ɏ])', '\1\2', 'g')")}, '')) AS text_md5 FROM n LEFT JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id""",
)
def _(t):
    return P.clean_pages(t.fx_page_text).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# ---- quotes: every document gets a reply around it, with a top message longer than the quote


_TOP = "concat('Please see below.', chr(10), chr(10), reverse(translate(text, concat(chr(10), '>:'), '   ')), ' zz yy xx ww vv uu tt ss', chr(10), chr(10))"
_QUOTE = """CASE doc_id % 4 WHEN 0 THEN concat('-----Original Message-----', chr(10), 'From: q@x', chr(10), 'Sent: 1 Jan 2024 10:0', doc_id % 10, chr(10), 'Subject: old', chr(10), chr(10))
    WHEN 1 THEN concat('> From: q@x', chr(10), '> Date: 1 Jan 2024 10:0', doc_id % 10, chr(10), '> To: b@x; c@x', chr(10), '> Subject: old', chr(10), chr(10))
    WHEN 2 THEN concat('On 1 Jan 2024 10:0', doc_id % 10, ', q@x wrote:', chr(10))
    ELSE concat('发件人: q@x', chr(10), '发送时间: 1 Jan 2024 10:0', doc_id % 10, chr(10), '主题: old', chr(10), chr(10)) END"""


def _chained(t):
    """Documents dressed as replies: one of the four kinds of quote after a longer top message."""
    dressed = t.documents.selectExpr("doc_id AS id", f"concat({_TOP}, {_QUOTE}, text) AS dressed")
    return t.fx_emails.join(dressed, "id").withColumn("body_text", F.col("dressed")).withColumn("default_tz", F.lit("UTC")).drop("dressed")


_DRESSED = f"""q AS (SELECT doc_id AS id, text, length({_TOP}) AS start, length({_QUOTE}) + length(text) AS size FROM documents WHERE regexp_matches(text, '[^{Q.WS}]'))"""
_UNQUOTED = Q.strip("regexp_replace(text, '[ \t]+$', '', 'gm')")


@query(
    "quotes_extracted",
    f"""WITH {_DRESSED} SELECT id, 1 AS position, CAST(start AS INTEGER) AS start, CAST(start + size AS INTEGER) AS "end", CASE id % 4 WHEN 0 THEN 'original_message' WHEN 1 THEN 'outlook_header' WHEN 2 THEN 'on_wrote' ELSE 'localized_header' END AS method,
        'q@x' AS from_addr, CASE WHEN id % 4 = 1 THEN 'b@x;c@x' ELSE '' END AS "to", concat('1 Jan 2024 10:0', id % 10) AS date_raw, concat('2024-01-01 10:0', id % 10, ':00') AS utc,
        CASE WHEN id % 4 <> 2 THEN 'old' END AS subject, md5({_UNQUOTED}) AS body_md5, CASE WHEN id % 4 = 3 THEN 'low' ELSE 'med' END AS confidence FROM q""",
)
def _(t):
    rows = K.extract_quotes(_chained(t))
    return rows.select("id", "position", "start", "end", "method", "from_addr", F.array_join("to", ";").alias("to"), "date_raw", stamp("date_utc").alias("utc"), "subject", F.md5(F.col("body_text").cast("binary")).alias("body_md5"), "confidence")


@query(
    "quoted_rows",
    f"""WITH {_DRESSED} SELECT e.case_id, q.id AS parent_email_id, 1 AS chain_position, message_id AS in_reply_to, coalesce(message_id, '') AS refs, CASE WHEN q.id % 4 <> 2 THEN 'old' ELSE e.subject END AS subject,
        CASE WHEN q.id % 4 = 3 THEN 'low' ELSE 'med' END AS parse_confidence, concat('quoted_parse_uncertain,boundary:', CASE q.id % 4 WHEN 0 THEN 'original_message' WHEN 1 THEN 'outlook_header' WHEN 2 THEN 'on_wrote' ELSE 'localized_header' END) AS flags FROM q JOIN fx_emails e ON e.id = q.id""",
)
def _(t):
    emails = _chained(t)
    rows = K.quoted_rows(emails, K.extract_quotes(emails))
    return rows.select("case_id", "parent_email_id", "chain_position", "in_reply_to", F.array_join("references", " ").alias("refs"), "subject", "parse_confidence", F.array_join("flags", ",").alias("flags"))


@query(
    "printed_emails_detected",
    f"""WITH {_DRESSED} SELECT id, 'q@x' AS from_addr, CASE WHEN id % 4 = 1 THEN 'b@x;c@x' ELSE '' END AS "to", concat('1 Jan 2024 10:0', id % 10) AS date_raw, 'old' AS subject, md5({_UNQUOTED}) AS body_md5 FROM q WHERE id % 4 <> 2""",
)
def _(t):
    # the quoted part alone is what a printed message looks like; a reply line alone is no printed header
    printed = t.documents.selectExpr("doc_id AS id", f"concat({_QUOTE}, text) AS text")
    rows = K.detect_printed_email(printed)[0]
    return rows.select("id", "from_addr", F.array_join("to", ";").alias("to"), "date_raw", "subject", F.md5(F.col("body_text").cast("binary")).alias("body_md5"))


@query(
    "quote_blocks_deduplicated",
    f"""SELECT source, count(DISTINCT concat(lower(lang), chr(0), lower({Q.strip('text')}))) AS n FROM documents GROUP BY 1""",
)
def _(t):
    blocks = t.documents.select(F.col("source").alias("id"), F.col("doc_id").alias("position"), F.col("lang").alias("from_addr"), F.lit(None).cast("string").alias("subject"), F.col("text").alias("body_text"))
    return K.dedupe_blocks(blocks).groupBy(F.col("id").alias("source")).agg(F.count("*").alias("n"))


def _quoting(t):
    """The emails, and standalone ones quoted once more: some whole, some with words added."""
    again = t.fx_emails.filter("source_kind = 'standalone' AND id % 8 = 0").withColumn("id", F.col("id") + 100_000_000).withColumn("source_kind", F.lit("quoted"))
    longer = F.when(F.col("id") % 16 == 0, F.concat(F.col("body_text"), F.lit(" and a few words more"))).otherwise(F.concat(F.lit("  "), F.col("body_text")))
    return t.fx_emails.unionByName(again.withColumn("body_text", longer))


_QUOTING = f"""n AS MATERIALIZED (SELECT id, case_id, source_kind, {Q.body_norm('body_text')} AS body_norm FROM (SELECT id, case_id, source_kind, body_text FROM fx_emails
    UNION ALL SELECT id + 100000000, case_id, 'quoted', CASE WHEN id % 16 = 0 THEN concat(body_text, ' and a few words more') ELSE concat('  ', body_text) END FROM fx_emails WHERE source_kind = 'standalone' AND id % 8 = 0) AS every)"""
_EQUAL = "SELECT q.id FROM n q WHERE source_kind = 'quoted' AND body_norm <> '' AND EXISTS (SELECT 1 FROM n s WHERE s.source_kind = 'standalone' AND s.case_id = q.case_id AND s.body_norm = q.body_norm)"


@query("quoted_repeats_exact", f"WITH {_QUOTING} {_EQUAL}")
def _(t):
    emails = _quoting(t)
    return R.repeated_exactly(R._bodies(emails.filter("source_kind = 'quoted'")), R._bodies(emails.filter("source_kind = 'standalone'")))


@query(
    "quoted_reconciled",
    f"""WITH {_QUOTING}, sh AS ({Q.shingle_rows('n')}), h AS MATERIALIZED (SELECT DISTINCT sh.id, case_id, source_kind, {Q.hash28('shingle')} AS h FROM sh JOIN n ON n.id = sh.id),
        c AS (SELECT id, count(*) AS n FROM h GROUP BY 1), held AS (SELECT q.id FROM h q JOIN h s ON s.h = q.h AND s.case_id = q.case_id JOIN c ON c.id = q.id JOIN c AS d ON d.id = s.id AND 0.7 * d.n <= c.n
          WHERE q.source_kind = 'quoted' AND s.source_kind = 'standalone' GROUP BY q.id, s.id, c.n HAVING count(*) / c.n >= 0.7)
        SELECT id FROM n WHERE id NOT IN (SELECT id FROM held) AND id NOT IN ({_EQUAL})""",
)
def _(t):
    return R.reconcile_quoted(_quoting(t)).select("id")


# ---- cards


def _offsets(t):
    n = F.col("n_chars").cast("int")
    cuts = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit(0), (n / 2).cast("int"))).otherwise(F.array((n * 2 / 3).cast("int"), (n / 3).cast("int"), (n / 3).cast("int")))
    return t.documents.select(F.col("doc_id").alias("id"), cuts.alias("offsets"))


_SPLIT = f"""b AS (SELECT e.id, replace(replace(body_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS body, n_chars AS n FROM fx_emails e JOIN documents ON doc_id = e.id WHERE deleted_at IS NULL AND superseded_at IS NULL AND e.id % 7 <> 0),
    r AS (SELECT id, body, unnest([1, 2, 3]) AS part_index, unnest([0, n // 3, n * 2 // 3]) AS s, unnest([n // 3, n * 2 // 3, n]) AS e, n FROM b WHERE n // 3 > 0 AND n * 2 // 3 > n // 3 AND n * 2 // 3 < n),
    p AS (SELECT *, substr(body, s + 1, e - s) AS raw FROM r), q AS (SELECT *, {Q.strip('raw')} AS part FROM p), ok AS (SELECT id FROM q GROUP BY id HAVING min(length(part)) >= 3)"""


@query(
    "bodies_split",
    f"""WITH {_SPLIT} SELECT id AS source_email_id, part_index, CAST(s + length(raw) - length(regexp_replace(raw, '^[{Q.WS}]+', '')) AS BIGINT) AS start_offset, md5(part) AS part_md5 FROM q WHERE id IN (SELECT id FROM ok)""",
)
def _(t):
    parts, _refused = C.split_bodies(t.fx_emails, _offsets(t))
    return parts.select("source_email_id", "part_index", F.col("start_offset").cast("long").alias("start_offset"), F.md5(F.col("body_text").cast("binary")).alias("part_md5"))


@query("splits_refused", f"WITH {_SPLIT} SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT id FROM ok)")
def _(t):
    return C.split_bodies(t.fx_emails, _offsets(t))[1]


@query(
    "snip_parts",
    f"""WITH {_SPLIT} SELECT q.id AS parent_email_id, part_index AS chain_position, CASE WHEN part_index = 1 THEN message_id END AS message_id, CASE WHEN part_index > 1 THEN message_id END AS in_reply_to, e.subject,
        CASE WHEN part_index = 1 THEN concat('manual_snip,snip_part:1_of_3') ELSE concat('manual_snip,snip_part:', part_index, '_of_3,manual_snip_needs_review') END AS flags FROM q JOIN fx_emails e ON e.id = q.id WHERE q.id IN (SELECT id FROM ok)""",
)
def _(t):
    parts = C.snip(t.fx_emails, _offsets(t), t.fx_cases)["parts"]
    return parts.select("parent_email_id", "chain_position", "message_id", "in_reply_to", "subject", F.array_join("flags", ",").alias("flags"))


@query("emails_superseded", f"WITH {_SPLIT} SELECT id, superseded_at IS NOT NULL OR id IN (SELECT id FROM ok) AS superseded FROM fx_emails")
def _(t):
    return C.snip(t.fx_emails, _offsets(t), t.fx_cases)["emails"].select("id", F.col("superseded_at").isNotNull().alias("superseded"))


@query(
    "drafts_applied",
    f"WITH {_SPLIT} SELECT id AS source_email_id, part_index, concat('draft ', part_index) AS subject FROM q WHERE id IN (SELECT id FROM ok) AND id % 4 <> 1",
)
def _(t):
    parts, _refused = C.split_bodies(t.fx_emails, _offsets(t))
    none = F.array().cast("array<string>")
    drafts = parts.select("source_email_id", "part_index", ((F.col("source_email_id") % 4 != 1) | (F.col("part_index") < 3)).alias("approved"), F.lit("a@x").alias("from_addr"), none.alias("to"), none.alias("cc"), F.lit("junk").alias("date_raw"), F.concat(F.lit("draft "), F.col("part_index").cast("string")).alias("subject"), F.lit("body of it").alias("body_text"))
    return C.apply_drafts(parts, drafts)[0].select("source_email_id", "part_index", F.col("draft.subject").alias("subject"))


def _selected(t):
    spans = t.fx_spans.withColumn("group_id", F.col("source_email_id") % 200)
    bad = (F.col("group_id") % 11 == 0) & (F.col("mapping_kind") == "manual")
    return spans.select("group_id", (F.col("source_email_id") * 10 + F.when(F.col("mapping_kind") == "parsed", 0).when(F.col("mapping_kind") == "quoted", 1).when(F.col("mapping_kind") == "snipped", 2).otherwise(3)).alias("seq"),
                        "source_email_id", "source_field", "start_offset", F.when(bad, F.col("field_length") + 1).otherwise(F.col("end_offset")).alias("end_offset"))


_SELECTED = f"""s AS (SELECT source_email_id % 200 AS group_id, source_email_id * 10 + CASE mapping_kind WHEN 'parsed' THEN 0 WHEN 'quoted' THEN 1 WHEN 'snipped' THEN 2 ELSE 3 END AS seq, source_email_id,
      {Q.strip('substr(text, start_offset + 1, end_offset - start_offset)')} AS piece, (source_email_id % 200) % 11 <> 0 OR mapping_kind <> 'manual' AS inside, e.deleted_at IS NULL AS live FROM fx_spans JOIN documents ON doc_id = source_email_id JOIN fx_emails e ON e.id = source_email_id),
    bad AS (SELECT DISTINCT group_id FROM s WHERE NOT inside OR NOT live OR length(piece) < 3)"""


@query("cards_from_selections", f"WITH {_SELECTED} SELECT group_id, md5(string_agg(piece, chr(10) || chr(10) ORDER BY seq)) AS body_md5, count(*) AS n_ranges FROM s WHERE group_id NOT IN (SELECT group_id FROM bad) GROUP BY 1")
def _(t):
    cards, _mappings, _refused = C.cards_from_selections(t.fx_emails, body_fields(t), _selected(t))
    return cards.select("group_id", F.md5(F.col("body_text").cast("binary")).alias("body_md5"), "n_ranges")


@query(
    "selection_mappings",
    f"""WITH {_SELECTED}, m AS (SELECT *, CAST(coalesce(sum(length(piece) + 2) OVER (PARTITION BY group_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS target_start_offset FROM s WHERE group_id NOT IN (SELECT group_id FROM bad))
        SELECT group_id, seq, target_start_offset, CAST(target_start_offset + length(piece) AS BIGINT) AS target_end_offset FROM m""",
)
def _(t):
    mappings = C.cards_from_selections(t.fx_emails, body_fields(t), _selected(t))[1]
    return mappings.select("group_id", "seq", F.col("target_start_offset").cast("long").alias("target_start_offset"), F.col("target_end_offset").cast("long").alias("target_end_offset"))


# ---- exports


@query(
    "chronology_exported",
    f"""WITH e AS (SELECT *, coalesce(strftime(date_utc, '%Y-%m-%dT%H:%M:%S+00:00'), '') AS d, concat('t', id % 40) AS thread_id FROM fx_emails WHERE deleted_at IS NULL AND superseded_at IS NULL),
        n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY d, id) AS no FROM e), f AS (SELECT case_id, thread_id, row_number() OVER (PARTITION BY case_id ORDER BY min(no)) AS k FROM n GROUP BY 1, 2)
        SELECT n.case_id, no AS "No", d AS "Date", concat('Thread ', k) AS "Thread", from_addr AS "From", subject AS "Subject",
        coalesce((SELECT string_agg(DISTINCT name, '; ') FROM fx_email_tags l JOIN fx_tags g ON g.id = l.tag_id WHERE l.email_id = n.id), '') AS "Tags" FROM n JOIN f ON f.case_id = n.case_id AND f.thread_id = n.thread_id""",
)
def _(t):
    emails = t.fx_emails.withColumn("thread_id", F.concat(F.lit("t"), (F.col("id") % 40).cast("string")))
    return E.chronology_export(emails, t.fx_tags, t.fx_email_tags).select("case_id", F.col("No").cast("long").alias("No"), "Date", "Thread", "From", "Subject", "Tags")


@query("coverage_exported", "SELECT case_id, count(*) AS cards FROM fx_emails WHERE deleted_at IS NULL AND superseded_at IS NULL GROUP BY 1")
def _(t):
    return E.coverage_export(_map(t))["cards"].groupBy("case_id").agg(F.count("*").alias("cards"))


@query(
    "blobs_validated",
    """SELECT 'bad_name' AS kind, concat('x', page_id) AS ref FROM pages WHERE page_id % 5 = 0 UNION ALL SELECT 'bad_hash', sha256(concat(html, 'x')) FROM pages WHERE page_id % 5 = 1 UNION ALL SELECT 'bad_reference', 'none' FROM documents WHERE n_chars % 10 = 0""",
)
def _(t):
    sha = F.sha2(F.col("html").cast("binary"), 256)
    other = F.sha2(F.concat("html", F.lit("x")).cast("binary"), 256)
    name = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("x"), F.col("page_id").cast("string"))).when(F.col("page_id") % 5 == 1, other).otherwise(sha)
    blobs = t.pages.select(name.alias("name"), F.col("html").alias("content"))
    emails = t.documents.select(F.when(F.col("n_chars") % 10 == 0, "none").otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("source_blob_sha256"))
    return E.validate_blobs(blobs, emails)


@query("case_exported", "SELECT case_id, count(*) AS emails FROM fx_emails WHERE case_id = 1 GROUP BY 1")
def _(t):
    cases = t.fx_cases
    tables = {"cases": cases, "emails": t.fx_emails, "email_tags": t.fx_email_tags}
    return E.case_tables(tables, 1)["emails"].groupBy("case_id").agg(F.count("*").alias("emails"))


# ---- mail files: every document written out as a message with its page attached


def _mail(t):
    head = F.concat(
        F.lit("Message-ID: <"), F.col("doc_id").cast("string"), F.lit("@x>\r\nFrom: Ann "), F.lit("<"), "source", F.lit("@x>\r\nTo: b@x, Bob <c@x>\r\nSubject: Re: "), "source",
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("\r\nDate: Mon, 1 Jan 2024 10:0"), (F.col("doc_id") % 10).cast("string"), F.lit(":00 +0800"))),
        F.lit("\r\nReferences: <a@x> <b@x>\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=cut\r\n\r\n"),
    )
    text = F.concat(F.lit("--cut\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"), F.base64(F.col("text").cast("binary")))
    inner = F.concat(F.lit("\r\n--cut\r\nContent-Type: message/rfc822\r\n\r\nMessage-ID: <in"), F.col("doc_id").cast("string"), F.lit("@x>\r\nSubject: Inner\r\n\r\ninner "), "lang", F.lit("\r\n--cut--\r\n"))
    return t.documents.select(F.concat(F.lit("/mail/"), F.col("doc_id").cast("string"), F.lit(".eml")).alias("path"), F.concat(head, text, inner).cast("binary").alias("content"))


@query(
    "messages_parsed",
    f"""SELECT concat('/mail/', doc_id, '.eml') AS path, concat('<', doc_id, '@x>') AS message_id, concat('Ann <', source, '@x>') AS from_addr, 'b@x|Bob <c@x>' AS recipients, concat('Re: ', source) AS subject,
        CASE WHEN doc_id % 3 <> 0 THEN concat('2024-01-01 02:0', doc_id % 10, ':00') END AS utc, CASE WHEN doc_id % 3 = 0 THEN 'low' ELSE 'high' END AS parse_confidence,
        md5({Q.strip("replace(text, chr(13) || chr(10), chr(10))")}) AS body_md5, CAST(1 AS BIGINT) AS n_attachments FROM documents""",
)
def _(t):
    rows = M.parse_eml(_mail(t)).filter("depth = 0")
    return rows.select("path", "message_id", "from_addr", F.array_join("to", "|").alias("recipients"), "subject", stamp("date_utc").alias("utc"), "parse_confidence",
                       F.md5(F.col("body_text").cast("binary")).alias("body_md5"), F.size("attachments").cast("long").alias("n_attachments"))


@query(
    "attached_messages",
    "SELECT concat('/mail/', doc_id, '.eml') AS path, 1 AS chain_position, 0 AS parent_node, concat('<in', doc_id, '@x>') AS message_id, concat('inner ', lang) AS body_text FROM documents",
)
def _(t):
    return M.explode_attached(M.parse_eml(_mail(t))).select("path", "chain_position", "parent_node", "message_id", "body_text")
