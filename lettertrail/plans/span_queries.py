"""Text-span queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spans as S
from ..operators.scan import first_seen_index
from . import checksql as Q
from .registry import query

_MERGED = """live AS (SELECT source_email_id, source_field, greatest(start_offset, 0) AS s, least(end_offset, field_length) AS e FROM fx_spans WHERE NOT stale AND end_offset > start_offset),
  flagged AS (SELECT *, s > max(e) OVER w AS opens, max(e) OVER w IS NULL AS first FROM live WINDOW w AS (PARTITION BY source_email_id, source_field ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  numbered AS (SELECT *, sum(CASE WHEN first OR opens THEN 1 ELSE 0 END) OVER (PARTITION BY source_email_id, source_field ORDER BY s, e) AS island FROM flagged),
  merged AS (SELECT source_email_id, source_field, min(s) AS start_offset, max(e) AS end_offset FROM numbered GROUP BY source_email_id, source_field, island)"""
_GAPS = """edge AS (SELECT source_email_id, start_offset, end_offset FROM merged UNION ALL SELECT doc_id, n_chars, n_chars FROM documents WHERE n_chars > 0),
  gap AS (SELECT source_email_id, coalesce(max(end_offset) OVER (PARTITION BY source_email_id ORDER BY start_offset, end_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_offset, start_offset AS end_offset FROM edge)"""


def body_fields(t):
    return t.documents.filter("n_chars > 0").select(
        F.col("doc_id").alias("source_email_id"), F.lit("body").alias("source_field"), F.col("n_chars").alias("field_length"), "text"
    )


@query("ranges_merged", f"WITH {_MERGED} SELECT source_email_id, start_offset, end_offset FROM merged")
def _(t):
    return S.merge_ranges(t.fx_spans).select("source_email_id", "start_offset", "end_offset")


@query(
    "gaps_found",
    f"""WITH {_MERGED}, {_GAPS} SELECT source_email_id, start_offset, end_offset FROM gap JOIN documents ON doc_id = source_email_id
        WHERE end_offset > start_offset AND {Q.strip('substr(text, start_offset + 1, end_offset - start_offset)')} <> ''""",
)
def _(t):
    return S.gap_ranges(S.merge_ranges(t.fx_spans), body_fields(t)).select("source_email_id", "start_offset", "end_offset")


def _coverage(by: str) -> str:
    return f"""WITH {_MERGED}, c AS (SELECT source_email_id, sum(end_offset - start_offset) AS covered FROM merged GROUP BY 1),
        f AS (SELECT doc_id AS source_email_id, doc_id % 5 AS case_id, n_chars, coalesce(covered, 0) AS covered FROM documents LEFT JOIN c ON doc_id = source_email_id WHERE n_chars > 0)
        SELECT {by}, CAST(sum(covered) AS BIGINT) AS covered_chars, CAST(sum(n_chars) AS BIGINT) AS total_chars, CAST(sum(n_chars) - sum(covered) AS BIGINT) AS unmapped_chars,
        round_even(sum(covered) / sum(n_chars) * 100, 1) AS coverage_percent FROM f GROUP BY {by}"""


@query("coverage_by_source", _coverage("source_email_id"))
def _(t):
    return S.coverage(S.merge_ranges(t.fx_spans), body_fields(t), ["source_email_id"])


@query("coverage_by_case", _coverage("case_id"))
def _(t):
    fields = body_fields(t).withColumn("case_id", F.col("source_email_id") % 5)
    return S.coverage(S.merge_ranges(t.fx_spans), fields, ["case_id"])


@query(
    "segments_displayed",
    """WITH o AS (SELECT *, CASE mapping_kind WHEN 'manual' THEN 0 WHEN 'snipped' THEN 1 WHEN 'quoted' THEN 2 WHEN 'attached' THEN 2 WHEN 'parsed' THEN 3 WHEN 'self' THEN 3 ELSE 4 END AS r FROM fx_spans WHERE end_offset > start_offset),
       c AS (SELECT *, coalesce(max(end_offset) OVER (PARTITION BY source_email_id, source_field ORDER BY start_offset, r, target_email_id, end_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor FROM o)
       SELECT source_email_id, greatest(start_offset, cursor) AS start_offset, end_offset, target_email_id, mapping_kind FROM c WHERE end_offset > greatest(start_offset, cursor)""",
)
def _(t):
    return S.segments(t.fx_spans).drop("source_field")


_BLOCKS = rf"""p AS (SELECT id, n, piece, coalesce(sum(length(piece)) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
    FROM (SELECT doc_id AS id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS n FROM (SELECT doc_id, string_split(regexp_replace(text, '([^{Q.WS}])(\n\n)', '\1' || chr(57350) || '\2', 'g'), chr(57350)) AS ps FROM documents) AS s) AS u),
  para AS (SELECT id, pos + length(piece) - length(regexp_replace(piece, '^[{Q.WS}]+', '')) AS start_offset, pos + length(piece) AS end_offset FROM p WHERE {Q.strip('piece')} <> '' AND regexp_matches(piece, '[^{Q.WS}]$')),
  many AS (SELECT id FROM para GROUP BY id HAVING count(*) > 1),
  l AS (SELECT id, piece, coalesce(sum(length(piece) + 1) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
    FROM (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS piece, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE doc_id NOT IN (SELECT id FROM many)) AS v)"""


@query(
    "text_blocks",
    f"""WITH {_BLOCKS} SELECT id AS source_email_id, CAST(start_offset AS BIGINT) AS start_offset, CAST(end_offset AS BIGINT) AS end_offset FROM para WHERE id IN (SELECT id FROM many)
        UNION ALL SELECT id, CAST(pos AS BIGINT), CAST(pos + length(piece) AS BIGINT) FROM l WHERE {Q.strip('piece')} <> ''""",
)
def _(t):
    return S.text_blocks(body_fields(t)).drop("source_field")


def _rich(t):
    none = F.array().cast("array<string>")
    return t.fx_emails.withColumn("to", F.array(F.lit("a@x"), F.col("from_addr"))).withColumn("cc", none).withColumn(
        "date_raw", F.date_format("date_utc", "yyyy-MM-dd")
    ).withColumn("in_reply_to", F.lit(None).cast("string")).withColumn("references", none).withColumn("body_html", F.concat(F.lit("<p>"), "subject", F.lit("</p>")))


def _files(t):
    return t.fx_files.select(
        F.col("page_id").alias("id"), F.col("page_id").alias("email_id"), F.col("path").alias("filename"), F.lit("text/html").alias("mime"), "size"
    )


_FIELDS = """SELECT id AS source_email_id, unnest(['headers', 'subject', 'body', 'html', 'attachments']) AS source_field,
   unnest([concat_ws(chr(10), concat('From: ', from_addr), concat('To: a@x; ', from_addr), concat('Date: ', coalesce(strftime(date_utc, '%Y-%m-%d'), '')), 'Message-ID: ' || message_id),
     subject, body_text, subject, coalesce('#' || f.page_id || ' ' || f.path || ' (text/html, ' || f.size || ' bytes)', '')]) AS text
   FROM (SELECT id, subject, body_text, from_addr, date_utc, message_id FROM fx_emails) e LEFT JOIN fx_files f ON f.page_id = e.id"""


@query(
    "source_fields",
    f"""SELECT source_email_id, source_field, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS field_length FROM (
        SELECT x.source_email_id, x.source_field, CASE WHEN x.source_field = 'html' THEN {Q.strip('x.text')} ELSE x.text END AS text FROM ({_FIELDS}) x) y
        WHERE {Q.strip('text')} <> ''""",
)
def _(t):
    fields = S.source_fields(_rich(t), _files(t))
    return fields.select("source_email_id", "source_field", F.md5(F.col("text").cast("binary")).alias("text_md5"), "field_length")


@query(
    "self_mappings",
    "SELECT doc_id AS source_email_id, 'body' AS source_field, CAST(0 AS BIGINT) AS start_offset, n_chars AS end_offset, doc_id AS target_email_id, 'parsed' AS mapping_kind, 1.0::DOUBLE AS confidence FROM documents WHERE n_chars > 0",
)
def _(t):
    return S.self_mappings(body_fields(t)).select("source_email_id", "source_field", "start_offset", "end_offset", "target_email_id", "mapping_kind", "confidence")


@query(
    "quoted_mappings",
    "SELECT doc_id - 1 AS source_email_id, n_chars // 4 AS start_offset, n_chars AS end_offset, doc_id AS target_email_id FROM (SELECT d.doc_id, d.n_chars, p.n_chars AS parent_chars FROM documents d JOIN documents p ON p.doc_id = d.doc_id - 1) x WHERE n_chars // 4 < n_chars AND n_chars <= parent_chars",
)
def _(t):
    quoted = t.documents.select(F.col("doc_id").alias("id"), (F.col("doc_id") - 1).alias("parent_email_id"), F.expr("n_chars div 4").alias("source_start_offset"), F.col("n_chars").alias("source_end_offset"))
    return S.quoted_mappings(quoted, t.fx_emails).select("source_email_id", "start_offset", "end_offset", "target_email_id")


@query(
    "attachment_mappings",
    """SELECT page_id AS source_email_id, CAST(0 AS BIGINT) AS start_offset, CAST(length(concat('#', page_id, ' ', path, ' (text/html, ', size, ' bytes)')) AS BIGINT) AS end_offset, page_id + 1000000 AS target_email_id
       FROM fx_files JOIN fx_emails ON fx_emails.id = page_id""",
)
def _(t):
    attached = t.fx_files.select((F.col("page_id") + 1000000).alias("id"), F.col("page_id").alias("parent_email_id"), F.col("page_id").alias("attachment_id"))
    out = S.attachment_mappings(attached, S.source_fields(_rich(t), _files(t)), _files(t))
    return out.select("source_email_id", "start_offset", "end_offset", "target_email_id")


@query(
    "spans_validated",
    "SELECT source_email_id, mapping_kind, start_offset, end_offset, least(1.0, 0.5 + start_offset / 100) AS confidence FROM fx_spans WHERE source_email_id % 10 <> 3 AND start_offset < end_offset AND end_offset <= field_length",
)
def _(t):
    field = F.when(F.col("source_email_id") % 10 == 3, "footer").otherwise(F.col("source_field"))
    rows = t.fx_spans.withColumn("source_field", field).withColumn("target_field", F.lit("body")).withColumn("confidence", 0.5 + F.col("start_offset") / 100)
    return S.valid_spans(rows)[0].select("source_email_id", "mapping_kind", "start_offset", "end_offset", "confidence")


_LIVE = """m AS (SELECT m.* FROM fx_spans m WHERE source_email_id IN (SELECT id FROM fx_emails WHERE deleted_at IS NULL) AND target_email_id IN (SELECT id FROM fx_emails WHERE deleted_at IS NULL AND superseded_at IS NULL))"""


@query("live_mappings", f"WITH {_LIVE} SELECT source_email_id, mapping_kind, target_email_id FROM m")
def _(t):
    return S.live_mappings(t.fx_spans, t.fx_emails).select("source_email_id", "mapping_kind", "target_email_id")


@query(
    "stale_refreshed",
    """SELECT source_email_id, mapping_kind, coalesce(s.deleted_at IS NOT NULL OR s.id IS NULL, true) OR coalesce(t.deleted_at IS NOT NULL OR t.id IS NULL, true) AS stale
       FROM fx_spans m LEFT JOIN fx_emails s ON s.id = source_email_id LEFT JOIN fx_emails t ON t.id = target_email_id""",
)
def _(t):
    return S.refresh_stale(t.fx_spans, t.fx_emails).select("source_email_id", "mapping_kind", "stale")


@query(
    "mapping_stats",
    f"""WITH {_LIVE}, o AS (SELECT source_email_id AS id, count(*) AS outbound, count(*) FILTER (mapping_kind = 'manual') AS n_manual FROM m WHERE NOT stale GROUP BY 1), i AS (SELECT target_email_id AS id, count(*) AS inbound FROM m WHERE NOT stale GROUP BY 1)
        SELECT e.id AS source_email_id, coalesce(outbound, 0) AS outbound, coalesce(inbound, 0) AS inbound, coalesce(n_manual, 0) AS n_manual,
        CASE WHEN outbound > 0 AND inbound > 0 THEN 'source_and_destination' WHEN outbound > 0 THEN 'source' WHEN inbound > 0 THEN 'destination' ELSE 'untracked' END AS mapping_role,
        CASE WHEN length(body_text) = 0 THEN 'empty' WHEN outbound > 0 THEN 'mapped_source' WHEN inbound > 0 THEN 'created_from_source' ELSE 'unmapped' END AS mapping_status
        FROM fx_emails e LEFT JOIN o ON o.id = e.id LEFT JOIN i ON i.id = e.id WHERE e.deleted_at IS NULL""",
)
def _(t):
    totals = t.documents.select(F.col("doc_id").alias("source_email_id"), F.col("n_chars").alias("total_chars"))
    return S.mapping_stats(t.fx_spans, t.fx_emails, totals).select("source_email_id", "outbound", "inbound", "n_manual", "mapping_role", "mapping_status")


@query(
    "map_status",
    """SELECT case_id, count(*) AS source_count, count(*) FILTER (length(body_text) > 0) AS cached_source_count, count(*) FILTER (id IN (SELECT source_email_id FROM fx_spans WHERE NOT stale)) AS mapped_source_count,
       coalesce((SELECT count(*) FROM fx_files f WHERE f.job_id = e.case_id AND f.status = 'skipped'), 0) AS running_jobs, coalesce((SELECT count(*) FROM fx_files f WHERE f.job_id = e.case_id AND f.status = 'skipped'), 0) = 0 AS ready
       FROM fx_emails e WHERE deleted_at IS NULL GROUP BY case_id""",
)
def _(t):
    jobs = t.fx_files.select(F.col("job_id").alias("case_id"), F.when(F.col("status") == "skipped", "running").otherwise("done").alias("status"))
    return S.map_status(t.fx_emails, t.fx_spans, body_fields(t), jobs)


def _map(t):
    emails = t.fx_emails.withColumn("source_file_display", F.concat(F.lit("doc-"), F.col("id").cast("string")))
    return S.build_map(emails, t.fx_spans.drop("field_length"), body_fields(t))


@query(
    "map_mappings",
    f"""WITH {_LIVE}, x AS (SELECT m.*, e.case_id FROM m JOIN fx_emails e ON e.id = source_email_id),
        f AS (SELECT case_id, target_email_id, min(row(source_email_id, source_field, start_offset)) AS first FROM x GROUP BY 1, 2),
        c AS (SELECT case_id, target_email_id, (row_number() OVER (PARTITION BY case_id ORDER BY first) - 1) % 12 AS color_index FROM f)
        SELECT x.source_email_id, x.mapping_kind, x.target_email_id, c.color_index, t.subject AS target_subject FROM x JOIN c ON c.target_email_id = x.target_email_id AND c.case_id = (SELECT case_id FROM fx_emails q WHERE q.id = x.source_email_id) JOIN fx_emails t ON t.id = x.target_email_id""",
)
def _(t):
    emails = t.fx_emails
    live = S.live_mappings(t.fx_spans, emails).join(emails.select(F.col("id").alias("source_email_id"), "case_id"), "source_email_id")
    colour = first_seen_index(live, "target_email_id", ["source_email_id", "source_field", "start_offset"], ["case_id"], "color_index", S.COLOURS)
    subjects = emails.select(F.col("id").alias("target_email_id"), F.col("subject").alias("target_subject"))
    return live.join(colour, ["case_id", "target_email_id"]).join(subjects, "target_email_id").select("source_email_id", "mapping_kind", "target_email_id", "color_index", "target_subject")


@query(
    "map_summary",
    f"""WITH {_LIVE}, {_MERGED.replace('FROM fx_spans', 'FROM m')}, c AS (SELECT source_email_id, sum(end_offset - start_offset) AS covered FROM merged GROUP BY 1),
        f AS (SELECT case_id, coalesce(n_chars, 0) AS n, coalesce(covered, 0) AS covered, e.superseded_at FROM fx_emails e JOIN documents ON doc_id = e.id LEFT JOIN c ON c.source_email_id = e.id WHERE e.deleted_at IS NULL)
        SELECT case_id, count(*) AS source_count, count(*) FILTER (superseded_at IS NULL) AS target_count, CAST(sum(covered) AS BIGINT) AS covered_chars, CAST(sum(n) AS BIGINT) AS total_chars, round_even(sum(covered) / sum(n) * 100, 1) AS coverage_percent FROM f GROUP BY 1""",
)
def _(t):
    return _map(t)["summary"].select("case_id", "source_count", "target_count", "covered_chars", "total_chars", "coverage_percent")
