"""Filter, search, order and read queries."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ..operators import pages
from ..operators import search as S
from ..operators.scan import first_seen_index, ranked
from ..session import shared_folder
from .registry import query
from .text_queries import STAMP, stamp

_LIVE = "deleted_at IS NULL AND superseded_at IS NULL"


@query("visible_emails", f"SELECT id, case_id FROM fx_emails WHERE {_LIVE}")
def _(t):
    return S.visible(t.fx_emails).select("id", "case_id")


@query("emails_between_dates", "SELECT id FROM fx_emails WHERE date_utc >= TIMESTAMP '2024-01-02' AND date_utc < TIMESTAMP '2024-01-04'")
def _(t):
    return S.date_between(t.fx_emails, "2024-01-02", "2024-01-03").select("id")


@query("emails_with_tag", "SELECT id FROM fx_emails WHERE id IN (SELECT email_id FROM fx_email_tags WHERE tag_id = 1)")
def _(t):
    return S.with_tag(t.fx_emails, t.fx_email_tags, 1).select("id")


@query("phrase_search", "SELECT id FROM fx_emails WHERE contains(lower(subject), 'er the') OR contains(lower(body_text), 'er the')")
def _(t):
    return S.search(t.fx_emails, " ER the ").select("id")


@query(
    "trigram_index",
    """SELECT id, count(DISTINCT g) AS n_grams FROM (
         SELECT id, substr(x, i, 3) AS g FROM (SELECT id, x, unnest(range(1, length(x) - 1)) AS i FROM (SELECT id, lower(subject) AS x FROM fx_emails UNION ALL SELECT id, lower(body_text) FROM fx_emails) a WHERE length(x) >= 3) b) c GROUP BY id""",
)
def _(t):
    return S.build_trigrams(t.fx_emails).groupBy("id").agg(F.count("*").alias("n_grams"))


@query("indexed_search", "SELECT id FROM fx_emails WHERE contains(lower(subject), 'tion of') OR contains(lower(body_text), 'tion of')")
def _(t):
    emails = t.fx_emails
    return S.search_indexed(S.build_trigrams(emails), emails, "tion of").select("id")


@query("match_count", f"SELECT count(DISTINCT id) AS total FROM fx_emails WHERE {_LIVE} AND (contains(lower(subject), 'the') OR contains(lower(body_text), 'the'))")
def _(t):
    return S.count_matches(S.search(S.visible(t.fx_emails), "the"))


@query("trashed_emails", f"SELECT id, strftime(deleted_at, '{STAMP}') AS deleted FROM fx_emails WHERE deleted_at >= TIMESTAMP '2024-04-15' - INTERVAL 30 DAY")
def _(t):
    return S.trash(t.fx_emails, datetime(2024, 4, 15)).select("id", stamp("deleted_at").alias("deleted"))


_CHRONO = "manual_chrono_order NULLS LAST, coalesce(date_utc, created_at), id"


@query("chronology_order", f"SELECT id, row_number() OVER (PARTITION BY case_id ORDER BY {_CHRONO}) AS place FROM fx_emails")
def _(t):
    order = [F.coalesce("manual_chrono_order", F.lit(2**62)), F.coalesce("date_utc", "created_at"), F.col("id")]
    return ranked(t.fx_emails.select("id", "case_id", "manual_chrono_order", "date_utc", "created_at"), order, ["case_id"], "place").select("id", F.col("place").cast("long"))


@query("chronology_head", f"SELECT id FROM fx_emails ORDER BY {_CHRONO} LIMIT 100")
def _(t):
    return S.order_chrono(t.fx_emails).limit(100).select("id")


@query(
    "thread_order",
    """WITH e AS (SELECT e.id, case_id, concat('t', id % 50) AS thread_id, CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS parent, date_utc, created_at FROM fx_emails e)
       SELECT id, row_number() OVER (PARTITION BY thread_id ORDER BY parent IS NOT NULL, coalesce(date_utc, created_at), id) AS place FROM e""",
)
def _(t):
    e = t.fx_emails.withColumn("thread_id", F.concat(F.lit("t"), (F.col("id") % 50).cast("string"))).withColumn("parent_email_id", F.when(F.col("id") % 3 != 0, F.col("id")))
    return ranked(e, S.thread_key(), ["thread_id"], "place").select("id", "place")


@query("chronology_positions", f"SELECT id, row_number() OVER (ORDER BY {_CHRONO}) AS position FROM fx_emails WHERE {_LIVE}")
def _(t):
    return ranked(S.visible(t.fx_emails), S.chrono_key()).select("id", "position")


@query(
    "chronology_seek",
    f"""WITH n AS (SELECT id, row_number() OVER (ORDER BY {_CHRONO}) - 1 AS position, count(*) OVER () AS total FROM fx_emails WHERE {_LIVE} AND id % 7 <> 0)
       SELECT s.start AS page, n.id, n.position, n.total, s.start + 150 < n.total AS has_more FROM n JOIN (SELECT unnest([0, 110, 640]) AS start) s ON n.position >= s.start AND n.position < s.start + 150""",
)
def _(t):
    """Pages at three places of a stored order from which every seventh email has gone."""
    emails = S.visible(t.fx_emails)
    path = f"{shared_folder(t.spark)}/order-{uuid.uuid4().hex}"
    pages.write_order(emails.select("id", "manual_chrono_order", "date_utc", "created_at"), S.chrono_key(), path, 1000)
    pages.take_out(t.spark, path, emails.filter("id % 7 = 0"))
    parts = [pages.read_page(t.spark, path, 150, start).select(F.lit(start).alias("page"), "id", "position", "total", "has_more") for start in (0, 110, 640)]
    return parts[0].union(parts[1]).union(parts[2])


@query("chronology_page", f"SELECT id, total, 250 < total AS has_more FROM (SELECT *, count(*) OVER () AS total FROM fx_emails WHERE {_LIVE}) x ORDER BY {_CHRONO} LIMIT 150 OFFSET 100")
def _(t):
    return S.page(S.order_chrono(S.visible(t.fx_emails)), 150, 100).select("id", "total", "has_more")


@query(
    "chrono_order_set",
    """WITH live AS (SELECT id, case_id FROM fx_emails WHERE deleted_at IS NULL), n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY id DESC) - 1 AS pos FROM live)
       SELECT e.id, CASE WHEN e.case_id <> 2 AND n.id IS NOT NULL THEN n.pos ELSE e.manual_chrono_order END AS place FROM fx_emails e LEFT JOIN n ON n.id = e.id""",
)
def _(t):
    live = t.fx_emails.filter("deleted_at IS NULL").select("case_id", "id", (-F.col("id")).alias("position"))
    extra = live.filter("case_id = 2").select("case_id", (F.col("id") + 10_000_000).alias("id"), "position")
    ordered, _bad = S.set_chrono_order(t.fx_emails, live.union(extra))
    return ordered.select("id", F.col("manual_chrono_order").alias("place"))


@query(
    "chain_order_set",
    """WITH e AS (SELECT id, case_id, id // 10 AS g, deleted_at FROM fx_emails), n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id DESC) - 1 AS pos FROM e),
       ok AS (SELECT g FROM e GROUP BY g HAVING count(*) = count(*) FILTER (deleted_at IS NULL))
       SELECT n.id, CASE WHEN n.g IN (SELECT g FROM ok) THEN n.pos END AS place FROM n""",
)
def _(t):
    e = t.fx_emails.withColumn("thread_id", F.concat(F.lit("t"), F.floor(F.col("id") / 10).cast("string"))).withColumn("manual_chain_order", F.lit(None).cast("long"))
    ids = e.select(F.floor(F.col("id") / 10).alias("request_id"), "id", (-F.col("id")).alias("position"))
    return S.set_chain_order(e, ids)[0].select("id", F.col("manual_chain_order").alias("place"))


@query("tags_by_name", "SELECT t.id, name, count(l.email_id) AS uses FROM fx_tags t LEFT JOIN fx_email_tags l ON l.tag_id = t.id GROUP BY 1, 2")
def _(t):
    uses = t.fx_email_tags.groupBy("tag_id").agg(F.count("*").alias("uses"))
    joined = t.fx_tags.join(uses, F.col("id") == F.col("tag_id"), "left")
    return S.order_nocase(joined).select("id", "name", F.coalesce("uses", F.lit(0)).alias("uses"))


@query(
    "senders_first_seen",
    """SELECT case_id, from_addr, (row_number() OVER (PARTITION BY case_id ORDER BY first) - 1) % 12 AS color_index FROM (SELECT case_id, from_addr, min(row(coalesce(date_utc, created_at), id)) AS first FROM fx_emails GROUP BY 1, 2) x""",
)
def _(t):
    e = t.fx_emails.withColumn("at", F.coalesce("date_utc", "created_at"))
    return first_seen_index(e, "from_addr", ["at", "id"], ["case_id"], "color_index", 12)


@query("flags_per_email", "SELECT email_id, string_agg(DISTINCT field, ',' ORDER BY field) AS flags FROM fx_edits GROUP BY email_id")
def _(t):
    return S.flags_agg(t.fx_edits.select("email_id", F.col("field").alias("flag")))


@query(
    "emails_hydrated",
    """SELECT e.id, f.flags, coalesce(a.n, 0) AS n_attachments, g.tags, (SELECT count(*) FROM fx_pairs p WHERE p.status = 'pending' AND (p.email_a_id = e.id OR p.email_b_id = e.id)) AS pending_duplicates,
       CASE source_kind WHEN 'attached' THEN 'attached_email' WHEN 'quoted' THEN 'quoted_text' ELSE 'mime' END AS boundary_method, CASE WHEN source_kind = 'quoted' THEN 'low' ELSE 'high' END AS relation_confidence
       FROM fx_emails e LEFT JOIN (SELECT email_id, string_agg(DISTINCT field, ',' ORDER BY field) AS flags FROM fx_edits GROUP BY 1) f ON f.email_id = e.id
       LEFT JOIN (SELECT page_id, count(*) AS n FROM fx_files GROUP BY 1) a ON a.page_id = e.id
       LEFT JOIN (SELECT email_id, string_agg(DISTINCT name, ',') AS tags FROM fx_email_tags l JOIN fx_tags ON fx_tags.id = l.tag_id GROUP BY 1) g ON g.email_id = e.id""",
)
def _(t):
    flags = t.fx_edits.select("email_id", F.col("field").alias("flag"))
    files = t.fx_files.select(F.col("page_id").alias("id"), F.col("page_id").alias("email_id"), F.col("path").alias("filename"), F.lit("text/html").alias("mime"), "size", F.lit(False).alias("is_inline"))
    out = S.hydrate(t.fx_emails, flags, files, t.fx_tags, t.fx_email_tags, t.fx_pairs)
    names = F.array_join(F.transform("tags", lambda x: x["name"]), ",")
    return out.select("id", "flags", F.coalesce(F.nullif(F.size("attachments"), F.lit(-1)), F.lit(0)).cast("long").alias("n_attachments"), names.alias("tags"), "pending_duplicates", "boundary_method", "relation_confidence")


@query(
    "case_list",
    f"SELECT c.id, c.name, count(e.id) AS email_count FROM fx_cases c LEFT JOIN (SELECT * FROM fx_emails WHERE {_LIVE}) e ON e.case_id = c.id WHERE c.deleted_at IS NULL GROUP BY 1, 2",
)
def _(t):
    return S.case_summary(t.fx_cases, t.fx_emails).select("id", "name", "email_count")


@query("case_trash", f"SELECT c.id, c.name, count(e.id) AS email_count FROM fx_cases c LEFT JOIN (SELECT * FROM fx_emails WHERE {_LIVE}) e ON e.case_id = c.id WHERE c.deleted_at IS NOT NULL GROUP BY 1, 2")
def _(t):
    return S.case_summary(t.fx_cases, t.fx_emails, deleted=True).select("id", "name", "email_count")


@query("audit_listed", "SELECT id, action, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM fx_audit WHERE case_id = 1 ORDER BY id DESC LIMIT 200")
def _(t):
    return S.list_audit(t.fx_audit, 1, decode={"props": "k bigint"}).select("id", "action", F.col("props.k").alias("k"))


@query(
    "cases_found",
    "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN doc_id % 5 WHEN doc_id % 4 = 1 AND doc_id % 7 < 5 THEN doc_id % 7 END AS case_id FROM documents",
)
def _(t):
    public = t.fx_cases.withColumn("public_id", F.concat(F.lit("pub-"), F.col("id").cast("string")))
    n = F.col("doc_id")
    ref = F.when(n % 4 == 0, F.concat(F.lit("pub-"), (n % 5).cast("string"))).when(n % 4 == 1, (n % 7).cast("string")).otherwise(F.concat(F.lit("x"), n.cast("string")))
    refs = t.documents.select("doc_id", ref.alias("ref"))
    found = S.find_cases(public, refs.select("ref").distinct())
    return refs.join(found, "ref").select("doc_id", "case_id")


@query(
    "sources_located",
    """SELECT e.id, CASE WHEN e.id % 3 = 0 AND s.digest IS NOT NULL THEN 'store' WHEN e.id % 2 = 0 AND f.path IS NOT NULL THEN 'folder' ELSE 'none' END AS place,
       CASE WHEN e.id % 3 = 0 AND s.digest IS NOT NULL THEN concat('store/', s.digest) WHEN e.id % 2 = 0 AND f.path IS NOT NULL THEN f.path END AS location, '.eml' AS suffix
       FROM fx_emails e LEFT JOIN fx_files s ON s.page_id = e.id AND e.id % 3 = 0 LEFT JOIN fx_files f ON f.path = concat('/in/', e.id, '.eml')""",
)
def _(t):
    files = t.fx_files
    digests = files.select(F.col("page_id").alias("pid"), F.col("digest"))
    e = t.fx_emails.drop("source_sha").join(digests, F.col("pid") == F.col("id"), "left")
    e = e.select("id", F.coalesce("digest", F.concat(F.lit("none-"), F.col("id").cast("string"))).alias("source_sha"),
                 F.concat(F.lit("/in/"), F.col("id").cast("string"), F.lit(".eml")).alias("source_file"),
                 F.when(F.col("id") % 2 == 0, "folder").otherwise("upload").alias("source_import_mode"))
    store = files.filter("page_id % 3 = 0").select(F.col("digest").alias("sha"), F.concat(F.lit("store/"), "digest").alias("path"))
    return S.resolve_sources(e, store, files).select("id", "place", "location", "suffix")


@query("tags_matched", "SELECT t.id, t.name, count(l.email_id) AS uses FROM fx_tags t LEFT JOIN fx_email_tags l ON l.tag_id = t.id WHERE contains(lower(t.name), 'i') GROUP BY 1, 2")
def _(t):
    uses = t.fx_email_tags.groupBy("tag_id").agg(F.count("*").alias("uses"))
    found = S.match_tags(t.fx_tags, "I", [2]).join(uses, F.col("id") == F.col("tag_id"), "left")
    return found.select("id", "name", F.coalesce("uses", F.lit(0)).alias("uses"))


@query(
    "pages_upserted",
    "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'new' ELSE status END AS status FROM fx_files UNION ALL SELECT page_id + 1000000, 'new' FROM fx_files WHERE page_id % 2 = 0",
)
def _(t):
    now = t.fx_files.select("page_id", "status")
    even = now.filter("page_id % 2 = 0").withColumn("status", F.lit("new"))
    return S.upsert(now, even.union(even.withColumn("page_id", F.col("page_id") + 1000000)), "page_id")
