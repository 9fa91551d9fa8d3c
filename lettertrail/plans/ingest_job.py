"""The batch job behind an upload: files in, email rows and their derived tables out.

Stages only hand DataFrames on; the costly ones are materialised once because several later stages read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedup, delta, quotes, reconcile, threads
from ..operators.boilerplate import strip_boilerplate
from ..operators.scan import ranked
from ..session import materialise
from ..sources import eml, files as source_files

_COLUMNS = (
    "path", "root_id", "item", "source_kind", "display", "message_id", "in_reply_to", "references", "from_addr", "to", "cc", "subject", "date_raw", "date_utc",
    "body_text", "body_html", "source_sha", "parse_confidence", "flags", "relation_confidence", "boundary_method", "conversation_index", "conversation_topic",
    "source_start_offset", "source_end_offset",
)


def _message_key(path: str = "path", node: str = "node"):
    """A message's own key: its file and its place in it."""
    return F.concat_ws("#", path, F.col(node).cast("string"))


def _read(files: DataFrame, known: DataFrame | None, case_id: int, default_tz: str, first_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files checked, messages parsed, email rows of messages and their quotes with ids from `first_id` on)."""
    checked = source_files.classify_files(source_files.with_sha256(files), max_bytes=None).withColumn("job_id", F.lit(1))
    if known is not None:
        seen = known.filter((F.col("case_id") == case_id) & F.col("deleted_at").isNull()).select(F.col("source_sha").alias("sha"), F.lit(True).alias("_seen")).distinct()
        checked = checked.join(seen, "sha", "left").withColumn("status", F.when((F.col("status") == "ready") & F.col("_seen"), "skipped").otherwise(F.col("status"))).drop("_seen")
    ready = checked.filter((F.col("status") == "ready") & (source_files.suffix(F.col("path")) == "eml"))
    parsed = materialise(eml.parse_eml(ready, default_tz))
    shas = ready.select("path", F.col("sha").alias("root_id"))
    # an attached mail is hashed by its own bytes; only the document code follows the file
    messages = parsed.filter("error IS NULL").join(shas, "path").withColumn("key", _message_key()).withColumn("source_sha", F.col("content_sha"))
    messages = messages.withColumn("parent_key", F.when(F.col("depth") > 0, _message_key(node="parent_node")))

    tops = messages.filter("depth = 0").withColumn("id", F.col("key")).withColumn("case_id", F.lit(case_id)).withColumn("default_tz", F.lit(default_tz))
    found = quotes.quoted_rows(tops, quotes.extract_quotes(tops)).withColumnRenamed("parent_email_id", "parent_key")
    quoted = found.join(tops.select(F.col("key").alias("parent_key"), "path", "display", "source_sha", "root_id"), "parent_key")
    quoted = quoted.withColumn("key", F.concat_ws("/q", "parent_key", F.col("chain_position").cast("string"))).withColumn("item", F.col("chain_position"))

    blank = lambda df: [F.col(c) if c in df.columns else F.lit(None).cast("int" if "offset" in c else "string").alias(c) for c in _COLUMNS]
    own = messages.withColumn("item", F.col("sibling")).withColumn("flags", F.array_distinct(F.concat("date_flags", "warnings")))
    rows = own.select("key", "parent_key", *blank(own)).unionByName(quoted.select("key", "parent_key", *blank(quoted)))
    rows = strip_boilerplate(rows).withColumn(
        "flags", F.when(F.col("boilerplate_stripped"), F.array_append("flags", F.lit("boilerplate_stripped"))).otherwise(F.col("flags"))
    )
    # attached messages of a file's top message follow its quotes; deeper ones count within their parent
    nth = rows.filter("source_kind = 'quoted'").groupBy("parent_key").agg(F.count("*").alias("_quotes"))
    rows = rows.join(nth, "parent_key", "left").withColumn(
        "chain_position", F.col("item") + F.when(F.col("source_kind") == "attached", F.coalesce("_quotes", F.lit(0))).otherwise(F.lit(0))
    )
    numbered = materialise(ranked(rows.drop("_quotes", "item"), ["key"], out="id").withColumn("id", F.col("id") + (first_id - 1)).withColumn("case_id", F.lit(case_id).cast("long")))
    parents = numbered.select(F.col("key").alias("parent_key"), F.col("id").alias("parent_email_id"))
    linked = numbered.join(parents, "parent_key", "left").withColumn("chain_source_id", F.coalesce("parent_email_id", "id"))
    linked = linked.withColumn("created_at", F.current_timestamp()).withColumn("deleted_at", F.lit(None).cast("timestamp")).withColumn("superseded_at", F.lit(None).cast("timestamp"))
    return checked, parsed, linked.drop("parent_key")


def _files_done(checked: DataFrame, parsed: DataFrame) -> DataFrame:
    """A status per file."""
    outcome = parsed.filter("depth = 0").select("path", F.when(F.col("error").isNull(), "parsed").otherwise("failed").alias("_status"), F.col("error").alias("_error"))
    done = checked.drop("content").join(outcome, "path", "left").withColumn("status", F.coalesce("_status", "status")).withColumn("error", F.coalesce("_error", "error")).drop("_status", "_error")
    unread = F.col("status") == "ready"
    done = done.withColumn("error", F.when(unread, F.concat(F.lit("No reader for files of type ."), source_files.suffix(F.col("path")))).otherwise(F.col("error")))
    return done.withColumn("status", F.when(unread, "failed").otherwise(F.col("status")))


def _attachments(parsed: DataFrame, emails: DataFrame) -> DataFrame:
    return eml.message_attachments(parsed).withColumn("key", _message_key()).join(emails.select("key", F.col("id").alias("email_id")), "key").drop("key", "path", "node", "item")


def ingest(files: DataFrame, known: DataFrame | None, case_id: int, default_tz: str = "UTC", first_id: int = 1) -> dict[str, DataFrame]:
    """Run one batch of (path, length, content) files for a case.

    `known` is the email table so far (case_id, source_sha, deleted_at). Returns `files` (a status per file),
    `emails`, `attachments`, `pairs` (scored duplicates among the new rows) and `jobs`.
    """
    checked, parsed, rows = _read(files, known, case_id, default_tz, first_id)
    kept = materialise(reconcile.reconcile_quoted(rows))
    thread = threads.assign_threads(kept).select("id", "thread_id", F.col("parent_id").alias("_parent"))
    emails = kept.join(thread, "id").withColumn("parent_email_id", F.col("_parent")).drop("_parent")
    emails = source_files.assign_doc_ids(emails)
    done = _files_done(checked, parsed)
    return {
        "files": done, "emails": emails.drop("key"), "attachments": _attachments(parsed, emails),
        "pairs": dedup.duplicate_pairs(emails), "jobs": source_files.job_status(done),
    }


def _repeated(stored: DataFrame, arrived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arrived rows that stay, ids of stored quoted rows that go): quoted rows against standalone ones of either side.

    Stored rows were compared with each other when they arrived, so only pairs with an arrived row are asked for.
    """
    narrow = lambda df: df.select("id", "case_id", "source_kind", "body_text")
    left = reconcile.reconcile_quoted(narrow(arrived).unionByName(narrow(stored.filter("source_kind = 'standalone'"))))
    quoted = narrow(stored.filter("source_kind = 'quoted'"))
    still = reconcile.reconcile_quoted(quoted.unionByName(narrow(arrived.filter("source_kind = 'standalone'"))))
    return materialise(arrived.join(left.select("id"), "id", "left_semi")), materialise(quoted.join(still.select("id"), "id", "left_anti").select("id"))


def ingest_into(files: DataFrame, stored: DataFrame, pairs: DataFrame, case_id: int, default_tz: str = "UTC", review: delta.Reviewed | None = None) -> dict[str, DataFrame | delta.Reviewed]:
    """Run one more batch of files for a case that has rows already.

    `stored` is its email table as `ingest` gives it, `pairs` its pair table with a status, `review` what the last
    batch returned under that name (worked out from `stored` if not given). Returns `files`, `emails` (the new rows),
    `moved` (id, thread_id, parent_email_id of stored rows that changed), `gone` (ids of stored quoted rows that a new
    mail repeats, to be deleted), `pairs` (the whole table after the batch), `attachments`, `jobs` and `review`.
    """
    stored = stored.filter(F.col("case_id") == case_id)
    first_id = (stored.agg(F.max("id").alias("id")).first()["id"] or 0) + 1
    checked, parsed, rows = _read(files, stored, case_id, default_tz, first_id)
    kept, gone = _repeated(stored, materialise(rows))
    stays = stored.join(gone, "id", "left_anti")
    torn = stored.join(gone, "id", "left_semi").select("case_id", "thread_id").distinct()
    changed = materialise(delta.changed_threads(stays, kept, torn)).select("id", "thread_id", F.col("parent_id").alias("parent_email_id"))
    emails = kept.drop("parent_email_id").join(changed, "id")
    emails = materialise(source_files.assign_doc_ids(emails, stored))

    before = delta.review_store(stored) if review is None else review
    again, rest = delta.removed_rows(before, gone)
    added, batch = delta.added_pairs(rest, emails)
    done = _files_done(checked, parsed)
    return {
        "files": done, "emails": emails.drop("key"), "attachments": _attachments(parsed, emails), "gone": gone,
        "moved": changed.join(emails.select("id"), "id", "left_anti"), "jobs": source_files.job_status(done),
        "pairs": delta.merge_added(pairs, gone, again.unionByName(added)), "review": rest.union(batch),
    }
