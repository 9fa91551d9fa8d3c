"""Bulk table maintenance: tags, edits, trash, cases. Each job takes a change table and gives the new table."""

from __future__ import annotations

from datetime import datetime, timedelta
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date, valid_zone
from ..functions.text import strip
from .scan import ranked
from .search import RESTORE_DAYS

# Default tag colour, the tag of undated rows, kinds tagged at upload, editable fields.
DEFAULT_COLOUR = "#64748b"
UNDATED = "Undated"
UPLOAD_KINDS = ("standalone", "attached")
EDIT_FIELDS = ("from_addr", "to", "cc", "date_utc", "date_raw", "subject", "body_text", "notes", "important")
PARSED_FIELDS = ("from_addr", "to", "cc", "date_utc", "date_raw", "subject", "body_text")


def _next_ids(rows: DataFrame, order: list[str], existing: DataFrame, id_: str = "id") -> DataFrame:
    top = existing.agg(F.coalesce(F.max(id_), F.lit(0)).alias("_top"))
    return ranked(rows, order, out="_n").withColumn(id_, F.col("_n") + top.scalar()).drop("_n")


# ---- tags


def upsert_tags(tags: DataFrame, incoming: DataFrame) -> DataFrame:
    """Tags of each case, names unique without regard to case; `tags`: id, case_id, name, color; `incoming`: case_id, name, color."""
    clean = incoming.select("case_id", strip(F.col("name")).alias("name"), F.coalesce(F.nullif(F.trim("color"), F.lit("")), F.lit(DEFAULT_COLOUR)).alias("color"))
    clean = clean.filter("name <> ''").withColumn("_key", F.lower("name"))
    fresh = clean.groupBy("case_id", "_key").agg(F.min_by(F.struct("name", "color"), F.struct("name", "color")).alias("t"))
    fresh = fresh.join(tags.select("case_id", F.lower("name").alias("_key")), ["case_id", "_key"], "left_anti").select("case_id", "t.*")
    return tags.unionByName(_next_ids(fresh, ["case_id", "name"], tags).select(*tags.columns))


def rename_tags(tags: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (id, name, color) changes; a name already taken in the case by another tag is not applied."""
    asked = changes.select("id", F.nullif(strip(F.col("name")), F.lit("")).alias("_name"), F.nullif(F.trim("color"), F.lit("")).alias("_color"))
    work = tags.join(asked, "id", "left").withColumn("_target", F.lower(F.coalesce("_name", "name")))
    held = tags.select("case_id", F.lower("name").alias("_target"), F.col("id").alias("_holder"))
    first = work.groupBy("case_id", "_target").agg(F.min("id").alias("_first"))
    both = work.join(held, ["case_id", "_target"], "left").join(first, ["case_id", "_target"])
    free = (F.col("_holder").isNull() & (F.col("_first") == F.col("id"))) | (F.col("_holder") == F.col("id"))
    return both.withColumn("name", F.when(free, F.coalesce("_name", "name")).otherwise(F.col("name"))).withColumn(
        "color", F.when(free, F.coalesce("_color", "color")).otherwise(F.col("color"))
    ).select(*tags.columns)


def delete_tags(tags: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tags.join(ids.select("id"), "id", "left_anti"), links.join(ids.select(F.col("id").alias("tag_id")), "tag_id", "left_anti")


def attach_tags(links: DataFrame, wanted: DataFrame, emails: DataFrame, tags: DataFrame) -> DataFrame:
    """Add (email_id, tag_id) links whose email and tag exist in the same case; existing links stay single."""
    mails = emails.select(F.col("id").alias("email_id"), "case_id")
    names = tags.select(F.col("id").alias("tag_id"), F.col("case_id").alias("tag_case"))
    valid = wanted.select("email_id", "tag_id").distinct().join(mails, "email_id").join(names, "tag_id").filter("case_id = tag_case")
    new = valid.select("email_id", "tag_id").join(links.select("email_id", "tag_id"), ["email_id", "tag_id"], "left_anti")
    return links.select("email_id", "tag_id").unionByName(new)


def detach_tags(links: DataFrame, unwanted: DataFrame) -> DataFrame:
    return links.join(unwanted.select("email_id", "tag_id"), ["email_id", "tag_id"], "left_anti")


def tag_job(emails: DataFrame, links: DataFrame, job_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Tag an upload's own rows (not quoted pieces). `job_tags`: ingest_job_id, tag_id."""
    top = emails.filter(F.col("source_kind").isin(*UPLOAD_KINDS))
    wanted = top.join(job_tags, "ingest_job_id").select(F.col("id").alias("email_id"), "tag_id")
    return attach_tags(links, wanted, emails, tags)


def sync_undated(emails: DataFrame, tags: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags, links) with the `Undated` tag on exactly the rows without a date that are not trashed."""
    undated = emails.filter("date_utc IS NULL AND deleted_at IS NULL").select(F.col("id").alias("email_id"), "case_id")
    needed = undated.select("case_id").distinct().select("case_id", F.lit(UNDATED).alias("name"), F.lit(None).cast("string").alias("color"))
    all_tags = upsert_tags(tags, needed)
    marks = all_tags.filter(F.lower("name") == UNDATED.lower()).select(F.col("id").alias("tag_id"), "case_id")
    desired = undated.join(marks, "case_id").select("email_id", "tag_id")
    others = links.select("email_id", "tag_id").join(marks.select("tag_id"), "tag_id", "left_anti")
    return all_tags, others.select("email_id", "tag_id").unionByName(desired)


def copy_links(links: DataFrame, parts: DataFrame) -> DataFrame:
    """Links of the source rows given to their parts; `parts`: id, source_email_id."""
    copies = links.join(parts, links["email_id"] == parts["source_email_id"]).select(parts["id"].alias("email_id"), "tag_id")
    return links.select("email_id", "tag_id").union(copies).distinct()


def copy_attachments(attachments: DataFrame, parts: DataFrame) -> DataFrame:
    """Attachments of the source rows given to their first part only; `parts`: id, source_email_id, part_index."""
    first = parts.filter("part_index = 1").select(F.col("id").alias("_to"), F.col("source_email_id").alias("email_id"))
    copies = attachments.join(first, "email_id").withColumn("email_id", F.col("_to")).drop("_to", "id")
    return attachments.unionByName(_next_ids(copies, ["email_id", "filename"], attachments).select(*attachments.columns))


# ---- edits


def apply_edits(emails: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(emails with the latest value of each edited field, log of real changes).

    `edits`: email_id, field, new_value, ts, edit_id. Trashed rows and edits that change nothing are left out;
    a row counts as edited by the user when a parsed field was sent along with a real change.
    """
    fields = [f for f in EDIT_FIELDS if f in emails.columns]
    known = edits.filter(F.col("field").isin(*fields))
    latest = known.groupBy(F.col("email_id").alias("id")).agg(
        *[F.max_by(F.struct("new_value"), F.when(F.col("field") == f, F.struct("ts", "edit_id"))).alias(f"_{f}") for f in fields]
    )
    joined = emails.join(latest, "id", "left")
    types = dict(emails.dtypes)
    live = F.col("deleted_at").isNull()

    def sent(f: str) -> Column:
        return live & F.col(f"_{f}").isNotNull()

    def new(f: str) -> Column:
        return F.col(f"_{f}.new_value").try_cast(types[f])

    def changed(f: str) -> Column:
        return sent(f) & ~new(f).eqNullSafe(F.col(f))

    any_change = sum((changed(f).cast("int") for f in fields[1:]), changed(fields[0]).cast("int")) > 0
    parsed_sent = [sent(f) for f in fields if f in PARSED_FIELDS]
    touched = parsed_sent[0]
    for one in parsed_sent[1:]:
        touched = touched | one
    entries = F.array_compact(
        F.array(*[F.when(changed(f), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old_value"), F.col(f"_{f}.new_value").alias("new_value"))) for f in fields])
    )
    log = joined.select(F.col("id").alias("email_id"), F.inline(entries))
    edited = F.col("user_edited") if "user_edited" in emails.columns else F.lit(False)
    out = joined.select(
        *[F.when(changed(c), new(c)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in emails.columns if c != "user_edited"],
        (edited | (any_change & touched)).alias("user_edited"),
    )
    return out, log


def add_manual(rows: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows) of hand-entered emails; a date that is given must parse."""
    zones = cases.select(F.col("id").alias("case_id"), "default_tz")
    work = rows.join(zones, "case_id")
    for name in ("from_addr", "subject", "body_text", "date_raw"):
        work = work.withColumn(name, strip(F.col(name)))
    work = work.withColumn("subject", F.coalesce(F.nullif("subject", F.lit("")), F.lit("(no subject)"))).withColumn(
        "date_raw", F.nullif("date_raw", F.lit(""))
    )
    work = work.withColumn("date_utc", parse_date(F.col("date_raw"), valid_zone(F.col("default_tz")))).drop("default_tz")
    work = work.withColumn("source_kind", F.lit("standalone")).withColumn("source_import_mode", F.lit("manual"))
    bad = F.col("date_raw").isNotNull() & F.col("date_utc").isNull()
    return work.filter(~bad), work.filter(bad)


# ---- trash


def trash_emails(emails: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    hit = emails.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    gone = F.col("_hit") & F.col("deleted_at").isNull()
    return hit.withColumn("deleted_at", F.when(gone, F.lit(now).cast("timestamp")).otherwise(F.col("deleted_at"))).drop("_hit")


def restore_emails(emails: DataFrame, ids: DataFrame, now: datetime, days: int = RESTORE_DAYS) -> DataFrame:
    """Restore rows trashed no longer than `days` ago; older ones stay in the trash."""
    hit = emails.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    back = F.col("_hit") & (F.col("deleted_at") >= F.lit(now - timedelta(days=days)))
    return hit.withColumn("deleted_at", F.when(F.coalesce(back, F.lit(False)), F.lit(None)).otherwise(F.col("deleted_at"))).drop("_hit")


# ---- cases


def trash_cases(cases: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    return trash_emails(cases, ids, now)


def restore_cases(cases: DataFrame, ids: DataFrame) -> DataFrame:
    hit = cases.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    return hit.withColumn("deleted_at", F.when(F.col("_hit"), F.lit(None)).otherwise(F.col("deleted_at"))).drop("_hit")


def purge_cases(tables: dict[str, DataFrame], asked: DataFrame) -> dict[str, DataFrame]:
    """Remove cases for good with all their rows. `asked`: id, name; the name must match and the case be trashed."""
    gone = tables["cases"].filter("deleted_at IS NOT NULL").join(asked.select("id", "name"), ["id", "name"], "left_semi").select("id")
    case_key = gone.select(F.col("id").alias("case_id"))
    email_key = tables["emails"].join(case_key, "case_id", "left_semi").select(F.col("id").alias("email_id"))
    out = {}
    for name, table in tables.items():
        if name == "cases":
            out[name] = table.join(gone, "id", "left_anti")
        elif "case_id" in table.columns:
            out[name] = table.join(case_key, "case_id", "left_anti")
        elif "email_id" in table.columns:
            out[name] = table.join(email_key, "email_id", "left_anti")
        else:
            out[name] = table
    return out


def rollup_cjk(cases: DataFrame, jobs: DataFrame) -> DataFrame:
    """A case keeps the Chinese-content flag once any of its runs carried it."""
    seen = jobs.groupBy("case_id").agg(F.max("contains_cjk").alias("_seen"))
    joined = cases.join(seen, cases["id"] == seen["case_id"], "left").drop("case_id")
    return joined.withColumn("has_cjk_content", F.col("has_cjk_content") | F.coalesce("_seen", F.lit(False))).drop("_seen")


def update_cases(cases: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (id, name, default_tz) changes; blank names and unknown zones are not applied."""
    zone = F.when(F.col("default_tz").isin(*sorted(available_timezones())), F.col("default_tz"))
    asked = changes.select("id", F.nullif(strip(F.col("name")), F.lit("")).alias("_name"), zone.alias("_tz"))
    joined = cases.join(asked, "id", "left")
    return joined.withColumn("name", F.coalesce("_name", "name")).withColumn("default_tz", F.coalesce("_tz", "default_tz")).drop("_name", "_tz")


def add_cases(cases: DataFrame, rows: DataFrame) -> DataFrame:
    """New cases from (name, default_tz) rows: trimmed name, checked zone, public id derived from id and name."""
    named = rows.select(F.coalesce(F.nullif(strip(F.col("name")), F.lit("")), F.lit("Untitled case")).alias("name"), valid_zone(F.col("default_tz")).alias("default_tz"))
    fresh = _next_ids(named, ["name", "default_tz"], cases)
    fresh = fresh.withColumn("public_id", F.substring(F.sha2(F.concat_ws(":", F.col("id").cast("string"), "name").cast("binary"), 256), 1, 16))
    return cases.unionByName(fresh, allowMissingColumns=True)


def snapshot(df: DataFrame, fields: list[str], out: str = "snapshot") -> DataFrame:
    return df.withColumn(out, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
