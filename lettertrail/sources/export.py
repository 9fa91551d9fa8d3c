"""Exports, case bundles as Parquet folders, and their import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_cell
from ..operators.scan import ranked
from ..operators.search import tags_by_email

# Bundle format and schema versions.
FORMAT = "case-bundle"
FORMAT_VERSION = 1
SCHEMA_VERSION = 26


def chronology_export(emails: DataFrame, tags: DataFrame, email_tags: DataFrame) -> DataFrame:
    """The 17-column chronology of each case: undated rows first, then by date and id; threads are numbered by
    first appearance. Adds `case_id` in front."""
    none = F.lit(None).cast("string")
    has = lambda name, other=none: F.col(name) if name in emails.columns else other
    live = emails.filter("deleted_at IS NULL AND superseded_at IS NULL")
    labelled = tags_by_email(tags, email_tags).select(
        F.col("email_id").alias("id"), F.array_join(F.transform("tags", lambda x: x["name"]), "; ").alias("_tags")
    )
    date = F.date_format("date_utc", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    work = live.withColumn("_date", F.coalesce(date, F.lit(""))).withColumn("_thread", F.coalesce(has("thread_id"), F.col("id").cast("string")))
    numbered = ranked(work, ["_date", "id"], ["case_id"], "No")
    first = numbered.groupBy("case_id", "_thread").agg(F.min("No").alias("_first"))
    threads = ranked(first, ["_first"], ["case_id"], "_n").drop("_first")
    joined = numbered.join(threads, ["case_id", "_thread"]).join(labelled, "id", "left")
    cell = lambda c: safe_cell(F.coalesce(c, F.lit("")))
    listed = lambda name: F.array_join(has(name, F.array().cast("array<string>")), "; ")
    return joined.select(
        "case_id", "No", cell(has("doc_id").cast("string")).alias("Doc ID"), cell(F.nullif("_date", F.lit(""))).alias("Date"),
        F.concat(F.lit("Thread "), F.col("_n").cast("string")).alias("Thread"), cell(has("from_addr")).alias("From"),
        cell(listed("to")).alias("To"), cell(listed("cc")).alias("Cc"), cell(F.col("subject")).alias("Subject"), cell(F.col("body_text")).alias("Body"),
        cell(has("source_file_display")).alias("Source"), F.when(has("important", F.lit(False)), "Yes").otherwise("No").alias("Important"),
        cell(has("notes")).alias("Notes"), has("parse_confidence").alias("Confidence"), cell(listed("flags")).alias("Flags"),
        cell(has("message_id")).alias("Message ID"), cell(has("source_kind")).alias("Kind"), cell(F.col("_tags")).alias("Tags"),
    )


def coverage_export(built: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The four coverage tables of `build_map`, text cells made safe for a spreadsheet."""
    sources = built["sources"].select("source_email_id", "case_id", "subject", "source_file_display", "source_kind")
    return {
        "summary": built["summary"],
        "sources": built["fields"].join(sources, "source_email_id").withColumn("subject", safe_cell(F.col("subject"))),
        "cards": built["cards"].withColumn("subject", safe_cell(F.col("subject"))),
        "unmapped": built["gaps"].withColumn("gap_text", safe_cell(F.col("gap_text"))),
    }


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


# ---- case bundles

# Foreign keys of the bundled tables as (column, table it points to, drop the row when orphaned).
KEYS = {
    "emails": (("parent_email_id", "emails", False), ("chain_source_id", "emails", False), ("superseded_by_snip_id", "email_snips", False),
               ("derived_from_attachment_id", "attachments", False), ("ingest_job_id", "ingest_jobs", False)),
    "tags": (),
    "email_snips": (("source_email_id", "emails", False),),
    "email_flags": (("email_id", "emails", True),),
    "email_tags": (("email_id", "emails", True), ("tag_id", "tags", True)),
    "attachments": (("email_id", "emails", True),),
    "email_snip_parts": (("snip_id", "email_snips", True), ("email_id", "emails", True)),
    "email_text_mappings": (("source_email_id", "emails", False), ("target_email_id", "emails", False), ("snip_id", "email_snips", False)),
    "email_duplicate_candidates": (("email_a_id", "emails", True), ("email_b_id", "emails", True), ("canonical_email_id", "emails", False), ("duplicate_email_id", "emails", False)),
    "ingest_jobs": (),
    "ingest_files": (("job_id", "ingest_jobs", True), ("email_id", "emails", False)),
    "case_folders": (),
}
_VIA = {"email_flags": ("email_id", "emails"), "email_tags": ("email_id", "emails"), "attachments": ("email_id", "emails"),
        "email_snip_parts": ("email_id", "emails"), "ingest_files": ("job_id", "ingest_jobs")}


def case_tables(tables: dict[str, DataFrame], case_id: int) -> dict[str, DataFrame]:
    """The rows of one case out of every table."""
    out = {"cases": tables["cases"].filter(F.col("id") == case_id)}
    for name in KEYS:
        if name in tables and name not in _VIA:
            out[name] = tables[name].filter(F.col("case_id") == case_id)
    for name, (column, parent) in _VIA.items():
        if name in tables and parent in out:
            out[name] = tables[name].join(out[parent].select(F.col("id").alias(column)), column, "left_semi")
    return out


def export_case(tables: dict[str, DataFrame], case_id: int, path: str) -> None:
    """Write one case as a folder of Parquet tables and a manifest of row counts."""
    spark = tables["cases"].sparkSession
    picked = case_tables(tables, case_id)
    write_tables(picked, f"{path}/tables")
    counts = None
    for name in picked:
        one = spark.read.parquet(f"{path}/tables/{name}").agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        counts = one if counts is None else counts.unionByName(one)
    manifest = counts.select("table", "rows", F.lit(FORMAT).alias("format"), F.lit(FORMAT_VERSION).alias("format_version"), F.lit(SCHEMA_VERSION).alias("schema_version"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def preview_export(spark: SparkSession, path: str) -> DataFrame:
    """(table, rows, format, versions, supported) of a bundle, without reading its tables."""
    manifest = spark.read.schema("table string, rows bigint, format string, format_version int, schema_version int").json(f"{path}/manifest")
    fine = (F.col("format") == FORMAT) & (F.col("format_version") <= FORMAT_VERSION) & (F.col("schema_version") <= SCHEMA_VERSION)
    return manifest.withColumn("supported", fine)


def import_case(spark: SparkSession, path: str, offsets: dict[str, int], case_id: int) -> dict[str, DataFrame]:
    """A bundle's tables as a new case: every id moves by its table's offset, references follow, and rows whose
    owner is not in the bundle go.

    Old ids are unique per table, so old id + offset is the id map; references are checked by semi-joins.
    Threads and duplicate pairs are derived data: recompute them on the result.
    """
    if preview_export(spark, path).filter("NOT supported").limit(1).count():
        raise ValueError("bundle is not of a supported format or version")
    names = [r["table"] for r in preview_export(spark, path).select("table").collect()]
    raw = {name: spark.read.parquet(f"{path}/tables/{name}") for name in names}
    out = {"cases": raw["cases"].withColumn("id", F.lit(case_id).cast("long"))}
    if "public_id" in raw["cases"].columns:
        fresh = F.substring(F.sha2(F.concat_ws(":", "public_id", F.lit(str(case_id))).cast("binary"), 256), 1, 16)
        out["cases"] = out["cases"].withColumn("public_id", fresh)
    kept_attachments = raw["attachments"].join(raw["emails"].select(F.col("id").alias("email_id")), "email_id", "left_semi") if "attachments" in raw else None
    owners = {**raw, **({"attachments": kept_attachments} if kept_attachments is not None else {})}
    for name in names:
        if name == "cases":
            continue
        table = raw[name]
        for column, parent, required in KEYS[name]:
            if column not in table.columns:
                continue
            shift = offsets.get(parent, 0)
            if parent not in owners:
                table = table.filter(F.lit(False)) if required else table.withColumn(column, F.lit(None).cast("long"))
                continue
            ids = owners[parent].select(F.col("id").alias(column), F.lit(True).alias("_there"))
            table = table.join(ids, column, "inner" if required else "left")
            moved = F.when(F.col("_there"), F.col(column) + shift)
            table = table.withColumn(column, moved).drop("_there")
        if "id" in table.columns:
            table = table.withColumn("id", F.col("id") + offsets.get(name, 0))
        if "case_id" in table.columns:
            table = table.withColumn("case_id", F.lit(case_id).cast("long"))
        out[name] = table.select(*raw[name].columns)
    return out


def validate_blobs(blobs: DataFrame, emails: DataFrame) -> DataFrame:
    """Violations (kind, ref): blob names that are not 64 hex digits or not their content's hash, and email
    references to blobs that are malformed."""
    name_ok = F.col("name").rlike("^[0-9a-f]{64}$")
    sha = F.sha2(F.col("content").cast("binary"), 256)
    named = blobs.filter(~name_ok).select(F.lit("bad_name").alias("kind"), F.col("name").alias("ref"))
    hashed = blobs.filter(name_ok & (sha != F.col("name"))).select(F.lit("bad_hash").alias("kind"), F.col("name").alias("ref"))
    ref = F.col("source_blob_sha256")
    refs = emails.filter(ref.isNotNull() & (ref != "") & ~ref.rlike("^[0-9a-f]{64}$")).select(F.lit("bad_reference").alias("kind"), ref.alias("ref"))
    return named.union(hashed).union(refs)
