"""Mail folders as tables: listing, checks, incremental selection, the content store and run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_path

# Suffixes read, and the code alphabet of documents.
SUFFIXES = ("eml", "msg", "pdf", "docx")
CODE_ALPHABET = "23456789ABCDEFGHJKMNPQRSTUVWXYZ"
CODE_LENGTH = 5


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def scan_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Supported files under a folder: path, display, suffix, modificationTime, length, content, by lower-case path.

    `content` is only read when a later step asks for it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/") + "/"), r"^[a-z]+:/+", "/")
    shown = F.replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), base, F.lit(""))
    listed = files.withColumn("display", clean_path(shown)).withColumn("suffix", suffix(F.col("path")))
    return listed.filter(F.col("suffix").isin(*SUFFIXES)).orderBy(F.lower("path"))


def with_sha256(files: DataFrame, content: str = "content", out: str = "sha") -> DataFrame:
    return files.withColumn(out, F.sha2(F.col(content).cast("binary"), 256))


def classify_files(files: DataFrame, path: str = "path", length: str = "length", max_bytes: int | None = None) -> DataFrame:
    """Add `status` (ready, skipped, failed) and `error`: an unread suffix fails; a caller's limit skips what is larger."""
    kind = suffix(F.col(path))
    large, unread = F.lit(False) if max_bytes is None else F.col(length) > max_bytes, ~kind.isin(*SUFFIXES)
    limit = F.lit(f"File exceeds the {max_bytes} byte limit")
    return files.withColumn("status", F.when(large, "skipped").when(unread, "failed").otherwise("ready")).withColumn(
        "error", F.when(large, limit).when(unread, F.concat(F.lit("Unsupported file type: ."), kind))
    )


def partition_by_size(files: DataFrame, max_bytes: int, length: str = "length") -> tuple[DataFrame, DataFrame]:
    """(files within a caller's limit, larger ones)."""
    return files.filter(F.col(length) <= max_bytes), files.filter(F.col(length) > max_bytes)


def new_files(files: DataFrame, emails: DataFrame, case_id: int) -> tuple[DataFrame, DataFrame]:
    """(files to read, files already known) by content hash among the case's rows that are not trashed. Two copies
    inside one batch are both read."""
    known = emails.filter((F.col("case_id") == case_id) & F.col("deleted_at").isNull()).select(F.col("source_sha").alias("sha")).distinct()
    return files.join(known, "sha", "left_anti"), files.join(known, "sha", "left_semi")


def store_sources(files: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row per content not yet stored: sha, shard, path, length, content; write it partitioned by shard."""
    once = files.dropDuplicates(["sha"])
    if stored is not None:
        once = once.join(stored.select("sha"), "sha", "left_anti")
    shard = F.substring("sha", 1, 2)
    return once.withColumn("shard", shard).withColumn("stored_path", F.concat_ws("/", shard, "sha"))


def write_store(files: DataFrame, path: str) -> None:
    store_sources(files).write.mode("append").partitionBy("shard").parquet(path)


def relink_sources(emails: DataFrame, files: DataFrame) -> DataFrame:
    """(id, source_file): emails whose content was found again; of several copies the first by lower-case path."""
    first = files.groupBy(F.col("sha").alias("source_sha")).agg(F.min_by("path", F.struct(F.lower("path"), "path")).alias("source_file"))
    return emails.select("id", "source_sha").join(first, "source_sha").select("id", "source_file")


def job_status(files: DataFrame) -> DataFrame:
    """Per run: totals, processed and failed files; the run fails only when every file of it failed."""
    sums = files.groupBy("job_id").agg(
        F.count("*").alias("total_files"), F.count_if(F.col("status") == "parsed").alias("processed_files"),
        F.count_if(F.col("status") == "failed").alias("failed_files"),
    )
    dead = (F.col("total_files") > 0) & (F.col("failed_files") == F.col("total_files"))
    return sums.withColumn("status", F.when(dead, "failed").otherwise("completed"))


def ingest_summary(emails: DataFrame, files: DataFrame) -> DataFrame:
    """Per run: email count, count per kind, file count. Kinds are a fixed small set, so the map stays small."""
    kinds = emails.groupBy("job_id", F.coalesce("source_kind", F.lit("standalone")).alias("kind")).agg(F.count("*").alias("n"))
    counts = kinds.groupBy("job_id").agg(
        F.sum("n").alias("email_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("counts")
    )
    named = files.groupBy("job_id").agg(F.count("*").alias("file_count"), F.min("path").alias("first_file"))
    return named.join(counts, "job_id", "left").withColumn("email_count", F.coalesce("email_count", F.lit(0)))


def jobs_with_files(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Runs with their files, one row per file, newest run first; a run may hold any number of files."""
    listed = files.select("job_id", F.col("path").alias("file_path"), F.col("status").alias("file_status"))
    joined = jobs.join(listed, jobs["id"] == listed["job_id"], "left").drop("job_id")
    return joined.orderBy(F.desc("id"), "file_path")


def guard_attachments(attachments: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(attachments kept, warnings) — what exceeds the caller's limit is dropped, its email stays."""
    kept = attachments.filter(F.col("size") <= max_bytes)
    over = attachments.filter(F.col("size") > max_bytes)
    return kept, over.select("email_id", F.concat(F.lit("attachment_too_large:"), F.col("filename")).alias("warning"))


def number_chain(rows: DataFrame) -> DataFrame:
    """Add `chain_position` per source file: the message 0, its quotes 1..n, its attached messages after them.

    `rows`: path, source_kind, item (order within its kind).
    """
    quotes = rows.filter("source_kind = 'quoted'").groupBy("path").agg(F.count("*").alias("_q"))
    joined = rows.join(quotes, "path", "left").withColumn("_q", F.coalesce("_q", F.lit(0)))
    place = F.when(F.col("source_kind") == "quoted", F.col("item")).when(F.col("source_kind") == "attached", F.col("_q") + F.col("item")).otherwise(F.lit(0))
    return joined.withColumn("chain_position", place.cast("int")).drop("_q")


def assign_doc_ids(emails: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Add `doc_id`: a short code per (case, root document), shared by every card of the document.

    The code is read off a hash; documents of a case that meet on a code get further letters, which no other
    code can start with. `taken` (case_id, root_id, doc_id) are the codes given out before: they stay.
    """
    base = len(CODE_ALPHABET)
    digit = lambda n: F.substr(F.lit(CODE_ALPHABET), (n + 1).cast("int"), F.lit(1))
    docs = emails.select("case_id", "root_id").distinct()
    if taken is not None:
        taken = taken.select("case_id", "root_id", "doc_id").distinct()
        docs = docs.join(taken, ["case_id", "root_id"], "left_anti")
    h = F.pmod(F.xxhash64("case_id", "root_id"), F.lit(base**CODE_LENGTH))
    code = F.concat(*[digit(F.pmod(F.floor(h / base**k), F.lit(base))) for k in range(CODE_LENGTH)])
    coded = docs.withColumn("_code", code)
    nth = F.row_number().over(Window.partitionBy("case_id", "_code").orderBy("root_id")) - 1
    if taken is not None:
        met = taken.groupBy("case_id", F.substring("doc_id", 1, CODE_LENGTH).alias("_code")).agg(F.count("*").alias("_met"))
        coded, nth = coded.join(met, ["case_id", "_code"], "left"), nth + F.coalesce("_met", F.lit(0))
    tail = F.when(nth == 0, F.lit("")).otherwise(F.translate(F.lower(F.conv(nth.cast("string"), 10, base)), "0123456789abcdefghijklmnopqrstu", CODE_ALPHABET))
    codes = coded.select("case_id", "root_id", F.concat("_code", tail).alias("doc_id"))
    return emails.join(codes if taken is None else codes.unionByName(taken), ["case_id", "root_id"])
