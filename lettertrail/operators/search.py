"""Filters and reads over an email table."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from .scan import ranked

# Days a trashed email can be restored, audit listing limit, length of index grams.
RESTORE_DAYS = 30
AUDIT_LIMIT = 200
GRAM = 3


def visible(emails: DataFrame, case_id: int | None = None) -> DataFrame:
    live = emails.filter(F.col("deleted_at").isNull() & F.col("superseded_at").isNull())
    return live if case_id is None else live.filter(F.col("case_id") == case_id)


def _bound(value: str) -> datetime:
    return datetime.fromisoformat(value.replace("Z", "+00:00")).replace(tzinfo=None)


def date_between(emails: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows dated between two ISO bounds, both included; a bound that is only a date means its whole day."""
    if start:
        emails = emails.filter(F.col("date_utc") >= F.lit(_bound(start)))
    if end:
        last = _bound(end)
        emails = emails.filter(F.col("date_utc") < F.lit(last + timedelta(days=1)) if len(end) <= 10 else F.col("date_utc") <= F.lit(last))
    return emails


def with_tag(emails: DataFrame, email_tags: DataFrame, tag_id: int) -> DataFrame:
    tagged = email_tags.filter(F.col("tag_id") == tag_id).select(F.col("email_id").alias("id"))
    return emails.join(tagged, "id", "left_semi")


def _holds(phrase: str) -> Column:
    parts = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(phrase)) for c in ("subject", "body_text")]
    return parts[0] | parts[1]


def search(emails: DataFrame, q: str | None) -> DataFrame:
    """Case-insensitive phrase search over subject or body; operators in the query are plain text."""
    if not q or not q.strip():
        return emails
    return emails.filter(_holds(q.strip().lower()))


def _windows(chars: Column) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.size(chars) - GRAM, F.lit(0)))
    return F.transform(starts, lambda i: F.concat_ws("", *[F.get(chars, i + k) for k in range(GRAM)]))


def grams(col: Column) -> Column:
    """Distinct lower-case trigrams of a text."""
    every = bind(F.split(F.lower(F.coalesce(col, F.lit(""))), ""), _windows)
    return F.array_distinct(F.filter(every, lambda g: F.length(g) == GRAM))


def build_trigrams(emails: DataFrame) -> DataFrame:
    """Inverted index (gram, id); write it partitioned or bucketed by gram."""
    both = F.array_union(grams(F.col("subject")), grams(F.col("body_text")))
    return emails.select("id", F.explode(both).alias("gram"))


def search_indexed(index: DataFrame, emails: DataFrame, q: str) -> DataFrame:
    """`search` through the trigram index: rows holding every gram of the phrase, then the phrase itself."""
    phrase = q.strip().lower()
    if len(phrase) < GRAM:
        return search(emails, q)
    wanted = sorted({phrase[i : i + GRAM] for i in range(len(phrase) - GRAM + 1)})
    hits = index.filter(F.col("gram").isin(*wanted)).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted))
    return emails.join(hits.select("id"), "id", "left_semi").filter(_holds(phrase))


def count_matches(found: DataFrame) -> DataFrame:
    return found.agg(F.count_distinct("id").alias("total"))


def trash(emails: DataFrame, now: datetime, days: int = RESTORE_DAYS) -> DataFrame:
    cutoff = F.lit(now - timedelta(days=days))
    return emails.filter(F.col("deleted_at") >= cutoff).orderBy(F.desc("deleted_at"), F.desc("id"))


def chrono_key() -> list[Column]:
    return [F.asc_nulls_last("manual_chrono_order"), F.coalesce("date_utc", "created_at"), F.col("id")]


def thread_key() -> list[Column]:
    """Order inside a thread: its first email, then by time."""
    return [F.col("parent_email_id").isNotNull(), F.coalesce("date_utc", "created_at"), F.col("id")]


def order_chrono(emails: DataFrame) -> DataFrame:
    return emails.orderBy(*chrono_key())


def order_threads(emails: DataFrame) -> DataFrame:
    return emails.orderBy("thread_id", *thread_key())


def order_nocase(df: DataFrame, name: str = "name") -> DataFrame:
    return df.orderBy(F.lower(name), name)


def page(ordered: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of an ordered frame, with `total` and `has_more` on every row."""
    size, skip = max(1, int(limit)), max(0, int(offset))
    total = ordered.agg(F.count("*").alias("total"))
    rows = ordered.offset(skip).limit(size)
    return rows.withColumn("total", total.scalar()).withColumn("has_more", F.lit(skip + size) < F.col("total"))


def flags_agg(flags: DataFrame) -> DataFrame:
    return flags.groupBy("email_id").agg(F.array_join(F.array_sort(F.collect_set("flag")), ",").alias("flags"))


def tags_by_email(tags: DataFrame, email_tags: DataFrame) -> DataFrame:
    named = email_tags.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    listed = named.groupBy("email_id").agg(F.array_sort(F.collect_set(F.struct(F.lower("name").alias("key"), F.col("name"), F.col("tag_id")))).alias("t"))
    return listed.select("email_id", F.transform("t", lambda x: F.struct(x["tag_id"].alias("id"), x["name"].alias("name"))).alias("tags"))


def hydrate(emails: DataFrame, flags: DataFrame, attachments: DataFrame, tags: DataFrame, email_tags: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each email with its flags, attachments, tags, pending-duplicate count and defaults for missing judgements.

    An email's flags, tags and attachments are bounded by the mail itself; each child table is aggregated once.
    """
    from .dedup import pending_counts

    files = attachments.groupBy("email_id").agg(
        F.array_sort(F.collect_list(F.struct("id", "filename", "mime", "size", "is_inline"))).alias("attachments")
    )
    joined = emails.join(flags_agg(flags), emails["id"] == F.col("email_id"), "left").drop("email_id")
    joined = joined.join(files, joined["id"] == F.col("email_id"), "left").drop("email_id")
    labelled = tags_by_email(tags, email_tags)
    joined = joined.join(labelled, joined["id"] == F.col("email_id"), "left").drop("email_id")
    joined = joined.join(pending_counts(pairs, emails), "id", "left")
    manual = F.col("source_import_mode") == "manual" if "source_import_mode" in emails.columns else F.lit(False)
    unsure = F.col("parse_confidence") == "low" if "parse_confidence" in emails.columns else F.lit(False)
    kind = F.col("source_kind")
    method = F.when(manual, "manual").when(kind == "attached", "attached_email").when(kind == "quoted", "quoted_text").otherwise("mime")
    trust = F.when(kind == "attached", "high").when((kind == "quoted") | unsure, "low").otherwise("high")
    fill = lambda name, value: F.coalesce(F.col(name), value) if name in joined.columns else value
    return joined.withColumn("boundary_method", fill("boundary_method", method)).withColumn("relation_confidence", fill("relation_confidence", trust))


def case_summary(cases: DataFrame, emails: DataFrame, deleted: bool = False) -> DataFrame:
    """Cases with their live email count, newest update first; with `deleted`, the trashed ones."""
    kept = cases.filter(F.col("deleted_at").isNotNull() if deleted else F.col("deleted_at").isNull())
    counts = visible(emails).groupBy("case_id").agg(F.count("*").alias("email_count"))
    joined = kept.join(counts, kept["id"] == counts["case_id"], "left").drop("case_id")
    latest = F.desc("deleted_at") if deleted else F.desc("updated_at") if "updated_at" in cases.columns else F.desc("id")
    return joined.withColumn("email_count", F.coalesce("email_count", F.lit(0))).orderBy(latest, F.desc("id"))


def list_audit(events: DataFrame, case_id: int, limit: int = AUDIT_LIMIT, decode: dict[str, str] | None = None) -> DataFrame:
    """Latest audit events of a case; `decode` maps JSON columns to their schema."""
    for name, schema in (decode or {}).items():
        events = events.withColumn(name, F.from_json(name, schema))
    return events.filter(F.col("case_id") == case_id).orderBy(F.desc("id")).limit(limit)


def find_cases(cases: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, case_id): by public id, else by number."""
    public = cases.select(F.col("public_id").alias("ref"), F.col("id").alias("by_public"))
    number = cases.select(F.col("id").alias("n"), F.col("id").alias("by_number"))
    asked = refs.withColumn("n", F.col("ref").try_cast("long"))
    found = asked.join(public, "ref", "left").join(number, "n", "left")
    return found.select("ref", F.coalesce("by_public", "by_number").alias("case_id"))


def resolve_sources(emails: DataFrame, store: DataFrame, files: DataFrame) -> DataFrame:
    """(id, location, place, suffix): the managed copy by sha, else an existing folder file, else nothing."""
    copies = store.select(F.col("sha").alias("source_sha"), F.col("path").alias("stored")).dropDuplicates(["source_sha"])
    there = files.select(F.col("path").alias("source_file"), F.lit(True).alias("exists")).distinct()
    joined = emails.join(copies, "source_sha", "left").join(there, "source_file", "left")
    folder = F.col("exists") & (F.col("source_import_mode") == "folder")
    place = F.when(F.col("stored").isNotNull(), "store").when(folder, "folder").otherwise("none")
    where = F.when(place == "store", F.col("stored")).when(place == "folder", F.col("source_file"))
    suffix = F.lower(F.regexp_extract("source_file", r"(\.[^./\\]+)$", 1))
    return joined.select("id", where.alias("location"), place.alias("place"), suffix.alias("suffix"))


def match_tags(tags: DataFrame, q: str, selected: list[int]) -> DataFrame:
    """Tags whose name holds the query, all of them when none does; selected ones first, then by name."""
    hit = F.contains(F.lower("name"), F.lit(q.strip().lower()))
    marked = tags.withColumn("_hit", hit)
    some = marked.agg(F.max("_hit").alias("_some"))
    kept = marked.withColumn("_some", some.scalar()).filter(F.col("_hit") | ~F.col("_some"))
    chosen = F.col("id").isin(*selected) if selected else F.lit(False)
    return kept.drop("_hit", "_some").orderBy(F.desc(chosen), F.lower("name"))


def upsert(current: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    return current.join(incoming, key, "left_anti").unionByName(incoming)


def _first_positions(ids: DataFrame, group: str) -> DataFrame:
    """Each id once, at its first place, numbered 0, 1, ... within its group."""
    once = ids.groupBy(group, "id").agg(F.min("position").alias("position"))
    return ranked(once, ["position", "id"], [group], "_new").withColumn("_new", F.col("_new") - 1).drop("position")


def _apply_order(emails: DataFrame, good: DataFrame, column: str) -> DataFrame:
    joined = emails.join(good.select("id", "_new"), "id", "left")
    return joined.withColumn(column, F.coalesce("_new", F.col(column).cast("long"))).drop("_new")


def set_chrono_order(emails: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(emails with manual positions, cases refused). `ids`: case_id, id, position.

    A case's ids must be exactly its rows that are not trashed; repeated ids count once.
    """
    live = emails.filter("deleted_at IS NULL").select("case_id", "id", F.lit(True).alias("_in"))
    placed = _first_positions(ids, "case_id")
    sizes = live.groupBy("case_id").agg(F.count("*").alias("_live"))
    verdict = placed.join(live, ["case_id", "id"], "left").groupBy("case_id").agg(
        F.count("*").alias("n"), F.count("_in").alias("known")
    ).join(sizes, "case_id", "left")
    fine = F.coalesce((F.col("n") == F.col("known")) & (F.col("n") == F.col("_live")), F.lit(False))
    good = placed.join(verdict.filter(fine).select("case_id"), "case_id", "left_semi")
    return _apply_order(emails, good, "manual_chrono_order"), verdict.filter(~fine).select("case_id")


def set_chain_order(emails: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(emails with manual chain positions, requests refused). `ids`: request_id, id, position.

    A request must stay inside one thread of rows that are not trashed; rows it does not name keep their place.
    """
    live = emails.filter("deleted_at IS NULL").select(
        "id", F.coalesce("thread_id", F.concat(F.lit("email:"), F.col("id").cast("string"))).alias("_thread")
    )
    placed = _first_positions(ids, "request_id")
    verdict = placed.join(live, "id", "left").groupBy("request_id").agg(
        (F.count("*") == F.count("_thread")).alias("known"), F.min("_thread").alias("low"), F.max("_thread").alias("high")
    )
    fine = F.col("known") & (F.col("low") == F.col("high"))
    good = placed.join(verdict.filter(fine).select("request_id"), "request_id", "left_semi")
    return _apply_order(emails, good, "manual_chain_order"), verdict.filter(~F.coalesce(fine, F.lit(False))).select("request_id")


def reset_order(emails: DataFrame, column: str, case_ids: DataFrame) -> DataFrame:
    """Drop manual positions of the given cases."""
    hit = emails.join(case_ids.select("case_id", F.lit(True).alias("_hit")), "case_id", "left")
    return hit.withColumn(column, F.when(F.col("_hit").isNull(), F.col(column))).drop("_hit")
