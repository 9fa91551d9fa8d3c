"""Threads and reply chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import conv_root, norm_msgid, norm_subject, strip_subject
from ..session import materialise
from .scan import prefix_max

CHILD_KINDS = ("quoted", "attached", "snipped")
CHAIN_BUCKET = 4096
MARK = ("at", "id", "row")  # rows in date order, told apart


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def reading_order(date: Column, created: Column) -> Column:
    return F.coalesce(date, created)


def with_thread_facts(emails: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Normalised header references of each row and the columns of `carry`; absent optional columns read as null."""
    refs = F.filter(F.transform(_column(emails, "references", "array<string>"), norm_msgid), lambda r: r.isNotNull())
    refs = F.coalesce(refs, F.array().cast("array<string>"))
    when = reading_order(F.col("date_utc"), _column(emails, "created_at", "timestamp"))
    topic = F.coalesce(F.nullif(_column(emails, "conversation_topic", "string"), F.lit("")), F.col("subject"))
    return emails.select(
        "id", "case_id", when.alias("at"),
        norm_msgid(F.col("message_id")).alias("ref"),
        F.coalesce(norm_msgid(F.col("in_reply_to")), F.try_element_at(refs, F.lit(-1))).alias("parent_ref"),
        F.get(refs, 0).alias("root_ref"),
        conv_root(_column(emails, "conversation_index", "string")).alias("conv"),
        F.concat(F.lit("subj:"), norm_subject(topic)).alias("subject_key"),
        F.when(_column(emails, "source_kind", "string").isin(*CHILD_KINDS), _column(emails, "parent_email_id", "bigint")).alias("kept_parent"),
        _column(emails, "thread_id", "string").alias("old_thread"),
        _column(emails, "parent_email_id", "bigint").alias("old_parent"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )


def reply_parents(emails: DataFrame) -> DataFrame:
    """(id, case_id, parent_id): the row a message answers; of several rows sharing an id the last in date order."""
    return _with_parents(with_thread_facts(emails)).select("id", "case_id", "parent_id")


def _with_parents(facts: DataFrame) -> DataFrame:
    """`facts` with `parent_id` and `parent`, the (at, id, row) of the row that is answered, if the table has it."""
    mark = F.struct(*[F.col(c) for c in MARK if c in facts.columns])
    holders = facts.filter("ref IS NOT NULL").groupBy("case_id", F.col("ref").alias("_ref")).agg(F.max(mark).alias("parent"))
    # rows answering nothing get a key of their own, so they do not meet in one partition
    sought = facts.withColumn("_ref", F.coalesce("parent_ref", F.concat(F.lit("\u0000"), F.col("id").cast("string"))))
    joined = sought.join(holders, ["case_id", "_ref"], "left").drop("_ref")
    return joined.withColumn("parent_id", F.coalesce("parent.id", "kept_parent"))


def _linked(facts: DataFrame, by_position: bool) -> DataFrame:
    """(row, id, at, parent_id, parent) of every row; `by_position` if rows may name a parent by its id."""
    rows = _with_parents(facts).select("row", "id", "at", "parent_id", "parent")
    if not by_position:
        return rows
    asked = rows.filter("parent IS NULL AND parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct()
    known = facts.join(asked, "id", "left_semi").groupBy(F.col("id").alias("parent_id")).agg(F.max(F.struct(*MARK)).alias("named"))
    return rows.join(known, "parent_id", "left").select("row", "id", "at", "parent_id", F.coalesce("parent", "named").alias("parent"))


def _roots(links: DataFrame) -> DataFrame:
    """(row, parent_id, top, looped): each row's root, or the earliest row of the reply cycle it leads to.

    Pointer doubling: each round replaces a row's ancestor by its ancestor's ancestor, so a chain or cycle of n rows takes
    log2(n) joins, however many rows there are. `low` is the earliest of the ancestors passed. A row that finds itself
    there is the earliest of a cycle passed whole; every row that has it among its ancestors leads to that cycle.
    """
    at = F.col("parent.row")
    hops = materialise(links.select(
        "row", "parent_id", F.coalesce(at, "row").alias("top"), (at.isNotNull() & (at != F.col("row"))).alias("open"),
        F.coalesce(at == F.col("row"), F.lit(False)).alias("looped"), F.col("parent").alias("low"),
    ))
    while True:
        left = hops.agg(F.count_if("open").alias("open"), F.count_if(F.col("open") & (F.col("low.row") == F.col("row"))).alias("cycles")).first()
        if not left["open"]:
            return hops.select("row", "parent_id", "top", "looped")
        closed, ahead = hops.filter("NOT open"), hops.filter("open")
        if left["cycles"]:
            heads = ahead.filter("low.row = row").select(F.col("row").alias("_head"))
            met = ahead.join(heads, F.col("low.row") == F.col("_head"), "left")
            hit = F.col("_head").isNotNull()
            hops = materialise(closed.unionByName(met.select(
                "row", "parent_id", F.coalesce("_head", "top").alias("top"), (~hit).alias("open"), hit.alias("looped"), "low")))
            closed, ahead = hops.filter("NOT open"), hops.filter("open")
        step = hops.select(F.col("row").alias("top"), F.col("top").alias("_top"), F.col("open").alias("_open"), F.col("looped").alias("_looped"), F.col("low").alias("_low"))
        hops = materialise(closed.unionByName(ahead.join(step, "top").select(
            "row", "parent_id", F.col("_top").alias("top"), F.col("_open").alias("open"), F.col("_looped").alias("looped"), F.least("low", "_low").alias("low"))))


def assign_threads(emails: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, case_id, thread_id, parent_id, changed) for every row, trashed ones included, and the columns of `carry`.

    A row takes the key of its root; one on or under a reply cycle the subject key of the cycle's earliest row. Rows
    that share an id stay apart: an answer belongs to the row whose message id it names, not to all rows of its id.
    """
    facts = materialise(with_thread_facts(emails, carry).withColumn("row", F.monotonically_increasing_id()))
    by_position = {"source_kind", "parent_email_id"} <= set(emails.columns)
    roots = _roots(_linked(facts, by_position))
    key = (
        F.when(F.col("root_ref").isNotNull(), F.concat(F.lit("msg:"), "root_ref"))
        .when(F.col("conv").isNotNull(), F.concat(F.lit("convidx:"), "conv"))
        .when(F.col("ref").isNotNull(), F.concat(F.lit("msg:"), "ref"))
        .otherwise(F.col("subject_key"))
    )
    tops = facts.select(F.col("row").alias("top"), key.alias("key"), F.col("subject_key").alias("loop_key"))
    named = roots.join(tops, "top").select("row", "parent_id", F.when(F.col("looped"), F.col("loop_key")).otherwise(F.col("key")).alias("new_thread"))
    return facts.join(named, "row").select(
        "id", "case_id", F.col("new_thread").alias("thread_id"), "parent_id",
        (~F.col("new_thread").eqNullSafe(F.col("old_thread")) | ~F.col("parent_id").eqNullSafe(F.col("old_parent"))).alias("changed"),
        *[F.col(f"carried.{c}").alias(c) for c in carry],
    )


def thread_key(thread: Column, id_: Column) -> Column:
    return F.coalesce(thread, F.concat(F.lit("email:"), id_.cast("string")))


def chain_conflicts(rows: DataFrame) -> DataFrame:
    """(id) of dated rows later than everything above them in their chain, and of the rows that were latest before.

    `rows`: id, chain_source_id, chain_position, date_utc. Works over the whole chain.
    """
    dated = rows.filter("chain_source_id IS NOT NULL AND date_utc IS NOT NULL").select(
        "id", "chain_source_id", "chain_position", "date_utc", F.struct(F.col("date_utc").alias("date"), (-F.col("chain_position")).alias("up"), (-F.col("id")).alias("neg_id")).alias("mark")
    )
    bucket = F.floor(F.col("chain_position") / CHAIN_BUCKET)
    seen = prefix_max(dated, ["chain_source_id"], bucket, ["chain_position", "id"], F.col("mark"), "latest")
    late = seen.filter(F.col("date_utc") > F.col("latest.date"))
    return late.select("id").union(late.select((-F.col("latest.neg_id")).alias("id"))).distinct()


def chain_reading_key(emails: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Add `chain_conflict` and `reading_key`, a sortable key of the reading order.

    Manual positions first; a chain with a date conflict runs from the last position up, at the place of its
    earliest date; anything else by date.
    """
    flagged = emails.join(conflicts.select("id", F.lit(True).alias("_hit")), "id", "left").withColumn(
        "chain_conflict", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")
    at = reading_order(F.col("date_utc"), _column(emails, "created_at", "timestamp"))
    chains = flagged.filter("chain_source_id IS NOT NULL").groupBy("chain_source_id").agg(
        F.max("chain_conflict").alias("_any"), F.min("date_utc").alias("_anchor")
    ).filter("_any")
    joined = flagged.join(chains, "chain_source_id", "left")
    manual = F.coalesce(_column(emails, "manual_chain_order", "bigint"), F.lit(2**62))
    step = F.when(F.col("_any"), -F.col("chain_position")).otherwise(F.lit(0)).cast("long")
    key = F.struct(manual.alias("manual"), F.coalesce("_anchor", at).alias("at"), step.alias("step"), F.col("id").alias("id"))
    return joined.withColumn("reading_key", key).drop("_any", "_anchor")


def order_chain(emails: DataFrame) -> DataFrame:
    """Emails sorted for reading along their chains, with `chain_conflict`."""
    return chain_reading_key(emails, chain_conflicts(emails)).orderBy("reading_key").drop("reading_key")


def chain_of(emails: DataFrame, email_id: int) -> DataFrame:
    """The emails of one email's thread in chain order."""
    key = thread_key(F.col("thread_id"), F.col("id"))
    wanted = emails.filter(F.col("id") == email_id).limit(1).select(key.alias("_key"))
    return order_chain(emails.filter(key == wanted.scalar()))


def thread_groups(emails: DataFrame) -> DataFrame:
    """Per thread: size, subject of its first email, first and last dated row in reading order."""
    manual = F.coalesce(F.col("manual_chrono_order").cast("long"), F.lit(2**62))
    at = F.struct(manual.alias("manual"), reading_order(F.col("date_utc"), F.col("created_at")).alias("at"), F.col("id").alias("id"))
    dated = F.when(F.col("date_utc").isNotNull(), at)
    return emails.groupBy("case_id", thread_key(F.col("thread_id"), F.col("id")).alias("thread_key")).agg(
        F.count("*").alias("size"),
        strip_subject(F.min_by("subject", at)).alias("subject"),
        F.min_by("date_utc", dated).alias("first_date"),
        F.max_by("date_utc", dated).alias("last_date"),
    )


def month_groups(emails: DataFrame, tz: Column) -> DataFrame:
    """(case_id, month, emails) in each row's zone, undated rows last."""
    month = F.coalesce(F.date_format(F.from_utc_timestamp("date_utc", tz), "yyyy-MM"), F.lit("no-date"))
    return emails.groupBy("case_id", month.alias("month")).agg(F.count("*").alias("emails")).orderBy(
        "case_id", F.col("month") == "no-date", "month"
    )
