"""How emails relate to a focus email."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_contact, strip_subject

# Confidence levels from weak to strong.
CONFIDENCE = ("low", "med", "high")


def _level(col: Column) -> Column:
    rank = F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.coalesce(col, F.lit("")))
    return F.greatest(rank, F.lit(1).cast("long"))


def _refs(reply: str, refs: str) -> Column:
    every = F.concat(F.array(F.col(reply)), F.coalesce(refs, F.array().cast("array<string>")))
    return F.filter(F.array_compact(every), lambda r: r != "")


def _people(p: str = "") -> Column:
    none = F.array().cast("array<string>")
    every = F.concat(F.array(f"{p}from_addr"), F.coalesce(f"{p}to", none), F.coalesce(f"{p}cc", none))
    return F.filter(F.transform(F.array_compact(every), norm_contact), lambda x: x != "")


FACTS = ("id", "parent_email_id", "message_id", "in_reply_to", "references", "chain_source_id", "source_kind",
         "thread_id", "subject", "from_addr", "to", "cc", "relation_confidence")


def label_relations(pairs: DataFrame) -> DataFrame:
    """Label rows holding an email (plain columns) and its focus (`f_` columns)."""
    same = F.col("id") == F.col("f_id")
    email_refs, focus_refs = _refs("in_reply_to", "references"), _refs("f_in_reply_to", "f_references")
    has = lambda name: F.coalesce(F.col(name) != "", F.lit(False))
    reply = (F.col("parent_email_id") == F.col("f_id")) | (has("f_message_id") & (F.col("in_reply_to") == F.col("f_message_id")))
    parent = (F.col("f_parent_email_id") == F.col("id")) | (has("message_id") & F.array_contains(focus_refs, F.col("message_id")))
    chain = (
        (F.col("chain_source_id") == F.col("f_id")) | (F.col("f_chain_source_id") == F.col("id")) | (F.col("chain_source_id") == F.col("f_chain_source_id"))
    )
    attached = (F.col("source_kind") == "attached") | (F.col("f_source_kind") == "attached")
    thread = has("thread_id") & (F.col("thread_id") == F.col("f_thread_id"))
    late = has("message_id") & has("f_message_id") & F.array_contains(email_refs, F.col("f_message_id"))
    subject = F.lower(strip_subject(F.col("subject"))) == F.lower(strip_subject(F.col("f_subject")))
    people = F.arrays_overlap(_people(), _people("f_"))
    label = (
        F.when(same, "Focus").when(reply, "Reply").when(parent, "Parent")
        .when(chain & (F.col("source_kind") == "quoted"), "Quoted").when(chain & attached, "Attached").when(chain, "Forwarded")
        .when(thread, "Same thread").when(late, "Reply").when(subject & people, "Inferred").otherwise("")
    )
    both = F.least(_level(F.col("relation_confidence")), _level(F.col("f_relation_confidence")))
    level = (
        F.when(F.col("label") == "Focus", F.lit(3)).when(F.col("label").isin("Quoted", "Inferred"), F.lit(1))
        .when(F.col("label") == "Forwarded", F.least(both, F.lit(2))).otherwise(both)
    )
    labelled = pairs.withColumn("label", label)
    return labelled.select("id", F.col("f_id").alias("focus_id"), "label", F.element_at(F.array(*map(F.lit, CONFIDENCE)), level.cast("int")).alias("confidence"))


def relations_to(emails: DataFrame, focus_id: int) -> DataFrame:
    """(id, focus_id, label, confidence) of every email to one focus email; the focus row is a scalar subquery."""
    focus = emails.filter(F.col("id") == focus_id).limit(1).select(F.struct(*FACTS).alias("f"))
    beside = emails.select(*FACTS).withColumn("_f", focus.scalar()).filter("_f IS NOT NULL")
    return label_relations(beside.select(*FACTS, *[F.col(f"_f.{c}").alias(f"f_{c}") for c in FACTS]))


def relations_in_threads(emails: DataFrame, date: str = "date_utc") -> DataFrame:
    """Every email's relation to the first email of its thread: one row per email, never all pairs."""
    order = F.struct(F.col(date).isNull().alias("undated"), F.col(date).alias("at"), F.col("id").alias("id"))
    first = emails.groupBy("thread_id").agg(F.min_by(F.struct(*FACTS), order).alias("_f"))
    keyed = emails.select(*FACTS).join(first, "thread_id")
    return label_relations(keyed.select(*FACTS, *[F.col(f"_f.{c}").alias(f"f_{c}") for c in FACTS]))
