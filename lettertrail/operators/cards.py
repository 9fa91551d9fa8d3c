"""Cards made from source text: selections, and bodies split into parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date, valid_zone
from ..functions.text import SPACE, strip, unix_lines
from .quotes import infer_headers

# Shortest card text, and the gap between joined selections.
MIN_CHARS = 3
JOINER = "\n\n"


def cards_from_selections(emails: DataFrame, fields: DataFrame, selections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cards, mappings, refused groups) for groups of selected ranges.

    `selections`: group_id, seq, source_email_id, source_field, start_offset, end_offset. The trimmed texts of a
    group are joined with a blank line; one bad range refuses the whole group.
    """
    live = emails.filter("deleted_at IS NULL").select(F.col("id").alias("source_email_id"))
    known = fields.join(live, "source_email_id", "left_semi").select("source_email_id", "source_field", "text", "field_length")
    work = selections.join(known, ["source_email_id", "source_field"], "left")
    width = (F.col("end_offset") - F.col("start_offset")).cast("int")
    inside = (F.col("start_offset") >= 0) & (width > 0) & (F.col("end_offset") <= F.col("field_length"))
    piece = strip(F.substring("text", (F.col("start_offset") + 1).cast("int"), width))
    work = work.withColumn("piece", F.when(inside, piece)).withColumn("fine", F.coalesce(F.length("piece") >= MIN_CHARS, F.lit(False))).drop("text")
    refused = work.groupBy("group_id").agg(F.bool_and("fine").alias("ok")).filter("NOT ok").select("group_id")
    good = work.join(refused, "group_id", "left_anti")
    before = Window.partitionBy("group_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("piece") + len(JOINER)).over(before), F.lit(0))
    mappings = good.withColumn("target_start_offset", at).withColumn("target_end_offset", F.col("target_start_offset") + F.length("piece"))
    # the text of one card is one value, put together from the ranges a reader picked
    cards = good.groupBy("group_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), JOINER).alias("body_text"),
        F.min_by("source_email_id", "seq").alias("parent_email_id"), F.count("*").alias("n_ranges"),
    )
    heads = emails.select(
        F.col("id").alias("parent_email_id"), "case_id", "from_addr", "date_utc", F.col("message_id").alias("in_reply_to"),
        *([F.col("chain_source_id").alias("_chain")] if "chain_source_id" in emails.columns else [F.lit(None).cast("long").alias("_chain")]),
    )
    cards = cards.join(heads, "parent_email_id").withColumn("chain_source_id", F.coalesce("_chain", "parent_email_id")).drop("_chain")
    single = F.concat(F.lit("Selection from #"), F.col("parent_email_id").cast("string"))
    many = F.concat(F.lit("Grouped selection from "), F.col("n_ranges").cast("string"), F.lit(" source ranges"))
    cards = cards.withColumn("subject", F.when(F.col("n_ranges") == 1, single).otherwise(many)).withColumn("source_kind", F.lit("snipped")).withColumn(
        "boundary_method", F.when(F.col("n_ranges") == 1, "manual_selection").otherwise("multi_selection")
    ).withColumn("parse_confidence", F.lit("high")).withColumn("user_edited", F.lit(True))
    columns = ["group_id", "seq", "source_email_id", "source_field", "start_offset", "end_offset", "target_start_offset", "target_end_offset"]
    return cards, mappings.select(*columns, F.lit("manual").alias("mapping_kind"), F.lit(1.0).alias("confidence")), refused


def split_bodies(emails: DataFrame, offsets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts, refused ids). `offsets`: id, offsets array<int>.

    Line ends are normalised; offsets must lie strictly inside the body and leave no part under three characters.
    Parts carry their trimmed text and the trimmed range it has in the normalised body.
    """
    live = emails.filter("deleted_at IS NULL AND superseded_at IS NULL")
    body = unix_lines(F.coalesce("body_text", F.lit("")))
    work = live.select("id", body.alias("body")).join(offsets.select("id", F.array_sort(F.array_distinct("offsets")).alias("cuts")), "id")
    work = work.withColumn("len", F.length("body"))
    inside = (F.size("cuts") > 0) & (F.get("cuts", 0) > 0) & (F.element_at("cuts", -1) < F.col("len"))
    bounds = F.arrays_zip(
        F.concat(F.array(F.lit(0)), "cuts").alias("s"), F.concat("cuts", F.array("len")).alias("e")
    )
    rows = work.filter(F.coalesce(inside, F.lit(False))).select("id", "body", F.posexplode(bounds).alias("n", "r"))
    rows = rows.select("id", (F.col("n") + 1).alias("part_index"), F.col("r.s").alias("s"), F.col("r.e").alias("e"), "body")
    raw = F.substring("body", F.col("s") + 1, F.col("e") - F.col("s"))
    rows = rows.withColumn("raw", raw).drop("body").withColumn("body_text", strip(F.col("raw")))
    lead = F.length("raw") - F.length(F.regexp_replace("raw", f"^[{SPACE}]+", ""))
    rows = rows.withColumn("start_offset", F.col("s") + lead).withColumn("end_offset", F.col("start_offset") + F.length("body_text"))
    fine = rows.groupBy("id").agg(F.bool_and(F.length("body_text") >= MIN_CHARS).alias("ok"), F.count("*").alias("total")).filter("ok")
    parts = rows.join(fine.select("id", "total"), "id").select(F.col("id").alias("source_email_id"), "part_index", "total", "start_offset", "end_offset", "body_text")
    return parts, offsets.select("id").join(fine, "id", "left_anti")


def apply_drafts(parts: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reviewed parts, refused source ids). `drafts`: source_email_id, part_index, approved, from_addr, to, cc,
    date_raw, subject, body_text. A source is taken only when every part has one approved, non-empty draft."""
    d = drafts.select("source_email_id", "part_index", "approved", F.struct(*[c for c in ("from_addr", "to", "cc", "date_raw", "subject", "body_text")]).alias("draft"))
    both = parts.select("source_email_id", "part_index", "total", "start_offset", "end_offset").join(d, ["source_email_id", "part_index"], "full")
    reviewed = drafts.select("source_email_id").distinct()
    fine = F.col("total").isNotNull() & F.col("draft").isNotNull() & F.coalesce("approved", F.lit(False)) & (F.length(strip(F.col("draft.body_text"))) >= MIN_CHARS)
    verdict = both.join(reviewed, "source_email_id", "left_semi").groupBy("source_email_id").agg(
        F.bool_and(F.coalesce(fine, F.lit(False))).alias("ok"), F.count("*").alias("n"), F.max("total").alias("total")
    )
    ok = (F.col("ok")) & (F.col("n") == F.col("total"))
    taken = both.join(verdict.filter(ok).select("source_email_id"), "source_email_id", "left_semi")
    return taken.drop("approved"), verdict.filter(~F.coalesce(ok, F.lit(False))).select("source_email_id")


def snip(emails: DataFrame, offsets: DataFrame, cases: DataFrame, drafts: DataFrame | None = None) -> dict[str, DataFrame]:
    """Split emails into part cards: new `parts`, `mappings`, the `emails` marked superseded, and `refused` ids.

    Part 1 keeps its email's headers; later parts take the headers their text opens with, else none and a
    review flag. With `drafts`, reviewed fields replace the inferred ones.
    """
    parts, refused = split_bodies(emails, offsets)
    taken = parts
    if drafts is not None:
        reviewed, wrong = apply_drafts(parts, drafts)
        drafted = reviewed.select("source_email_id", "part_index", "draft")
        taken = parts.join(wrong, "source_email_id", "left_anti").join(drafted, ["source_email_id", "part_index"], "left")
        refused = refused.unionByName(wrong.withColumnRenamed("source_email_id", "id"))
    else:
        taken = taken.withColumn("draft", F.lit(None).cast("struct<from_addr:string,to:array<string>,cc:array<string>,date_raw:string,subject:string,body_text:string>"))
    zones = cases.select(F.col("id").alias("case_id"), valid_zone(F.col("default_tz")).alias("_tz"))
    none = F.array().cast("array<string>")
    opt = lambda name, kind: F.col(name) if name in emails.columns else F.lit(None).cast(kind)
    source = emails.join(zones, "case_id").select(
        F.col("id").alias("source_email_id"), "case_id", "_tz", F.col("message_id").alias("_mid"), opt("in_reply_to", "string").alias("_irt"),
        F.coalesce(opt("references", "array<string>"), none).alias("_refs"), F.col("from_addr").alias("_from"), opt("to", "array<string>").alias("_to"),
        opt("cc", "array<string>").alias("_cc"), opt("date_raw", "string").alias("_raw"), F.col("date_utc").alias("_utc"), F.col("subject").alias("_subject"),
        opt("parse_confidence", "string").alias("_conf"), F.coalesce(opt("chain_source_id", "bigint"), F.col("id")).alias("chain_source_id"),
        F.coalesce(opt("chain_position", "int"), F.lit(0)).alias("_pos"),
    )
    later = F.col("part_index") > 1
    work = taken.join(source, "source_email_id").withColumn("_h", infer_headers(F.when(later & F.col("draft").isNull(), F.col("body_text"))))
    inferred, draft = F.col("_h.method").isNotNull(), F.col("draft").isNotNull()

    def pick(drafted, guessed, first, other):
        return F.when(draft, drafted).when(inferred, guessed).when(~later, first).otherwise(other)

    raw = pick(F.nullif(F.trim("draft.date_raw"), F.lit("")), F.col("_h.date_raw"), F.col("_raw"), F.lit(None).cast("string"))
    titled = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("(no subject)"))
    work = work.withColumn("date_raw", raw).withColumn("_parsed", parse_date(F.col("date_raw"), F.col("_tz")))
    guessed_conf = F.when((F.col("_h.method") != "localized_header") & F.col("_parsed").isNotNull(), "med").otherwise("low")
    refs = F.when(later, F.array_distinct(F.concat("_refs", F.when(F.col("_mid").isNotNull(), F.array("_mid")).otherwise(none)))).otherwise(F.col("_refs"))
    flags = F.array_compact(
        F.array(
            F.lit("manual_snip"), F.concat(F.lit("snip_part:"), F.col("part_index").cast("string"), F.lit("_of_"), F.col("total").cast("string")),
            F.when(draft, F.lit("manual_snip_reviewed")), F.when(later & ~inferred & ~draft, F.lit("manual_snip_needs_review")),
        )
    )
    rows = work.select(
        "case_id", "source_email_id", "part_index", F.col("source_email_id").alias("parent_email_id"), "chain_source_id", (F.col("_pos") + F.col("part_index")).alias("chain_position"),
        F.lit("snipped").alias("source_kind"), F.when(~later, F.col("_mid")).alias("message_id"), F.when(later, F.col("_mid")).otherwise(F.col("_irt")).alias("in_reply_to"),
        refs.alias("references"),
        pick(F.trim("draft.from_addr"), F.col("_h.from_addr"), F.col("_from"), F.lit("")).alias("from_addr"),
        pick(F.col("draft.to"), F.col("_h.to"), F.col("_to"), F.col("_to")).alias("to"), pick(F.col("draft.cc"), F.col("_h.cc"), F.col("_cc"), F.col("_cc")).alias("cc"),
        "date_raw", F.when(~later & ~draft, F.col("_utc")).otherwise(F.col("_parsed")).alias("date_utc"),
        pick(titled(F.col("draft.subject")), titled(F.col("_h.subject")), titled(F.col("_subject")), titled(F.col("_subject"))).alias("subject"),
        pick(strip(F.col("draft.body_text")), F.col("_h.body_text"), F.col("body_text"), F.col("body_text")).alias("body_text"),
        F.when(draft, "high").when(inferred, guessed_conf).when(~later, F.col("_conf")).otherwise("low").alias("parse_confidence"),
        flags.alias("flags"), F.lit("manual_snip").alias("boundary_method"), F.lit("high").alias("relation_confidence"), "start_offset", "end_offset",
    )
    split = taken.select(F.col("source_email_id").alias("id"), F.lit(True).alias("_split")).distinct()
    marked = emails.join(split, "id", "left").withColumn("superseded_at", F.when(F.col("_split"), F.current_timestamp()).otherwise(F.col("superseded_at"))).drop("_split")
    return {"parts": rows, "emails": marked, "refused": refused}
