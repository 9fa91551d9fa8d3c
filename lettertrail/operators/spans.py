"""Text-span provenance: which characters of a source field are accounted for.

Spans are half-open code-point ranges [start_offset, end_offset) on (source_email_id, source_field).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, html_to_text, fold_space, round_even, strip
from .scan import first_seen_index, prefix_max

KEYS = ["source_email_id", "source_field"]
BUCKET_CHARS = 8192

# Field and mapping kinds allowed, display priority of kinds, colours in the palette.
SOURCE_FIELDS = ("headers", "subject", "body", "html", "attachments")
TARGET_FIELDS = SOURCE_FIELDS + ("notes",)
KINDS = ("parsed", "quoted", "attached", "snipped", "manual", "self", "fuzzy")
KIND_ORDER = {"manual": 0, "snipped": 1, "quoted": 2, "attached": 2, "parsed": 3, "self": 3}
COLOURS = 12


def _bucket(start: Column) -> Column:
    return F.floor(start / BUCKET_CHARS)


def clamp(spans: DataFrame) -> DataFrame:
    fit = spans.withColumn("start_offset", F.greatest("start_offset", F.lit(0)))
    if "field_length" in spans.columns:
        fit = fit.withColumn("end_offset", F.least("end_offset", "field_length"))
    return fit.filter("end_offset > start_offset")


def live_spans(spans: DataFrame) -> DataFrame:
    return clamp(spans.filter("NOT stale") if "stale" in spans.columns else spans)


def merge_ranges(spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Overlapping or touching live spans of a key as single ranges.

    Spans with the same start collapse first, so a key carries at most one row per character position.
    """
    keys = keys or KEYS
    starts = live_spans(spans).groupBy(*keys, "start_offset").agg(F.max("end_offset").alias("end_offset"))
    bucket = _bucket(F.col("start_offset"))
    reach = prefix_max(starts, keys, bucket, ["start_offset"], F.col("end_offset"), "reach")
    opens = F.when(F.col("reach").isNull() | (F.col("start_offset") > F.col("reach")), F.col("start_offset"))
    islands = prefix_max(reach, keys, bucket, ["start_offset"], opens, "island", inclusive=True)
    merged = islands.groupBy(*keys, "island").agg(F.max("end_offset").alias("end_offset"))
    return merged.withColumnRenamed("island", "start_offset")


def gap_ranges(merged: DataFrame, fields: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Uncovered ranges of every field. `fields` has the keys, `field_length` and `text`; blank gaps are dropped."""
    keys = keys or KEYS
    ends = fields.select(*keys, F.col("field_length").alias("start_offset"), F.col("field_length").alias("end_offset"))
    rows = merged.select(*keys, "start_offset", "end_offset").unionByName(ends)
    reached = prefix_max(rows, keys, _bucket(F.col("start_offset")), ["start_offset", "end_offset"], F.col("end_offset"), "gap_start")
    gaps = reached.withColumn("gap_start", F.coalesce("gap_start", F.lit(0))).filter("start_offset > gap_start")
    gaps = gaps.select(*keys, F.col("gap_start").alias("start_offset"), F.col("start_offset").alias("end_offset"))
    if "text" not in fields.columns:
        return gaps
    width = (F.col("end_offset") - F.col("start_offset")).cast("int")
    text = F.substring("text", (F.col("start_offset") + 1).cast("int"), width)
    return gaps.join(fields.select(*keys, "text"), keys).withColumn("gap_text", text).filter(strip(F.col("gap_text")) != "").drop("text")


def percent(covered: Column, total: Column) -> Column:
    return F.when(total <= 0, F.lit(100.0)).otherwise(round_even(covered / total * 100, 1))


def coverage(merged: DataFrame, fields: DataFrame, by: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Covered, total and unmapped characters per `by` group (default: per field); fields without spans count."""
    keys = keys or KEYS
    by = keys if by is None else by
    covered = merged.groupBy(*keys).agg(F.sum(F.col("end_offset") - F.col("start_offset")).alias("covered"))
    extra = [c for c in by if c not in keys]
    joined = fields.select(*keys, *extra, "field_length").join(covered, keys, "left")
    sums = joined.groupBy(*by).agg(
        F.sum(F.coalesce("covered", F.lit(0))).cast("long").alias("covered_chars"), F.sum("field_length").cast("long").alias("total_chars")
    )
    return sums.withColumn("unmapped_chars", F.greatest(F.lit(0), F.col("total_chars") - F.col("covered_chars"))).withColumn(
        "coverage_percent", percent(F.col("covered_chars"), F.col("total_chars"))
    )


def kind_order(kind: Column) -> Column:
    rank = F.lit(4)
    for name, value in KIND_ORDER.items():
        rank = F.when(kind == name, value).otherwise(rank)
    return rank


def segments(spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Non-overlapping display segments: earlier start, then stronger kind wins; the rest is trimmed."""
    keys = keys or KEYS
    once = clamp(spans).groupBy(*keys, "start_offset", "end_offset", kind_order(F.col("mapping_kind")).alias("_rank")).agg(
        F.min(F.struct("target_email_id", "mapping_kind")).alias("_who")
    )
    order = ["start_offset", "_rank", F.col("_who.target_email_id"), "end_offset"]
    seen = prefix_max(once, keys, _bucket(F.col("start_offset")), order, F.col("end_offset"), "cursor")
    cut = seen.withColumn("start_offset", F.greatest("start_offset", F.coalesce("cursor", F.lit(0))))
    return cut.filter("end_offset > start_offset").select(*keys, "start_offset", "end_offset", "_who.*")


# Fixed value: a Unicode noncharacter that marks where a text is cut; it never occurs in a message.
CUT = "﷐"


def _pieces(fields: DataFrame, keys: list[str], marked: Column) -> DataFrame:
    """One row per piece of a marked text, with its code-point offset."""
    rows = fields.select(*keys, F.posexplode(F.split(marked, CUT)).alias("piece_no", "piece"))
    before = Window.partitionBy(*keys).orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0))
    lead = F.length("piece") - F.length(F.regexp_replace("piece", f"^[{SPACE}]+", ""))
    return rows.withColumn("at", at).withColumn("lead", lead)


def text_blocks(fields: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Paragraphs of each field with offsets; a field of at most one paragraph gives its non-blank lines."""
    keys = keys or KEYS
    paragraphs = _pieces(fields, keys, F.regexp_replace("text", rf"(?<=[^{SPACE}])(?=\n\n)", CUT))
    solid = (strip(F.col("piece")) != "") & F.col("piece").rlike(rf"[^{SPACE}]\z")
    paragraphs = paragraphs.filter(solid).select(
        *keys, (F.col("at") + F.col("lead")).alias("start_offset"), (F.col("at") + F.length("piece")).alias("end_offset")
    )
    many = paragraphs.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)
    single = fields.join(many, keys, "left_anti")
    lines = _pieces(single, keys, F.regexp_replace("text", r"(?<=[^\n])(?=\n)", CUT))
    body = F.regexp_replace("piece", r"^\n+", "")
    lines = lines.filter(strip(body) != "").select(
        *keys, (F.col("at") + F.length("piece") - F.length(body)).alias("start_offset"), (F.col("at") + F.length("piece")).alias("end_offset")
    )
    return paragraphs.join(many, keys, "left_semi").unionByName(lines).select(
        *keys, F.col("start_offset").cast("long").alias("start_offset"), F.col("end_offset").cast("long").alias("end_offset")
    )


# ---- source fields and mappings


def attachment_line(id_: Column, filename: Column, mime: Column, size: Column) -> Column:
    return F.concat(F.lit("#"), id_.cast("string"), F.lit(" "), filename, F.lit(" ("), mime, F.lit(", "), size.cast("string"), F.lit(" bytes)"))


def attachment_text(attachments: DataFrame) -> DataFrame:
    line = attachment_line(F.col("id"), F.col("filename"), F.col("mime"), F.col("size"))
    listed = attachments.groupBy("email_id").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("lines"))
    return listed.select("email_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("attachments_text"))


def source_fields(emails: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """Up to five (field, label, text) rows per email; blank ones and an html text equal to the body are dropped.

    `emails`: id, from_addr, to, cc, date_raw, message_id, in_reply_to, references, subject, body_text, body_html.
    """
    def header(label: str, value: Column, always: bool = False) -> Column:
        text = F.concat(F.lit(f"{label}: "), F.coalesce(value, F.lit("")))
        return text if always else F.when(F.coalesce(value, F.lit("")) != "", text)

    headers = F.concat_ws(
        "\n",
        header("From", F.col("from_addr"), True),
        header("To", F.array_join("to", "; "), True),
        header("Cc", F.array_join("cc", "; ")),
        header("Date", F.col("date_raw"), True),
        header("Message-ID", F.col("message_id")),
        header("In-Reply-To", F.col("in_reply_to")),
        header("References", F.array_join("references", " ")),
    )
    html = strip(html_to_text(F.coalesce("body_html", F.lit(""))))
    html = F.when(fold_space(html) != fold_space(F.col("body_text")), html)
    joined = emails
    if attachments is not None:
        joined = emails.join(attachment_text(attachments), emails["id"] == F.col("email_id"), "left").drop("email_id")
    else:
        joined = emails.withColumn("attachments_text", F.lit(None).cast("string"))
    rows = F.array(
        *[
            F.struct(F.lit(field).alias("source_field"), F.lit(label).alias("label"), F.coalesce(text, F.lit("")).alias("text"))
            for field, label, text in (
                ("headers", "Headers", headers),
                ("subject", "Subject", F.col("subject")),
                ("body", "Body", F.col("body_text")),
                ("html", "HTML text", html),
                ("attachments", "Parsed attachments", F.col("attachments_text")),
            )
        ]
    )
    fields = joined.select(F.col("id").alias("source_email_id"), F.inline(rows))
    return fields.filter(strip(F.col("text")) != "").withColumn("field_length", F.length("text").cast("long"))


def valid_spans(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted with confidence clamped to 0..1, rejected)."""
    fine = (
        (F.col("start_offset") >= 0)
        & (F.col("start_offset") < F.col("end_offset"))
        & (F.col("end_offset") <= F.col("field_length"))
        & F.col("source_field").isin(*SOURCE_FIELDS)
        & F.col("target_field").isin(*TARGET_FIELDS)
        & F.col("mapping_kind").isin(*KINDS)
    )
    fine = F.coalesce(fine, F.lit(False))
    accepted = spans.filter(fine).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")))
    return accepted, spans.filter(~fine)


def _mapping(rows: DataFrame, field: Column, start: Column, end: Column, target: Column, target_field: Column, kind: str, confidence: float, transform: str) -> DataFrame:
    return rows.select(
        "source_email_id", field.alias("source_field"), start.cast("long").alias("start_offset"), end.cast("long").alias("end_offset"),
        target.alias("target_email_id"), target_field.alias("target_field"), F.lit(kind).alias("mapping_kind"),
        F.lit(confidence).alias("confidence"), F.lit(transform).alias("transform"), F.lit(False).alias("stale"),
    )


def self_mappings(fields: DataFrame, kind: str = "parsed") -> DataFrame:
    """Each field maps onto the same field of its own card."""
    return _mapping(fields, F.col("source_field"), F.lit(0), F.col("field_length"), F.col("source_email_id"), F.col("source_field"), kind, 1.0, "identity")


def quoted_mappings(quoted: DataFrame, emails: DataFrame) -> DataFrame:
    """Quoted rows onto their parent's body; `quoted` has id, parent_email_id, source_start_offset, source_end_offset."""
    bodies = emails.select(F.col("id").alias("source_email_id"), F.length(F.coalesce("body_text", F.lit(""))).alias("_len"))
    rows = quoted.join(bodies, F.col("parent_email_id") == F.col("source_email_id"))
    inside = "source_start_offset >= 0 AND source_start_offset < source_end_offset AND source_end_offset <= _len"
    return _mapping(rows.filter(inside), F.lit("body"), F.col("source_start_offset"), F.col("source_end_offset"), F.col("id"), F.lit("body"), "quoted", 0.85, "quote_extraction")


def attachment_mappings(attached: DataFrame, fields: DataFrame, attachments: DataFrame) -> DataFrame:
    """Attached rows onto their line in the parent's attachment list; `attached` has id, parent_email_id, attachment_id."""
    line = attachment_line(F.col("aid"), F.col("filename"), F.col("mime"), F.col("size"))
    lines = attachments.select(F.col("id").alias("aid"), "filename", "mime", "size").withColumn("line", line)
    lists = fields.filter("source_field = 'attachments'").select("source_email_id", "text")
    rows = attached.join(lines, F.col("attachment_id") == F.col("aid")).join(lists, F.col("parent_email_id") == F.col("source_email_id"))
    rows = rows.withColumn("_at", F.position("line", "text") - 1).filter("_at >= 0")
    return _mapping(rows, F.lit("attachments"), F.col("_at"), F.col("_at") + F.length("line"), F.col("id"), F.lit("body"), "attached", 1.0, "attachment_parse")


def snip_mappings(parts: DataFrame) -> DataFrame:
    """Split parts onto the body they came from; `parts` has id, source_email_id, start_offset, end_offset."""
    return _mapping(parts.filter("end_offset > start_offset"), F.lit("body"), F.col("start_offset"), F.col("end_offset"), F.col("id"), F.lit("body"), "snipped", 1.0, "manual_snip")


def live_mappings(mappings: DataFrame, emails: DataFrame) -> DataFrame:
    """Mappings whose source is not trashed and whose target is neither trashed nor superseded."""
    sources = emails.filter("deleted_at IS NULL").select(F.col("id").alias("source_email_id"))
    targets = emails.filter("deleted_at IS NULL AND superseded_at IS NULL").select(F.col("id").alias("target_email_id"))
    return mappings.join(sources, "source_email_id", "left_semi").join(targets, "target_email_id", "left_semi")


def refresh_stale(mappings: DataFrame, emails: DataFrame) -> DataFrame:
    """A mapping is stale exactly when one of its ends is trashed or gone."""
    live = emails.filter("deleted_at IS NULL").select("id")
    s = live.select(F.col("id").alias("source_email_id"), F.lit(True).alias("_s"))
    t = live.select(F.col("id").alias("target_email_id"), F.lit(True).alias("_t"))
    joined = mappings.join(s, "source_email_id", "left").join(t, "target_email_id", "left")
    return joined.withColumn("stale", F.col("_s").isNull() | F.col("_t").isNull()).drop("_s", "_t")


def mapping_stats(mappings: DataFrame, emails: DataFrame, totals: DataFrame) -> DataFrame:
    """Per source: outbound mappings by kind, inbound count, role and status. `totals`: source_email_id, total_chars."""
    live = live_mappings(mappings.filter("NOT stale"), emails)
    out = live.groupBy("source_email_id").agg(
        F.count("*").alias("outbound"), *[F.count_if(F.col("mapping_kind") == kind).alias(f"n_{kind}") for kind in KINDS]
    )
    into = live.groupBy(F.col("target_email_id").alias("source_email_id")).agg(F.count("*").alias("inbound"))
    sources = emails.filter("deleted_at IS NULL").select(F.col("id").alias("source_email_id"))
    joined = sources.join(out, "source_email_id", "left").join(into, "source_email_id", "left").join(totals, "source_email_id", "left")
    joined = joined.na.fill(0)
    o, i = F.col("outbound") > 0, F.col("inbound") > 0
    role = F.when(o & i, "source_and_destination").when(o, "source").when(i, "destination").otherwise("untracked")
    status = F.when(F.col("total_chars") <= 0, "empty").when(o, "mapped_source").when(i, "created_from_source").otherwise("unmapped")
    return joined.withColumn("mapping_role", role).withColumn("mapping_status", status)


def map_status(emails: DataFrame, mappings: DataFrame, fields: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per case: sources, sources with cached fields, sources with a live mapping, running jobs, ready flag."""
    cached = fields.select(F.col("source_email_id").alias("id")).distinct().withColumn("_c", F.lit(True))
    mapped = mappings.filter("NOT stale").select(F.col("source_email_id").alias("id")).distinct().withColumn("_m", F.lit(True))
    rows = emails.filter("deleted_at IS NULL").select("id", "case_id").join(cached, "id", "left").join(mapped, "id", "left")
    counts = rows.groupBy("case_id").agg(
        F.count("*").alias("source_count"), F.count_if("_c").alias("cached_source_count"), F.count_if("_m").alias("mapped_source_count")
    )
    running = jobs.filter("status = 'running'").groupBy("case_id").agg(F.count("*").alias("running_jobs"))
    joined = counts.join(running, "case_id", "left").withColumn("running_jobs", F.coalesce("running_jobs", F.lit(0)))
    return joined.withColumn("ready", (F.col("source_count") > 0) & (F.col("running_jobs") == 0))


def build_map(emails: DataFrame, mappings: DataFrame, fields: DataFrame) -> dict[str, DataFrame]:
    """The whole provenance map as flat tables: summary, fields, sources, mappings, cards, gaps.

    `fields` has source_email_id, source_field, text, field_length; emails need case_id, subject, source_kind,
    source_file_display.
    """
    live = live_mappings(mappings, emails)
    cases = emails.select(F.col("id").alias("source_email_id"), "case_id")
    sources = emails.filter("deleted_at IS NULL").select(F.col("id").alias("source_email_id"), "case_id", "source_kind", "source_file_display", F.coalesce(F.nullif("subject", F.lit("")), F.lit("(no subject)")).alias("subject"))
    kept = fields.join(sources.select("source_email_id", "case_id"), "source_email_id")
    merged = merge_ranges(live.join(kept.select(*KEYS, "field_length"), KEYS))
    by_field = coverage(merged, kept)
    by_source = coverage(merged, kept, ["source_email_id"])
    by_case = coverage(merged, kept, ["case_id"])
    stats = mapping_stats(mappings, emails, by_source.select("source_email_id", "total_chars"))
    colour = first_seen_index(live.join(cases, "source_email_id"), "target_email_id", ["source_email_id", "source_field", "start_offset"], ["case_id"], "color_index", COLOURS)
    targets = emails.select(F.col("id").alias("target_email_id"), F.col("subject").alias("target_subject"), F.col("source_file_display").alias("target_source"))
    shown = live.join(cases, "source_email_id").join(targets, "target_email_id", "left").join(colour, ["case_id", "target_email_id"], "left")
    cards = emails.filter("deleted_at IS NULL AND superseded_at IS NULL").select(
        F.col("id").alias("target_email_id"), "case_id", "from_addr", "date_utc", "source_kind", "source_file_display",
        F.coalesce(F.nullif("subject", F.lit("")), F.lit("(no subject)")).alias("subject"),
    ).join(colour, ["case_id", "target_email_id"], "left").withColumn("color_index", F.coalesce("color_index", F.lit(0)))
    counts = sources.groupBy("case_id").agg(F.count("*").alias("source_count")).join(
        cards.groupBy("case_id").agg(F.count("*").alias("target_count")), "case_id", "left"
    )
    return {
        "summary": counts.join(by_case, "case_id", "left"),
        "sources": sources.join(by_source, "source_email_id", "left").join(stats.drop("total_chars"), "source_email_id", "left"),
        "fields": by_field,
        "mappings": shown,
        "cards": cards,
        "gaps": gap_ranges(merged, kept),
    }
