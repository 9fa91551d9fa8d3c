"""Scalar text, fingerprint and date queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import fingerprint as P
from ..functions import text as T
from ..operators import boilerplate
from ..session import materialise
from . import checksql as Q
from .registry import query

STAMP = "%Y-%m-%d %H:%M:%S"


def stamp(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


@query("message_ids_normalized", f"SELECT id, {Q.msgid_norm('message_id')} AS message_ref FROM fx_emails")
def _(t):
    return t.fx_emails.select("id", T.norm_msgid(F.col("message_id")).alias("message_ref"))


@query("subjects_normalized", f"SELECT id, {Q.subject_norm('subject')} AS subject_key FROM fx_emails")
def _(t):
    return t.fx_emails.select("id", T.norm_subject(F.col("subject")).alias("subject_key"))


@query(
    "subjects_displayed",
    rf"SELECT id, coalesce(nullif(regexp_replace({Q.strip('subject')}, '(?i)^(?:[{Q.WS}]*(?:re|fw|fwd):[{Q.WS}]*)+', ''), ''), '(no subject)') AS subject_shown FROM fx_emails",
)
def _(t):
    return t.fx_emails.select("id", T.strip_subject(F.col("subject")).alias("subject_shown"))


@query(
    "conversation_roots",
    """SELECT doc_id, CASE WHEN strlen(text) >= 22 THEN lower(substr(hex(CAST(encode(text) AS BLOB)), 1, 44)) END AS conv_root
       FROM documents""",
)
def _(t):
    index = F.base64(F.encode(F.col("text"), "UTF-8"))
    index = F.regexp_replace(index, r"\s", "")
    return t.documents.select("doc_id", T.conv_root(index).alias("conv_root"))


@query(
    "bodies_canonical",
    f"SELECT id, sha256(body_norm) AS body_hash, CAST(length(body_norm) AS INTEGER) AS norm_len FROM (SELECT id, {Q.body_norm('body_text')} AS body_norm FROM fx_emails) AS n",
)
def _(t):
    norm = t.fx_emails.select("id", T.canonical_body(F.col("body_text")).alias("body_norm"))
    return norm.select("id", T.body_hash(F.col("body_norm")).alias("body_hash"), F.length("body_norm").alias("norm_len"))


def _boilerplate_check() -> str:
    expr = "body_text"
    for pattern in boilerplate.patterns(quote="sql"):
        expr = f"regexp_replace({expr}, '{pattern}', '', 'gi')"
    tidy = Q.strip(r"regexp_replace(regexp_replace(cleaned, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
    return f"""SELECT id, md5(CASE WHEN cleaned <> body_text THEN {tidy} ELSE body_text END) AS body_md5,
       cleaned <> body_text AS boilerplate_stripped FROM (SELECT id, body_text, {expr} AS cleaned FROM fx_boilerplate) AS c"""


@query("boilerplate_stripped", _boilerplate_check())
def _(t):
    out = boilerplate.strip_boilerplate(t.fx_boilerplate)
    return out.select("id", F.md5(F.col("body_text").cast("binary")).alias("body_md5"), "boilerplate_stripped")


@query(
    "html_as_text",
    """SELECT page_id, md5(replace(regexp_replace(regexp_replace(html, '<br ?/?>', chr(10), 'g'), '<[^>]*(?:>|$)', '', 'g'), '>', '')) AS text_md5 FROM pages""",
)
def _(t):
    return t.pages.select("page_id", F.md5(T.html_to_text(F.col("html")).cast("binary")).alias("text_md5"))


@query("senders_normalized", f"SELECT id, {Q.fold('lower(from_addr)')} AS sender_key, md5({Q.fold('body_text')}) AS folded_md5 FROM fx_emails")
def _(t):
    return t.fx_emails.select(
        "id", T.norm_contact(F.col("from_addr")).alias("sender_key"), F.md5(T.fold_space(F.col("body_text")).cast("binary")).alias("folded_md5")
    )


@query(
    "cells_made_safe",
    r"""SELECT doc_id, md5(CASE WHEN substr(ltrim(text, ' '), 1, 1) IN ('=', '+', '-', '@') OR substr(text, 1, 1) IN (chr(9), chr(10), chr(13))
       THEN concat('''', text) ELSE text END) AS cell_md5 FROM (SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN concat(' =', text) ELSE text END AS text FROM documents) AS d""",
)
def _(t):
    text = F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit(" ="), "text")).otherwise(F.col("text"))
    return t.documents.select("doc_id", F.md5(T.safe_cell(text).cast("binary")).alias("cell_md5"))


@query(
    "paths_cleaned",
    r"""SELECT page_id, array_to_string(list_filter(list_transform(string_split(replace(concat('a\..', url), '\', '/'), '/'), lambda p: trim(p)), lambda p: p NOT IN ('', '.', '..')), '/') AS clean_path,
       coalesce(nullif(regexp_replace(string_split(url, '/')[-1], '[^\p{L}\p{N}._ ()\-]', '_', 'g'), ''), 'attachment') AS file_name FROM pages""",
)
def _(t):
    return t.pages.select(
        "page_id", T.clean_path(F.concat(F.lit("a\\.."), "url")).alias("clean_path"), T.safe_filename(F.col("url")).alias("file_name")
    )


@query(
    "snippets",
    f"""SELECT id, CASE WHEN length(f) > 160 THEN concat(regexp_replace(substr(f, 1, 160), '[{Q.WS}]+$', ''), '...') ELSE f END AS snippet
        FROM (SELECT id, {Q.fold('body_text')} AS f FROM fx_emails) AS x""",
)
def _(t):
    return t.fx_emails.select("id", T.snippet(F.col("body_text")).alias("snippet"))


@query(
    "quote_prefixes_stripped",
    rf"""SELECT doc_id, md5({Q.strip(r"regexp_replace(regexp_replace(q, '(?m)^[ \t]*>[ \t]?', '', 'g'), '(?m)[ \t\v\f\x{85}\x1c-\x1f\p{Z}]+$', '', 'g')")}) AS text_md5
        FROM (SELECT doc_id, replace(replace(concat('> ', replace(text, chr(10), concat(chr(10), ' > '))), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS q FROM documents) AS d""",
)
def _(t):
    quoted = F.concat(F.lit("> "), F.replace("text", F.lit("\n"), F.lit("\n > ")))
    return t.documents.select("doc_id", F.md5(T.strip_quote_prefix(quoted).cast("binary")).alias("text_md5"))


@query(
    "address_lists_split",
    f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, CASE WHEN contains(text, ';') THEN ';' ELSE ',' END), lambda p: {Q.strip('p')}), lambda p: p <> ''), '|') AS parts FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", F.array_join(T.split_addresses(F.col("text")), "|").alias("parts"))


_HEADED = """SELECT doc_id, concat(CASE n_chars % 7 WHEN 0 THEN '> From: ' WHEN 1 THEN '*Sent*: ' WHEN 2 THEN 'To : ' WHEN 3 THEN '抄送：' WHEN 4 THEN '主题: ' WHEN 5 THEN '发 件 人：' ELSE 'note ' END, source) AS line FROM documents"""


@query(
    "header_lines_classified",
    rf"""SELECT doc_id, CASE
        WHEN regexp_matches(line, '(?i)^[\s>*]*(?:发[\s*]*件[\s*]*人|寄[\s*]*件[\s*]*[人者]|from)[\s*]*[:：]') THEN 'from'
        WHEN regexp_matches(line, '(?i)^[\s>*]*(?:sent|date|日期|时间)[\s*]*[:：]') THEN 'sent'
        WHEN regexp_matches(line, '(?i)^[\s>*]*to[\s*]*[:：]') THEN 'to'
        WHEN regexp_matches(line, '(?i)^[\s>*]*(?:cc|抄送)[\s*]*[:：]') THEN 'cc'
        WHEN regexp_matches(line, '(?i)^[\s>*]*(?:subject|主题)[\s*]*[:：]') THEN 'subject' END AS kind
        FROM ({_HEADED}) AS h""",
)
def _(t):
    lead = F.lit("note ")
    for digit, text in {0: "> From: ", 1: "*Sent*: ", 2: "To : ", 3: "抄送：", 4: "主题: ", 5: "发 件 人："}.items():
        lead = F.when(F.col("n_chars") % 7 == digit, text).otherwise(lead)
    return t.documents.select("doc_id", T.header_kind(F.concat(lead, "source")).alias("kind"))


@query(
    "leading_dates",
    """SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN '1 Jan 2024 10:00' END AS embedded_date FROM documents""",
)
def _(t):
    body = F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("From: a\n> Date: 1 Jan 2024 10:00\n"), "text")).otherwise(F.col("text"))
    return t.documents.select("doc_id", T.leading_date(body).alias("embedded_date"))


# ---- fingerprints

_NORM = f"norm AS MATERIALIZED (SELECT id, {Q.body_norm('body_text')} AS body_norm FROM fx_emails)"


@query(
    "shingles",
    f"WITH {_NORM}, sh AS ({Q.shingle_rows('norm')}) SELECT id, count(*) AS n_shingles, CAST(sum({Q.hash28('shingle')}) AS BIGINT) AS hash_sum FROM sh GROUP BY id",
)
def _(t):
    norm = t.fx_emails.select("id", T.canonical_body(F.col("body_text")).alias("body_norm"))
    rows = norm.select("id", F.explode(P.shingles(F.col("body_norm"))).alias("shingle"))
    return rows.groupBy("id").agg(F.count("*").alias("n_shingles"), F.sum(P.hash28(F.col("shingle"))).alias("hash_sum"))


@query(
    "shingle_sets",
    f"""WITH {_NORM}, sh AS ({Q.shingle_rows('norm')}), h AS (SELECT DISTINCT id, {Q.hash28('shingle')} AS h FROM sh)
        SELECT id, count(*) AS n_hashes, CAST(sum(h) AS BIGINT) AS hash_sum FROM h GROUP BY id""",
)
def _(t):
    norm = t.fx_emails.select("id", T.canonical_body(F.col("body_text")).alias("body_norm"))
    sets = norm.select("id", P.shingle_hashes(F.col("body_norm")).alias("hashes")).filter(F.size("hashes") > 0)
    return sets.select(
        "id", F.size("hashes").cast("long").alias("n_hashes"), F.aggregate("hashes", F.lit(0).cast("long"), lambda acc, h: acc + h).alias("hash_sum")
    )


_SIGS = f"""sh AS ({Q.shingle_rows('norm')}), h AS (SELECT DISTINCT id, {Q.hash28('shingle')} AS h FROM sh),
       sig AS MATERIALIZED (SELECT id, {Q.signature_columns()} FROM h GROUP BY id)"""


def _fingerprints(t):
    norm = t.fx_emails.select("id", T.canonical_body(F.col("body_text")).alias("body_norm"))
    return P.with_fingerprints(norm)


@query(
    "minhash_signatures",
    f"WITH {_NORM}, {_SIGS} SELECT id, md5(concat_ws(',', {', '.join(Q.SIG_NAMES)})) AS signature_md5 FROM sig",
)
def _(t):
    sig = _fingerprints(t).filter(F.col("signature").isNotNull())
    return sig.select("id", F.md5(F.concat_ws(",", F.transform("signature", lambda v: v.cast("string"))).cast("binary")).alias("signature_md5"))


@query(
    "lsh_band_keys",
    f"""WITH {_NORM}, {_SIGS} SELECT id, unnest([{', '.join(Q.band_keys())}]) AS band_key FROM sig""",
)
def _(t):
    return _fingerprints(t).select("id", F.explode(P.lsh_keys(F.col("signature"))).alias("band_key"))


@query(
    "neighbour_jaccard",
    f"""WITH {_NORM}, {_SIGS} SELECT a.id AS a_id, b.id AS b_id, ({' + '.join(f'CAST(a.s{i} = b.s{i} AS INTEGER)' for i in range(64))}) / 64.0 AS jaccard
        FROM sig a JOIN sig b ON b.id = a.id + 5""",
)
def _(t):
    sig = materialise(_fingerprints(t).filter(F.col("signature").isNotNull()).select("id", "signature"))
    a = sig.select(F.col("id").alias("a_id"), F.col("signature").alias("sa"))
    b = sig.select(F.col("id").alias("b_id"), F.col("signature").alias("sb"))
    return a.join(b, F.col("b_id") == F.col("a_id") + 5).select("a_id", "b_id", P.minhash_jaccard(F.col("sa"), F.col("sb")).alias("jaccard"))


@query(
    "neighbour_containment",
    f"""WITH {_NORM}, sh AS ({Q.shingle_rows('norm')}), h AS MATERIALIZED (SELECT DISTINCT id, {Q.hash28('shingle')} AS h FROM sh),
        n AS (SELECT id, count(*) AS n FROM h GROUP BY id), inter AS (SELECT a.id AS a_id, b.id AS b_id, count(*) AS c FROM h a JOIN h b ON b.id = a.id + 5 AND a.h = b.h GROUP BY 1, 2)
        SELECT na.id AS a_id, nb.id AS b_id, CASE WHEN least(na.n, nb.n) < 5 THEN 0.0 ELSE round(coalesce(c, 0) / least(na.n, nb.n), 6) END AS contained
        FROM n na JOIN n nb ON nb.id = na.id + 5 LEFT JOIN inter ON inter.a_id = na.id AND inter.b_id = nb.id""",
)
def _(t):
    norm = t.fx_emails.select("id", P.shingle_hashes(T.canonical_body(F.col("body_text"))).alias("h")).filter(F.size("h") > 0)
    norm = materialise(norm)
    a = norm.select(F.col("id").alias("a_id"), F.col("h").alias("ha"))
    b = norm.select(F.col("id").alias("b_id"), F.col("h").alias("hb"))
    return a.join(b, F.col("b_id") == F.col("a_id") + 5).select(
        "a_id", "b_id", F.round(P.containment(F.col("ha"), F.col("hb")), 6).alias("contained")
    )


@query(
    "fingerprints_refreshed",
    f"""WITH norm AS MATERIALIZED (SELECT id, {Q.body_norm("CASE WHEN id % 7 = 0 THEN concat(body_text, ' edited once more') ELSE body_text END")} AS body_norm, {Q.body_norm('body_text')} AS old_norm FROM fx_emails),
        {_SIGS} SELECT norm.id, sha256(body_norm) AS body_hash, body_norm <> old_norm AS recomputed, md5(concat_ws(',', {', '.join(Q.SIG_NAMES)})) AS signature_md5
        FROM norm LEFT JOIN sig ON sig.id = norm.id""",
)
def _(t):
    from ..operators.dedup import fingerprint_table, refresh_fingerprints

    emails = t.fx_emails
    old = fingerprint_table(emails)
    edited = F.when(F.col("id") % 7 == 0, F.concat("body_text", F.lit(" edited once more"))).otherwise(F.col("body_text"))
    now = refresh_fingerprints(emails.withColumn("body_text", edited), old)
    joined = F.concat_ws(",", F.transform(F.coalesce("signature", F.array().cast("array<bigint>")), lambda v: v.cast("string")))
    return now.select("id", "body_hash", "recomputed", F.md5(joined.cast("binary")).alias("signature_md5"))


@query("body_hashes", "SELECT id, sha256(body_text) AS body_hash FROM fx_emails")
def _(t):
    return t.fx_emails.select("id", T.body_hash(F.col("body_text")).alias("body_hash"))


@query(
    "neighbour_dates_close",
    "SELECT a.id AS a_id, coalesce(abs(epoch(a.date_utc) - epoch(b.date_utc)) <= 600, false) AS dates_close FROM fx_emails a JOIN fx_emails b ON b.id = a.id + 5",
)
def _(t):
    a = t.fx_emails.select(F.col("id").alias("a_id"), F.col("date_utc").alias("da"))
    b = t.fx_emails.select((F.col("id") - 5).alias("a_id"), F.col("date_utc").alias("db"))
    return a.join(b, "a_id").select("a_id", T.dates_close(F.col("da"), F.col("db")).alias("dates_close"))


# ---- dates

def _utc(tz: str) -> str:
    return f"""CASE d.id % 4
   WHEN 0 THEN try_strptime(date_raw, '%d/%m/%Y %H:%M') AT TIME ZONE {tz} AT TIME ZONE 'UTC'
   WHEN 1 THEN try_strptime(substr(date_raw, 1, 19), '%Y-%m-%dT%H:%M:%S') - INTERVAL 8 HOUR
   WHEN 2 THEN try_strptime(regexp_replace(date_raw, ' -0500$', ''), '%d %b %Y %H:%M:%S') + INTERVAL 5 HOUR END"""


@query("dates_parsed", f"SELECT d.id, strftime({_utc('default_tz')}, '{STAMP}') AS utc FROM fx_dates d JOIN fx_cases c ON c.id = d.case_id")
def _(t):
    zones = t.fx_cases.select(F.col("id").alias("case_id"), "default_tz")
    return D.with_utc(t.fx_dates.join(zones, "case_id")).select("id", stamp("date_utc").alias("utc"))


@query(
    "dates_rederived",
    f"""SELECT id, strftime(fresh, '{STAMP}') AS utc, fresh IS DISTINCT FROM stored AS changed FROM (
        SELECT d.id, {_utc('default_tz')} AS fresh, {_utc("'UTC'")} AS stored FROM fx_dates d JOIN fx_cases c ON c.id = d.case_id) AS x""",
)
def _(t):
    stored = t.fx_dates.withColumn("date_utc", D.parse_date(F.col("date_raw"), F.lit("UTC")))
    return D.rederive_dates(stored, t.fx_cases).select("id", stamp("date_utc").alias("utc"), "changed")


@query(
    "dates_repaired",
    """SELECT id, strftime(CASE WHEN date_utc IS NOT NULL THEN date_utc WHEN id % 2 = 1 THEN TIMESTAMP '2024-01-05 09:30:00' AT TIME ZONE default_tz AT TIME ZONE 'UTC' END, '%Y-%m-%d %H:%M:%S') AS utc,
       date_utc IS NULL AND id % 2 = 1 AS repaired FROM (SELECT e.id, e.date_utc, c.default_tz FROM fx_emails e JOIN fx_cases c ON c.id = e.case_id) AS x""",
)
def _(t):
    body = F.when(F.col("id") % 2 == 1, F.concat(F.lit("Sent: 05/01/2024 09:30\n"), "body_text")).otherwise(F.col("body_text"))
    emails = t.fx_emails.withColumn("body_text", body).withColumn("date_raw", F.lit(None).cast("string"))
    return D.repair_dates(emails, t.fx_cases).select("id", stamp("date_utc").alias("utc"), "repaired")


@query(
    "entry_dates_checked",
    f"""SELECT event_id, CASE WHEN mo > 12 THEN '{D.ENTRY_ERRORS['month']}' WHEN try_cast(format('2023-{{:02d}}-{{:02d}}', mo, dd) AS DATE) IS NULL THEN '{D.ENTRY_ERRORS['calendar']}' END AS error,
        CASE WHEN mo <= 12 AND try_cast(format('2023-{{:02d}}-{{:02d}}', mo, dd) AS DATE) IS NOT NULL THEN format('2023-{{:02d}}-{{:02d}}T{{:02d}}:05:00+08:00', mo, dd, hh) END AS iso
        FROM (SELECT event_id, 1 + event_id % 13 AS mo, 1 + user_id % 31 AS dd, CAST(extract(hour FROM ts) AS BIGINT) AS hh FROM events) AS e""",
)
def _(t):
    mo, dd = 1 + F.col("event_id") % 13, 1 + F.col("user_id") % 31
    raw = F.format_string("%d/%d/2023 %d:05 GMT+8", dd, mo, F.hour("ts"))
    return D.parse_entry_dates(t.events.select("event_id", raw.alias("raw"))).select("event_id", "error", "iso")


@query(
    "dates_shown_locally",
    """SELECT id, concat(strftime(local, '%d/%m/%Y %H:%M'), ' GMT', CASE WHEN off < 0 THEN '-' ELSE '+' END, lpad(CAST(abs(off) // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(abs(off) % 60 AS VARCHAR), 2, '0')) AS shown
       FROM (SELECT id, local, CAST((epoch(local) - epoch(date_utc)) / 60 AS BIGINT) AS off FROM (
         SELECT e.id, e.date_utc, e.date_utc AT TIME ZONE 'UTC' AT TIME ZONE c.default_tz AS local FROM fx_emails e JOIN fx_cases c ON c.id = e.case_id WHERE e.date_utc IS NOT NULL) AS x) AS y""",
)
def _(t):
    zones = t.fx_cases.select(F.col("id").alias("case_id"), "default_tz")
    dated = t.fx_emails.filter(F.col("date_utc").isNotNull()).join(zones, "case_id")
    return dated.select("id", D.format_local(F.col("date_utc"), F.col("default_tz")).alias("shown"))


@query(
    "parse_quality",
    """SELECT id, array_to_string(list_filter([CASE WHEN date_utc IS NULL THEN 'missing_date' END, CASE WHEN message_id IS NULL THEN 'missing_message_id' END], lambda f: f IS NOT NULL), ',') AS flags,
       CASE WHEN date_utc IS NULL THEN 'low' WHEN message_id IS NULL THEN 'med' ELSE 'high' END AS parse_confidence FROM fx_emails""",
)
def _(t):
    emails = t.fx_emails.withColumn("date_raw", stamp("date_utc"))
    return D.parse_quality(emails).select("id", F.array_join("date_flags", ",").alias("flags"), "parse_confidence")


@query("zones_checked", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'Europe/Paris' WHEN lang = 'de' THEN 'UTC' ELSE 'UTC' END AS zone FROM documents")
def _(t):
    zone = F.when(F.col("lang") == "en", "Europe/Paris").when(F.col("lang") == "de", F.lit(None)).otherwise(F.concat(F.lit("Nowhere/"), "lang"))
    return t.documents.select("doc_id", D.valid_zone(zone).alias("zone"))


@query("lists_deduplicated", "SELECT doc_id, array_to_string(list_transform(list_sort(list_distinct(ws)), lambda w: w), ' ') AS kept FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents) AS d")
def _(t):
    words = F.array_distinct(F.split("text", " "))
    return t.documents.select("doc_id", F.array_join(F.array_sort(words), " ").alias("kept"))
