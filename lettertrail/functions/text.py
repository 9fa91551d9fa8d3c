"""Scalar text columns: normalisation, address lists, header lines, safe cells.

Everything is a native column expression except NFKC folding, which Spark has no builtin for; that one
goes through an Arrow UDF and only sees rows holding characters NFKC can change.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Fixed value: the characters str.split()/str.strip() treat as whitespace, as a regex class body.
SPACE = r"\t-\r\x1C-\x20\x85\p{Z}"

# Reply and forward markers removed from a thread's subject key.
REPLY_PREFIXES = ("re", "fw", "fwd", "回复", "回覆", "答复", "答覆", "转发", "轉發")

# Zero-width characters, and typographic quote/dash variants with their ASCII form.
ZERO_WIDTH = "​‌‍⁠﻿"
QUOTE_DASH = {
    "‘": "'", "’": "'", "′": "'", "`": "'",
    "“": '"', "”": '"', "″": '"',
    "–": "-", "—": "-", "−": "-",
}

# Mail-client footers dropped from a body before comparison.
MOBILE_FOOTERS = ("sent from my", "get outlook for", "sent from mail for windows")

# Characters NFKC leaves alone and that never combine; a text made only of these and the first 160 skips the UDF.
NFKC_STABLE = r"¡-§©«-®°±¶·»¿-ıĴ-ľŁ-ňŊ-žа-яА-Я–—‘-‟、。一-鿿"


def bind(col: Column, body) -> Column:
    """Evaluate `col` once and hand it to `body`: an outer expression used inside a lambda is otherwise
    recomputed for every element."""
    return F.get(F.transform(F.array(col), body), 0)


def pin(col: Column) -> Column:
    """`col`, evaluated once where it is written: the optimiser will not copy it into later expressions (a
    Python UDF whose argument holds a lambda is otherwise left unplanned)."""
    return F.when(F.spark_partition_id() >= 0, col)


def strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^[{SPACE}]+|[{SPACE}]+$", "")


def fold_space(col: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(col, F.lit("")), f"[{SPACE}]+", " "))


def norm_contact(col: Column) -> Column:
    return fold_space(F.lower(col))


def unix_lines(col: Column) -> Column:
    return F.regexp_replace(col, r"\r\n?", "\n")


def norm_msgid(col: Column) -> Column:
    bare = F.regexp_replace(strip(col), "^[<>]+|[<>]+$", "")
    return F.nullif(F.lower(strip(bare)), F.lit(""))


def norm_subject(col: Column) -> Column:
    folded = F.lower(F.replace(strip(F.coalesce(col, F.lit(""))), F.lit("："), F.lit(":")))
    bare = F.regexp_replace(folded, f"^(?:(?:{'|'.join(REPLY_PREFIXES)}):[{SPACE}]*)+", "")
    return F.coalesce(F.nullif(fold_space(bare), F.lit("")), F.lit("no-subject"))


def strip_subject(col: Column) -> Column:
    bare = strip(F.regexp_replace(col, f"^(?i:[{SPACE}]*(?:re|fw|fwd):[{SPACE}]*)+", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("(no subject)"))


def conv_root(col: Column) -> Column:
    raw = F.try_to_binary(strip(col), F.lit("base64"))
    return F.when(F.octet_length(raw) >= 22, F.lower(F.hex(F.substring(raw, 1, 22))))


def _fold_compatibility(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


# Marked non-deterministic so that the optimiser evaluates it once and does not copy it into later expressions.
_nfkc = pandas_udf(_fold_compatibility, StringType()).asNondeterministic()


def nfkc(col: Column) -> Column:
    # one range turns most characters away; a class is otherwise searched range by range for each of them
    risky = F.when(col.rlike(rf"[[^\x00-\x9F]&&[^{NFKC_STABLE}]]"), col)
    return F.coalesce(_nfkc(risky), col)


def canonical_body_native(col: Column) -> Column:
    """`canonical_body` for text already in NFKC form: fully JVM-side."""
    text = F.coalesce(col, F.lit(""))
    source = "".join(QUOTE_DASH) + ZERO_WIDTH
    text = F.translate(text, source, "".join(QUOTE_DASH.values()))
    text = F.regexp_replace(text, r"(?dm)^--[ \t]*$[\s\S]*", "")
    footers = "|".join(rf"{f}\b" for f in MOBILE_FOOTERS)
    text = F.regexp_replace(text, rf"(?dim)^[ \t>]*(?:{footers}).*$", "")
    return fold_space(F.lower(text))


def canonical_body(col: Column) -> Column:
    return canonical_body_native(nfkc(col))


def html_to_text(col: Column) -> Column:
    breaks = F.regexp_replace(col, "<br ?/?>", "\n")
    breaks = F.regexp_replace(breaks, "<[^>]*(?:>|$)", "")
    return F.replace(breaks, F.lit(">"), F.lit(""))


def safe_cell(col: Column) -> Column:
    """Text a spreadsheet will not run as a formula."""
    risky = F.substring(F.ltrim(col), 1, 1).isin("=", "+", "-", "@") | F.substring(col, 1, 1).isin("\t", "\r", "\n")
    return F.when(risky, F.concat(F.lit("'"), col)).otherwise(col)


def snippet(col: Column, limit: int = 160) -> Column:
    folded = fold_space(col)
    cut = F.concat(F.regexp_replace(F.substring(folded, 1, limit), f"[{SPACE}]+$", ""), F.lit("..."))
    return F.when(F.length(folded) > limit, cut).otherwise(folded)


def clean_path(col: Column) -> Column:
    """Relative display path: forward slashes, no empty, `.` or `..` segments."""
    parts = F.split(F.replace(col, F.lit("\\"), F.lit("/")), "/")
    kept = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: ~p.isin("", ".", ".."))
    return F.array_join(kept, "/")


def safe_filename(col: Column, default: str = "attachment") -> Column:
    base = F.element_at(F.split(F.replace(col, F.lit("\\"), F.lit("/")), "/"), -1)
    cleaned = strip(F.regexp_replace(base, r"[^\p{L}\p{N}._ ()\-]", "_"))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(default))


def strip_quote_prefix(col: Column) -> Column:
    lines = F.regexp_replace(unix_lines(col), f"(?dm)^[{SPACE}&&[^\\n]]*>[{SPACE}&&[^\\n]]?", "")
    return strip(F.regexp_replace(lines, f"(?dm)[{SPACE}&&[^\\n]]+$", ""))


def split_addresses(col: Column) -> Column:
    text = F.coalesce(col, F.lit(""))
    pieces = F.when(F.contains(text, F.lit(";")), F.split(text, ";")).otherwise(F.split(text, ","))
    return F.filter(F.transform(pieces, strip), lambda p: p != "")


# Header labels, Western and Chinese, by the field they introduce.
HEADER_LABELS = {
    "from": ("发件人", "寄件人", "寄件者", "from"),
    "sent": ("发送时间", "发送日期", "时间", "日期", "sent", "date"),
    "to": ("收件人", "收件者", "to"),
    "cc": ("抄送人", "抄送", "cc"),
    "subject": ("主题", "主旨", "subject"),
}


def _label_pattern(kind: str) -> str:
    spaced = ("[\\s*]*".join(label) for label in HEADER_LABELS[kind])
    return rf"(?i)^[\s>*]*(?:{'|'.join(spaced)})[\s*]*[:：]"


def header_kind(col: Column) -> Column:
    line = F.replace(col, F.lit("　"), F.lit(" "))
    kind = F.lit(None).cast("string")
    for name in reversed(list(HEADER_LABELS)):
        kind = F.when(line.rlike(_label_pattern(name)), F.lit(name)).otherwise(kind)
    return kind


def header_value(col: Column) -> Column:
    return strip(F.regexp_extract(F.replace(col, F.lit("　"), F.lit(" ")), r"^[^:：]*[:：][\s*]*(.*)$", 1))


def leading_date(col: Column) -> Column:
    """Value of the first date header of a body."""
    head = F.transform(F.split(unix_lines(col), "\n"), strip)
    dated = F.filter(head, lambda line: header_kind(line) == "sent")
    return F.when(F.size(dated) > 0, header_value(F.get(dated, 0)))


def body_hash(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def dates_close(a: Column, b: Column, seconds: int = 600) -> Column:
    return F.coalesce(F.abs(F.unix_micros(a) - F.unix_micros(b)) <= seconds * 1_000_000, F.lit(False))


def round_even(value: Column, digits: int) -> Column:
    """Half to even on the scaled value, as SQL's round_even does; `bround` rounds the shortest decimal form instead."""
    return F.rint(value * 10.0**digits) / 10.0**digits
