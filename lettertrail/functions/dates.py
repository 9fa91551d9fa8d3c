"""Date text to UTC instants, as native columns.

Each accepted shape is one anchored pattern whose groups are rewritten to `y|mon|d|h|m|s|zone|ampm`; the
first shape that yields a real calendar date wins. Dates without a zone are read in the row's own zone. AM and PM after a
clock time are read as such in every shape.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, bind, leading_date, strip

# Month and weekday names, zone abbreviations and their hours, Chinese month names.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
ZONE_HOURS = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "AST": -4, "ADT": -3, "EST": -5, "EDT": -4,
    "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}
LOCAL_ZONE_HOURS = {"SGT": 8}
CHINESE_MONTHS = ("一月", "二月", "三月", "四月", "五月", "六月", "七月", "八月", "九月", "十月", "十一月", "十二月")

_LONG = "|".join(MONTHS)
_MON = "|".join(MONTHS) + "|" + "|".join(m[:3] for m in MONTHS)
_DAY3 = "|".join(d[:3] for d in WEEKDAYS)
_DAYS = "|".join(WEEKDAYS)
_CLOCK = r"(\d{1,2})[:.](\d{2})(?:[:.](\d{2}))?"
_HALF = r"(?: ?(AM|PM)\b)?"
_ZONE = r"(?: ?([+-]\d{4})| ([A-Za-z]\S*))?(?: .*)?"
_RFC_LEAD = rf"(?i)^(?:[^ ,]*, ?|(?:{_DAY3}) )?"
_CJK_HALF = "上午|下午"

# pattern, rewrite to y|mon|d|h|m|s|zone|ampm
_MAIL_SHAPES = (
    (rf"{_RFC_LEAD}(\d{{1,2}}),? ({_MON}),? (\d{{4}}|\d{{2}}),? {_CLOCK}{_HALF}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$8$9|$7"),
    (rf"{_RFC_LEAD}({_MON}) (\d{{1,2}}),? (\d{{4}}|\d{{2}}),? {_CLOCK}{_HALF}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$8$9|$7"),
    (rf"{_RFC_LEAD}({_MON}) (\d{{1,2}}) {_CLOCK}(?: [A-Z]+)? (\d{{4}})$", "$6|$1|$2|$3|$4|$5||"),
)
_ISO_SHAPES = (
    (
        r"^(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2}):?(\d{2})(?::?(\d{2}(?:[.,]\d{1,6})?)\d*)?)?(Z|[+-]\d{2}:?\d{2})?$",
        "$1|$2|$3|$4|$5|$6|$7|",
    ),
)
_SPOKEN_SHAPES = (
    (rf"(?i)^(?:(?:{_DAY3}|{_DAYS}), )?({_MON}) (\d{{1,2}}), (\d{{4}}) at (\d{{1,2}}):(\d{{1,2}}) (AM|PM)$", "$3|$1|$2|$4|$5|||$6"),
    (rf"(?i)^(?:(?:{_DAYS}), )?(\d{{1,2}}) ({_LONG}) (\d{{4}}) at (\d{{1,2}}):(\d{{1,2}})(?::(\d{{1,2}}))? (AM|PM)$", "$3|$2|$1|$4|$5|$6||$7"),
    (rf"(?i)^(?:{_DAYS}), (\d{{1,2}}) ({_LONG}) (\d{{4}}) at (\d{{1,2}}):(\d{{1,2}})$", "$3|$2|$1|$4|$5|||"),
    (rf"(?i)^(?:{_DAYS}) (\d{{1,2}}) ({_LONG}) (\d{{4}}) (\d{{1,2}}):(\d{{1,2}})$", "$3|$2|$1|$4|$5|||"),
)
# day first, except a full year with AM/PM; the other reading is tried when that is no date
_SLASH_SHAPES = (
    (r"(?i)^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{1,2}) (AM|PM)$", "$3|$1|$2|$4|$5|||$6"),
    (r"(?i)^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2}) (\d{1,2}):(\d{1,2})(?: (AM|PM))?$", "$3|$2|$1|$4|$5|||$6"),
)
_SLASH_SWAPPED = (
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{1,2})$", "$3|$1|$2|$4|$5|||"),
    (r"(?i)^(\d{1,2})/(\d{1,2})/(\d{2}) (\d{1,2}):(\d{1,2})(?: (AM|PM))?$", "$3|$1|$2|$4|$5|||$6"),
)
_CJK_SHAPES = (
    (
        r"^.*?(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日(?:\s*\([^)]*\)|\s*周.)?\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*"
        rf"({_CJK_HALF})?.*$",
        "$1|$2|$3|$4|$5|$6||$7",
    ),
    (
        rf"^.*?({'|'.join(sorted(CHINESE_MONTHS, key=len, reverse=True))})\s+(\d{{1,2}}),\s*(\d{{4}})\s+"
        rf"(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?\s*({_CJK_HALF})?.*$",
        "$3|$1|$2|$4|$5|$6||$7",
    ),
)


def _shape(text: Column, pattern: str, rewrite: str) -> Column:
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, rewrite))


def _int(col: Column) -> Column:
    return col.try_cast("int")


def _month(col: Column) -> Column:
    short = "".join(m[:3].lower() for m in MONTHS)
    named = ((F.instr(F.lit(short), F.lower(F.substring(col, 1, 3))) + 2) / 3).cast("int")
    chinese = F.array_position(F.array(*map(F.lit, CHINESE_MONTHS)), col).cast("int")
    return F.when(chinese > 0, chinese).when(col.rlike(r"^\d+$"), _int(col)).otherwise(named)


def _offset_minutes(zone: Column) -> Column:
    """Minutes east of UTC; null for a zone that does not say (including `-0000`)."""
    table = F.create_map(*[F.lit(v) for k, h in ZONE_HOURS.items() for v in (k, h * 60)])
    digits = F.replace(F.substring(zone, 2, 5), F.lit(":"), F.lit(""))
    minutes = _int(F.substring(digits, 1, 2)) * 60 + _int(F.substring(digits, 3, 2))
    signed = F.when(F.substring(zone, 1, 1) == "-", -minutes).otherwise(minutes)
    return F.when(zone == "-0000", None).when(zone.rlike(r"^[+-]\d{2}:?\d{2}$"), signed).otherwise(table[F.upper(zone)])


def _instant(p: Column, tz: Column) -> Column:
    year = _int(p[0])
    year = F.when(F.length(p[0]) > 2, year).when(year > 68, year + 1900).otherwise(year + 2000)
    hour, half = F.coalesce(_int(p[3]), F.lit(0)), F.upper(p[7])
    hour = (
        F.when((half == "PM") & hour.between(1, 12), hour % 12 + 12)
        .when((half == "AM") & hour.between(1, 12), hour % 12)
        .when(half.isin("PM", "AM"), F.lit(None))
        .when((half == "下午") & (hour < 12), hour + 12)
        .when((half == "上午") & (hour == 12), F.lit(0))
        .otherwise(hour)
    )
    second = F.coalesce(F.replace(p[5], F.lit(","), F.lit(".")).try_cast("decimal(16,6)"), F.lit(0).cast("decimal(16,6)"))
    local = F.try_make_timestamp(year, _month(p[1]), _int(p[2]), hour, F.coalesce(_int(p[4]), F.lit(0)), second)
    offset = _offset_minutes(p[6])
    fixed = F.timestamp_micros(F.unix_micros(local) - offset.cast("long") * 60_000_000)
    return F.when(offset.isNotNull(), fixed).otherwise(F.to_utc_timestamp(local, tz))


def valid_zone(tz: Column) -> Column:
    """The zone when it names a known one, else UTC."""
    return F.when(tz.isin(*sorted(zoneinfo.available_timezones())), tz).otherwise(F.lit("UTC"))


def parse_date(raw: Column, tz: Column) -> Column:
    """UTC instant for a raw date, or null. `tz` applies to dates that carry no zone."""
    text = strip(F.regexp_replace(raw, f"[{SPACE}]+", " "))
    text = F.when(F.length(text) > 0, text)
    local = F.regexp_extract(text, rf" ({'|'.join(LOCAL_ZONE_HOURS)})$", 1)
    core = F.when(local != "", F.regexp_replace(text, r" [A-Z]{2,5}$", "")).otherwise(text)
    fixed_zone = F.create_map(*[F.lit(v) for k, h in LOCAL_ZONE_HOURS.items() for v in (k, f"{h:+03d}:00")])
    zone = F.when(local != "", fixed_zone[local]).otherwise(tz)

    def readings(given: Column) -> Column:
        text = given["text"]

        def when_like(hint: str, shapes: tuple) -> Column:
            return F.when(text.rlike(hint), F.coalesce(*[_shape(text, *shape) for shape in shapes]))

        hit = F.coalesce(
            when_like("[年月]", _CJK_SHAPES), when_like(r"^\d{4}[-\d]", _ISO_SHAPES), when_like(r"^\d{1,2}/", _SLASH_SHAPES),
            when_like(r"[A-Za-z]{3}.*\d[:.]\d\d", _MAIL_SHAPES), when_like(r"[A-Za-z]{3}.*\d:\d", _SPOKEN_SHAPES),
        )
        parts = F.transform(F.array_compact(F.array(hit, when_like(r"^\d{1,2}/", _SLASH_SWAPPED))), lambda h: F.split(h, r"\|"))
        return F.get(F.array_compact(F.transform(parts, lambda p: _instant(p, given["zone"]))), 0)

    return bind(F.struct(core.alias("text"), zone.alias("zone")), readings)


def with_utc(df: DataFrame, raw: str = "date_raw", tz: str = "default_tz", out: str = "date_utc") -> DataFrame:
    return df.withColumn(out, parse_date(F.col(raw), valid_zone(F.col(tz))))


def rederive_dates(emails: DataFrame, cases: DataFrame) -> DataFrame:
    """Recompute every instant in its case's current zone; adds `changed`. Unparseable rows keep theirs."""
    joined = emails.join(cases.select(F.col("id").alias("case_id"), "default_tz"), "case_id")
    fresh = parse_date(F.col("date_raw"), valid_zone(F.col("default_tz")))
    return (
        joined.withColumn("_new", F.coalesce(fresh, F.col("date_utc")))
        .withColumn("changed", ~F.col("_new").eqNullSafe(F.col("date_utc")))
        .withColumn("date_utc", F.col("_new"))
        .drop("_new", "default_tz")
    )


def repair_dates(emails: DataFrame, cases: DataFrame) -> DataFrame:
    """Fill missing instants from the raw date, else the first date header in the body."""
    joined = emails.join(cases.select(F.col("id").alias("case_id"), "default_tz"), "case_id")
    raw = F.coalesce(F.nullif(F.col("date_raw"), F.lit("")), leading_date(F.col("body_text")))
    found = parse_date(raw, valid_zone(F.col("default_tz")))
    repaired = F.col("date_utc").isNull() & found.isNotNull()
    return (
        joined.withColumn("repaired", repaired)
        .withColumn("_raw", F.when(repaired, raw).otherwise(F.col("date_raw")))
        .withColumn("date_utc", F.coalesce(F.col("date_utc"), found))
        .withColumn("date_raw", F.col("_raw"))
        .drop("_raw", "default_tz")
    )


# The accepted manual entry and the message for each way it can be wrong.
ENTRY = r"(?i)^(\d{1,2})/(\d{1,2})/(\d{4})[ T](\d{1,2}):(\d{2})(?:\s*GMT\s*([+-])\s*(\d{1,2})(?::?(\d{2}))?)?$"
ENTRY_ERRORS = {
    "shape": "Enter the date as DD/MM/YYYY HH:MM, or leave it blank.",
    "month": "Month must be between 01 and 12.",
    "day": "Day must be between 01 and 31.",
    "hour": "Hour must be between 00 and 23.",
    "minute": "Minutes must be between 00 and 59.",
    "calendar": "That date does not exist on the calendar.",
    "offset": "GMT offset is out of range.",
}


def parse_entry_dates(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Check a hand-typed date; adds `iso` (null when blank or wrong) and `error` (null when fine)."""
    text = strip(F.col(raw))
    part = [_int(F.nullif(F.regexp_extract(text, ENTRY, g), F.lit(""))) for g in range(1, 9)]
    day, month, year, hour, minute, off_h, off_m = part[0], part[1], part[2], part[3], part[4], part[6], part[7]
    sign = F.regexp_extract(text, ENTRY, 6)
    off_m = F.coalesce(off_m, F.lit(0))
    problem = (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("string"))
        .when(~text.rlike(ENTRY), ENTRY_ERRORS["shape"])
        .when(~month.between(1, 12), ENTRY_ERRORS["month"])
        .when(~day.between(1, 31), ENTRY_ERRORS["day"])
        .when(hour > 23, ENTRY_ERRORS["hour"])
        .when(minute > 59, ENTRY_ERRORS["minute"])
        .when(F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")).isNull(), ENTRY_ERRORS["calendar"])
        .when((sign != "") & ((off_h > 14) | (off_m > 59)), ENTRY_ERRORS["offset"])
    )
    stamp = F.format_string("%04d-%02d-%02dT%02d:%02d:00", year, month, day, hour, minute)
    zone = F.when(sign != "", F.format_string("%s%02d:%02d", sign, off_h, off_m)).otherwise(F.lit(""))
    return df.withColumn("error", problem).withColumn(
        "iso", F.when(problem.isNull() & (text != ""), F.concat(stamp, zone))
    )


def format_local(ts: Column, tz: Column) -> Column:
    """`DD/MM/YYYY HH:MM GMT±HH:MM` on the wall clock of `tz`."""
    local = F.from_utc_timestamp(ts, tz)
    minutes = F.round((F.unix_micros(local) - F.unix_micros(ts)) / 60_000_000).cast("int")
    size = F.abs(minutes)
    sign = F.when(minutes < 0, "-").otherwise("+")
    offset = F.concat(sign, F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0"))
    return F.concat(F.date_format(local, "dd/MM/yyyy HH:mm"), F.lit(" GMT"), offset)


def date_flags(raw: Column, utc: Column, message_id: Column) -> Column:
    present = F.length(F.coalesce(raw, F.lit(""))) > 0
    return F.array_compact(
        F.array(
            F.when(~present, F.lit("missing_date")).when(utc.isNull(), F.lit("malformed_date")),
            F.when(F.coalesce(message_id, F.lit("")) == "", F.lit("missing_message_id")),
        )
    )


def parse_quality(emails: DataFrame) -> DataFrame:
    """Add `date_flags` and `parse_confidence` (low: no usable date; med: no message id; else high)."""
    flags = date_flags(F.col("date_raw"), F.col("date_utc"), F.col("message_id"))
    bad_date = F.arrays_overlap(flags, F.array(F.lit("missing_date"), F.lit("malformed_date")))
    level = F.when(bad_date, "low").when(F.array_contains(flags, "missing_message_id"), "med").otherwise("high")
    return emails.withColumn("date_flags", flags).withColumn("parse_confidence", level)
