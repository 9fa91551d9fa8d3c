"""Licence notices by ordered signature rules, in DataFrame functions only.

A text is brought to one line of lower-cased words with one blank between them. Signature rules are regular
expressions over that line, each with a keyword, a label, a confidence and a rank. Only texts that hold one of a few
telling words at all are looked at, and a rule's expression runs only on texts that hold its keyword. Detections are
intervals of the line; of equal intervals the rule of the best rank stays, and an interval that lies within another
one's is suppressed, but for the names of one SPDX expression, which all start with it. Suppression is a running maximum over the detections of one text, not a comparison of pairs.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases whose places are counted, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Label, keyword, and the licence's names as an expression over lower-cased words.
LICENCES = (
    ("mit", "mit", "mit"),
    ("mit", "expat", "expat"),
    ("x11", "x11", "x11"),
    ("apache-1.1", "apache", "apache(?: software)?(?: licen[sc]e)?(?: version)? v?1 1"),
    ("apache-2.0", "apache", "apache(?: software)?(?: licen[sc]e)?(?: version)? v?2(?: 0)?"),
    ("apache", "apache", "apache(?: software)?"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd)"),
    ("bsd-2-clause", "freebsd", "freebsd"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd", "bsd", "bsd"),
    ("isc", "isc", "isc"),
    ("gpl-1.0", "gnu", "gnu general public licen[sc]e(?: version)? v?1(?: 0)?"),
    ("gpl-2.0", "gnu", "gnu general public licen[sc]e(?: version)? v?2(?: 0)?"),
    ("gpl-3.0", "gnu", "gnu general public licen[sc]e(?: version)? v?3(?: 0)?"),
    ("gpl", "gnu", "gnu general public"),
    ("gpl-2.0", "gplv2", "gplv2"),
    ("gpl-3.0", "gplv3", "gplv3"),
    ("gpl", "gpl", "gpl"),
    ("lgpl-2.1", "gnu", "gnu lesser general public licen[sc]e(?: version)? v?2 1"),
    ("lgpl-3.0", "gnu", "gnu lesser general public licen[sc]e(?: version)? v?3(?: 0)?"),
    ("lgpl", "gnu", "gnu (?:lesser|library) general public"),
    ("lgpl", "lgpl", "lgpl"),
    ("agpl-3.0", "gnu", "gnu affero general public licen[sc]e(?: version)? v?3(?: 0)?"),
    ("agpl", "gnu", "gnu affero general public"),
    ("agpl", "agpl", "agpl"),
    ("gfdl", "gnu", "gnu free documentation"),
    ("mpl-1.1", "mozilla", "mozilla public licen[sc]e(?: version)? v?1 1"),
    ("mpl-2.0", "mozilla", "mozilla public licen[sc]e(?: version)? v?2 0"),
    ("mpl", "mozilla", "mozilla public"),
    ("epl-1.0", "eclipse", "eclipse public licen[sc]e(?: version)? v?1 0"),
    ("epl-2.0", "eclipse", "eclipse public licen[sc]e(?: version)? v?2 0"),
    ("epl", "eclipse", "eclipse public"),
    ("cddl", "cddl", "cddl"),
    ("cddl", "distribution", "common development and distribution"),
    ("cpl", "common", "common public"),
    ("artistic-1.0", "artistic", "artistic license(?: version)? v?1 0"),
    ("artistic-2.0", "artistic", "artistic license(?: version)? v?2 0"),
    ("artistic", "artistic", "artistic"),
    ("boost", "boost", "boost software"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("cc0", "cc0", "cc0(?: 1 0)?"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", "cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", "cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", "cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc", "cc by(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?"),
    ("cc-by-nc-sa", "commons", "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "commons", "creative commons attribution non ?commercial"),
    ("cc-by-nd", "commons", "creative commons attribution no ?deriv(?:ative)?s(?: works)?"),
    ("cc-by-sa", "commons", "creative commons attribution share ?alike"),
    ("cc-by", "commons", "creative commons attribution"),
    ("cc", "commons", "creative commons"),
    ("python", "python", "python software foundation"),
    ("php", "php", "php"),
    ("ruby", "ruby", "ruby"),
    ("perl", "perl", "perl"),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl"),
    ("ofl", "ofl", "ofl"),
    ("ofl", "font", "(?:sil )?open font"),
    ("eupl", "european", "european union public"),
    ("odbl", "odbl", "odbl"),
    ("odbl", "database", "open database"),
    ("vim", "vim", "vim"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa"),
    ("ms-pl", "microsoft", "microsoft public"),
    ("upl", "universal", "universal permissive"),
)

# The ways a notice names a licence: confidence and expression, {} being the licence.
NOTICES = (
    (1.0, "spdx license identifier {}(?: only| or later)?"),
    (0.95, "(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{}(?: licen[sc]e)?(?: version [0-9]+(?: [0-9]+)?)?"),
    (0.85, "subject to (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{}(?: licen[sc]e)?(?: version [0-9]+(?: [0-9]+)?)?"),
    (0.7, "(?:the )?{} licen[sc]e(?: version [0-9]+(?: [0-9]+)?)?"),
)

# Short names that follow "SPDX-License-Identifier:", as words, with their labels.
SHORT = (
    ("mit", "mit"), ("x11", "x11"), ("apache 1 1", "apache-1.1"), ("apache 2 0", "apache-2.0"), ("0bsd", "bsd-0-clause"), ("bsd 2 clause", "bsd-2-clause"),
    ("bsd 3 clause", "bsd-3-clause"), ("bsd 4 clause", "bsd-4-clause"), ("isc", "isc"), ("gpl 1 0", "gpl-1.0"), ("gpl 2 0", "gpl-2.0"), ("gpl 3 0", "gpl-3.0"),
    ("lgpl 2 0", "lgpl-2.0"), ("lgpl 2 1", "lgpl-2.1"), ("lgpl 3 0", "lgpl-3.0"), ("agpl 3 0", "agpl-3.0"), ("gfdl 1 [1-3]", "gfdl"), ("mpl 1 1", "mpl-1.1"),
    ("mpl 2 0", "mpl-2.0"), ("epl 1 0", "epl-1.0"), ("epl 2 0", "epl-2.0"), ("cddl 1 [01]", "cddl"), ("cpl 1 0", "cpl"), ("artistic 1 0", "artistic-1.0"),
    ("artistic 2 0", "artistic-2.0"), ("bsl 1 0", "boost"), ("zlib", "zlib"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("cc0 1 0", "cc0"),
    ("cc by nc nd [1-4] [05]", "cc-by-nc-nd"), ("cc by nc sa [1-4] [05]", "cc-by-nc-sa"), ("cc by nc [1-4] [05]", "cc-by-nc"), ("cc by nd [1-4] [05]", "cc-by-nd"),
    ("cc by sa [1-4] [05]", "cc-by-sa"), ("cc by [1-4] [05]", "cc-by"), ("psf 2 0", "python"), ("php 3 [01]{1,2}", "php"), ("ruby", "ruby"), ("postgresql", "postgresql"),
    ("openssl", "openssl"), ("ofl 1 [01]", "ofl"), ("eupl 1 [12]", "eupl"), ("odbl 1 0", "odbl"), ("vim", "vim"), ("ncsa", "ncsa"), ("ms pl", "ms-pl"), ("upl 1 0", "upl"),
)
# What may follow a short name, and the other names of an expression before it.
SUFFIX = "(?: only| or later)?"
EXPRESSION = "(?:[a-z0-9]{1,12}(?: [0-9]| clause| by| nc| nd| sa| pl| only| or later){0,6} (?:or|and|with) ){0,6}"

# Rules that stand for themselves: label, keyword, confidence, expression.
OTHERS = (
    ("public-domain", "domain", 0.6, "(?:released into|dedicated to|placed in|in) the public domain"),
    ("all-rights-reserved", "reserved", 0.6, "all rights reserved"),
    ("copyright", "copyright", 0.4, "copyright (?:c )?(?:19|20)[0-9]{2}"),
    ("mit", "permission", 0.9, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution", 0.9, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission", 0.9, "permission to use copy modify and or distribute this software for any purpose"),
    ("warranty-disclaimer", "warranty", 0.4, "without warranty of any kind"),
    ("proprietary", "proprietary", 0.6, "proprietary and confidential"),
)

# Every rule's match holds one of these.
TELLING = ("licen", "copyright", "spdx", "domain", "reserved", "permission", "redistribution", "warranty", "proprietary", "under", "subject to")


def rules() -> list[tuple[int, str, str, float, str]]:
    """(rank, label, keyword, confidence, expression) of every rule; a smaller rank goes first."""
    built = [(label, keyword, sure, form.replace("{}", name)) for (sure, form), (label, keyword, name) in itertools.product(NOTICES, LICENCES)]
    # a name that says "licence" and a version needs no word behind it
    whole = [(label, keyword, 0.7, f"(?:the )?{name}") for label, keyword, name in LICENCES if "licen" in name and "v?" in name]
    short = [(label, name.split(" ")[0], 1.0, f"spdx license identifier {EXPRESSION}{name}{SUFFIX}") for name, label in SHORT]
    return [(rank, *rule) for rank, rule in enumerate([*short, *whole, *built, *OTHERS])]


def line_of_words(text: Column) -> Column:
    """The words of a text, lower-cased, each with one blank before and after it; one blank for a text without words."""
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.concat(F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")))


def _blanks(line: Column) -> Column:
    return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))).cast("long")


def _places(line: Column) -> tuple[Column, Column, Column]:
    """(number, first word, last word) of the places of all phrases."""
    count, firsts, lasts = [], [], []
    for phrase, _ in PHRASES:
        here = F.contains(line, F.lit(f" {phrase} "))
        count.append(F.when(here, F.regexp_count(line, F.lit(f" {phrase}(?= )"))).otherwise(0))
        before = F.substring(line, F.lit(1), F.locate(f" {phrase} ", line))
        firsts.append(F.when(here, _blanks(before) - 1))
        turned = F.reverse(line)
        after = F.substring(turned, F.lit(1), F.locate(f" {phrase} "[::-1], turned))
        lasts.append(F.when(here, _blanks(line) - 1 - phrase.count(" ") - _blanks(after)))
    total = sum(count[1:], count[0]).cast("long")
    return total, F.least(*firsts), F.greatest(*lasts)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): one row for each input row.

    Words are runs of digits, a-z (after lower-casing) and characters beyond ASCII; null counts as the empty text,
    which has no words, empty labels and score 0. `n_base` counts the places of the base phrases, `first_word` and
    `last_word` are their smallest and largest start; labels are distinct, sorted and joined by commas; `score` is the
    highest confidence of a detection that stays (0.7 at least where a base phrase stands). Repeated rows give repeated
    results, null ids stay, other columns are not read, an empty table gives an empty result.
    """
    lined = docs.select(docs[doc_id].alias("doc_id"), line_of_words(docs[text].cast("string")).alias("line"))
    n_base, first_word, last_word = _places(F.col("line"))
    base_labels = F.array_compact(F.array(*[F.when(F.contains("line", F.lit(f" {phrase} ")), F.lit(label)) for phrase, label in PHRASES]))
    telling = F.lit(False)
    for word in TELLING:
        telling = telling | F.contains("line", F.lit(word))
    base = lined.select(
        "doc_id", (_blanks(F.col("line")) - 1).alias("n_words"), n_base.alias("n_base"), first_word.alias("first_word"),
        last_word.alias("last_word"), base_labels.alias("base"),
        # texts that no rule looks at get keys of their own, so that they don't meet in one task of the join
        F.when(telling, F.sha2("line", 256)).otherwise(F.concat_ws(" ", F.lit("row"), F.col("doc_id").cast("string"))).alias("line_id"),
    )

    table = F.broadcast(docs.sparkSession.createDataFrame(rules(), "rank int, label string, keyword string, sure double, expression string"))
    keywords = F.array(*[F.lit(k) for k in sorted({keyword for _, _, keyword, _, _ in rules()})])
    gated = lined.filter(telling).select(F.sha2("line", 256).alias("line_id"), "line", F.explode(F.array_intersect(F.split("line", " "), keywords)).alias("keyword"))
    tried = gated.join(table, "keyword").withColumn("pattern", F.concat(F.lit("(?<= )(?:"), F.col("expression"), F.lit(")(?= )")))
    met = tried.filter(F.expr("regexp_like(line, pattern)"))
    matches, gaps = F.expr("regexp_extract_all(line, pattern, 0)"), F.expr("split(line, pattern)")
    parts = met.select("line_id", "rank", "label", "sure", F.posexplode(F.arrays_zip(gaps.alias("gap"), matches.alias("match")))).filter("col.match IS NOT NULL")
    sized = parts.select("line_id", "rank", "label", "sure", "pos", F.length("col.gap").alias("gap"), F.length("col.match").alias("size")).distinct()
    along = Window.partitionBy("line_id", "rank").orderBy("pos")
    placed = sized.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(along)).withColumn("start", F.col("end") - F.col("size"))
    earlier = Window.partitionBy("line_id").orderBy("start", F.desc("end"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    stays = placed.withColumn("reached", F.max("end").over(earlier)).filter((F.col("rank") < len(SHORT)) | F.col("reached").isNull() | (F.col("reached") < F.col("end")))
    found = stays.groupBy("line_id").agg(F.collect_set("label").alias("own"), F.max("sure").alias("sure"))

    labels = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    floor = F.when(F.col("n_base") > 0, F.lit(0.7)).otherwise(F.lit(0.0))
    return base.join(found, "line_id", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.greatest(floor, F.coalesce("sure", F.lit(0.0))).alias("score"),
    )
