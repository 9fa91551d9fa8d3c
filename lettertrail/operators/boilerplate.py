"""Removal of disclaimer paragraphs, whatever their line wraps, quotes, dashes and case."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, strip

# The disclaimer texts to remove.
DISCLAIMERS = [
    "This email and any attachments are confidential and access to this email or attachment by anyone other than the "
    "addressee is unauthorised. If you are not the intended recipient please notify the sender and permanently delete the "
    "email including any attachments. You must not copy, disclose or distribute any of the contents to any other person. "
    "Personal views or opinions are solely those of the author and not of the Group or its affiliates. The Group does not "
    "guarantee that the integrity of this communication has been maintained nor that the communication is free of viruses, "
    "interceptions or interference. By communicating with anyone at the Group by email, you consent to the monitoring or "
    "interception of such email by the Group in accordance with its internal policies. Unless otherwise stated, any pricing "
    "information given in this message is indicative only, is subject to change and does not constitute an offer to deal at "
    "any price quoted.",
    "This email and its contents, together with any attachments, are confidential to the sender and the intended "
    "recipient(s), and may be covered by legal professional privilege. If you are not the intended recipient of this email "
    "and its attachment(s), you must destroy them immediately. You must take no action based upon them, nor copy them or "
    "show them to anyone. Please contact the sender if you have received this email in error. Email communication is not "
    "secure.",
    "CAUTION: This email originated from outside of the Organization. Do not click links or open attachments unless you "
    "recognize the sender and expecting the email. If in doubt, contact IT.",
    "CAUTION: This email is originated from outside our organization, Do not click on links, open attachments, or reply "
    "unless you recognized the sender and validate the content is safe.",
    "This message is from an EXTERNAL SENDER - be CAUTIOUS, particularly with links and attachments.",
    "WARNING: This message originated outside your organization, please be vigilant.",
    "The information contained in this communication (including any attachments) is privileged and confidential, and may be "
    "legally exempt from disclosure under applicable law. It is intended only for the specific purpose of being used by the "
    "individual or entity to whom it is addressed. If you are not the addressee indicated in this message (or are responsible "
    "for delivery of the message to such person), you must not disclose, disseminate, distribute, deliver, copy, circulate, "
    "rely on or use any of the information contained in this transmission.",
    "We apologize if you have received this communication in error; kindly inform the sender accordingly. Please also ensure "
    "that this original message and any record of it is permanently deleted from your computer system. We do not give or "
    "endorse any opinions, conclusions and other information in this message that do not relate to our official business.",
]

# Characters that stand for each other inside a disclaimer.
ALIKE = ("'‘’′", '"“”', "-–—")


def patterns(quote: str = "java") -> list[str]:
    """One pattern per disclaimer; `quote="sql"` writes it for a SQL literal of the checking engine."""
    space = f"[{SPACE}]+" if quote == "java" else r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"
    out = []
    for text in DISCLAIMERS:
        body = ""
        for char in " ".join(text.split()):
            group = next((g for g in ALIKE if char in g), None)
            body += space if char == " " else f"[{group.replace('-', '') + '-' if '-' in group else group}]" if group else re.escape(char)
        out.append(body.replace("'", "''") if quote == "sql" else body)
    return out


def _without(col: Column) -> Column:
    for pattern in patterns():
        col = F.regexp_replace(col, f"(?iu){pattern}", "")
    return col


def strip_boilerplate(df: DataFrame, col: str = "body_text") -> DataFrame:
    """Replace `col` with its text free of disclaimers, keep the original as `<col>_original`, flag the change."""
    work = df.withColumn("_clean", _without(F.col(col)))
    changed = F.coalesce(F.col("_clean") != F.col(col), F.lit(False))
    tidy = strip(F.regexp_replace(F.regexp_replace("_clean", r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))
    return (
        work.withColumn("boilerplate_stripped", changed)
        .withColumn(f"{col}_original", F.col(col))
        .withColumn(col, F.when(changed, tidy).otherwise(F.col(col)))
        .drop("_clean")
    )
