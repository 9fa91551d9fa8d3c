"""Quoted rows that only repeat a standalone message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import shingle_hashes
from ..session import materialise
from .dedup import distinct_bodies, held_in, sets_of, with_body_norm

# Fixed value: the share of a quoted body's five-word windows that a standalone body must hold.
HELD = 0.70


def _bodies(rows: DataFrame) -> DataFrame:
    return with_body_norm(rows).filter("norm_len > 0").select("id", "case_id", "body_norm", "body_hash")


def repeated_exactly(quoted: DataFrame, standalone: DataFrame) -> DataFrame:
    """(id) of quoted rows whose normalised body is some standalone body of the case."""
    return quoted.join(standalone.select("case_id", "body_hash").distinct(), ["case_id", "body_hash"], "left_semi").select("id")


def reconcile_quoted(emails: DataFrame) -> DataFrame:
    """The emails without quoted rows that equal a standalone body of their case or lie to 0.70 inside one of like size.

    A standalone body more than 1 / 0.70 times as large only quotes them in turn, as the mail they were taken from does.

    Trashed rows take part. A body of fewer than five words is one window, so it goes only where it is equal. Equal
    bodies go by an equi-join, the rest by exact containment of five-word windows between distinct bodies.
    """
    kinds = emails.filter(F.col("source_kind").isin("quoted", "standalone"))
    hashed = with_body_norm(kinds).filter("norm_len > 0").withColumn("hashes", shingle_hashes(F.col("body_norm")).cast("array<int>"))
    rows = materialise(hashed.select("id", "case_id", "source_kind", "body_hash", "hashes"))
    names = rows.select("id", "case_id", "source_kind", "body_hash")
    quoted, standalone = (names.filter(F.col("source_kind") == kind) for kind in ("quoted", "standalone"))
    same = repeated_exactly(quoted, standalone)
    left = materialise(quoted.join(same, "id", "left_anti"))
    # the distinct bodies of each case by their first row
    asked, holders = (distinct_bodies(x) for x in (left, standalone))
    held = held_in(sets_of(rows.filter("source_kind = 'quoted'"), asked), sets_of(rows.filter("source_kind = 'standalone'"), holders), "id", HELD, ("case_id",))
    found = asked.join(held.select(F.col("small_key").alias("id")).distinct(), "id", "left_semi")
    near = left.join(found, ["case_id", "body_hash"], "left_semi").select("id")
    return emails.join(same.union(near), "id", "left_anti")
