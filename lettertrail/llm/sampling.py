"""Bounded samples of labelled rows, and folds by a checksum of the id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def first_by_hash(ids: DataFrame, doc_id: str, n: int) -> DataFrame:
    """At most `n` rows, those with the smallest id hashes: the same rows whatever the partitioning."""
    return ids.orderBy(F.xxhash64(doc_id), doc_id).limit(n)


def labelled(labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y) with at most `per_class` ids of each label, and how many ids each label has in all.

    Rows with a null id or label are no labels; an id labelled both ways counts as 1.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {row["y"]: row["n"] for row in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [first_by_hash(known.filter(F.col("y") == y), "doc_id", per_class) for y in (0, 1)]
    return reduce(DataFrame.union, picked), counts
