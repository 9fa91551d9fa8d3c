"""Buckets of any size compared in pieces of bounded size, by as many tasks as there are pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 512  # rows of a bucket that a piece of work takes from each side


def dealt(rows: DataFrame, bucket: str, member: str, query: str) -> DataFrame:
    """`rows` dealt to pieces: columns `piece` and `asks` are added.

    A bucket's queries and all its members are split into chunks by hash. Each piece holds a chunk of queries (`asks`)
    and a chunk of members, so that each query meets each member of its bucket in exactly one piece.
    """
    spot = F.xxhash64(member, bucket)
    sizes = rows.groupBy(bucket).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_chunks"), F.ceil(F.count_if(query) / CHUNK).cast("int").alias("_askers")).filter("_askers > 0")
    placed = rows.join(sizes, bucket)
    asking = placed.filter(query).withColumn("_q", F.pmod(spot, "_askers")).withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    asked = placed.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_askers") - 1))).withColumn("_c", F.pmod(spot, "_chunks"))
    one = lambda part, asks: part.withColumn("piece", F.xxhash64(bucket, F.col("_q").cast("int"), F.col("_c").cast("int"))).withColumn("asks", F.lit(asks)).drop("_q", "_c", "_chunks", "_askers")
    return one(asking, True).union(one(asked, False))


def pieces_of(stream: Iterator[pa.RecordBatch], key: str = "piece") -> Iterator[pa.Table]:
    """Tables of whole groups of `key` from batches sorted by it; a group that batches cut is put together."""
    held: list[pa.RecordBatch] = []
    for batch in stream:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if held and held[-1].column(key)[0].as_py() != keys[low]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Which of a piece's components are already joined by the pairs it has given out."""

    def __init__(self, comp: np.ndarray):
        self.label = comp.copy()

    def join(self, a: int, b: int) -> None:
        self.label[self.label == self.label[b]] = self.label[a]


def spanning(near: Callable[[int, np.ndarray], np.ndarray], asks: np.ndarray, others: np.ndarray, forest: Forest, everything: bool) -> Iterator[tuple[int, int]]:
    """Pairs (query row, member row) of different components that `near` accepts.

    `near(row, rows)` says which of `rows` may be linked with `row`. A pair between components that earlier pairs of the
    piece have joined is left out, unless `everything` is asked for: a piece gives out fewer pairs than it has components.
    """
    for a in asks.tolist():
        apart = others[forest.label[others] != forest.label[a]]
        if not len(apart):
            continue
        found = apart[near(a, apart)]
        for b in found.tolist():
            if everything:
                yield a, b
            elif forest.label[a] != forest.label[b]:
                yield a, b
                forest.join(a, b)
