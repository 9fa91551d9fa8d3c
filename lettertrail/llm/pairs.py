"""Texts of chosen documents, and a comparison of pairs of them inside tasks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import store
from .words import limit_batches, tidy

PARTNERS = 256  # of one document in one group
_BITS = 1 << 25  # of the filter of wanted ids


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *names, text = batch.columns
        packed = [zlib.compress((one or "").encode(), 1) for one in text.to_pylist()]
        yield pa.RecordBatch.from_arrays([*names, pa.array(packed, pa.binary())], [*batch.schema.names[:-1], "packed"])


def maybe(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """`rows` without most of those whose id isn't wanted: a bit for each hash of a wanted id.

    The bits are a table of at most `_BITS` / 8 bytes (4 MB) whatever the number of ids, so it may be broadcast; with very
    many ids it lets all rows pass, and the join that follows decides alone.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(_BITS))
    bits = wanted.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = rows.withColumn("part", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "part")
    return held.filter(F.getbit(byte, (bit % 8).cast("int")) == 1).select(rows.columns)


def packed_texts(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, packed): the texts of `docs` whose id is in `ids` (one column), compressed before any shuffle and stored."""
    limit_batches(docs.sparkSession)
    rows = docs.select(docs[doc_id].cast("bigint").alias("id"), docs[text].cast("string").alias("text")).filter("id IS NOT NULL")
    wanted = ids.toDF("id").distinct()
    packed = maybe(rows, wanted).mapInArrow(tidy(_squeeze), "id bigint, packed binary")
    return store(packed.join(wanted, "id", "left_semi"))


def text_tag(text: Column) -> Column:
    """Tells apart the texts of one id."""
    return F.xxhash64(text.cast("string"))


def packed_nodes(docs: DataFrame, nodes: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, packed): the text of each of the `nodes` (node, id, tag), named by its node, compressed and stored."""
    limit_batches(docs.sparkSession)
    rows = docs.select(docs[doc_id].cast("bigint").alias("id"), text_tag(docs[text]).alias("tag"), docs[text].cast("string").alias("text")).filter("id IS NOT NULL")
    wanted = nodes.select("node", "id", "tag").distinct()
    packed = maybe(rows, wanted.select("id")).mapInArrow(tidy(_squeeze), "id bigint, tag bigint, packed binary")
    return store(packed.join(wanted, ["id", "tag"]).select(F.col("node").alias("id"), "packed"))


def compare_pairs(pairs: DataFrame, texts: DataFrame, prepare: Callable, compare: Callable, schema: str) -> DataFrame:
    """Rows that `compare` yields for each pair (left, right, extra) of distinct ids.

    `prepare(raw text)` is computed once for each left document of a task group and once for each pair on the right;
    `compare(left id, left prepared, right id, right prepared, extra)` yields result tuples. A left document's
    partners are dealt by their hash to groups of about `PARTNERS`, so no task holds all partners of a hot document; rows
    stream by in order, and only one left document is held at a time.
    """
    degree = pairs.groupBy("left").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("groups"))
    salted = pairs.join(degree, "left").withColumn("salt", F.pmod(F.xxhash64("right"), "groups").cast("int")).drop("groups")
    dealt = degree.select("left", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"))
    lefts = dealt.join(texts.select(F.col("id").alias("left"), "packed"), "left")
    rights = salted.join(texts.select(F.col("id").alias("right"), "packed"), "right")
    kind = pairs.schema["extra"].dataType
    rows = lefts.select("left", "salt", F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("right"), F.lit(None).cast(kind).alias("extra"), "packed").union(
        rights.select("left", "salt", F.lit(1).alias("side"), "right", "extra", "packed"))
    names = [field.strip().split(" ")[0] for field in schema.split(",")]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in stream:
            out = []
            for left, salt, side, right, extra, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = prepare(zlib.decompress(packed))
                if side == 0:
                    # several texts under one id are all compared
                    held = [*held, raw] if key == (left, salt) else [raw]
                    key = (left, salt)
                else:
                    for one in held if key == (left, salt) else []:
                        out += compare(left, one, right, raw, extra)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    spread = rows.repartition("left", "salt").sortWithinPartitions("left", "salt", "side")
    return spread.mapInArrow(tidy(batches), schema)
