"""Documents whose sets of word windows overlap, joined through parity sketches.

A sketch toggles one bit for every element of a set, so two sketches differ in at most as many bits as the sets differ in
elements: Hamming distance bounds the symmetric difference from below. Sketches are long and sparse (blocks of 2**16
bits); a block's parity is kept as the exclusive or of a random number for each toggled bit.

1. Sizes fall into bands [2**i, 2**(i+1)), and linked sets of neighbouring bands meet in a band around their border.
   Inside a band at most k elements differ between linked sets, so at most k blocks do: of m = k + 1 + slack blocks,
   slack + 1 agree at least.
2. A block's content is a key. Any order of all keys makes the pigeonhole stronger: with keys ordered from rare to
   frequent, linked sets share one of their first k + 1 keys each. So the `slack` most frequent keys of a set (empty
   blocks, blocks of common passages) join nothing, and a set most of whose keys nobody else has leaves early.
3. In a bucket of equal keys each set is first compared with the bucket's smallest id, one pair for each set. What these
   links don't connect meets in pieces of bounded size (`buckets`): pairs whose sketches, folded to 8 bits a
   block, are near enough are given out as far as they connect components, and verified on the full sets. Where a pair given out fails, the
   sets that it would have connected are compared once more without leaving out any pair.

So no link between different components is lost, and a group of like texts never gives out all its pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .buckets import Forest, dealt, pieces_of, spanning
from .near_dedup import _agree, _shingle_set
from .pairs import compare_pairs, maybe, packed_texts
from .store import store
from .words import Words, keyed, limit_batches, mix, pieces

SLACK = 0.25  # blocks above k + 1, as a share of k + 1
_BIT = np.uint64(0xFFFF)


def _differ(total, percent: int):
    """How many elements may differ at most between linked sets of `total` elements together."""
    return (100 - percent) * total // (100 + percent)


def _bands(n: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, band, k) for the own bands of sets of sizes `n`, and for the bands around a border that a partner may cross."""
    own = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    out = [(np.flatnonzero(n > 0), 2 * own, _differ(2 * (2 ** (own + 1) - 1), percent))]
    below = 100 * n >= percent * 2 ** (own + 1)  # a larger partner may lie beyond the upper border
    above = percent * n <= 100 * (2**own - 1)
    for rows, border in ((below, own + 1), (above, own)):
        edge = 2**border
        out.append((np.flatnonzero(rows & (n > 0)), 2 * border - 1, _differ(edge - 1 + 100 * (edge - 1) // percent, percent)))
    return [(rows, band[rows], k[rows]) for rows, band, k in out]


def _blocks(k: np.ndarray) -> np.ndarray:
    return np.where(k > 0, k + 1 + np.ceil(SLACK * (k + 1)).astype(np.int64), 0)


def _keys(width: int, percent: int):
    """Set size, digest and the keys of all blocks for each text and each of its bands."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for low, high, data, offsets in pieces(batch.column(1)):
                rows, h = Words(data, offsets, lower=True).shingles(width)
                first = np.unique(keyed(rows, h), return_index=True)[1]
                rows, h = rows[first], h[first]
                order = np.argsort(rows, kind="stable")
                rows, h = rows[order], h[order]
                n = np.bincount(rows, minlength=high - low)
                ends = np.cumsum(n)
                sums = []
                for salt in (0x3C6EF372FE94F82B, 0x1F83D9ABFB41BD6B):
                    total = np.zeros(high - low, np.uint64)
                    np.add.at(total, rows, mix(h ^ np.uint64(salt)))
                    sums.append(total.view(np.int64))
                names = batch.column(0).slice(low, high - low)
                none = np.flatnonzero(n == 0)
                for own, (rows_in, band, k) in enumerate([(none, np.zeros(len(none), np.int64), np.zeros(len(none), np.int64)), *_bands(n, percent)]):
                    if not len(rows_in):
                        continue
                    m = _blocks(k)
                    size = n[rows_in]
                    begins = np.cumsum(m) - m
                    take = np.where(m > 0, size, 0)
                    at = np.arange(take.sum()) + np.repeat(ends[rows_in] - size - (np.cumsum(take) - take), take)
                    e, of = h[at], np.repeat(np.arange(len(rows_in)), take)
                    block = (e >> np.uint64(20)) % m[of].astype(np.uint64)
                    parity = np.zeros(int(m.sum()), np.uint64)
                    np.bitwise_xor.at(parity, begins[of] + block.astype(np.int64), mix((block << np.uint64(16) | e & _BIT) + np.uint64(0x632BE59BD9B4E019)))
                    place = np.arange(len(parity)) - np.repeat(begins, m)
                    keys = mix(parity + mix((place.astype(np.uint64) << np.uint64(8)) + np.repeat(band, m).astype(np.uint64)))
                    cuts = pa.array(np.concatenate([[0], np.cumsum(m)]), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(rows_in)), pa.array(size), *(pa.array(s[rows_in]) for s in sums), pa.array(np.full(len(rows_in), own < 2)), pa.array(band), pa.array(k),
                         pa.ListArray.from_arrays(cuts, pa.array(keys.view(np.int64)))],
                        ["doc_id", "n", "set_a", "set_b", "own", "band", "k", "keys"])

    return batches


_KEYED = "doc_id bigint, n bigint, set_a bigint, set_b bigint, own boolean, band bigint, k bigint, keys array<bigint>"


def _folded(width: int):
    """The sketch of a packed text for one band, its blocks folded to 8 bits each: about 8 k bits, so pairs with far more than k differences stand out."""
    elements = _shingle_set(width)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = []
            for packed, k in zip(batch.column("packed").to_pylist(), batch.column("k").to_pylist(), strict=True):
                h = elements(zlib.decompress(packed))
                folded = np.zeros(int(_blocks(np.array(k))), np.uint8)
                np.bitwise_xor.at(folded, ((h >> np.uint64(20)) % np.uint64(len(folded))).astype(np.int64), (np.uint64(1) << (h & np.uint64(7))).astype(np.uint8))
                out.append(folded.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("band"), pa.array(out, pa.binary())], ["rep", "band", "bits"])

    return batches


def _near_pairs(percent: int, everything: bool):
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for table in pieces_of(stream):
            rep, n, comp, asks = (table[c].to_numpy() for c in ("rep", "n", "comp", "asks"))
            bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint8).reshape(len(rep), -1)

            def near(a: int, rows: np.ndarray, bits=bits, n=n) -> np.ndarray:
                return np.bitwise_count(bits[rows] ^ bits[a]).sum(axis=1, dtype=np.int64) <= _differ(n[rows] + n[a], percent)

            for a, b in spanning(near, np.flatnonzero(asks), np.flatnonzero(~asks), Forest(comp), everything):
                left.append(min(rep[a], rep[b]))
                right.append(max(rep[a], rep[b]))
            if len(left) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["left", "right"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["left", "right"])

    return batches


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each input row.

    A document's set holds its distinct windows of `width` lower-cased words (a shorter text is one window; a null or
    blank text is the empty set and linked with nothing). Documents link where 100 * intersection >= `percent` * union;
    `component_id` is the smallest id that links reach. Repeated rows share everything; ids that
    name several texts are one node of the links, wherever they are a text's smallest id. A row with a null id takes the component of its copies, null if it has none with an id.
    Ids are integers; other columns aren't read; an empty table gives an empty result.
    """
    if not 50 < percent <= 100:
        raise ValueError("sizes of linked sets must lie within a factor of two: percent above 50, up to 100")
    spark = docs.sparkSession
    limit_batches(spark)
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    sketched = store(rows.mapInArrow(_keys(width, percent), _KEYED))
    spread = sketched.filter("doc_id IS NOT NULL AND k > 0").select("doc_id", "n", "set_a", "set_b", "band", "k", F.size("keys").alias("m"), F.explode("keys").alias("id"))

    # keys of two different sets at least; the count orders them
    counts = store(spread.groupBy("id").agg(F.count("*").alias("times"), F.min("set_a").alias("low"), F.max("set_a").alias("high")).filter("low < high").select("id", "times"))
    shared = maybe(spread, counts.select("id")).join(counts, "id")
    shared = shared.groupBy("set_a", "set_b", "band", "id").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "k", "m", "times")))
    mine = Window.partitionBy("set_a", "set_b", "band")
    # keys that only this set has come first in the order, so the first k + 1 keys hold all m - held of them
    ranked = shared.withColumn("held", F.count("*").over(mine)).withColumn("rank", F.row_number().over(mine.orderBy("times", "id")))
    members = store(ranked.filter("rank <= k + 1 - (m - held)").select(F.col("id").alias("bucket"), "rep", "n", "band", "k"))
    lows = members.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").drop("high")
    members = store(members.join(lows, "bucket"))
    texts = packed_texts(docs, members.select("rep"), doc_id, text)

    def verified(pairs: DataFrame) -> DataFrame:
        return store(compare_pairs(pairs.withColumn("extra", F.lit(0)), texts, _shingle_set(width), _agree(percent), "left bigint, right bigint"))

    first = members.filter("low < rep").groupBy("rep").agg(F.min("low").alias("left")).select("left", F.col("rep").alias("right"))
    links = verified(first)
    roots = connected_components(links, "left", "right")

    def between(roots: DataFrame, only: DataFrame | None, everything: bool) -> DataFrame:
        """Pairs of different components in buckets, near by their sketches."""
        placed = members.join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("root", "rep"))
        sizes = placed.groupBy("bucket", "comp").agg(F.count("*").alias("size")).groupBy("bucket").agg(F.count("*").alias("comps"), F.max(F.struct("size", "comp")).alias("largest"))
        placed = placed.join(sizes.filter("comps > 1"), "bucket").withColumn("query", F.col("comp") != F.col("largest.comp"))
        if only is not None:
            placed = placed.join(only, "rep", "left_semi")
        placed = store(placed.select("bucket", "rep", "n", "band", "k", "comp", "query"))
        wanted = placed.select(F.col("rep").alias("id"), "band", "k").distinct()
        bits = store(texts.join(wanted, "id").select("id", "band", "k", "packed").mapInArrow(_folded(width), "rep bigint, band bigint, bits binary"))
        pieces_in = dealt(placed.join(bits, ["rep", "band"]), "bucket", "rep", "query").select("piece", "rep", "n", "comp", "asks", "bits")
        near = pieces_in.repartition("piece").sortWithinPartitions("piece").mapInArrow(_near_pairs(percent, everything), "left bigint, right bigint")
        return store(near.distinct())

    given = between(roots, None, False)
    found = verified(given)
    links = links.union(found)
    failed = given.join(found, ["left", "right"], "left_anti")
    if not given.isEmpty():
        roots = connected_components(links, "left", "right")
        if not failed.isEmpty():
            meant = connected_components(given, "left", "right")
            open_roots = failed.select(F.col("left").alias("id")).join(meant, "id").select("root").distinct()
            again = verified(between(roots, meant.join(open_roots, "root").select(F.col("id").alias("rep")), True))
            roots = connected_components(links.union(again), "left", "right")

    own = sketched.filter("own")
    classes = own.filter("n > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    classes = classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("root", "rep").alias("component"))
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return own.join(classes, ["set_a", "set_b"], "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
