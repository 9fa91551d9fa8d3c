"""Near-duplicate documents by SetSketch registers.

Every element of a set gives a Poisson process of points, each falling on one of `REGISTERS` registers; a register
keeps the smallest point of all elements. Such minima are exponentially distributed, merge by taking the smaller one
and agree between two sets about as often as the sets overlap. They are stored as truncated logarithms to the base
`BASE`: K = floor(1 - log_b(x / RATE)). Points beyond a limit that follows from the set's size can't become minima,
so an element's process stops there, and the work per document hardly depends on its length.

1. Documents of equal sets form a class; one document stands for it.
2. `BANDS` bands of `BAND_ROWS` register values are hashed; classes that share a band's hash share a bucket. Two sets at
   the threshold of 0.8 share no bucket with probability (1 - 0.8**4)**32 < 1e-7.
3. Each class is first compared with the smallest id of its buckets, one pair for each class.
4. Classes of one bucket that these links don't connect meet in pieces of bounded size (`buckets`): the Jaccard similarity of
   two classes is estimated jointly from how many registers are greater, equal and smaller (maximum likelihood, given
   both set sizes). Likely pairs are given out as far as they connect components, and verified on the full sets.
5. What is still apart is compared again, now with every pair whose estimate is not clearly too low, each in the
   first of its common buckets only, but for what a count rules out: of a set's elements, those that no other candidate
   holds can't be shared, and a set with too few others has no partner at the threshold.

So no link between different components is lost, and links inside a component, which change nothing, are not looked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .buckets import Forest, dealt, pieces_of, spanning
from .pairs import compare_pairs, packed_nodes, text_tag
from .store import store
from .words import Words, keyed, limit_batches, mix, pieces, tidy

REGISTERS = 256
BASE = 1.001
RATE = 20.0
BANDS, BAND_ROWS = 32, 4
MARGIN = 0.1  # estimates may lie so far under the threshold: four standard errors at 256 registers


def _minima(rows: np.ndarray, h: np.ndarray, n_rows: int) -> np.ndarray:
    """Register minima (rows x REGISTERS, infinite for empty sets) of the sets of distinct element hashes."""
    out = np.full(n_rows * REGISTERS, np.inf)
    sizes = np.bincount(rows, minlength=n_rows)
    slack = 7.0
    todo = np.ones(n_rows, bool)
    while True:
        use = todo[rows]
        row, state = rows[use], h[use]
        x = np.zeros(len(row))
        cap = (np.log(REGISTERS) + slack) / np.maximum(1, sizes[row])
        while len(row):
            state = mix(state + np.uint64(0x9E3779B97F4A7C15))
            x = x - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / REGISTERS
            near = x <= cap
            row, state, x, cap = row[near], state[near], x[near], cap[near]
            np.minimum.at(out, row * REGISTERS + (state & np.uint64(REGISTERS - 1)).astype(np.int64), x)
        todo = np.isinf(out.reshape(n_rows, REGISTERS)).any(axis=1) & (sizes > 0)
        if not todo.any():
            return out.reshape(n_rows, REGISTERS)
        slack *= 2


def registers(rows: np.ndarray, h: np.ndarray, n_rows: int) -> np.ndarray:
    """SetSketch registers (uint16) of the sets of distinct element hashes; all 0 for an empty set."""
    minima = _minima(rows, h, n_rows)
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(minima / RATE) / np.log(BASE))
    return np.clip(k, 0, 65535).astype(np.uint16)


def likeliest(n_left: np.ndarray, n_right: np.ndarray, greater: np.ndarray, smaller: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from the comparison of registers and the set sizes.

    With u and v the shares of both sizes in their sum, a left register is greater with probability u - v J, smaller
    with v - u J and equal with J (base near 1). The log-likelihood is concave in J; a few Newton steps find its top.
    """
    u = n_left / (n_left + n_right)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    j = np.clip(equal / (greater + smaller + equal), 1e-6, top - 1e-6)
    for _ in range(6):
        a, b = np.maximum(u - v * j, 1e-9), np.maximum(v - u * j, 1e-9)
        slope = equal / j - greater * v / a - smaller * u / b
        curve = equal / j**2 + greater * (v / a) ** 2 + smaller * (u / b) ** 2
        j = np.clip(j + slope / np.maximum(curve, 1e-9), 1e-6, top - 1e-9)
    return j


def _sketch(width: int):
    """Texts' sketches; the columns before the text go along."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for low, high, data, offsets in pieces(batch.column(2)):
                rows, h = Words(data, offsets, lower=True).shingles(width)
                first = np.unique(keyed(rows, h), return_index=True)[1]
                rows, h = rows[first], h[first]
                n = np.bincount(rows, minlength=high - low)
                sums = []
                for salt in (0x3C6EF372FE94F82B, 0x1F83D9ABFB41BD6B):
                    total = np.zeros(high - low, np.uint64)
                    np.add.at(total, rows, mix(h ^ np.uint64(salt)))
                    sums.append(pa.array(total.view(np.int64)))
                k = registers(rows, h, high - low)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(n.astype(np.int64)), *sums, pa.array([r.tobytes() for r in k], pa.binary())],
                    ["doc_id", "tag", "n", "set_a", "set_b", "regs"],
                )

    return batches


def sketches(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tag, n, set_a, set_b, regs): a hash of the text, set size, a 128-bit digest of the set and the registers of each row."""
    limit_batches(docs.sparkSession)
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), text_tag(docs[text]).alias("tag"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(tidy(_sketch(width)), "doc_id bigint, tag bigint, n bigint, set_a bigint, set_b bigint, regs binary")


def _offers(least: float, percent: int, everything: bool):
    """Pairs of a piece whose estimate is `least` or more, each in the first band in which both agree."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for table in pieces_of(stream):
            rep, n, held, comp, asks = (table[c].to_numpy() for c in ("rep", "n", "held", "comp", "asks"))
            regs = np.frombuffer(b"".join(table["regs"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
            band = table["band"][0].as_py()

            def near(a: int, rows: np.ndarray, n=n, held=held, regs=regs, band=band) -> np.ndarray:
                shared = np.minimum(held[rows], held[a])
                able = np.flatnonzero(100 * shared >= percent * (n[rows] + n[a] - shared))
                same = regs[rows[able]] == regs[a]
                equal = same.sum(axis=1)
                agree = same[:, : BANDS * BAND_ROWS].reshape(len(able), BANDS, BAND_ROWS).all(axis=2)
                fit = (equal >= (least - 0.15) * REGISTERS) & (agree.argmax(axis=1) == band)
                able, equal = able[fit], equal[fit]
                greater = (regs[a] > regs[rows[able]]).sum(axis=1)
                good = np.zeros(len(rows), bool)
                good[able] = likeliest(np.full(len(able), n[a]), n[rows[able]], greater, REGISTERS - equal - greater, equal) >= least
                return good

            for a, b in spanning(near, np.flatnonzero(asks), np.flatnonzero(~asks), Forest(comp), everything):
                left.append(min(rep[a], rep[b]))
                right.append(max(rep[a], rep[b]))
            if len(left) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["left", "right"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["left", "right"])

    return batches


def _elements(width: int):
    """(id, h) of every element of every text's set."""
    prepare = _shingle_set(width)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = prepare(zlib.decompress(packed))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), name)), pa.array(h.view(np.int64))], ["id", "h"])

    return batches


def _shingle_set(width: int):
    def prepare(raw: bytes) -> np.ndarray:
        data = np.frombuffer(raw, np.uint8)
        return np.unique(Words(data, np.array([0, len(data)]), lower=True).shingles(width)[1])

    return prepare


def _agree(percent: int):
    def compare(left, a, right, b, extra):
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        at = np.searchsorted(large, small)
        shared = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
        union = len(a) + len(b) - shared
        if union and 100 * shared >= percent * union:
            yield left, right

    return compare


def _decided(docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, tag, n_shingles, component_id, kept) of every row."""
    spark = docs.sparkSession
    limit_batches(spark)
    sketched = store(sketches(docs, width, doc_id, text))
    one = sketched.filter("n > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "tag", "n", "regs")).alias("c"))
    one = one.select("set_a", "set_b", F.col("c.doc_id").alias("id"), "c.tag", "c.n", "c.regs")
    # a class is named by its smallest id, or by a hash where the texts of one id would give several classes that name
    names = one.groupBy("id").agg((F.count("*") > 1).alias("several"))
    named = F.when(F.col("several"), F.xxhash64("id", "set_a", "set_b")).otherwise(F.col("id"))
    classes = store(one.join(names, "id").withColumn("rep", named).drop("several"))

    size = 2 * BAND_ROWS
    bands = F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.substring("regs", 1 + i * size, size)) for i in range(BANDS)])).alias("band", "bucket")
    banded = classes.select("rep", bands)
    lows = banded.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").drop("high")
    buckets = store(banded.join(lows, "bucket"))
    texts = packed_nodes(docs, buckets.select("rep").join(classes, "rep").withColumnRenamed("rep", "node"), doc_id, text)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.withColumn("extra", F.lit(0))
        return store(compare_pairs(pairs, texts, _shingle_set(width), _agree(percent), "left bigint, right bigint"))

    def able(rows: DataFrame) -> DataFrame:
        """(rep, held): the queries among `rows` of whose elements enough are held by another class in `rows`, and how many."""
        asked = rows.groupBy(F.col("rep").alias("id")).agg(F.max("query").alias("query"))
        elements = lambda ids: texts.join(ids, "id").select("id", "packed").mapInArrow(tidy(_elements(width)), "id bigint, h bigint")
        several = elements(asked).groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
        own = elements(asked.filter("query")).join(several, "h", "left").groupBy(F.col("id").alias("rep"))
        counted = own.agg(F.count("*").alias("all"), F.count("low").alias("held"))
        return counted.filter(100 * F.col("held") >= percent * F.col("all")).select("rep", "held")

    def between(roots: DataFrame, least: float, everything: bool) -> DataFrame:
        """Pairs of different components in buckets, near by their estimates."""
        placed = buckets.join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("root", "rep"))
        parts = placed.groupBy("bucket", "comp").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("k", "comp")).alias("largest"))
        placed = placed.join(parts.filter("parts > 1"), "bucket").select("bucket", "band", "rep", "comp", (F.col("comp") != F.col("largest.comp")).alias("query"))
        placed = store(placed)
        rows = placed.withColumn("held", F.lit(None).cast("bigint"))
        if everything:
            rows = placed.join(store(able(placed)), "rep", "left").filter("held IS NOT NULL OR NOT query")
        spread = dealt(rows, "bucket", "rep", "query").join(classes.select("rep", "n", "regs"), "rep")
        spread = spread.select("piece", "band", "rep", "n", F.coalesce("held", "n").alias("held"), "comp", "asks", "regs").repartition("piece").sortWithinPartitions("piece")
        return store(spread.mapInArrow(tidy(_offers(least, percent, everything)), "left bigint, right bigint").distinct())

    links = verified(buckets.filter("low < rep").groupBy("rep").agg(F.min("low").alias("left")).select("left", F.col("rep").alias("right")))
    roots = connected_components(links, "left", "right")
    for least, everything in ((percent / 100, False), (percent / 100 - MARGIN, True)):
        given = between(roots, least, everything)
        links = links.union(verified(given))
        roots = connected_components(links, "left", "right")

    membership = classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("set_a", "set_b", "id", "rep", F.coalesce("root", "rep").alias("root"))
    firsts = membership.groupBy("root").agg(F.min(F.struct("id", "rep")).alias("first"))
    membership = membership.join(firsts, "root").select("set_a", "set_b", F.col("first.id").alias("component"), (F.col("first.rep") == F.col("rep")).alias("first"))
    rows = sketched.select("doc_id", "tag", "n", "set_a", "set_b").join(membership, ["set_a", "set_b"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return rows.select(
        "doc_id", "tag", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce((F.col("doc_id") == component) & F.coalesce("first", F.lit(True)), component.isNull()).alias("kept"),
    )


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each input row.

    A document's set holds its distinct windows of `width` lower-cased words (a shorter text is one window; a null or
    blank text is the empty set and linked with nothing). Documents are linked where 100 * intersection >=
    `percent` * union; `component_id` is the smallest id that links reach. Repeated rows share a component and are kept
    or dropped alike; rows of one id with different texts go their own ways, and of its linked texts one is kept. A row with a null id takes the component
    of its copies and is kept only if it has none with an id. Ids are integers; other columns are not read; an empty
    table gives an empty result.
    """
    return _decided(docs, width, percent, doc_id, text).drop("tag")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each group of near duplicates, the one with the smallest id; columns unchanged.

    Rows are told apart by id and text, so a row goes only if its own text is a near copy. Rows with a null id stay.
    """
    gone = _decided(docs, width, percent, "doc_id", "text").filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    same = (docs["doc_id"].cast("bigint") == gone["_id"]) & (text_tag(docs["text"]) == gone["_tag"])
    return docs.join(gone, same, "left_anti").select(docs.columns)
