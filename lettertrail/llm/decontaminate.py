"""Benchmark passages inside documents, found by an embedding of edit distance into Hamming distance.

A random walk (CGK) reads a sequence of words and at each step writes the word it stands on, then moves on or stays as
a random bit of (step, word) says. Sequences a few edits apart soon walk in step again, so their outputs differ in few
places. Sampling a few places of the output gives a key that similar sequences share; `WALKS` walks with `SAMPLES`
places each reach the recall aimed at. Document windows of the items' sizes get such keys; windows and items that share
a key are verified by exact edit distance of the item to the best fitting run of the document's words.

Windows that cannot be close to any item are left out by a lossless test: k edits of words destroy at most 2 k pairs of
neighbouring words, so enough of a window's pairs must occur in some item. The items of a pass are a block of at most
`ITEMS` rows sent to the tasks; more items make more passes over the documents. Documents are neither shuffled nor joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, limit_batches, mix, pieces, tidy

ITEMS = 20_000  # items of one pass
LEAST_WORDS = 5
WALKS, SAMPLES = 64, 3
GROWTH = 1.12  # ratio of the lengths that share a window size
_BITS = 22


@dataclass
class _Size:
    """Items of like length: window length, least number of known pairs, walk places, keys and the items they name."""

    length: int
    least: int
    places: np.ndarray
    seeds: np.ndarray
    keys: np.ndarray
    owners: np.ndarray


def _walk(words: np.ndarray, places: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """(n x WALKS) keys of word sequences (n x length; 0 past the end)."""
    n, length = words.shape
    padded = np.concatenate([words, np.zeros((n, 1), np.uint64)], axis=1).ravel()
    row = (np.arange(n) * (length + 1))[:, None]
    at = np.zeros((n, len(places)), np.int64)
    keys = np.zeros((n, len(places)), np.uint64)
    for step in range(int(places.max()) + 1):
        now = padded[row + at]
        taken = (places == step).any(axis=1)
        if taken.any():
            keys[:, taken] = keys[:, taken] * np.uint64(0x9FB21C651E98DF25) + now[:, taken]
        # a multiply and a shift give the bit of (walk, step, word)
        at += ((now ^ seeds[:, step]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40) & np.uint64(1)).astype(np.int64)
        np.minimum(at, length, out=at)
    return mix(keys + np.arange(len(places), dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def _fit(items: np.ndarray, sizes: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edit distance, end) of each item (padded row of words) to the best run of words in its region (0 past the end)."""
    n, width = regions.shape
    steps = np.arange(width + 1)
    row = np.zeros((n, width + 1), np.int32)
    best = np.zeros((n, width + 1), np.int32)
    for i in range(items.shape[1]):
        cost = (regions != items[:, i : i + 1]).astype(np.int32)
        new = row + 1
        np.minimum(new[:, 1:], row[:, :-1] + cost, out=new[:, 1:])
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        done = sizes == i + 1
        best[done] = row[done]
    return best.min(axis=1), best.argmin(axis=1)


class _Index:
    """The items of one pass: word hashes, pairs of neighbouring words, and walk keys by size."""

    def __init__(self, names: list, texts: list[str], edits: float):
        self.edits = edits
        words = [Words(data, offsets, lower=True) for _, _, data, offsets in pieces(pa.array(texts, pa.string()))] if texts else []
        rows = [w.hashes[a:b] for w in words for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        wanted = [i for i, row in enumerate(rows) if len(row) >= LEAST_WORDS]
        self.names, self.rows = [names[i] for i in wanted], [rows[i] for i in wanted]
        pairs = [self.pairs(row[:-1], row[1:]) for row in self.rows]
        self.known = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.uint64)
        self.opening = np.unique([pair[0] for pair in pairs]) if pairs else np.empty(0, np.uint64)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.known & np.uint64((1 << _BITS) - 1)] = True
        self.sizes = list(self._sizes())

    @staticmethod
    def pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return mix(left * np.uint64(0x9FB21C651E98DF25) + right)

    def _sizes(self) -> Iterator[_Size]:
        lengths = np.array([len(row) for row in self.rows])
        random = np.random.default_rng(20)
        left = np.unique(lengths)
        while len(left):
            group = left[left <= left[0] * GROWTH]
            left = left[len(group) :]
            members = np.flatnonzero(np.isin(lengths, group))
            short, long = int(group[0]), int(group[-1])
            least = max(1, short - 1 - 3 * int(self.edits * short))
            reach = max(SAMPLES, int(1.5 * short))
            places = np.array([np.sort(random.choice(reach, SAMPLES, replace=False)) for _ in range(WALKS)])
            seeds = random.integers(0, 2**63, (WALKS, reach), dtype=np.int64).astype(np.uint64)
            padded = np.zeros((len(members), long), np.uint64)
            for i, member in enumerate(members):
                padded[i, : lengths[member]] = self.rows[member]
            keys = _walk(padded, places, seeds)
            owners = np.repeat(members, WALKS)
            order = np.argsort(keys.ravel(), kind="stable")
            yield _Size(long, least, places, seeds, keys.ravel()[order], owners[order])

    def candidates(self, words: Words) -> Iterator[tuple[_Size, np.ndarray, np.ndarray]]:
        """(size, first word, item) of windows that share a walk key with an item."""
        n = len(words.starts)
        if n < 2:
            return
        pair = self.pairs(words.hashes[:-1], words.hashes[1:])
        hit = np.zeros(n, bool)
        maybe = np.flatnonzero(self.seen[pair & np.uint64((1 << _BITS) - 1)] & (words.doc[:-1] == words.doc[1:]))
        at = np.minimum(np.searchsorted(self.known, pair[maybe]), len(self.known) - 1)
        hit[maybe[self.known[at] == pair[maybe]]] = True
        sums = np.concatenate([[0], np.cumsum(hit)])
        fresh = hit.copy()
        fresh[1:] &= ~hit[:-1]  # a run of known pairs begins here, or an item's first pair stands here
        known = np.flatnonzero(hit)
        fresh[known[np.isin(pair[known], self.opening)]] = True
        starts = np.flatnonzero(fresh)
        stop = words.first[words.doc[starts] + 1]
        for size in self.sizes:
            end = np.minimum(starts + size.length - 1, stop)
            good = np.flatnonzero(sums[end] - sums[starts] >= size.least)
            for part in np.array_split(good, len(good) * size.length // 200_000 + 1):
                if not len(part):
                    continue
                place = starts[part][:, None] + np.arange(size.length)
                window = np.where(place < stop[part][:, None], words.hashes[np.minimum(place, n - 1)], np.uint64(0))
                keys = _walk(window, size.places, size.seeds)
                low = np.searchsorted(size.keys, keys.ravel(), "left")
                many = np.searchsorted(size.keys, keys.ravel(), "right") - low
                which = np.repeat(np.arange(keys.size), many)
                owner = size.owners[np.repeat(low, many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)]
                both = np.unique(np.stack([starts[part][which // WALKS], owner], axis=1), axis=0)
                if len(both):
                    yield size, both[:, 0], both[:, 1]

    def hits(self, words: Words) -> list[tuple]:
        """(row, item name, distance, item words, first word, end word): the best place of each item in each row."""
        best: dict[tuple[int, int], tuple] = {}
        for size, start, item in self.candidates(words):
            slack = int(self.edits * size.length) + 4
            for part in np.array_split(np.arange(len(start)), len(start) // 512 + 1):
                if not len(part):
                    continue
                doc = words.doc[start[part]]
                low = np.maximum(start[part] - slack, words.first[doc])
                place = low[:, None] + np.arange(size.length + 2 * slack)
                inside = place < words.first[doc + 1][:, None]
                region = np.where(inside, words.hashes[np.minimum(place, len(words.hashes) - 1)], np.uint64(0))
                own = np.full((len(part), size.length), np.uint64(1))
                lengths = np.array([len(self.rows[i]) for i in item[part]])
                for k, i in enumerate(item[part]):
                    own[k, : lengths[k]] = self.rows[i]
                distance, end = _fit(own, lengths, region)
                for k in np.flatnonzero(distance <= self.edits * lengths):
                    back = region[k : k + 1, : end[k]][:, ::-1]
                    run = _fit(own[k : k + 1, : lengths[k]][:, ::-1], lengths[k : k + 1], back)[1][0]
                    first = int(low[k] + end[k] - run - words.first[doc[k]])
                    found = (int(distance[k]), int(lengths[k]), first, first + int(run))
                    key = (int(doc[k]), int(item[part[k]]))
                    best[key] = min(best.get(key, found), found)
        return [(row, self.names[item], *found) for (row, item), found in sorted(best.items())]


def leaks(docs: DataFrame, items: DataFrame, edits: float = 0.2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, item_words, first_word, end_word): items within `edits` of their words of a run of a document's words.

    `items` has item_id and text. Words are lower-cased runs without ASCII white space. One row for each input row and
    item, at the item's best (first) place. Null and empty texts hold nothing; items of fewer than five words are not
    searched for, as any text may hold them; repeated rows and items are found each time; no items, no rows.
    """
    limit_batches(docs.sparkSession)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    kinds = rows.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance bigint, item_words bigint, first_word bigint, end_word bigint"
    names = ["doc_id", "item_id", "distance", "item_words", "first_word", "end_word"]

    def one_pass(index: _Index, item_kind: pa.DataType) -> DataFrame:
        def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                for low, _, data, offsets in pieces(batch.column(1)):
                    found = index.hits(Words(data, offsets, lower=True)) if index.names else []
                    if found:
                        row, name, *numbers = zip(*found, strict=True)
                        ids = batch.column(0).take(pa.array([low + r for r in row]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(name, item_kind), *(pa.array(c, pa.int64()) for c in numbers)], names)

        return rows.mapInArrow(tidy(batches), schema)

    return reduce(DataFrame.union, [one_pass(*found) for found in _indexes(items, edits)])


def _indexes(items: DataFrame, edits: float) -> Iterator[tuple[_Index, pa.DataType]]:
    """The items in blocks of about `ITEMS`, each as an index for one pass."""
    known = items.select(items["item_id"].alias("item_id"), items["text"].cast("string").alias("text")).filter("text IS NOT NULL")
    passes = max(1, -(-known.count() // ITEMS))
    for number in range(passes):
        part = known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number).orderBy("item_id", "text").toArrow()
        yield _Index(part["item_id"].to_pylist(), part["text"].to_pylist(), edits), part.schema.field("item_id").type


def keep_clean(docs: DataFrame, items: DataFrame, edits: float = 0.2) -> DataFrame:
    """`docs` without the rows whose text holds an item, columns unchanged."""
    limit_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].cast("string").alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string"

    def one_pass(rows: DataFrame, index: _Index) -> DataFrame:
        def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                clean = np.ones(batch.num_rows, bool)
                for low, _, data, offsets in pieces(batch.column(1)):
                    for hit in index.hits(Words(data, offsets, lower=True)) if index.names else []:
                        clean[low + hit[0]] = False
                yield batch.filter(pa.array(clean))

        return rows.mapInArrow(tidy(batches), schema)

    for index, _ in _indexes(items, edits):
        rows = one_pass(rows, index)
    return rows.select("row.*")
