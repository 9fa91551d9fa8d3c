"""BPE encoding and decoding through a table of distinct words.

For a tokenizer whose tokens never cross white space, a text's ids are its words' ids in order. Each task splits its
texts into words and numbers the distinct ones of a block of texts; the block's texts become word numbers. Distinct
words travel to the slot of their hash, where each is encoded once whatever number of blocks it comes from, and their
ids go back to the blocks, where word numbers are replaced by ids. Decoding joins ids with the pieces of the
vocabulary, whose size the tokenizer file fixes.

Two exchanges carry the distinct words of the blocks and the numbers of the words, packed; texts are never shuffled.
Word tables of a task shrink as `spark.sql.shuffle.partitions` grows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, give_back, limit_batches, pieces, tidy

BLOCK_BYTES = 12 << 20
_CLASSES = 16  # words of a block are numbered by how often they occur, in classes of powers of two
_PACKED = "target bigint, block bigint, slot int, payload binary"
_NAMES = ["target", "block", "slot", "payload"]


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _pack(*arrays: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    # one value a column, over the array's own bytes: a block's numbers aren't copied to be packed
    columns = [pa.BinaryArray.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, a.nbytes], np.int32)), pa.py_buffer(np.ascontiguousarray(a))]) for a in arrays]
    batch = pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(arrays))])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.compress(sink.getvalue(), 3)


def _unpack(payload: bytes, *kinds) -> list[np.ndarray]:
    batch = pa.ipc.open_stream(zstandard.decompress(payload)).read_next_batch()
    return [np.frombuffer(column[0].as_buffer(), kind) for column, kind in zip(batch.columns, kinds, strict=True)]


def _planes(numbers: np.ndarray) -> np.ndarray:
    """The numbers' bytes with those of like weight together, which compress well."""
    return np.ascontiguousarray(numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)


def _from_planes(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)


def _beginnings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each word as a number that sorts alike."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(8):
        at = starts + i
        out = out << np.uint64(8) | np.where(at < ends, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint64)
    return out


class _Block:
    """Texts of one task until they fill a block. A word is kept once a block, however many pieces it stands in."""

    def __init__(self):
        self.ids, self.counts, self.places, self.words, self.size = [], [], [], [], 0
        self.seen = np.empty(0, np.uint64)  # hashes of the words so far, sorted

    def add(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        found = Words(data, offsets)
        h, first, places, times = np.unique(found.hashes, return_index=True, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.seen, h)
        new = np.flatnonzero(np.append(self.seen, np.uint64(0))[at] != h) if len(self.seen) else np.arange(len(h))
        starts, ends = found.starts[first[new]], found.ends[first[new]]
        words = np.empty(len(new), object)
        raw = data.tobytes()
        words[:] = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        self.ids.append(ids.take(pa.array(np.arange(len(ids)))))  # a slice would hold its batch's texts too
        self.counts.append(found.counts)
        self.places.append((h, times.astype(np.uint32), places.astype(np.min_scalar_type(len(h)))))
        self.words.append((h[new], words, _beginnings(data, starts, ends)))
        self.seen = np.sort(np.concatenate([self.seen, h[new]]))
        self.size += len(data)

    def rows(self, block: int, slots: int) -> Iterator[tuple]:
        distinct, spelled, begins = (np.concatenate(x) for x in zip(*self.words, strict=True))
        self.words = []
        order = np.argsort(distinct)
        distinct, spelled, begins = distinct[order], spelled[order], begins[order]
        times = np.zeros(len(distinct), np.int64)
        for h, n, _ in self.places:
            times[np.searchsorted(distinct, h)] += n
        slot = (distinct % np.uint64(slots)).astype(np.int64)
        rarity = _CLASSES - 1 - np.minimum(np.log2(np.maximum(times, 1)).astype(np.int64), _CLASSES - 1)
        sent = np.lexsort((begins, rarity, slot))  # as slots get them: frequent words first, then like beginnings together
        rank = np.empty(len(sent), np.uint32)
        rank[np.lexsort((begins, slot, rarity))] = np.arange(len(sent), dtype=np.uint32)
        numbers = np.concatenate([rank[np.searchsorted(distinct, h)][own] for h, _, own in self.places])
        self.places = []
        cuts = np.searchsorted(slot[sent], np.arange(slots + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            yield s, block, s, zstandard.compress(b"\n".join(spelled[sent[cuts[s] : cuts[s + 1]]].tolist()), 3)
        sink = pa.BufferOutputStream()
        ids = pa.concat_arrays(self.ids)
        with pa.ipc.new_stream(sink, pa.schema([("doc_id", ids.type)])) as out:
            out.write_batch(pa.RecordBatch.from_arrays([ids], ["doc_id"]))
        docs = np.frombuffer(sink.getvalue(), np.uint8)
        sizes = np.bincount(slot * _CLASSES + rarity, minlength=slots * _CLASSES).astype(np.int64)
        planes = _planes(numbers)
        del numbers
        yield block, block, slots, _pack(docs, np.concatenate(self.counts).astype(np.int64), sizes, planes)


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", decoded: bool = False) -> DataFrame:
    """(doc_id, ids): for every input row the token ids of its whole text as little-endian 32-bit integers.

    With `decoded` the rows are those of `decode`, made where the ids are put back: a step of its own behind this one
    has every task hold two Python workers, which then stay with the executor. `path` names a tokenizers file whose tokens don't cross ASCII white space. A null or empty text has no ids; null
    and repeated ids keep one result for each row; other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    slots = int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    texts = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    id_kind = texts.schema["doc_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        block = _Block()
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column(1)):
                block.add(batch.column(0).slice(low, high - low), data, offsets)
                if block.size >= BLOCK_BYTES:
                    for row in block.rows(name, slots):
                        yield _rows([row])
                    name, block = name + 1, _Block()
                    give_back()
        if block.ids:
            for row in block.rows(name, slots):
                yield _rows([row])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["slot"] == slots:
                    yield _rows([(row["block"], row["block"], slots, row["payload"])])
                    continue
                words = zstandard.decompress(row["payload"]).split(b"\n")
                new = [w for w in words if w not in known]
                for i in range(0, len(new), 4096):
                    part = new[i : i + 4096]
                    for w, found in zip(part, tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                        known[w] = np.array(found.ids, np.uint32)
                ids = [known[w] for w in words]
                lengths = np.array([len(x) for x in ids], np.uint32)
                yield _rows([(row["block"], row["block"], row["slot"], _pack(_planes(lengths), _planes(np.concatenate(ids))))])

    def put_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ids = [], []
        spelling = _spelling(path) if decoded else None
        for batch in batches:
            for row in batch.to_pylist():
                if row["slot"] < slots:
                    one = [_from_planes(x) for x in _unpack(row["payload"], np.uint8, np.uint8)]
                    lengths.append(one[0])
                    ids.append(one[1])
                    continue
                head, counts, sizes, planes = _unpack(row["payload"], np.uint8, np.int64, np.int64, np.uint8)
                names = pa.ipc.open_stream(head.tobytes()).read_next_batch().column(0)
                numbers = _from_planes(planes)
                # words came slot by slot, frequent ones first; their numbers go by frequency over all slots
                rarity = np.repeat(np.arange(len(sizes)) % _CLASSES, sizes)
                by_number = np.argsort(rarity, kind="stable")
                size = np.concatenate([np.empty(0, np.uint32), *lengths]).astype(np.int64)
                flat = np.concatenate([np.empty(0, np.uint32), *ids])
                starts = (np.cumsum(size) - size)[by_number]
                size = size[by_number]
                ends = np.cumsum(counts)
                low = 0
                while low < len(counts):  # a few texts at a time
                    begin = ends[low] - counts[low]
                    high = max(low + 1, int(np.searchsorted(ends, begin + 300_000, "right")))
                    part = numbers[begin : ends[high - 1]]
                    take = size[part]
                    till = np.cumsum(take)
                    at = np.arange(till[-1] if len(till) else 0) + np.repeat(starts[part] - (till - take), take)
                    cuts = np.concatenate([[0], till])[np.concatenate([[0], ends[low:high] - begin])] * 4
                    raw = pa.BinaryArray.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(flat[at].tobytes())])
                    one = pa.RecordBatch.from_arrays([names.slice(low, high - low), raw], ["doc_id", "ids"])
                    yield from _decoded(one, spelling) if decoded else [one]
                    low = high
                lengths, ids = [], []

    packed = texts.mapInArrow(tidy(split), _PACKED)
    encoded = packed.repartition(slots, "target").mapInArrow(tidy(look_up), _PACKED)
    sorted_back = encoded.repartition(slots, "target").sortWithinPartitions("block", "slot")
    return sorted_back.mapInArrow(tidy(put_back), f"doc_id {id_kind}, ids binary" + ", decoded string" * decoded)


def _spelling(path: str) -> pa.Array:
    """The piece of each id."""
    tokenizer = _tokenizer(path)
    return pa.array([tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size(with_added_tokens=True))])


def _decoded(batch: pa.RecordBatch, spelling: pa.Array) -> Iterator[pa.RecordBatch]:
    """The rows of (doc_id, ids) with their text, some at a time."""
    values = batch.column(1).cast(pa.large_binary())
    size = pc.fill_null(pc.binary_length(values), 0).to_numpy().astype(np.int64) // 4
    ends = np.cumsum(size)
    low = 0
    while low < len(size):
        begin = ends[low] - size[low]
        high = max(low + 1, int(np.searchsorted(ends, begin + 300_000, "right")))
        ids = np.frombuffer(b"".join(v for v in values.slice(low, high - low).to_pylist() if v), np.uint32)
        cuts = np.concatenate([[0], ends[low:high] - begin])
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spelling.take(pa.array(ids)))
        yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in batch.columns), pc.binary_join(lists, " ")], ["doc_id", "ids", "decoded"])
        low = high


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): ids joined with the vocabulary's pieces, special tokens included, a blank between pieces."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = _spelling(path)
        for batch in rows:
            yield from _decoded(batch, spelling)

    id_kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(tidy(batches), f"doc_id {id_kind}, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    return encode(docs, path, decoded=True).select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
