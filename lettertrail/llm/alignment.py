"""Tokens of two tokenizers aligned by the byte offsets where both end.

The token ends of both sides are two sorted lists over the same bytes (texts of a block one behind the other). Merging
them is divided by merge paths: on the diagonal of each multiple of `PIECE` merge steps a binary search finds how many
of those steps each side has made, so pieces of equal work are independent of each other and of where texts begin. A
piece gives out the ends that both sides have, its overlaps; groups that run over pieces are stitched by a running
number over the overlaps of all pieces.

How often an id pair is linked in the whole corpus, and which count is the highest of a B id, needs all texts. A block
sends each of its distinct pairs once with its number, the counts come back to the block, and only there meet the
block's texts. Texts and token ids are never shuffled, only groups' digests and pair numbers.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import store
from .words import limit_batches, pieces

PIECE = 1 << 16  # merge steps
BLOCK_BYTES = 8 << 20

# How byte-level pieces spell bytes. Bytes without a visible Latin-1 character take those from U+0100 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


class _Ids:
    """The bytes of each id of a tokenizer."""

    def __init__(self, spelled: list[bytes]):
        self.spelled = spelled
        self.size = np.array([len(x) for x in spelled], np.int64)


class _ByteLevel(_Ids):
    """A byte-level tokenizers file; texts get a leading space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.model.no_truncation()
        self.model.no_padding()
        hidden = [b for b in range(256) if b not in set(_SHOWN)]
        byte = {chr(b): b for b in _SHOWN} | {chr(0x100 + i): b for i, b in enumerate(hidden)}
        pieces_ = [self.model.id_to_token(i) for i in range(self.model.get_vocab_size(with_added_tokens=True))]
        special = {token.content for token in self.model.get_added_tokens_decoder().values()}
        super().__init__([(p or "").encode() if p in special or p is None else bytes(byte[c] for c in p) for p in pieces_])
        self.fast = self._merges_only(special)

    def _merges_only(self, special: set[str]):
        """The same merges run by another library, several times as fast, where the package names the split pattern."""
        try:
            import public_tokenizers
            import tiktoken

            ranks = {raw: i for i, raw in enumerate(self.spelled) if self.model.id_to_token(i) not in special}
            fast = tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (ImportError, AttributeError, ValueError):
            return None
        probe = " Don't  stop\n\n at 1234 déjà-vu 日本 <|endoftext|> 'tis _x_\t\r\n "
        return fast if fast.encode_ordinary(probe) == self.model.encode(probe, add_special_tokens=False).ids else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        texts = [" " + text for text in texts]
        if self.fast is not None:
            try:
                return [self.fast.encode_ordinary(text) for text in texts]
            except BaseException as error:  # the library's own panics aren't Exceptions: very long runs of one kind of character
                if isinstance(error, KeyboardInterrupt | SystemExit):
                    raise
        return [found.ids for found in self.model.encode_batch(texts, add_special_tokens=False)]


class _Pieces(_Ids):
    """A sentencepiece model that adds the leading space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        byte = lambda i: bytes([int(self.model.id_to_piece(i)[3:5], 16)])
        super().__init__([byte(i) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in range(self.model.vocab_size())])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def _models(path_a: str, path_b: str) -> tuple[_ByteLevel, _Pieces]:
    return _ByteLevel(path_a), _Pieces(path_b)


def merge_cuts(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How far each of the sorted lists is taken when k * piece steps of their merge are made, equal values of both together.

    The steps before diagonal d are i of `a` and d - i of `b`; i is found by a binary search, for all diagonals at once.
    """
    d = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        open_ = low < high
        # of equal values a's comes first
        take = open_ & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(d - mid - 1, 0, len(b) - 1)])
        low, high = np.where(take, mid + 1, low), np.where(open_ & ~take, mid, high)
    i, j = low, d - low
    # a diagonal between two equal values moves behind the second one
    if len(a) and len(b):
        same = (i > 0) & (j < len(b)) & (a[np.maximum(i - 1, 0)] == b[np.minimum(j, len(b) - 1)])
        j = j + same
    return i, j


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Positions in `a` and in `b` of the values that both strictly rising lists hold, piece by piece."""
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    i, j = merge_cuts(a, b, piece)
    for a0, a1, b0, b1 in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist(), strict=True):
        if a0 == a1 or b0 == b1:
            continue
        at = np.searchsorted(b[b0:b1], a[a0:a1])
        both = np.flatnonzero(b[b0:b1][np.minimum(at, b1 - b0 - 1)] == a[a0:a1])
        out_a.append(a0 + both)
        out_b.append(b0 + at[both])
    return np.concatenate(out_a), np.concatenate(out_b)


def _spelled(ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of decimal numbers below 100,000, each with the byte `after` it."""
    digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    rest = ids.copy()
    for k in range(5):
        on = digits > k
        out[ends[on] - 2 - k] = 48 + rest[on] % 10
        rest //= 10
    out[ends - 1] = after
    return out, ends


def aligned(texts: list[str], a: _Ids, b: _Ids, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """Of texts: token counts of both sides, groups, links, group digests; then the pairs (a << 32 | b) of all links in order."""
    found_a, found_b = a.encode(texts), b.encode(texts)
    none = [not text or b"".join(map(a.spelled.__getitem__, x)) != (raw := (" " + text).encode()) or b"".join(map(b.spelled.__getitem__, y)) != raw for text, x, y in zip(texts, found_a, found_b, strict=True)]
    found_a, found_b = [[] if no else x for no, x in zip(none, found_a, strict=True)], [[] if no else x for no, x in zip(none, found_b, strict=True)]
    n_a, n_b = np.array([len(x) for x in found_a], np.int64), np.array([len(x) for x in found_b], np.int64)
    ids_a, ids_b = np.fromiter((i for x in found_a for i in x), np.int64, int(n_a.sum())), np.fromiter((i for x in found_b for i in x), np.int64, int(n_b.sum()))
    # texts without tokens have no bytes on either side, so all texts' ends are one rising list
    at_a, at_b = overlaps(np.cumsum(a.size[ids_a]), np.cumsum(b.size[ids_b]), piece)
    text_of = np.searchsorted(np.cumsum(n_a), at_a, "right")
    groups = np.bincount(text_of, minlength=len(texts))
    pairs = ids_a[at_a] << 32 | ids_b[at_b]
    # tokens in the order of the digest: a group's A ids, then its B ids
    size_a, size_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
    end = np.cumsum(size_a + size_b)
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    order[np.arange(len(ids_a)) + np.repeat(np.cumsum(size_b) - size_b, size_a)] = ids_a
    order[np.arange(len(ids_b)) + np.repeat(np.cumsum(size_a), size_b)] = ids_b
    after = np.full(len(order), ord(","), np.uint8)
    after[end - size_b - 1] = ord("|")
    after[end - 1] = ord(";")
    raw, cuts = _spelled(order, after)
    last = np.concatenate([[0], cuts])[np.cumsum(n_a + n_b)]
    first = np.concatenate([[0], last[:-1]])
    raw = raw.tobytes()
    digests = [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(first.tolist(), last.tolist(), strict=True)]
    return n_a, n_b, groups, np.array(digests, object), pairs


_DOC = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string())]


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row for each input row.

    `path_a` is a byte-level tokenizers file, given space + text; `path_b` a sentencepiece model that adds the space.
    Neither gives special tokens. A null or empty text, or one whose tokens don't spell space + text, has no tokens:
    zeros and ''. Null and repeated ids keep one result for each row, and repeated rows count again in the corpus;
    other columns aren't read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    id_kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _models(path_a, path_b)
        name = TaskContext.get().partitionId() << 32
        size, held, links = 0, [], []

        def block() -> pa.RecordBatch:
            pairs = np.concatenate(links)
            distinct, number, times = np.unique(pairs, return_inverse=True, return_counts=True)
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(held)
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            packed = zstandard.compress(sink.getvalue(), 1)
            planes = np.ascontiguousarray(number.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
            listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([packed], pa.binary()), pa.array([zstandard.compress(planes.tobytes(), 3)], pa.binary()), listed(distinct), listed(times.astype(np.int64))],
                ["block", "texts", "links", "pairs", "times"])

        for batch in batches:
            for low, high, data, offsets in pieces(batch.column(1)):
                texts = ["" if x is None else x for x in batch.column(1).slice(low, high - low).to_pylist()]
                *columns, pairs = aligned(texts, a, b)
                held.append(pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *(pa.array(c, kind) for c, (_, kind) in zip(columns, _DOC, strict=True))], ["doc_id", *(n for n, _ in _DOC)]))
                links.append(pairs)
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield block()
                    name, size, held, links = name + 1, 0, [], []
        if held:
            yield block()

    blocks = store(rows.mapInArrow(encode, "block bigint, texts binary, links binary, pairs array<bigint>, times array<bigint>"))
    sent = blocks.select("block", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("block", "p.pairs", "p.times")
    counts = store(sent.groupBy("pairs").agg(F.sum("times").alias("count")))
    right = F.col("pairs").bitwiseAND(0xFFFFFFFF)
    best = counts.groupBy(right.alias("b")).agg(F.max("count").alias("most"))
    judged = counts.join(best, right == F.col("b")).select("pairs", "count", (F.col("count") == F.col("most")).alias("best"))
    told = sent.select("block", "pairs").join(judged, "pairs")
    kinds = [F.lit(None).cast("binary").alias("texts"), F.lit(None).cast("binary").alias("links")]
    back = told.select("block", F.lit(0).alias("last"), "pairs", "count", "best", *kinds).union(
        blocks.select("block", F.lit(1), F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), F.lit(None).cast("boolean"), "texts", "links"))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            low = 0
            for at in np.flatnonzero(batch.column("last").to_numpy() == 1).tolist():
                held.append(batch.slice(low, at - low))
                low = at + 1
                count, is_best = (np.concatenate([part.column(c).to_numpy(zero_copy_only=False) for part in held]) for c in ("count", "best"))
                held = []
                planes = np.frombuffer(zstandard.decompress(batch.column("links")[at].as_py()), np.uint8)
                number = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()
                table = pa.ipc.open_stream(zstandard.decompress(batch.column("texts")[at].as_py())).read_all().combine_chunks()
                ends = np.cumsum(table["n_groups"].to_numpy())
                per_text = lambda values, ends=ends: np.diff(np.concatenate([[0], np.cumsum(values.astype(np.int64))])[np.concatenate([[0], ends])])
                best_links, sums = (per_text(values[number]) if len(number) else np.zeros(len(ends), np.int64) for values in (is_best, count))
                columns = [table[c].combine_chunks() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_groups")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(best_links, pa.int64()), pa.array(sums, pa.int64()), table["groups_sha256"].combine_chunks()],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
            held.append(batch.slice(low))

    # a block's pairs come in the order of their numbers, its texts behind them
    spread = back.repartition("block").sortWithinPartitions("block", "last", "pairs")
    return spread.mapInArrow(tell, f"doc_id {id_kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
