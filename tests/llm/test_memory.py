"""What a task holds: Python workers side by side, a block of texts, the hash's tables."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from test_llm import BPE, ODD, WORDS, table

from lettertrail.llm import word_bpe, words


def test_one_python_worker_a_task(spark):
    digests = word_bpe.digests(table(spark, ODD), BPE)
    plan = digests._jdf.queryExecution().executedPlan().toString()
    steps = re.findall(r"MapInArrow|Exchange", plan)
    assert steps == ["MapInArrow", "Exchange"] * 2 + ["MapInArrow"]


@pytest.mark.parametrize("rows", [ODD, []])
def test_decoded_at_once_as_in_two_steps(spark, rows):
    docs = table(spark, rows)
    one, two = word_bpe.encode(docs, BPE, decoded=True), word_bpe.decode(word_bpe.encode(docs, BPE), BPE)
    assert one.columns == two.columns
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_block_does_not_hold_words_twice():
    text = " ".join(random.Random(1).choices(WORDS, k=100_000)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    block = word_bpe._Block()
    for i in range(10):
        block.add(pa.array([i]), data, offsets)
    tracemalloc.start()
    for _ in block.rows(0, 16):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * 1_000_000  # bytes for each of a million words


def test_block_holds_a_word_once_and_packs_without_copies():
    size = 8 << 20
    text = " ".join(random.Random(2).choices([f"{w}{i}" for w in WORDS for i in range(40_000 // len(WORDS))], k=size // 7)).encode()[:size]
    data, offsets = np.frombuffer(text, np.uint8), np.arange(0, len(text) + 1, len(text) // 512)
    column = pa.array([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    block = word_bpe._Block()
    tracemalloc.start()
    for low, high, piece, cuts in words.pieces(column):
        block.add(pa.array(range(low, high)), piece, cuts)
    held = tracemalloc.get_traced_memory()[0]
    for _ in block.rows(0, 16):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 2.5 * size and peak < 4 * size, (held / size, peak / size)


def test_memory_is_given_back_after_the_last_batch(monkeypatch):
    seen = []
    monkeypatch.setattr(words, "give_back", lambda: seen.append("back"))
    assert list(words.tidy(lambda stream: (x + 1 for x in stream))(iter([1, 2]))) == [2, 3] and seen == ["back"]


def test_block_lets_go_of_its_batch():
    ids = pa.RecordBatch.from_arrays([pa.array([1, None]), pa.array(["a b", "c"])], ["doc_id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, ids.schema) as out:
        out.write_batch(ids)
    batch = pa.ipc.open_stream(sink.getvalue()).read_next_batch()
    block = word_bpe._Block()
    for low, high, data, offsets in words.pieces(batch.column(1)):
        block.add(batch.column(0).slice(low, high - low), data, offsets)
    assert block.ids[0].to_pylist() == [1, None]
    assert block.ids[0].buffers()[1].address != batch.column(0).buffers()[1].address


def test_tables_reach_a_piece_only(monkeypatch):
    monkeypatch.setattr(words._Powers, "up", np.ones(1, np.uint64))
    monkeypatch.setattr(words._Powers, "down", np.ones(1, np.uint64))
    text = (b"ab cd " * (words.PIECE_BYTES // 6 + 1))[: words.PIECE_BYTES]
    found = words.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(np.unique(found.hashes)) == 3  # the last word is cut short
    assert len(words._Powers.up) == len(words._Powers.down) == words.PIECE_BYTES
