"""Alignment of two tokenizers' tokens: brute force, merge paths, odd rows."""

import base64
import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from test_llm import LONG, ODD, SMALL, documents, table
from tokenizers import Tokenizer

from lettertrail.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RANKS = [base64.b64decode(line.split()[0]) for line in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")]


def brute(rows: list[tuple]) -> list[tuple]:
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True

    def piece(i):
        return bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()

    found, counts = [], collections.Counter()
    for i, text in rows:
        text = text or ""
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        raw = (" " + text).encode()
        if not text or b"".join(RANKS[x] for x in a) != raw or b"".join(map(piece, b)) != raw:
            found.append((i, 0, 0, [], []))
            continue
        groups, links, side_a, side_b, x, y = [], [], [], [], 0, 0
        todo_a, todo_b = list(a), list(b)
        while todo_a or todo_b:
            if x <= y and todo_a and not (x == y and side_a):
                side_a.append(todo_a.pop(0))
                x += len(RANKS[side_a[-1]])
            else:
                side_b.append(todo_b.pop(0))
                y += len(piece(side_b[-1]))
            if x == y:
                groups.append((side_a, side_b))
                links.append((side_a[-1], side_b[-1]))
                side_a, side_b = [], []
        counts.update(links)
        found.append((i, len(a), len(b), groups, links))
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for i, n_a, n_b, groups, links in found:
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(told.encode()).hexdigest() if told else ""))
    return sorted(out, key=repr)


def got(spark, rows):
    return sorted((tuple(r) for r in alignment.align(table(spark, rows), A, B).collect()), key=repr)


def test_documents_brute_force(spark):
    rows = documents(spark)
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 100)
    rows = [*ODD, (9, "</s><s> <|endoftext|> <unk> <0x41>"), (10, "▁x ▁"), (11, "\x00\t\r\n  日本語 é 😀 é"), (12, " "), (13, "a" * 20_000), (14, " " * 3000 + "x")]
    out = got(spark, rows)
    assert out == brute(rows)
    assert {r[0]: r[1] for r in out}[10] == 0 and {r[0]: r[7] for r in out}[3] == ""
    assert alignment.align(table(spark, []), A, B).collect() == []


def test_without_the_fast_library(monkeypatch):
    texts = [LONG[:5000], "x\n\n y's <|endoftext|>", ""]
    a, b = alignment._ByteLevel(A), alignment._Pieces(B)
    assert a.fast is not None
    fast = a.encode(texts)
    a.fast = None
    assert a.encode(texts) == fast
    whole, parts = alignment.aligned(texts, a, b), alignment.aligned(texts, a, b, piece=7)
    assert all((x == y).all() for x, y in zip(whole, parts, strict=True))


@pytest.mark.parametrize("seed", range(20))
def test_merge_paths(seed):
    rng = random.Random(seed)
    a, b = (np.array(sorted(rng.sample(range(200), rng.randrange(0, 90))), np.int64) for _ in range(2))
    for piece in (1, 2, 3, 16, 1000):
        i, j = alignment.merge_cuts(a, b, piece)
        steps = np.diff(i + j)
        assert i[-1] == len(a) and j[-1] == len(b) and (steps <= piece + 1).all() and (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all()
        for x, y in zip(i.tolist(), j.tolist()):  # nothing behind a cut is smaller than, or equal to, what stands before it
            assert max([*a[:x], *b[:y]], default=-1) < min([*a[x:], *b[y:]], default=999)
        at_a, at_b = alignment.overlaps(a, b, piece)
        assert a[at_a].tolist() == b[at_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
