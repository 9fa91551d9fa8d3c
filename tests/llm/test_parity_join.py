"""Set overlap join through parity sketches: checking SQL, odd rows, hot groups, small pieces."""

import random

import numpy as np
import pytest
from brute import components, shingles
from llm_compare import compare, connect
from test_llm import LONG, ODD, SMALL, WORDS, table

from lettertrail.llm import buckets, parity_join


def classes(spark, rows, width=4, percent=85):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.jaccard_classes(table(spark, rows), width, percent).collect()}


def wanted(rows, width=4, percent=85):
    return {i: found[:2] for i, found in components(rows, width, percent).items()}


def test_against_sql(spark):
    assert compare(spark, connect(SMALL), SMALL, "op12_jaccard_join") is None


def changed(words, n, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = rng.choice(WORDS) + "x"
    return " ".join(words)


@pytest.mark.parametrize("chunk", [8, 512])
def test_hot_groups(spark, monkeypatch, chunk):
    """Near copies of one text, a template with own words, a passage that a third of the texts share, and chains."""
    monkeypatch.setattr(buckets, "CHUNK", chunk)
    rng = random.Random(chunk)
    base, template, passage = (rng.choices(WORDS, k=n) for n in (150, 90, 60))
    texts = [changed(base, rng.randrange(9), rng) for _ in range(150)]
    texts += [" ".join([*template, *rng.choices(WORDS, k=rng.choice([4, 8, 12, 30]))]) for _ in range(100)]
    texts += [" ".join([*passage, *rng.choices(WORDS, k=60)]) for _ in range(150)]
    chain = rng.choices(WORDS, k=200)
    texts += [" ".join(chain[i : i + 120]) for i in range(0, 80, 4)]
    texts += [" ".join(rng.choices(WORDS[:4], k=rng.randrange(1, 12))) for _ in range(80)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert classes(spark, rows) == wanted(rows)


def test_odd_rows(spark):
    out = parity_join.jaccard_classes(table(spark, [*ODD, (9, LONG + " tail")]), 4, 85).collect()
    assert len(out) == len(ODD) + 1
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out} == {
        (1, 3, 1), (5, 3, 1), (None, 3, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (8, 0, 8), (None, 0, None), (7, 1, 7),
        (6, len(shingles(LONG, 4)), 6), (9, len(shingles(LONG, 4)) + 1, 6)}
    assert parity_join.jaccard_classes(table(spark, []), 4, 85).collect() == []


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_bands_hold_every_linkable_pair(percent):
    """Sets of linkable sizes share a band whose k is the largest difference they may have."""
    bands = {}
    for rows, band, k in parity_join._bands(np.arange(400), percent):
        for n, b, most in zip(rows.tolist(), band.tolist(), k.tolist()):
            bands.setdefault(n, {})[b] = most
    for a in range(1, 400):
        for b in range(a, min(399, 100 * a // percent) + 1):
            shared = a  # the smaller set inside the larger one
            if 100 * shared >= percent * (a + b - shared):
                most = parity_join._differ(a + b, percent)
                assert any(bands[a][band] >= most for band in bands[a].keys() & bands[b].keys()), (a, b)

