"""Near duplicates in hot groups, and rows that share an id."""

import random

from brute import components
from test_llm import WORDS, table
from test_parity_join import changed

from lettertrail.llm import buckets, near_dedup, passages


def test_hot_groups(spark, monkeypatch):
    """700 near copies of one text and 400 texts of one template, dealt to small pieces."""
    monkeypatch.setattr(buckets, "CHUNK", 64)
    rng = random.Random(11)
    base, template = rng.choices(WORDS, k=150), rng.choices(WORDS, k=90)
    texts = [changed(base, rng.randrange(9), rng) for _ in range(700)]
    texts += [" ".join([*template, *rng.choices(WORDS, k=rng.choice([8, 16, 24]))]) for _ in range(400)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(table(spark, rows), width=4).collect()}
    assert got == components(rows, 4)


def test_one_id_with_two_texts(spark):
    rng = random.Random(5)
    one, two, three = (" ".join(rng.choices(WORDS, k=80)) for _ in range(3))
    rows = [(1, one), (2, one + " more"), (2, two), (3, three), (3, three), (None, one), (None, "x y")]
    kept = near_dedup.keep_one(table(spark, rows))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(1, one), (2, two), (3, three), (3, three), (None, one), (None, "x y")], key=repr)
    assert kept.columns == table(spark, []).columns


def test_passages_of_one_id_with_two_texts(spark):
    rng = random.Random(6)
    one, two = rng.choices(WORDS, k=200), rng.choices(WORDS, k=10)
    rows = [(1, " ".join(one)), (2, " ".join([*one, *two])), (2, " ".join(two)), (None, " ".join(one)), (3, None)]
    got = [(r["doc_id"], r["text"].strip() if r["text"] else None) for r in passages.without_repeats(table(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted([(1, " ".join(one)), (2, " ".join(two)), (2, " ".join(two)), (None, " ".join(one)), (3, None)], key=repr)
