"""Toxicity by a classifier that is regularised with counterfactual sentences.

A linear model over the words of a text and the beginnings of its words (four and five bytes). For every labelled text that names
a group, the same text with another group in its place is formed, and the squared change of the score between the two
is part of the loss. Which group a text names therefore moves its score as little as the labels allow.

The sample is bounded (`PER_CLASS` labelled texts of each label, chosen by id hash), so fitting is one small job
whatever the corpus; scoring is one pass over the corpus without a shuffle.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled
from .words import NOT_ALNUM, Words, limit_batches, pieces

BUCKETS = 1 << 18
PER_CLASS = 4000
FEATURES = 512
PREFIXES = (4, 5)
RIDGE = 1.0
FAIRNESS = 10.0

# Words that name a group, in the languages of the corpus.
IDENTITY_TERMS = (
    "women", "men", "woman", "man", "girls", "boys", "gay", "lesbian", "straight", "transgender", "black", "white",
    "asian", "african", "european", "latino", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist",
    "immigrants", "refugees", "disabled", "deaf", "blind", "old", "young", "femmes", "hommes", "noirs", "blancs",
    "musulmans", "chrétiens", "juifs", "immigrés", "frauen", "männer", "schwarze", "weiße", "muslime", "christen",
    "juden", "flüchtlinge", "mujeres", "hombres", "negros", "blancos", "musulmanes", "cristianos", "judíos", "inmigrantes",
)


@dataclass
class ToxicityModel:
    """`weights` of the feature buckets (most are 0) and the intercept."""

    weights: np.ndarray
    bias: float


def _buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word and of each word beginning."""
    mask = np.uint64(BUCKETS - 1)
    rows, found = [words.doc], [words.hashes]
    for size in PREFIXES:
        long = np.flatnonzero(words.ends - words.starts >= size)
        rows.append(words.doc[long])
        found.append(words.hash_spans(words.starts[long], words.starts[long] + size) * np.uint64(2 * size + 1))
    return np.concatenate(rows), (np.concatenate(found) & mask).astype(np.int64)


def _distinct(rows: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(rows * BUCKETS + buckets)
    return both // BUCKETS, both % BUCKETS


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in pieces(batch.column(1)):
            rows, buckets = _distinct(*_buckets(Words(data, offsets, NOT_ALNUM, lower=True)))
            cuts = np.searchsorted(rows, np.arange(1, high - low))
            sets = [part.astype(np.uint32).tobytes() for part in np.split(buckets, cuts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(sets, pa.binary())], ["y", "buckets"])


def _swaps(sets: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets taken out, buckets put in) for each text and each of three groups in place of the one it names."""
    column = pa.array(IDENTITY_TERMS)
    _, _, data, offsets = next(pieces(column))
    words = Words(data, offsets, NOT_ALNUM, lower=True)
    rows, buckets = _distinct(*_buckets(words))
    terms = [buckets[rows == i] for i in range(len(IDENTITY_TERMS))]
    out = []
    for own in sets:
        named = [i for i, term in enumerate(terms) if np.isin(term, own).all()]
        for i, step in itertools.product(named, (1, 5, 11)):
            out.append((terms[i], terms[(i + step) % len(terms)]))
    return out


def _newton(x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray, change: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Minimise weighted log loss + RIDGE/2 |w|^2 + FAIRNESS/2 mean (w . change)^2; the last column of x is the intercept."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    fair = FAIRNESS * len(y) / max(1, len(change)) * (change.T @ change)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (sample_weight * (p - y)) + ridge * w + fair @ w
        curve = x.T @ (x * (sample_weight * p * (1 - p))[:, None]) + np.diag(ridge) + fair
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """A model from `labels` (doc_id, toxic) and the texts of `docs` (doc_id, text).

    Without labels of both kinds every text scores the same: the share of label 1, or 0.5 without any label.
    """
    limit_batches(docs.sparkSession)
    picked, counts = labelled(labels, "toxic", per_class)
    if len(counts) < 2:
        share = 0.5 if not counts else float(1 in counts)
        return ToxicityModel(np.zeros(BUCKETS, np.float32), 30.0 * (2 * share - 1))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("y", "text")
    table = texts.mapInArrow(_sets, "y int, buckets binary").toArrow()
    y = table["y"].to_numpy().astype(float)
    sets = [np.frombuffer(b, np.uint32).astype(np.int64) for b in table["buckets"].to_pylist()]
    swaps = _swaps(sets)

    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    ones = np.bincount(flat[y[owner] == 1], minlength=BUCKETS)
    zeros = np.bincount(flat[y[owner] == 0], minlength=BUCKETS)
    n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    share = (ones + zeros + 1) / (n1 + n0 + 2)
    gap = (ones / n1 - zeros / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    gap[(ones + zeros) < 3] = 0
    chosen = np.argsort(-np.abs(gap), kind="stable")[:FEATURES]
    chosen = np.unique(np.concatenate([chosen[gap[chosen] != 0], *(b for pair in swaps for b in pair)]).astype(np.int64))

    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(sets), len(chosen) + 1))
    known = place[flat] >= 0
    x[owner[known], place[flat[known]]] = 1
    x[:, -1] = 1
    change = np.zeros((len(swaps), len(chosen) + 1))
    for i, (out, into) in enumerate(swaps):
        change[i, place[out]] -= 1
        change[i, place[into]] += 1
    # the sample holds both labels in like numbers; weights restore their shares
    weight = np.where(y == 1, counts[1] / n1, counts[0] / n0)
    w = _newton(x, y, weight / weight.mean(), change)
    weights = np.zeros(BUCKETS, np.float32)
    weights[chosen] = w[:-1]
    return ToxicityModel(weights, float(w[-1]))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """(row, score): every input row with a score from 0 to 1; a null or empty text scores by the intercept alone.

    `row` holds the input columns whatever their names; repeated rows are scored alike; an empty table stays empty.
    """
    limit_batches(docs.sparkSession)
    weights, bias = model.weights, model.bias

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for low, high, data, offsets in pieces(batch.column(1)):
                row, bucket = _buckets(Words(data, offsets, NOT_ALNUM, lower=True))
                used = weights[bucket] != 0
                row, bucket = _distinct(row[used], bucket[used])
                logit = bias + np.bincount(row, weights[bucket], minlength=high - low)
                scores = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(scores)], ["row", "score"])

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(batches, f"row {rows.schema['row'].dataType.simpleString()}, score double")
