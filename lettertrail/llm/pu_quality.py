"""Text quality learned from trusted positives and unlabelled text.

Documents labelled good are the positives; a sample of the whole corpus is the unlabelled text. With the class prior
pi, estimated as the share of good documents among the training labels, the risk

    pi * E_positive[loss(+)] + max(0, E_unlabelled[loss(-)] - pi * E_positive[loss(-)])

is unbiased but for the max, which keeps its second part from going negative (non-negative risk): when that part
falls below zero the step goes against it instead. Bad labels only count towards pi.

Samples are bounded (`POSITIVES`, `UNLABELLED`) and chosen by id hash; scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import measure
from .sampling import first_by_hash, labelled
from .words import Words, keyed, limit_batches, pieces

POSITIVES = 4000
UNLABELLED = 12000
ROUNDS = 1500
RATE = 0.05
RIDGE = 1e-4


@dataclass
class QualityModel:
    """Centre and spread of the features, weights and intercept."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers for each text: shares of symbols, capitals, repeats, short and distinct words, and the like."""
    m = {name: values.astype(float) for name, values in measure(data, offsets).items()}
    words = Words(data, offsets)
    rows = len(offsets) - 1
    n = np.maximum(1, m["n_words"])
    count = lambda flags: np.bincount(words.doc[flags], minlength=rows) / n
    size = words.ends - words.starts
    same = np.zeros(len(size), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    first = np.zeros(len(size), bool)
    first[np.unique(keyed(words.doc, words.hashes), return_index=True)[1]] = True
    per_word = lambda flags: words.per_row(flags) / n
    shares = [
        m["n_symbols"] / n, m["n_exclamations"] / n, m["n_repeat_words"] / n, m["n_letter_words"] / n,
        m["n_capitals"] / np.maximum(1, m["n_letters"]), m["n_dup_lines"] / np.maximum(1, m["n_lines"]),
        count(same), count(first), count(size <= 2), count(size <= 4), count(size >= 12),
        per_word(data == 0x7C), per_word(data == 0x2C), per_word(data == 0x2E), per_word(data == 0x0A),
        per_word((data >= 0x30) & (data <= 0x39)), per_word(data >= 0x80),
    ]
    lengths = [np.log1p(m["n_words"]), m["word_chars"] / n, np.log1p(m["n_lines"])]
    shares = np.column_stack(shares)
    return np.column_stack([shares, np.sqrt(np.minimum(shares, 4.0)), np.column_stack(lengths)])


N_FEATURES = features(np.frombuffer(b"a", np.uint8), np.array([0, 1])).shape[1]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in pieces(batch.column(1)):
            values = [row.tobytes() for row in features(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(values, pa.binary())], ["kind", "x"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of the least non-negative risk, by Adam over the whole sample."""
    x = np.vstack([positive, unlabelled])
    x = np.column_stack([x, np.ones(len(x))])
    p, u = x[: len(positive)], x[len(positive) :]
    w, first, second = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, ROUNDS + 1):
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        negative = -np.log(np.maximum(1e-12, 1 - su)).mean() + prior * np.log(np.maximum(1e-12, 1 - sp)).mean()
        slope_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        slope_positive = -prior * (p.T @ (1 - sp)) / len(p)
        slope = slope_positive + slope_negative if negative >= 0 else -slope_negative
        slope[:-1] += RIDGE * w[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w -= RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> QualityModel:
    """A model from `labels` (doc_id, quality) and the texts of `docs` (doc_id, text).

    Without a positive label every text scores 0; when all labels are positive the prior is 0.99.
    """
    limit_batches(docs.sparkSession)
    picked, counts = labelled(labels, "quality", positives)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if not counts.get(1):
        return QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), -30.0)
    prior = min(0.99, counts[1] / sum(counts.values()))
    ids = texts.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    wanted = picked.filter("y = 1").select("doc_id", F.lit(1).alias("kind")).union(
        first_by_hash(ids, "doc_id", unlabelled).select("doc_id", F.lit(0).alias("kind")))
    table = texts.join(F.broadcast(wanted), "doc_id").select("kind", "text").mapInArrow(_rows, "kind int, x binary").toArrow()
    kind = table["kind"].to_numpy()
    x = np.array([np.frombuffer(v) for v in table["x"].to_pylist()]).reshape(len(kind), N_FEATURES)
    centre, spread = x.mean(0), np.maximum(1e-6, x.std(0))
    x = np.clip((x - centre) / spread, -8, 8)
    weights, bias = minimise(x[kind == 1], x[kind == 0], prior)
    return QualityModel(centre, spread, weights, bias)


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """(row, score): every input row with a score from 0 to 1; null counts as the empty text.

    `row` holds the input columns whatever their names; repeated rows are scored alike; an empty table stays empty.
    """
    limit_batches(docs.sparkSession)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for low, high, data, offsets in pieces(batch.column(1)):
                x = np.clip((features(data, offsets) - model.centre) / model.spread, -8, 8)
                scores = _sigmoid(x @ model.weights + model.bias)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(scores)], ["row", "score"])

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(batches, f"row {rows.schema['row'].dataType.simpleString()}, score double")
