"""Quality rules as a ledger of failure bits and measurements.

Every rule is evaluated once for each document and leaves one bit. A policy is a versioned set of bits: applying
another policy, or asking what a policy would keep without one of its rules, reads the stored bits, never the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Words, keyed, limit_batches, pieces, tidy

# Bit of each rule, and what a document fails by.
RULES = {
    "few_words": 0,  # under 10 words
    "repeated_windows": 1,  # over 20 % of the words stand in 5-word windows that occur twice
    "symbols": 2,  # one symbol of # * $ % & | < > for each four words or more
    "exclamations": 3,  # an exclamation mark for each four words or more
    "repeated_lines": 4,  # over half of the lines with words repeat an earlier line, of four lines at least
    "word_length": 5,  # mean word length outside 2 to 20 characters
    "few_letters": 6,  # under half of the words hold a letter or a character beyond ASCII
    "upper_case": 7,  # over 60 % of the ASCII letters are capitals, of 50 letters at least
}
BASE = ("few_words", "repeated_windows")
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "exclamations", "repeated_lines", "word_length", "few_letters", "upper_case"),
}
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations",
    "n_letter_words", "n_letters", "n_capitals",
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_LETTER = _CAPITAL.copy()
_LETTER[97:123] = True
_SPELLS = _LETTER.copy()
_SPELLS[128:] = True
_LEAD = np.ones(256, bool)  # bytes that begin a character
_LEAD[0x80:0xC0] = False


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    words = Words(data, offsets)
    rows = len(offsets) - 1
    inside = np.zeros(len(data) + 1, np.int32)
    inside[words.starts] += 1
    np.subtract.at(inside, words.ends, 1)
    out = {
        "n_words": words.counts,
        "word_chars": words.per_row(_LEAD[data] & (np.cumsum(inside[:-1]) > 0)),
        "n_symbols": words.per_row(_SYMBOL[data]),
        "n_exclamations": words.per_row(data == 0x21),
        "n_letters": words.per_row(_LETTER[data]),
        "n_capitals": words.per_row(_CAPITAL[data]),
    }

    spelled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SPELLS[data], out=spelled[1:])
    out["n_letter_words"] = np.bincount(words.doc[spelled[words.ends] > spelled[words.starts]], minlength=rows)

    breaks = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    row = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], offsets[row + 1])
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, row = starts[has_word], ends[has_word], row[has_word]
    distinct = np.unique(keyed(row, words.hash_spans(starts, ends)), return_index=True)[1]
    out["n_lines"] = np.bincount(row, minlength=rows)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(row[distinct], minlength=rows)

    at, h = words.windows(5)
    _, which, times = np.unique(keyed(words.doc[at], h), return_inverse=True, return_counts=True)
    again = at[times[which] > 1]
    cover = np.zeros(len(words.starts) + 6, np.int32)
    np.add.at(cover, again, 1)
    np.subtract.at(cover, again + 5, 1)
    covered = np.cumsum(cover)[: len(words.starts)] > 0
    out["n_repeat_words"] = np.bincount(words.doc[covered], minlength=rows)
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, text = batch.column(0), batch.column(1)
        for low, high, data, offsets in pieces(text):
            found = measure(data, offsets)
            columns = [pa.array(found[name].astype(np.int64)) for name in MEASURES]
            yield pa.RecordBatch.from_arrays([kept.slice(low, high - low), *columns], ["kept_row", *MEASURES])


def _failures() -> dict[str, Column]:
    c = F.col
    return {
        "few_words": c("n_words") < 10,
        "repeated_windows": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "symbols": (c("n_symbols") > 0) & (4 * c("n_symbols") >= c("n_words")),
        "exclamations": (c("n_exclamations") > 0) & (4 * c("n_exclamations") >= c("n_words")),
        "repeated_lines": (c("n_lines") >= 4) & (2 * c("n_dup_lines") > c("n_lines")),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words")),
        "few_letters": 2 * c("n_letter_words") < c("n_words"),
        "upper_case": (c("n_letters") >= 50) & (10 * c("n_capitals") > 6 * c("n_letters")),
    }


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, measurements..., failed_bits): one ledger row for each input row; `row` holds all columns as they came.

    Null texts count as empty: no words, so `few_words` fails. Input columns may have any names, since they stay
    inside `row`; repeated rows give repeated ledger rows; an empty table gives an empty ledger.
    """
    limit_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("kept_row"), docs[text].cast("string").alias("text"))
    measures = ", ".join(f"{name} bigint" for name in MEASURES)
    kind = rows.schema["kept_row"].dataType.simpleString()
    measured = rows.mapInArrow(tidy(_batches), f"kept_row {kind}, {measures}")
    bits = sum((F.when(failed, F.lit(1 << RULES[name])).otherwise(F.lit(0)) for name, failed in _failures().items()), F.lit(0))
    return measured.withColumn("failed_bits", bits.cast("long")).withColumnRenamed("kept_row", "row")


def mask(policy: str) -> int:
    return sum(1 << RULES[name] for name in POLICIES[policy])


def passes(policy: str, bits: str = "failed_bits") -> Column:
    """Whether a ledger row passes every rule of a policy."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """(rule, n_failed, n_alone, n_kept_without): what each rule of a policy rejects, and what would be kept without it.

    The ledger is first counted by bit pattern (at most 2**rules groups, summed before the shuffle).
    """
    counts = rows.groupBy("failed_bits").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << RULES[name]).alias("bit")) for name in POLICIES[policy]])).alias("r")
    whole = F.lit(mask(policy))
    of = counts.select("failed_bits", "n", rules).select("failed_bits", "n", "r.*")
    failed = F.col("failed_bits").bitwiseAND(whole)
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return of.groupBy("rule").agg(
        count(failed.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(failed == F.col("bit")).alias("n_alone"),
        count(failed.bitwiseAND(whole.bitwiseXOR(F.col("bit"))) == 0).alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """`docs` without the rows that a policy rejects, columns unchanged."""
    return ledger(docs, text).filter(passes(policy)).select("row.*")
