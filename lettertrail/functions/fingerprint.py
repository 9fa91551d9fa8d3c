"""Shingles, MinHash signatures and LSH band keys."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from .text import bind, pin

# Shingle width, signature size, and bands. Two signatures that agree in 47 of the 64 places differ in 17,
# so of 18 bands at least one is equal: a join on bands misses no pair of Jaccard estimate 0.72 or more.
SHINGLE_WORDS = 5
PERMUTATIONS = 64
BANDS = 18
PRIME = 2147483647


def _digest28(text: str) -> int:
    return int(md5(text.encode()).hexdigest()[:7], 16)


def coefficients(n: int = PERMUTATIONS) -> list[tuple[int, int]]:
    """The fixed permutation family: (a, b) from the md5 of their own position."""
    return [(1 + _digest28(f"a{i}"), _digest28(f"b{i}")) for i in range(n)]


def _grams(words: Column, k: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))


def shingles(body_norm: Column, k: int = SHINGLE_WORDS) -> Column:
    """Overlapping k-word windows; a body of fewer words is one window, an empty body none."""
    return F.filter(bind(F.split(body_norm, " "), lambda words: _grams(words, k)), lambda gram: gram != "")


def hash28(col: Column) -> Column:
    return F.conv(F.substring(F.md5(col.cast("binary")), 1, 7), 16, 10).cast("long")


def _window_hashes(texts: pd.Series, widths: pd.Series) -> pd.Series:
    fresh = md5()

    def digest(gram):
        # a copy costs less than a new one
        one = fresh.copy()
        one.update(gram)
        return one.digest()

    def one(text, k):
        if not text:
            return np.empty(0, dtype=np.int64)
        data = text.encode()
        gaps = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == ord(" ")).tolist()
        starts, ends = [0, *(gap + 1 for gap in gaps)], [*gaps, len(data)]
        digests = [digest(data[start:end]) for start, end in zip(starts, ends[k - 1 :] or ends[-1:])]
        return pd.unique(np.frombuffer(b"".join(digests), dtype=">u4")[::4].astype(np.int64) >> 4)

    return pd.Series([one(text, k) for text, k in zip(texts, widths, strict=True)], dtype=object)


# Marked non-deterministic so that the optimiser evaluates it once and does not copy it into later expressions.
window_hashes = pandas_udf(_window_hashes, ArrayType(LongType())).asNondeterministic()


def shingle_hashes(body_norm: Column, k: int = SHINGLE_WORDS) -> Column:
    """The distinct `hash28` of the `shingles`, in order of first appearance."""
    return window_hashes(body_norm, F.lit(k))


def _signature(values: pd.Series) -> pd.Series:
    a, b = (np.array(v, dtype=np.uint64)[:, None] for v in zip(*coefficients()))
    prime, bits = np.uint64(PRIME), np.uint64(31)

    def one(hashes):
        if hashes is None or len(hashes) == 0:
            return None
        low = np.full(PERMUTATIONS, prime, dtype=np.uint64)
        for at in range(0, len(hashes), 512):
            value = a * np.asarray(hashes[at : at + 512]).astype(np.uint64)[None, :]
            value += b
            # the remainder for a prime 2^31 - 1: the upper bits count as ones; one subtraction is left, which wraps if it isn't due
            upper = value >> bits
            value &= prime
            value += upper
            np.subtract(value, prime, out=upper)
            low = np.minimum(low, np.minimum(value, upper, out=value).min(axis=1))
        return low.astype(np.int64)

    return values.map(one)


# Marked non-deterministic so that the optimiser evaluates it once and does not copy it into later expressions.
minhash_signature = pandas_udf(_signature, ArrayType(LongType())).asNondeterministic()


def minhash(body_norm: Column, hashes: Column) -> Column:
    return minhash_signature(F.when(F.length(body_norm) > 0, hashes))


def minhash_jaccard(a: Column, b: Column) -> Column:
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda hit: hit))
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(same / F.lit(float(PERMUTATIONS)))


def band_places(bands: int = BANDS) -> list[range]:
    """The signature places of each band."""
    return [range(PERMUTATIONS * i // bands, PERMUTATIONS * (i + 1) // bands) for i in range(bands)]


def lsh_keys(signature: Column, bands: int = BANDS) -> Column:
    keys = [
        F.concat(F.lit(f"lsh:{i}:"), F.md5(F.concat_ws(",", *[F.get(signature, place).cast("string") for place in places]).cast("binary")))
        for i, places in enumerate(band_places(bands))
    ]
    return F.when(signature.isNotNull(), F.array(*keys))


def containment(a: Column, b: Column, min_shingles: int = 5) -> Column:
    small = F.least(F.size(a), F.size(b))
    return F.when(small < min_shingles, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / small)


def with_fingerprints(emails: DataFrame, body_norm: str = "body_norm") -> DataFrame:
    """Add `hashes` and `signature` for the normalised body column."""
    hashed = emails.withColumn("hashes", pin(shingle_hashes(F.col(body_norm))))
    return hashed.withColumn("signature", minhash(F.col(body_norm), F.col("hashes")))
