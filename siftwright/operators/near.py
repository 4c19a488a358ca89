"""Near duplicates: shingles, MinHash signatures, banded candidates and masks.

Equal normal texts are one class, named by their hash.  Texts are signed where
they lie, and what follows shuffles hashes and signatures only, never texts.  A
corpus' bands are a table of (band, band key, class); a text of the own corpus
is a near duplicate of another corpus if any of its bands is there, without
emitting pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread
from . import masks

#: Characters of a shingle, permutations, and the weights of the two errors.
SHINGLE, PERMUTATIONS = 7, 128
THRESHOLD, WEIGHTS = 0.7, (0.4, 0.6)
PRIME = 4294967311
SEED = 1
_BLOCK = 4096
#: Signatures a task and hashes of shingles a worker remembers; more are made anew.
_KNOWN, _KEPT = 4096, 500_000


def permutations(n: int = PERMUTATIONS, seed: int = SEED) -> list[tuple[int, int]]:
    """Factors and offsets of the hash family (a * x + b) mod PRIME, which stay within 64 bits for 32-bit x."""
    rng = np.random.RandomState(seed)
    return list(zip(rng.randint(1, 1 << 30, n, dtype=np.int64).tolist(), rng.randint(0, 1 << 31, n, dtype=np.int64).tolist()))


def band_shape(threshold: float = THRESHOLD, weights: tuple[float, float] = WEIGHTS, n: int = PERMUTATIONS) -> tuple[int, int]:
    """Numbers of bands and rows that make the weighted sum of both errors least."""
    s = np.linspace(0, 1, 2001)
    below, above = s[s <= threshold], s[s >= threshold]
    best, shape = np.inf, (1, n)
    for bands in range(1, n + 1):
        for rows in range(1, n // bands + 1):
            hit = lambda x: 1 - (1 - x**rows) ** bands  # noqa: B023, E731
            error = weights[0] * np.trapezoid(hit(below), below) + weights[1] * np.trapezoid(1 - hit(above), above)
            if error < best - 1e-12:
                best, shape = error, (bands, rows)
    return shape


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Distinct overlapping shingles of a text; none for a shorter one."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))."), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; null for two empty ones."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


class _Hashes(dict):
    """32-bit hashes of shingles, kept up to a number, as texts share most of their shingles with others."""

    def __missing__(self, piece: str) -> int:
        x = int.from_bytes(hashlib.sha256(piece.encode("utf-8", "replace")).digest()[:4], "big")
        if len(self) < _KEPT:
            self[piece] = x
        return x


_HASHES = _Hashes()


def signature_of(text: str, factors: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Least hash of each permutation over a text's shingles; the largest value everywhere for a text without any."""
    least = np.full(len(factors), PRIME - 1, dtype=np.int64)
    pieces = {text[k : k + size] for k in range(len(text) - size + 1)}
    if not pieces:
        return least
    x = np.fromiter(map(_HASHES.__getitem__, pieces), dtype=np.int64, count=len(pieces))
    for k in range(0, len(x), _BLOCK):
        np.minimum(least, ((x[k : k + _BLOCK, None] * factors + offsets) % PRIME).min(axis=0), out=least)
    return least


def keyed(corpus: DataFrame, text: str = "normal") -> DataFrame:
    """``key, text`` of each row with a text; the key names its class."""
    return corpus.where(F.col(text).isNotNull()).select(F.sha2(F.col(text), 256).alias("key"), F.col(text).alias("text"))


def signatures(rows: DataFrame, size: int = SHINGLE, n: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """``key, signature`` of each row of ``rows(key, text)``, with its other columns: narrow; shingles live within a row and are never shuffled.

    A class that a task has just signed is not signed again, so that hot copies cost one signature a task.
    """
    family = permutations(n, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factors, offsets = (np.array(v, dtype=np.int64) for v in zip(*family))
        known: dict[str, np.ndarray] = {}
        for pdf in batches:
            out = []
            for key, text in zip(pdf["key"], pdf["text"]):
                if key not in known:
                    if len(known) >= _KNOWN:
                        known.pop(next(iter(known)))
                    known[key] = signature_of(text or "", factors, offsets, size)
                out.append(known[key])
            yield pdf.drop(columns="text").assign(signature=out)

    kept = [f for f in rows.schema if f.name != "text"]
    return spread(rows.select(*[f.name for f in kept], "text")).mapInPandas(run, T.StructType([*kept, T.StructField("signature", T.ArrayType(T.LongType()))]))


def classes(corpus: DataFrame, text: str = "normal") -> DataFrame:
    """``key, signature``: one row for each different normal text; null texts have none.  Only keys and signatures are shuffled."""
    return signatures(keyed(corpus, text)).distinct()


def bands(signed: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """``band, band_key, key``: the index of a corpus, with what other columns ``signed`` has."""
    b, r = shape or band_shape()
    parts = F.array(*[F.struct(F.lit(k).alias("band"), F.md5(F.array_join(F.transform(F.slice("signature", k * r + 1, r), lambda v: v.cast("string")), ",")).alias("band_key")) for k in range(b)])
    kept = [c for c in signed.columns if c != "signature"]
    return signed.select(*kept, F.explode(parts).alias("_b")).select("_b.band", "_b.band_key", *kept)


def near_keys(own: DataFrame, other: DataFrame) -> DataFrame:
    """Keys of own classes that share a band with the other corpus.

    The other side is distinct before the join, so a band that many texts share
    (all texts too short for a shingle do) never multiplies rows.
    """
    there = other.select("band", "band_key").distinct()
    return own.join(there, ["band", "band_key"], "left_semi").select("key").distinct()


def near_mask(corpus: DataFrame, keys: DataFrame, name: str, text: str = "normal") -> DataFrame:
    """``corpus`` with the boolean ``near_duplicates_<name>``; no row is dropped."""
    marked = keys.select(F.col("key").alias("_class"), F.lit(1).alias("_there"))
    joined = masks.flagged(corpus.withColumn("_class", F.sha2(F.col(text), 256)), "_class", marked, "_there")
    return joined.withColumn(f"near_duplicates_{name}", F.col("_there") > 0).drop("_class", "_there")


def signed_alike(signed: DataFrame) -> DataFrame:
    """``key, alike``: classes of equal signature have one name, as all texts too short for a shingle have."""
    return signed.select("key", F.md5(F.array_join(F.transform("signature", lambda v: v.cast("string")), ",")).alias("alike"), "signature")


def candidates(own: DataFrame, other: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """``key, other_key``: pairs of classes of ``own`` and ``other(key, signature)`` that share a band; copies are not expanded.

    Bands are joined between names of equal signatures, of which each has one
    row a band, so that the texts too short for a shingle, which share all
    bands, meet as one pair; keys are put in at the end.
    """
    a, b = signed_alike(own), signed_alike(other)

    def index(named: DataFrame) -> DataFrame:
        return bands(named.select(F.col("alike").alias("key"), "signature").distinct(), shape)

    pairs = index(a).join(index(b).withColumnRenamed("key", "_other"), ["band", "band_key"]).select("key", "_other").distinct()
    met = pairs.withColumnRenamed("key", "alike").join(a.select("key", "alike"), "alike")
    return met.join(b.select(F.col("key").alias("other_key"), F.col("alike").alias("_other")), "_other").select("key", "other_key")


def _shingled(rows: DataFrame, keys: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``key, s``: the shingles of the classes among ``keys``; rows of no candidate are left before any text is shuffled or cut."""
    chosen = rows.join(keys.distinct(), "key", "left_semi")
    return chosen.groupBy("key").agg(F.any_value("text").alias("text")).select("key", shingles(F.col("text"), size).alias("s"))


def verified(pairs: DataFrame, own: DataFrame, other: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``key, other_key, similarity`` of candidate pairs whose shingle sets are as similar as the threshold; ``own`` and ``other`` have ``key, text``."""
    a = _shingled(own, pairs.select("key")).withColumnRenamed("s", "a")
    b = _shingled(other, pairs.select(F.col("other_key").alias("key"))).select(F.col("key").alias("other_key"), F.col("s").alias("b"))
    scored = pairs.join(a, "key").join(b, "other_key").select("key", "other_key", jaccard(F.col("a"), F.col("b")).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold)
