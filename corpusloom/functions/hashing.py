"""Hashes, MinHash signatures and band allocation."""
from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from corpusloom.plans.spreading import spread

# Modulus and mask of the permutations by number of bits.
PERMUTATION_FIELD = {16: ((1 << 16) - 15, (1 << 16) - 1, np.uint16), 32: ((1 << 32) - 5, (1 << 32) - 1, np.uint32), 64: ((1 << 61) - 1, (1 << 64) - 1, np.uint64)}


def sha1_number(value: Column, bits: int = 32) -> Column:
    """The first ``bits`` / 8 bytes of the SHA-1 digest, little-endian, for up to 32 bits."""
    digest = F.sha1(value.cast("binary"))
    pairs = [F.substring(digest, 2 * i + 1, 2) for i in reversed(range(bits // 8))]
    return F.conv(F.concat(*pairs), 16, 10).cast("long")  # above 63 bits: sha1_digits


def sha1_digits(value: Column, bits: int = 64) -> Column:
    """The same as decimal digits, for up to 64 bits, which a long could not hold without a sign."""
    digest = F.sha1(value.cast("binary"))
    return F.conv(F.concat(*[F.substring(digest, 2 * i + 1, 2) for i in reversed(range(bits // 8))]), 16, 10)


def xxh3_number(bits: int = 64):
    """A UDF of the low bits of XXH3; 64-bit values come out as signed numbers."""

    @F.pandas_udf(LongType())
    def udf(value: pd.Series) -> pd.Series:
        mask = (1 << bits) - 1
        found = np.array([xxhash.xxh3_64_intdigest(v) & mask if v is not None else 0 for v in value], dtype=np.uint64).view(np.int64)
        return pd.Series(found).where(value.notna().to_numpy(), None).astype("Int64")

    return udf


def permutations(count: int, bits: int = 32, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers from 1 and offsets from 0, below the prime of the field."""
    prime, _, kind = PERMUTATION_FIELD[bits]
    rng = np.random.RandomState(seed)
    return rng.randint(1, prime, size=count, dtype=kind), rng.randint(0, prime, size=count, dtype=kind)


def signature(grams: set[str], count: int = 250, bits: int = 32, seed: int = 42, hasher=None) -> np.ndarray:
    """The least permuted hash for each permutation; arithmetic wraps at ``bits``.  No grams give the mask throughout."""
    prime, mask, kind = PERMUTATION_FIELD[bits]
    if not grams:
        return np.full(count, mask, dtype=kind)
    a, b = permutations(count, bits, seed)
    hasher = hasher or (lambda data: int.from_bytes(hashlib.sha1(data).digest()[: bits // 8], "little"))
    hashes = np.array([hasher(g.encode()) for g in grams], dtype=kind)
    return ((hashes[:, None] * a[None, :] + b[None, :]) % kind(prime) & kind(mask)).min(axis=0)


def optimal_bands(threshold: float, count: int, false_positive: float = 0.5, false_negative: float = 0.5) -> tuple[int, int]:
    """The (bands, rows) with the least weighted area of false positives and negatives."""
    nodes, weights = np.polynomial.legendre.leggauss(64)
    best = (float("inf"), 0, 0)
    below, above = threshold / 2 * (nodes + 1), threshold + (1 - threshold) / 2 * (nodes + 1)
    for b in range(1, count + 1):
        r = np.arange(1, count // b + 1)[:, None]
        fp = threshold / 2 * ((1 - (1 - below**r) ** b) @ weights)
        fn = (1 - threshold) / 2 * (((1 - above**r) ** b) @ weights)
        error = fp * false_positive + fn * false_negative
        at = int(error.argmin())
        if error[at] < best[0]:
            best = (float(error[at]), b, at + 1)
    return best[1], best[2]


class _Minima:
    """The least permuted hashes of sets of grams, inside a Python worker."""

    def __init__(self, count: int, bits: int, seed: int, hasher):
        self.prime, self.mask, self.kind = PERMUTATION_FIELD[bits]
        self.a, self.b = permutations(count, bits, seed)
        self.count, self.bits, self.hasher = count, bits, hasher
        self.memo: dict[str, int] = {}
        self.unpack = struct.Struct({16: "<H", 32: "<I", 64: "<Q"}[bits]).unpack

    def of(self, grams: set[str]) -> np.ndarray:
        hashes, memo = [], self.memo
        for g in grams:
            h = memo.get(g)
            if h is None:
                if len(memo) > 500_000:
                    memo.clear()
                data = g.encode()
                h = memo[g] = self.hasher(data) if self.hasher else self.unpack(hashlib.sha1(data).digest()[: self.bits // 8])[0]
            hashes.append(h)
        kind = self.kind
        least = np.full(self.count, self.mask, dtype=kind)
        for at in range(0, len(hashes), 512):
            mixed = np.array(hashes[at : at + 512], dtype=kind)[:, None] * self.a[None, :]
            mixed += self.b[None, :]
            if self.bits == 64:
                mixed %= kind(self.prime)
            else:  # below twice the prime, so one subtraction is the remainder
                np.subtract(mixed, kind(self.prime), out=mixed, where=mixed >= kind(self.prime))
            np.minimum(least, mixed.min(axis=0), out=least)
        return least


def band_signatures(
    df: DataFrame, key: str, grams: Column, bands: int, rows: int, count: int = 250, bits: int = 32, seed: int = 42, hasher=None
) -> DataFrame:
    """``(key, band, sig)``: for every row the signature's bands as comma-joined numbers.

    Rows without grams have the mask in every place and so share every band; a null array counts as none.
    """
    source = spread(df).select(F.col(key).alias("key"), F.coalesce(grams, F.array().cast("array<string>")).alias("grams"))

    def run(batches):
        minima = _Minima(count, bits, seed, hasher)
        for batch in batches:
            found = [minima.of(set(g)) for g in batch.column(1).to_pylist()]
            sigs = [",".join(map(str, s[i * rows : (i + 1) * rows])) for s in found for i in range(bands)]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), bands)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(bands, dtype=np.int32), batch.num_rows)), pa.array(sigs, pa.string())], ["key", "band", "sig"])

    kind = StructType([source.schema["key"], StructField("band", IntegerType()), StructField("sig", StringType())])
    return source.mapInArrow(run, kind).withColumnRenamed("key", key)


_SPLIT = re.compile(r"\W")


def band_keys(
    df: DataFrame, key: str, text: str, bands: int, rows: int, ngram: int = 5, least: int = 5, count: int = 250, bits: int = 32, seed: int = 42, hasher=None, drop_short: bool = False,
) -> DataFrame:
    """``(key, band, sig)`` with a 64-bit number for each band, and a row with band -1 for every text that takes part.

    Texts are split, cut into grams and hashed in one pass.  Those with fewer than ``least`` parts, empty ones counted, and null
    texts take no part; texts with fewer than ``least`` words have no grams and share every band, unless ``drop_short``.
    """
    source = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")))

    def run(batches):
        minima = _Minima(count, bits, seed, hasher)
        fold = np.random.RandomState(seed + 1).randint(1, 1 << 62, rows).astype(np.uint64) | np.uint64(1)
        for batch in batches:
            kept, found = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                parts = _SPLIT.split(t.lower()) if t is not None else []
                words = [w for w in parts if w]
                if len(parts) < least or (drop_short and len(words) < least):
                    continue
                grams = set() if len(words) < least else {" ".join(words)} if len(words) < ngram else {" ".join(words[j : j + ngram]) for j in range(len(words) - ngram + 1)}
                kept.append(i)
                found.append(minima.of(grams)[: bands * rows])
            if not kept:
                continue
            cells = np.stack(found).astype(np.uint64).reshape(len(kept), bands, rows)
            mixed = (cells + np.uint64(0x9E3779B97F4A7C15)) * fold
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            sigs = np.concatenate([np.zeros((len(kept), 1), np.uint64), mixed.sum(axis=2, dtype=np.uint64)], axis=1).reshape(-1).view(np.int64)
            ids = batch.column(0).take(pa.array(np.repeat(kept, bands + 1)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(-1, bands, dtype=np.int32), len(kept))), pa.array(sigs)], ["key", "band", "sig"])

    kind = StructType([source.schema["key"], StructField("band", IntegerType()), StructField("sig", LongType())])
    return source.mapInArrow(run, kind).withColumnRenamed("key", key)
