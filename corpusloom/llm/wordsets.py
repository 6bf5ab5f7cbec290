"""Sets of words as 64-bit hashes, built in bulk inside Python workers."""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from corpusloom.llm.textform import WORD, consistent

#: Entries that a worker remembers before it starts afresh; only speed depends on it.
REMEMBERED = 1_000_000
_U = np.uint64


class Memo(dict):
    """Word to hash."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hash_sets(texts: list[str | None], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of each text: all hashes one after another, and how many belong to each text."""
    flat: list[int] = []
    lengths = np.zeros(len(texts), dtype=np.int64)
    find, get = WORD.findall, memo.__getitem__
    for i, text in enumerate(texts):
        if text:
            found = set(find(consistent(text).lower()))
            lengths[i] = len(found)
            flat.extend(map(get, found))
    return np.array(flat, dtype=np.uint64), lengths


def starts(lengths: np.ndarray) -> np.ndarray:
    """Where each list starts, with the end of the last one."""
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def identities(flat: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that identify each non-empty set, whatever the order of its members."""
    turned = (flat * np.uint64(0x9E3779B97F4A7C15)) ^ (flat >> np.uint64(29))
    return np.add.reduceat(flat, begin), np.add.reduceat(turned * np.uint64(0xBF58476D1CE4E5B9), begin)


def sketches(flat: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Parities of 256 cells per non-empty set, as four 64-bit words.

    Two sets that differ in d members have at most d different parities, so the number of
    different bits never exceeds the size of the symmetric difference.
    """
    bit = np.uint64(1) << (flat & np.uint64(63))
    word = (flat >> np.uint64(6)) & np.uint64(3)
    return [np.bitwise_xor.reduceat(np.where(word == np.uint64(j), bit, np.uint64(0)), begin) for j in range(4)]


def least_common(num: int, den: int, total):
    """The fewest common members of two sets with ``total`` members in all whose overlap is num/den or more."""
    return (num * total + num + den - 1) // (num + den)


def gather(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the members of lists that start at ``begin`` and have ``lengths`` members."""
    first = np.cumsum(lengths) - lengths
    return np.repeat(begin - first, lengths) + np.arange(int(lengths.sum()), dtype=np.int64)


def mix(values: np.ndarray, salt: int) -> np.ndarray:
    x = (values.astype(np.uint64) + _U(salt)) * _U(0x9E3779B97F4A7C15)
    return (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9) >> _U(24)


def word_counts(batches):
    """In how many records each word is, summed over a part of the table in bulk."""
    held, pending = [], 0

    def summed():
        token, count = np.concatenate([t for t, _ in held]), np.concatenate([c for _, c in held])
        unique, at = np.unique(token, return_inverse=True)
        return unique, np.bincount(at, weights=count).astype(np.int64)

    for batch in batches:
        token, count = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
        held.append((token, count))
        pending += len(token)
        if pending > 2_000_000:
            held = [summed()]
            pending = 0
    if held:
        token, count = summed()
        for at in range(0, len(token), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(token[at : at + 50_000]), pa.array(count[at : at + 50_000])], ["word", "count"])

# -- one global order of words ----------------------------------------------------------------


@dataclass(frozen=True)
class Order:
    """Rare words first, by their 32-bit hash; then the frequent ones by falling rarity."""

    common: np.ndarray  # frequent words, sorted by hash
    rank: np.ndarray  # their place among the frequent ones, from 0
    by_rank: np.ndarray  # frequent words in order

    @classmethod
    def of(cls, tokens: np.ndarray) -> Order:
        """The order of frequent words that come by rising frequency."""
        by = np.argsort(tokens)
        return cls(tokens[by], by.astype(np.uint64), tokens)

    def arrange(self, n: np.ndarray, words32: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The record of each word, the words in order inside each record, and their 40-bit places in the order."""
        rows = np.repeat(np.arange(len(n), dtype=np.uint64), n)
        if len(n) >= 1 << 24:
            raise ValueError("more records at once than 24 bits can number")
        place = words32.view(np.uint32).astype(np.uint64)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, words32.view(np.uint32)), len(self.common) - 1)
            known = self.common[at] == words32.view(np.uint32)
            place[known] = self.rank[at[known]] | _U(1 << 32)
        order = np.sort(rows << _U(40) | place)
        rows, place = (order >> _U(40)).astype(np.int64), order & _U((1 << 40) - 1)
        word = (place & _U(0xFFFFFFFF)).astype(np.uint32)
        frequent = place >> _U(32) != 0
        word[frequent] = self.by_rank[word[frequent]]
        return rows, word, place


# -- entries packed by group -------------------------------------------------------------------


def buckets_needed(records: float, starts_each: float, task_records: int) -> int:
    """The fewest buckets of first words such that a bucket gets at most ``task_records`` of the records."""
    if records <= task_records:
        return 1
    return max(1, math.ceil(1 / (1 - (1 - task_records / records) ** (1 / max(starts_each, 1.0)))))


def as_bytes(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.uint8)


def packed(cells: pa.Array, each: np.ndarray) -> pa.Array:
    """Bytes cut into binary values of ``each`` length."""
    return pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer(starts(each).astype(np.int32)), pa.py_buffer(cells)])


def unpacked(column: pa.ChunkedArray) -> np.ndarray:
    """The bytes of all binary values one after another."""
    parts = [np.frombuffer(c.buffers()[2], np.uint8)[_offset(c, 0) : _offset(c, len(c))] for c in column.chunks if len(c)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def _offset(array: pa.Array, at: int) -> int:
    kind = np.int64 if pa.types.is_large_binary(array.type) else np.int32
    return int(np.frombuffer(array.buffers()[1], kind)[array.offset + at])
