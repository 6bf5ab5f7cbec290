"""Near-duplicate records by word overlap, exact at any size of the collection (problem 1).

The overlap of two sets of a and b words is at least t only if they have at least
o(a, b) = ceil(t (a + b) / (1 + t)) words in common, that is, if they differ in at most
a + b - 2 o words.  Words are put in one global order, rare ones first.  If two sets share o
words, the first |r| - o + l words of r and the first |s| - o + l words of s share at least l
(the l first shared words have o - l shared words behind them).  The universe of words is
partitioned by hash into g segments; by the pigeonhole principle, if l = g (k - 1) + 1, some
segment holds k shared words.  So every record is indexed under the k-word subsets of each
of its segments; for a segment of k + 1 words these are its one-deletion
neighbourhood.  g and k are allocated per size band by estimated cost from corpus statistics.

The smaller record of a pair needs l words beyond |s| - o(s, s) (it is indexed), the larger
one beyond |r| - o(r, least partner) (it probes).  Candidates are found in groups of one segment and one bucket of first words, each inside one
task, where a 256-bit parity sketch gives a lower bound of the difference and rules
out nearly all false ones before anything is shuffled; the rest are verified on their words.

What is sent: a record has an entry (id, size, sketch, and two or three bytes for each word that may follow) in each
group that one of its first words belongs to.  It has at most n - ceil(t n) + 1 first words whatever the
allocation, so the bytes of a record are bounded at any size of the collection; first words that too many
records have are told apart by their second word, with one entry for each.  The search runs in
rounds over the groups if it would fill the disks at once.
"""
from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from corpusloom.llm.spool import Spool
from corpusloom.llm.textform import words
from corpusloom.llm.wordsets import (
    Memo, Order, as_bytes, buckets_needed, gather, hash_sets, identities, least_common, mix, packed, sketches, starts, unpacked, word_counts,
)
from corpusloom.plans.staging import stage
from corpusloom.plans.spreading import spread

#: Words in more than 1 of this many records are ordered by frequency, all others come first in
#: order of their hash; so at most (mean record size) * this many frequencies are broadcast.
FREQUENT_SHARE = 2000
#: Records that one task of the candidate search is meant to hold: about 75 bytes each on the executor's disk, about 50 in memory.
TASK_RECORDS = 3_000_000
#: Bytes of an entry without its codes, and bytes a round of the candidate search may send for each distinct word
#: of a record (texts have 3 to 6 bytes for each distinct word when compressed).
ENTRY_BYTES, ROUND_BYTES = 44, 8
#: Ids broadcast to fetch texts for verification; more are joined by shuffling.
BROADCAST_IDS = 1_000_000
_STEP = 4096  # rows handled at once: 12 bits of a sort key
_CODES = 1_000_000  # codes looked through at once
_U = np.uint64


@dataclass(frozen=True)
class Band:
    """Sizes lo <= n < hi, with the segments and subset size allocated to them."""

    lo: int
    hi: int
    segments: int
    subset: int
    base: int  # number of the first segment

    @property
    def width(self) -> int:
        """Bytes of a code; words whose codes are equal by chance only give candidates that the sketch rules out."""
        return 2 if self.subset == 3 else 3

    @property
    def shared(self) -> int:
        return self.segments * (self.subset - 1) + 1


@dataclass(frozen=True)
class NearCopies:
    """``classes``: (id, class_id), records with the same words; class_id is the least id.
    ``links``: (class_a, class_b, overlap), class_a < class_b, each pair of classes that overlap enough."""

    classes: DataFrame
    links: DataFrame


# -- one row per record: sizes, identity, sketch, words ------------------------------------


def _signatures(minimum: int):
    def run(batches):
        memo = Memo()
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                flat, lengths = hash_sets(part.column(1).to_pylist(), memo)
                kept = lengths >= minimum
                if not kept.any():
                    continue
                flat, ids = flat[np.repeat(kept, lengths)], part.column(0).filter(pa.array(kept))
                lengths = lengths[kept]
                begin = starts(lengths)
                h1, h2 = identities(flat, begin[:-1])
                words32 = (flat >> _U(32)).astype(np.uint32).view(np.int32)
                columns = [ids, h1.view(np.int64), h2.view(np.int64), lengths.astype(np.int32)]
                columns += [s.view(np.int64) for s in sketches(flat, begin[:-1])]
                columns.append(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(words32)))
                names = ["id", "h1", "h2", "n", "s0", "s1", "s2", "s3", "words"]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    return run


def _signature_type(id_type) -> StructType:
    longs = [StructField(c, LongType()) for c in ("s0", "s1", "s2", "s3")]
    return StructType(
        [StructField("id", id_type), StructField("h1", LongType()), StructField("h2", LongType()), StructField("n", IntegerType()), *longs, StructField("words", ArrayType(IntegerType()))]
    )


# -- allocation ----------------------------------------------------------------------------


def allocate(num: int, den: int, minimum: int, records: int, mean_size: float, frequencies: np.ndarray) -> list[Band]:
    """Segments and subset size for each size band, by the least estimated cost.

    frequencies: in how many records each frequent word is, ascending.  The cost counts the
    rows sent (one per segment), the subsets made, and the pairs of records expected to share
    a subset, if the words of a prefix are drawn as the rarest words are in the corpus.
    """
    share = np.asarray(frequencies, dtype=float) / max(records, 1)
    rare = max(mean_size - share.sum(), 0.0)  # expected words per record below the broadcast ones
    cumulated = rare + np.cumsum(share)
    collisions = rare / FREQUENT_SHARE + np.cumsum(share**2)  # expected common words of two records, up to there
    bands, base = [], 0
    least_size = max(minimum, 1)
    edges = sorted({least_size, *(max(least_size, int(mean_size * x)) for x in (0.25, 4, 16))})
    for lo, hi in zip(edges, [*edges[1:], 1 << 30]):
        size = mean_size if lo <= mean_size < hi else lo * 1.5
        best = None
        for segments, subset in itertools.product((1, 2, 3, 4, 6, 8, 12, 16, 24, 36, 48), (1, 2, 3)):
            shared = segments * (subset - 1) + 1
            if (subset == 1 and segments > 1) or shared > least_common(num, den, 2 * lo):
                continue
            prefix = size * (1 - num / den) + shared
            at = min(np.searchsorted(cumulated, prefix * mean_size / max(size, mean_size)), len(share) - 1) if len(share) else -1
            common = collisions[at] if at >= 0 else rare / FREQUENT_SHARE
            each = prefix / segments
            subsets = segments * np.prod([max(each - i, 0.5) / (i + 1) for i in range(subset)])
            pairs = records / 2 * segments * np.prod([common / segments / (i + 1) for i in range(subset)])
            cost = segments * 1.0 + subsets * 0.1 + pairs * 0.03
            if best is None or cost < best[0]:
                best = (cost, segments, subset)
        bands.append(Band(lo, hi, best[1], best[2], base))
        base += best[1]
    return bands


# -- index and probe entries ----------------------------------------------------------------


@dataclass(frozen=True)
class _Plan:
    num: int
    den: int
    bands: tuple
    buckets: tuple  # for each band: buckets of first words in a segment
    order: Order
    hot: np.ndarray  # words in more records than a task is meant to hold, sorted
    blocks: np.ndarray  # how many times as many records have each of them
    rounds: int = 1


def _spread_hot(plan: _Plan, band: Band, h1: np.ndarray, row: np.ndarray, word: np.ndarray, left: np.ndarray, f: np.ndarray, blocks: np.ndarray) -> list[tuple]:
    """(entry it comes from, sub-group, start) for first words that too many records have.

    Up to three times a task, or with subsets of one word, the records of a word are cut into blocks
    by hash and meet in a group for each pair of blocks.  Beyond that the group is the first word with a bucket
    of second words: that costs at most one copy for each word of the segment, however many records there are.
    """
    found = []
    cut = (blocks <= 3) | (band.subset == 1)
    for fits in (True, False):
        k = np.nonzero(cut == fits)[0]
        if not len(k):
            continue
        p = f[k]
        if fits:
            times = blocks[k]
            mine = (h1[row[p]] % times.astype(np.uint64)).astype(np.int64)
            each = np.repeat(np.arange(len(k)), times)
            other = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
            a, b = np.minimum(mine[each], other), np.maximum(mine[each], other)
            sub = mix(word[p[each]].astype(np.uint64) << _U(24) | (a << 12).astype(np.uint64) ^ b.astype(np.uint64), 17) | _U(1 << 62)
            found.append((p[each], sub.astype(np.int64), p[each]))
        else:
            times = left[p] - 1 - (band.subset - 2)
            each = np.repeat(np.arange(len(k)), times)
            second = p[each] + 1 + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
            of = mix(word[second], 19) % (blocks[k][each] * 8).astype(np.uint64)
            sub = mix(word[p[each]].astype(np.uint64) << _U(24) ^ of, 23) | _U(1 << 61)
            found.append((p[each], sub.astype(np.int64), second))
    return found


def _entries(n: np.ndarray, words32: np.ndarray, h1: np.ndarray, plan: _Plan) -> list[tuple]:
    """For each band: key, sub-group, record, codes, their number and bytes, an entry for each record and sub-group.

    The key is the segment with the bytes of a code and the subset size in its low bits.

    A code has bits of a word above its three marks: bit 0 tells that it is in the prefix under which its record is indexed,
    bit 1 that subsets that begin with it belong to this sub-group, bit 2 that it is the entry's last one.
    """
    num, den = plan.num, plan.den
    rows, token, _ = plan.order.arrange(n, words32)
    place = np.arange(len(token), dtype=np.int64) - starts(n)[rows]
    least = -(-num * n // den)  # the fewest words of a partner
    found = []
    for band, buckets in zip(plan.bands, plan.buckets):
        own = (n >= band.lo) & (n < band.hi)
        probing = (n >= band.lo) & (least < band.hi)
        smallest = np.maximum(least, band.lo)
        index_to = np.where(own, n - least_common(num, den, 2 * n) + band.shared, 0)
        probe_to = np.where(probing, n - least_common(num, den, n + smallest) + band.shared, 0)
        kept = np.nonzero(place < np.maximum(index_to, probe_to)[rows])[0]
        if not len(kept):
            continue
        segment = (mix(token[kept], 7) % _U(band.segments)).astype(np.int64)
        by = np.argsort(rows[kept] * band.segments + segment, kind="stable")
        row, segment, word = rows[kept][by], segment[by], token[kept][by]
        indexed = (place[kept] < index_to[rows[kept]])[by]
        code = (mix(word, 13) & _U((1 << (8 * band.width - 3)) - 1)).astype(np.uint32) << np.uint32(3) | indexed
        group = np.cumsum(np.concatenate([[True], (row[1:] != row[:-1]) | (segment[1:] != segment[:-1])])) - 1
        size = np.bincount(group)
        end = starts(size)[1:]
        left = end[group] - np.arange(len(group))  # words from here to the end of the segment
        f = np.nonzero((left >= band.subset) & (size[group] >= band.subset))[0]
        if not len(f):
            continue
        bucket = (mix(word[f], 11) % _U(buckets)).astype(np.int64)
        parts = [(f, bucket, f)]
        if len(plan.hot):
            k = np.minimum(np.searchsorted(plan.hot, word[f]), len(plan.hot) - 1)
            is_hot = plan.hot[k] == word[f]
            parts = [(f[~is_hot], bucket[~is_hot], f[~is_hot]), *_spread_hot(plan, band, h1, row, word, left, f[is_hot], plan.blocks[k[is_hot]])]
        source, sub, start = (np.concatenate(x) for x in zip(*parts))
        by = np.lexsort((start, sub, group[source]))
        source, sub, start = source[by], sub[by], start[by]
        new = np.concatenate([[True], (group[source][1:] != group[source][:-1]) | (sub[1:] != sub[:-1])])
        entry = np.cumsum(new) - 1
        begin, sub = start[new], sub[new]
        length = end[group[begin]] - begin
        codes = code[gather(begin, length)]
        at = starts(length)
        codes[at[:-1][entry] + start - begin[entry]] |= np.uint32(2)
        codes[at[1:] - 1] |= np.uint32(4)
        subset = np.where(sub >> 61 == 1, band.subset - 1, band.subset)
        found.append(((band.base + segment[begin]) * 16 + band.width * 4 + subset, sub, row[begin], codes, length, band.width))
    return found


def _index_rows(broadcast, turn: int = 0):
    """Entries packed by group: for each batch one row for each group, with its entries one after another."""

    def run(batches):
        plan = broadcast.value
        sent = set()
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                h1 = part.column(0).to_numpy().view(np.uint64)
                fresh = np.zeros(len(h1), bool)
                for i, identity in enumerate(h1.tolist()):
                    if identity not in sent:  # equal records of a task are sent once
                        sent.add(identity)
                        fresh[i] = True
                if len(sent) > 2_000_000:
                    sent.clear()
                part = part.filter(pa.array(fresh))
                if not part.num_rows:
                    continue
                h1 = h1[fresh]
                n = part.column(1).to_numpy().astype(np.int64)
                sketch = np.stack([part.column(c).to_numpy() for c in (2, 3, 4, 5)], axis=1)
                for key, sub, row, codes, length, width in _entries(n, part.column(6).flatten().to_numpy(), h1, plan):
                    if plan.rounds > 1:
                        mine = mix(mix(sub.astype(np.uint64), 29) ^ key.astype(np.uint64), 31) % _U(plan.rounds) == turn
                        kept = np.nonzero(mine)[0]
                        codes = codes[gather(starts(length)[:-1][kept], length[kept])]
                        key, sub, row, length = key[kept], sub[kept], row[kept], length[kept]
                        if not len(key):
                            continue
                    by = np.lexsort((sub, key))
                    codes = codes[gather(starts(length)[:-1][by], length[by])]
                    key, sub, row, length = key[by], sub[by], row[by], length[by]
                    first = np.nonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])]))[0]
                    count = np.diff(np.append(first, len(key)))
                    total = np.add.reduceat(length, first)
                    small = as_bytes(codes).reshape(-1, 4)[:, :width]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key[first].astype(np.int32)), pa.array(sub[first]), packed(as_bytes(h1[row]), 8 * count), packed(as_bytes(n[row].astype(np.uint32)), 4 * count),
                            packed(as_bytes(sketch[row]).reshape(-1), 32 * count), packed(np.ascontiguousarray(small).reshape(-1), width * total),
                        ],
                        ["key", "sub", "h1", "n", "sketch", "codes"],
                    )

    return run


_INDEX_TYPE = "key int, sub long, h1 binary, n binary, sketch binary, codes binary"


# -- candidates of one group ------------------------------------------------------------------


def _subset_keys(first: np.ndarray, codes: np.ndarray, document: np.ndarray, begin: np.ndarray, subset: int, bits: int, share: tuple[int, int] = (0, 1)) -> np.ndarray:
    """Keys of all subsets that begin at the places ``first``: the subset's hash, the record, and 1 bit if indexed.

    share: (i, k) leaves only those whose second code is the i-th of k kinds.
    """
    at, of = first, document[first].astype(np.int64)
    end = begin[of + 1]
    h = mix(_word(codes[at]), 3)
    for level in range(1, subset):
        each = np.maximum(end - at - (subset - level), 0)  # leaves enough for the codes to come
        take = np.repeat(np.arange(len(at)), each)
        at = gather(at + 1, each)
        word = _word(codes[at])
        if level == 1 and share[1] > 1:
            kept = mix(word, 41) % _U(share[1]) == share[0]
            take, at, word = take[kept], at[kept], word[kept]
        h, of, end = mix(h[take] ^ (word * _U(0xD6E8FEB86659FD93)), 5), of[take], end[take]
    return mix(h, 9) << _U(bits + 1) | of.astype(np.uint64) << _U(1) | (codes[at, 0] & 1).astype(np.uint64)


def _word(codes: np.ndarray) -> np.ndarray:
    """Codes, a row of bytes each, without their marks."""
    return sum(codes[:, i].astype(np.uint64) << _U(8 * i) for i in range(codes.shape[1])) >> _U(3)


def record_bits(records: int) -> int:
    """Bits for the number of a record in its group; what is left of 64 holds the hash of a subset."""
    bits = max(1, int(records).bit_length())
    if bits > 40:
        raise ValueError(f"{records} records in one group; lower task_records")
    return bits


def _subsets_from(left: np.ndarray, subset: int) -> np.ndarray:
    """How many subsets begin with a code that has ``left`` codes from its place to the end of the record."""
    return (np.ones_like(left), left - 1, (left - 1) * (left - 2) // 2)[subset - 1]


def _candidates(num: int, den: int, chunk: int = 250_000, keys_at_once: int = 2_000_000):
    """Pairs of records that share a subset and can overlap enough by size and sketch.

    The memory a task needs besides about 50 bytes for each record follows from ``chunk`` and ``keys_at_once``: entries are read batch by batch into
    spools, subsets are made and sorted in parts by their first code, and if records have too many with one first code, by the second as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subset, spools = 0, {}
        for batch in batches:
            if not subset:
                key = batch.column("key")[0].as_py()
                subset, width = key % 4, key // 4 % 4
                spools = {"h1": Spool(np.uint64), "n": Spool(np.int32), "sketch": Spool(np.uint64, 4), "codes": Spool(np.uint8, width)}
            for name, spool in spools.items():
                spool.add(unpacked(pa.chunked_array([batch.column(name)])))
        batch = None
        pa.default_memory_pool().release_unused()
        h1, n, sketch, codes = (spool.array() for spool in spools.values())
        ends = np.concatenate([np.nonzero(codes[at : at + _CODES, 0] & 4)[0] + at + 1 for at in range(0, len(codes), _CODES)])
        one = np.lexsort((h1, n))  # by size; equal records sent by several tasks are next to each other
        one = one[np.concatenate([[True], (h1[one[1:]] != h1[one[:-1]]) | (n[one[1:]] != n[one[:-1]])])]
        spools = [Spool(np.uint64), Spool(np.uint64, 4), Spool(np.uint8, codes.shape[1]), Spool(np.int32)]
        lengths = []
        for at in range(0, len(one), _STEP):
            taken = one[at : at + _STEP]
            start = np.where(taken > 0, ends[taken - 1], 0)
            lengths.append(ends[taken] - start)
            for spool, values in zip(spools, (h1[taken], sketch[taken], codes[gather(start, lengths[-1])], np.repeat(np.arange(at, at + len(taken), dtype=np.int32), lengths[-1]))):
                spool.add(values)
        n = n[one]
        del one, ends
        h1, sketch, codes, document = (spool.array() for spool in spools)
        begin = starts(np.concatenate(lengths))
        del lengths
        largest = np.searchsorted(n, n.astype(np.int64) * den // num, side="right").astype(np.int32)  # the first record too large for each

        # parts by first code, with as many subsets as are handled at once
        made = 0
        for first in _openings(codes):
            made += int(_subsets_from(begin[document[first].astype(np.int64) + 1] - first, subset).sum())
        parts = min(made // keys_at_once + 1, 65_535)
        part_of = Spool(np.uint16)
        for at in range(0, len(codes), _CODES):
            some = codes[at : at + _CODES]
            part_of.add(np.where(some[:, 0] & 2, mix(_word(some), 37) % _U(parts), _U(65_535)).astype(np.uint16))
        part_of = part_of.array()
        bits = record_bits(len(n))
        for part in range(parts):
            first = np.concatenate([np.nonzero(part_of[at : at + _CODES] == part)[0] + at for at in range(0, len(codes), _CODES)])
            left = begin[document[first].astype(np.int64) + 1] - first
            count, far = np.cumsum(_subsets_from(left, subset)), np.cumsum(left)
            kinds = 1 if subset == 1 or not len(first) else int(count[-1]) // (2 * keys_at_once) + 1
            for kind in range(kinds):
                keys, at = [np.zeros(0, np.uint64)], 0
                while at < len(first):  # by and by, as what leads to a key takes more room than the key
                    most = [np.searchsorted(sums, (sums[at - 1] if at else 0) + room, side="right") for sums, room in ((count, chunk * kinds), (far, 2 * chunk))]
                    to = max(int(min(most)), at + 1)
                    keys.append(_subset_keys(first[at:to], codes, document, begin, subset, bits, (kind, kinds)))
                    at = to
                keys = np.concatenate(keys)
                keys.sort()
                for pairs in _pairs_of_keys(keys, n, sketch, largest, num, den, chunk):
                    a, b = h1[pairs // len(n)].view(np.int64), h1[pairs % len(n)].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["x", "y"])

    return run


def _openings(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the codes that subsets begin with."""
    for at in range(0, len(codes), _CODES):
        yield np.nonzero(codes[at : at + _CODES, 0] & 2)[0] + at


def _pairs_of_keys(keys: np.ndarray, n: np.ndarray, sketch: np.ndarray, largest: np.ndarray, num: int, den: int, chunk: int) -> Iterator[np.ndarray]:
    """Pairs, as one number each, of an indexed record and a larger one under equal keys that the sketch doesn't rule out."""
    bits = record_bits(len(n))
    document = ((keys >> _U(1)) & _U((1 << bits) - 1)).astype(np.int32)
    use = np.nonzero((keys & _U(1)) != 0)[0]  # the smaller record of a pair is indexed
    end = np.searchsorted(keys, (keys[use] >> _U(bits + 1) << _U(bits + 1)) | (largest[document[use]].astype(np.uint64) << _U(1)))
    count = np.maximum(end - use - 1, 0)
    use, count = use[count > 0], count[count > 0]
    pieces = -(-count // chunk)  # a record with many others is compared with them by and by
    piece = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(use + 1, pieces) + piece * chunk
    count = np.minimum(np.repeat(count, pieces) - piece * chunk, chunk)
    use = np.repeat(use, pieces)
    total = np.cumsum(count)
    results, held, at = [], 0, 0
    while at < len(use):
        to = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + chunk, side="right")), at + 1)
        other = document[gather(begin[at:to], count[at:to])]
        mine = np.repeat(document[use[at:to]], count[at:to])
        at = to
        both = n[mine].astype(np.int64) + n[other]
        apart = both - 2 * least_common(num, den, both)
        for j in (0, 2):
            apart = apart - np.bitwise_count(sketch[mine, j : j + 2] ^ sketch[other, j : j + 2]).sum(axis=1, dtype=np.int64)
            keep = (apart >= 0) & (mine != other)
            mine, other, apart = mine[keep], other[keep], apart[keep]
        results.append(np.unique(mine.astype(np.int64) * len(n) + other))
        held += len(results[-1])
        if held > 4 * chunk:
            yield np.unique(np.concatenate(results))
            results, held = [], 0
    if held:
        yield np.unique(np.concatenate(results))


def _band_records(signed: DataFrame, bands: list[Band], num: int, den: int) -> list[tuple[int, float]]:
    """For each band, how many records are indexed or probe in it, and their mean size."""
    if not bands:
        return []
    sums = []
    for i, b in enumerate(bands):
        inside = (F.col("n") >= b.lo) & (F.ceil(F.col("n") * num / den) < b.hi)
        sums += [F.sum(inside.cast("long")).alias(f"c{i}"), F.avg(F.when(inside, F.col("n"))).alias(f"m{i}")]
    row = signed.agg(*sums).first()
    return [(row[f"c{i}"] or 0, row[f"m{i}"] or 0.0) for i in range(len(bands))]


def make_plan(
    num: int, den: int, bands: list[Band], held: list[tuple[int, float]], tokens: np.ndarray, counts: np.ndarray, records: int, size: float, task_records: int, cores: int,
) -> _Plan:
    """Groups of at most about ``task_records`` records, and rounds such that a round sends a bounded share of the input.

    A record has at most n - ceil(t n) + 1 first words in all its segments, whatever the allocation, so
    the copies of a record stay below that number at any size of the collection.
    """
    buckets, sent = [], 0.0
    for band, (inside, mean) in zip(bands, held):
        first = (mean * (1 - num / den) + 1) / band.segments  # first words in a segment
        need = buckets_needed(inside, first, task_records)
        if inside > 10_000:
            need = max(need, -(-cores // band.segments))
        buckets.append(need)
        copies = band.segments * need * (1 - (1 - 1 / need) ** first)
        sent += inside * copies * (ENTRY_BYTES + band.width * (first + band.subset - 1) / (1 if need == 1 else 2))
    hot = np.nonzero(counts > task_records)[0]
    hot = hot[np.argsort(tokens[hot])]
    blocks = -(-counts[hot] // task_records)
    rounds = max(1, math.ceil(sent / max(records * size * ROUND_BYTES, 1)))
    return _Plan(num, den, tuple(bands), tuple(buckets), Order.of(tokens), tokens[hot], blocks, rounds)


def _word_lists(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, _STEP):
            part = batch.slice(at, _STEP)
            lists = [sorted(set(words(t))) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, pa.list_(pa.string()))], ["id", "words"])


# -- the operator -----------------------------------------------------------------------------


def near_copies(
    df: DataFrame, key: str, text: str, threshold: float = 0.65, min_words: int = 5, task_records: int = TASK_RECORDS,
    bands: list[Band] | None = None,
) -> NearCopies:
    """Records of ``df`` whose texts overlap by ``threshold`` or more.

    Texts are compared by their distinct words in consistent form.  Null and empty texts and
    texts of fewer than ``min_words`` distinct words, and rows with a null key, are left out.
    Rows with the same key count once (they are expected to be equal).  Records with the same
    words form one class, found by hash, so that a group of copies of any size is one
    record from then on.  Other columns are not read.  ``bands`` overrides the allocation.
    """
    spark = df.sparkSession
    exact = Fraction(str(threshold))
    num, den = exact.numerator, exact.denominator
    source = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    signed = stage(spread(source).mapInArrow(_signatures(min_words), _signature_type(source.schema["id"].dataType)))

    # the global order: words in more than 1 of FREQUENT_SHARE records by frequency, the others before them
    records, size = signed.agg(F.count("*"), F.avg("n")).first()
    frequent = (
        signed.select("words").mapInArrow(word_counts, "word int, count long").groupBy("word").agg(F.sum("count").alias("count"))
        .where(F.col("count") > records / FREQUENT_SHARE).orderBy("count", "word").toPandas()
    )
    tokens = frequent["word"].to_numpy().astype(np.int32).view(np.uint32)
    counts = frequent["count"].to_numpy().astype(np.int64)
    bands = bands or allocate(num, den, min_words, records, size or 0.0, counts)
    held = _band_records(signed, bands, num, den)
    cores = spark.sparkContext.defaultParallelism
    plan = make_plan(num, den, bands, held, tokens, counts, records, size or 0.0, task_records, cores)
    broadcast = spark.sparkContext.broadcast(plan)
    found = None
    for turn in range(plan.rounds):
        index = signed.select("h1", "n", "s0", "s1", "s2", "s3", "words").mapInArrow(_index_rows(broadcast, turn), _INDEX_TYPE)
        part = index.groupBy("key", "sub").applyInArrow(_candidates(num, den), "x long, y long").distinct()
        if plan.rounds > 1:
            part = stage(part)
            spark.sparkContext._jvm.System.gc()  # shuffles no longer referred to are removed from the disks
        found = part if found is None else found.union(part)
    found = found.distinct() if plan.rounds > 1 else found

    # classes of equal word sets
    members = signed.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("id", "h.h1", "h.h2")
    least = members.groupBy("h1", "h2").agg(F.min("id").alias("class_id"))
    classed = stage(members.join(least, ["h1", "h2"]).select("id", "class_id", "h1"))
    heads = classed.where("id = class_id")

    # verification on the words themselves
    a = heads.select(F.col("h1").alias("x"), F.col("class_id").alias("p"))
    b = heads.select(F.col("h1").alias("y"), F.col("class_id").alias("q"))
    candidates = stage(
        found.join(a, "x").join(b, "y").where("p <> q")
        .select(F.least("p", "q").alias("class_a"), F.greatest("p", "q").alias("class_b")).distinct()
    )
    needed = candidates.select(F.col("class_a").alias("id")).union(candidates.select("class_b")).distinct()
    if 2 * candidates.count() <= BROADCAST_IDS:
        needed = F.broadcast(needed)
    listed = source.join(needed, "id", "left_semi").mapInArrow(
        _word_lists, StructType([source.schema["id"], StructField("words", ArrayType(StringType()))])
    )
    left = listed.select(F.col("id").alias("class_a"), F.col("words").alias("words_a"))
    right = listed.select(F.col("id").alias("class_b"), F.col("words").alias("words_b"))
    common = F.size(F.array_intersect("words_a", "words_b"))
    links = (
        candidates.join(left, "class_a").join(right, "class_b")
        .withColumn("_common", common)
        .withColumn("_either", F.size("words_a") + F.size("words_b") - F.col("_common"))
        .where(F.col("_common") * den >= F.col("_either") * num)
        .groupBy("class_a", "class_b")  # a record may have been delivered twice
        .agg(F.max(F.col("_common") / F.col("_either")).alias("overlap"))
    )
    classes = classed.select("id", "class_id")
    return NearCopies(classes, links)


def pairs_of(result: NearCopies) -> DataFrame:
    """All pairs of record ids, (a, b) with a < b: within classes and across linked ones."""
    classes = result.classes
    several = classes.groupBy("class_id").count().where("count > 1").select("class_id")
    shared = classes.join(several, "class_id", "left_semi")
    left = shared.select(F.col("id").alias("a"), "class_id")
    right = shared.select(F.col("id").alias("b"), "class_id")
    within = left.join(right, "class_id").where("a < b").select("a", "b")
    at_a = classes.select(F.col("id").alias("p"), F.col("class_id").alias("class_a"))
    at_b = classes.select(F.col("id").alias("q"), F.col("class_id").alias("class_b"))
    across = result.links.join(at_a, "class_a").join(at_b, "class_b")
    return within.union(across.select(F.least("p", "q"), F.greatest("p", "q")))


def p1_found(spark, folder: str) -> DataFrame:
    from corpusloom.session import table

    pairs = pairs_of(near_copies(table(spark, folder, "temp_legal_corpus_withstpvl"), "oid", "text"))
    return pairs.select(F.col("a").alias("oid_a"), F.col("b").alias("oid_b"))


def p1_groups(spark, folder: str) -> DataFrame:
    """The group of every record that is linked to another one, and how many links its class has."""
    from corpusloom.operators.graph import connected_components
    from corpusloom.session import table

    result = near_copies(table(spark, folder, "temp_legal_corpus_withstpvl"), "oid", "text")
    links = stage(result.links)
    degree = links.select(F.col("class_a").alias("class_id")).union(links.select("class_b")).groupBy("class_id").agg(F.count("*").alias("links"))
    parts = connected_components(links, "class_a", "class_b").select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    alone = result.classes.groupBy("class_id").count().where("count > 1").select("class_id")
    return (
        result.classes.join(parts, "class_id", "left").join(degree, "class_id", "left").join(alone.withColumn("_copies", F.lit(True)), "class_id", "left")
        .where("group_id IS NOT NULL OR _copies")
        .select(F.col("id").alias("oid"), "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
