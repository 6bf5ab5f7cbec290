"""Pairs of a group whose word sets resemble each other, exactly, without sending words for pairs that don't.

A set of n words has a sketch of 4 n bits or more, in which each word flips one bit.  Sketches of two sets differ in at most
as many places as the sets differ in words, so a pair of sketches that differ in more places than the threshold allows is
none, and only the few other pairs are compared by their words.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from corpusloom.plans.spreading import spread
from corpusloom.plans.staging import stage

#: Bits of the smallest sketch; sets in a block of a group, and blocks of a group before they grow, up to the largest.
LEAST_BITS, BLOCK, BLOCKS, LARGEST = 256, 8192, 16, 65536
#: Rows and columns of pairs that are compared at once.
ROWS, COLUMNS = 32, 4096


def digest(words: Column) -> Column:
    """16 bytes that are equal for equal sets of words; words hold no line ends."""
    return F.substring(F.unhex(F.sha2(F.array_join(F.sort_array(words), "\n"), 256)), 1, 16)


def widths(n: np.ndarray) -> np.ndarray:
    """Bits of the sketches of sets of ``n`` words: a power of two."""
    return np.maximum(LEAST_BITS, 2 ** np.ceil(np.log2(np.maximum(4 * n, 1))).astype(np.int64))


def sketch(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The sketches of sets given by the hashes of their words, one after the other."""
    n = np.diff(offsets)
    bits, found = widths(n), [b""] * len(n)
    for w in np.unique(bits):
        for own in np.array_split(at := np.flatnonzero(bits == w), max(1, len(at) * w >> 22)):
            words = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in own]) if len(own) else own
            cells = np.repeat(np.arange(len(own)), n[own]) * w + (hashes[words] & (w - 1))
            packed = np.packbits((np.bincount(cells, minlength=len(own) * w) & 1).astype(np.uint8).reshape(len(own), w), axis=1, bitorder="little")
            for i, p in zip(own, packed):
                found[i] = p.tobytes()
    return found


def _folded(m: np.ndarray) -> np.ndarray:
    """Sketches of half the width, as rows of words of 64 bits."""
    half = len(m) // 2
    return m[:half] ^ m[half:]


def _places(a: np.ndarray, b: np.ndarray, sums: np.ndarray, mixed: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """In how many places each of ``a`` differs from each of ``b``; rows are words of 64 bits, the rest are buffers."""
    for k in range(len(a)):
        np.bitwise_xor(a[k][:, None], b[k][None, :], out=mixed)
        np.bitwise_count(mixed, out=ones)
        np.add(sums, ones, out=sums) if k else np.copyto(sums, ones)
    return sums


def near(na: np.ndarray, a: np.ndarray, nb: np.ndarray, b: np.ndarray, threshold: float, same: bool):
    """Places (i, k) of pairs that may resemble each other more than ``threshold``; ``na`` and ``nb`` ascend, ``same``: a is b and i < k.

    ``a`` and ``b`` are sketches of one width, rows are words of 64 bits.  Half the width is compared first.
    """
    share = (1 - threshold) / (1 + threshold)
    half = (_folded(a), _folded(b)) if len(a) * 64 > LEAST_BITS else (a, b)
    la, lb = np.ceil(na * share + 1e-9).astype(np.int32), np.ceil(nb * share + 1e-9).astype(np.int32)
    buffers = np.empty(ROWS * COLUMNS, np.int32), np.empty(ROWS * COLUMNS, np.uint64), np.empty(ROWS * COLUMNS, np.uint8)
    for i in range(0, len(na), ROWS):
        j = min(i + ROWS, len(na))
        low = max(np.searchsorted(nb, na[i] * threshold - 1e-9), i + 1 if same else 0)
        high = np.searchsorted(nb, na[j - 1] / threshold + 1e-9, "right")
        for k in range(low, high, COLUMNS):
            m = min(k + COLUMNS, high)
            shaped = [x[: (j - i) * (m - k)].reshape(j - i, m - k) for x in buffers]
            places = _places(half[0][:, i:j], half[1][:, k:m], *shaped)
            places -= lb[None, k:m]
            x, y = np.nonzero(places <= la[i:j, None])
            x, y = x + i, y + k
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                both = (na[x] + nb[y]).astype(np.float64)
                fits = np.bitwise_count(a[:, x] ^ b[:, y]).sum(axis=0, dtype=np.int64) <= both * share + 1e-9
                fits &= np.minimum(na[x], nb[y]) >= np.maximum(na[x], nb[y]) * threshold - 1e-9
                yield x[fits], y[fits]


def _classes(n: np.ndarray, sketches: pa.Array):
    """``(bits, from, to, words of 64 bits)`` for each width of sketches of ascending sets."""
    bits = widths(n)
    for w in np.unique(bits):
        lo, hi = np.searchsorted(bits, w), np.searchsorted(bits, w, "right")
        raw = np.frombuffer(b"".join(sketches.slice(lo, hi - lo).to_pylist()), np.uint64)
        yield w, lo, hi, np.ascontiguousarray(raw.reshape(hi - lo, w // 64).T)


def _block_pair(rows: pa.Table, threshold: float):
    """``(ids, ids)`` of the possible pairs of two blocks, on sides 1 and 2, or of one with itself, on side 0; a block may have no rows."""
    side = rows["side"].to_numpy()
    same, cut = side[0] == 0, int(np.searchsorted(side, 2))
    parts = []
    for part in (rows,) if same else (rows.slice(0, cut), rows.slice(cut)):
        n = part["n"].to_numpy().astype(np.int64)
        parts.append((part["g"].to_numpy(), n, [*_classes(n, part["bits"].combine_chunks())]))
    (ga, na, left), (gb, nb, right) = parts[0], parts[-1]
    for p, (wa, la, ha, a) in enumerate(left):
        for wb, lb, hb, b in right[p if same else 0 :]:
            if nb[lb] * threshold > na[ha - 1] + 1e-9 or na[la] * threshold > nb[hb - 1] + 1e-9:
                continue
            x, y = a, b
            while len(x) > len(y):
                x = _folded(x)
            while len(y) > len(x):
                y = _folded(y)
            for i, k in near(na[la:ha], x, nb[lb:hb], y, threshold, same and wa == wb):
                yield ga[la + i], gb[lb + k]


def possible_pairs(heads: DataFrame, group: str, threshold: float) -> DataFrame:
    """``(a, b)``: ids of two sets of a group whose sketches allow a similarity above ``threshold``; no such pair is left out.

    ``heads`` is staged, with ``g`` (id), ``n``, ``digest`` and ``bits``.  Sets of a group are put in blocks by size, and blocks meet
    in pairs if their sizes allow.  Places in the order of sizes come from counts of the sizes, so nothing sorts a group.
    Staged tables of counts and of keys are much smaller as files than in memory, hence the hints against broadcasts.
    """
    before = Window.partitionBy(group).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    counts = heads.groupBy(group, "n").agg(F.count("*").alias("_count"))
    total = F.sum("_count").over(Window.partitionBy(group))
    sizes = stage(
        counts.withColumn("_total", total).withColumn("_start", F.coalesce(F.sum("_count").over(before), F.lit(0))).where("_total > 1")
        .withColumn("_size", F.greatest(F.lit(BLOCK), F.least(F.lit(LARGEST), F.ceil(F.col("_total") / BLOCKS))).cast("long"))
    )
    blocks = sizes.select(group, "n", F.explode(F.expr("sequence(_start div _size, (_start + _count - 1) div _size)")).alias("_block"))
    ranges = blocks.groupBy(group, "_block").agg(F.min("n").alias("_lo"), F.max("n").alias("_hi"))
    i, j = ranges.select(group, F.col("_block").alias("_i"), F.col("_hi").alias("_top")), ranges.select(group, F.col("_block").alias("_j"), F.col("_lo").alias("_least"))
    met = stage(i.join(j, group).where((F.col("_i") <= F.col("_j")) & (F.col("_least") * threshold <= F.col("_top") + 1e-9)).select(group, "_i", "_j", F.monotonically_increasing_id().alias("pair")))
    first = met.select(group, "pair", F.col("_i").alias("_block"), F.when(F.expr("_i < _j"), 1).otherwise(0).alias("side"))
    sides = first.union(met.where("_i < _j").select(group, "pair", F.col("_j").alias("_block"), F.lit(2).alias("side")))
    placed = heads.join(sizes.select(group, "n", "_start", "_count", "_size").hint("merge"), [group, "n"]).select(group, "g", "n", "bits", F.expr("(_start + pmod(xxhash64(digest), _count)) div _size").alias("_block"))
    sent = placed.join(sides.hint("merge"), [group, "_block"]).select("pair", "side", "g", "n", "bits")
    spark = heads.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)

    def run(batches):
        held: list = []

        def pairs():
            found, size = [], 0
            for pair in _block_pair(pa.Table.from_batches(held), threshold):
                found.append(pair)
                size += len(pair[0])
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["a", "b"])
                    found, size = [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["a", "b"])

        for batch in batches:
            key = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and hi > lo and held[0].column(0)[0].as_py() != key[lo]:
                    yield from pairs()
                    held.clear()
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield from pairs()

    return sent.repartition(parts, "pair").sortWithinPartitions("pair", "side", "n").mapInArrow(run, "a long, b long")


def resembling_pairs(df: DataFrame, key: str, group: str, words: Column, threshold: float) -> DataFrame:
    """``(a, b, jaccard, containment)``: pairs of keys a < b of a group whose ``words`` resemble each other more than ``threshold``.

    ``words`` is an array of distinct strings.  What is staged of a row are its key, group, digest and sketch; the words are taken
    again from ``df``, only for sets in possible pairs.  Copies of a set are collapsed by digest and come back at the end.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(group).isNotNull())
    source = spread(rows.select(F.col(key).alias("key"), F.col(group).alias("group"), words.alias("_words")))
    hashed = source.select("key", "group", digest(F.col("_words")).alias("digest"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))

    def run(batches):
        for batch in batches:
            offsets = batch.column(3).offsets.to_numpy()
            bits = sketch(batch.column(3).values.to_numpy(), offsets)
            found = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets), pa.int32()), pa.array(bits, pa.binary())], ["key", "group", "digest", "n", "bits"])
            yield found.filter(pa.array(np.diff(offsets) > 0))

    kind = StructType([*(hashed.schema[c] for c in ("key", "group", "digest")), StructField("n", IntegerType()), StructField("bits", BinaryType())])
    marked = stage(hashed.mapInArrow(run, kind))
    collapsed = marked.groupBy("group", "digest").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("key").alias("key"), F.count("*").alias("copies"))
    heads = stage(collapsed.withColumn("g", F.monotonically_increasing_id()))
    possible = stage(possible_pairs(heads, "group", threshold))
    # the words of the sets in possible pairs
    wanted = heads.join(possible.select(F.explode(F.array("a", "b")).alias("g")).distinct(), "g", "left_semi").select("g", "group", "key", "digest")
    again = rows.join(wanted.select("g", F.col("group").alias("_group"), F.col("key").alias("_key"), "digest"), (F.col(key) == F.col("_key")) & (F.col(group) == F.col("_group")))
    found = stage(again.select("g", "digest", words.alias("_words")))  # else the digest would become a key of the join, made of all rows
    sets = found.where(digest(F.col("_words")) == F.col("digest")).groupBy("g").agg(F.first("_words").alias("_words"))
    x, y = sets.select(F.col("g").alias("a"), F.col("_words").alias("_x")), sets.select(F.col("g").alias("b"), F.col("_words").alias("_y"))
    common = F.size(F.array_intersect("_x", "_y")).alias("_c")
    counted = possible.join(x, "a").join(y, "b").select("a", "b", common, F.size("_x").alias("_n"), F.size("_y").alias("_m"))
    scored = counted.select("a", "b", (F.col("_c") / (F.col("_n") + F.col("_m") - F.col("_c"))).alias("jaccard"), (F.col("_c") / F.least("_n", "_m")).alias("containment")).where(F.col("jaccard") > threshold)
    # every row of one set is in a pair with every row of the other, and with the other rows of its own set
    member = stage(marked.select("group", "digest", "key").join(heads.select("group", "digest", "g", "copies"), ["group", "digest"]).select("g", "key", "copies"))
    a, b = member.select(F.col("g").alias("a"), F.col("key").alias("_a")), member.select(F.col("g").alias("b"), F.col("key").alias("_b"))
    across = scored.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "jaccard", "containment")
    copied = member.where("copies > 1")
    p, q = copied.select("g", F.col("key").alias("a")), copied.select("g", F.col("key").alias("b"))
    within = p.join(q.hint("merge"), "g").where("a < b").select("a", "b", F.lit(1.0).alias("jaccard"), F.lit(1.0).alias("containment"))
    return across.union(within)
