"""Evaluation texts that also stand in the training split, exactly or nearly (problem 2).

A text is taken as the string of its distinct words in one global order, rare ones first.  Between two
such strings of a and b words the edit distance by insertions and deletions is the number of words
that only one of them has, so an overlap of t or more is the same as a distance of at most
k(a, b) = a + b - 2 o(a, b) with o(a, b) = ceil(t (a + b) / (1 + t)), in any order of the original words.

At most m = a - ceil(t a) words of an evaluation string can be missing from its partner,
so it is cut into m + 1 segments, one of which stands in the partner unbroken: the m
rarest words are a segment each, the rest is the last one, found by its first word.  The first word that both
strings have stands at a place of at most a - o in the one and b - o in the other, so of a training string only its
first b - ceil(t b) + 1 words are sent, to the groups of segments that begin with them.  What meets there at
allowed places and passes a parity sketch of the words is verified by a banded dynamic programme.

Both sides are read and tokenised once, into staged word hashes.  Groups are buckets of words of a bounded
number of texts; words in more texts are cut into blocks of either side.  The bytes sent are bounded for each text,
and are sent in rounds over the groups if they would fill the disks.
"""
from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from corpusloom.llm.wordsets import (
    Memo, Order, as_bytes, buckets_needed, gather, hash_sets, identities, least_common, mix, packed, sketches, starts, unpacked, word_counts,
)
from corpusloom.plans.spreading import spread
from corpusloom.plans.staging import stage

#: Words in more than 1 of this many texts are ordered by frequency, all others come first in order of their hash.
FREQUENT_SHARE = 2000
#: Texts that one group is meant to hold, about 100 bytes each.
TASK_TEXTS = 3_000_000
#: Bytes of an entry and of each of its words; bytes a round may send for each distinct word of a text.
ENTRY_BYTES, WORD_BYTES, ROUND_BYTES = 28, 6, 8
_STEP = 2000
_U = np.uint64


def banded_distances(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray, band: int) -> np.ndarray:
    """Insertions and deletions between the rows of two padded tables of symbols, all rows at once.

    Right up to ``band``; a larger distance comes out as some number above it.
    """
    pairs, width = len(a), 2 * band + 1
    far = np.int32(1 << 20)
    steps = np.arange(width, dtype=np.int32)
    padded = np.full((pairs, max(a.shape[1], b.shape[1]) + 2 * band + 2), -2, dtype=np.int64)
    padded[:, band + 1 : band + 1 + b.shape[1]] = b
    state = np.where(steps >= band, steps - band, far)[None, :].repeat(pairs, 0).astype(np.int32)
    result = np.full(pairs, far, dtype=np.int32)
    off = b_len - a_len + band
    inside = (off >= 0) & (off < width)

    def record(i: int) -> None:
        done = np.nonzero((a_len == i) & inside)[0]
        result[done] = state[done, off[done]]

    record(0)
    for i in range(1, a.shape[1] + 1):
        same = padded[:, i : i + width] == a[:, i - 1 : i]  # column d stands for place i + d - band of b, from 1
        down = np.concatenate([state[:, 1:], np.full((pairs, 1), far, np.int32)], axis=1) + 1
        state = np.minimum(down, np.where(same, state, far))
        if i <= band:
            state[:, : band - i] = far
            state[:, band - i] = i
        state = np.minimum.accumulate(state - steps, axis=1) + steps
        record(i)
    return result


def _padded(values: np.ndarray, begin: np.ndarray, lengths: np.ndarray, filler: int) -> np.ndarray:
    table = np.full((len(lengths), int(lengths.max(initial=0))), filler, dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    column = np.arange(int(lengths.sum())) - np.repeat(starts(lengths)[:-1], lengths)
    table[row, column] = values[gather(begin, lengths)]
    return table


# -- texts as staged word hashes --------------------------------------------------------------


def _hashed(batches, passages: bool):
    """For each text: the key, whether it is a passage, identity, size, a 128-bit parity sketch and 32-bit word hashes."""
    memo = Memo()
    for batch in batches:
        for at in range(0, batch.num_rows, _STEP):
            part = batch.slice(at, _STEP)
            texts = part.column(1).to_pylist()
            source = np.arange(part.num_rows)
            if passages:
                lists = part.column(2)
                count = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                texts += lists.flatten().to_pylist()
                source = np.concatenate([source, np.repeat(source, count)])
            flat, lengths = hash_sets(texts, memo)
            kept = np.nonzero(lengths)[0]
            if not len(kept):
                continue
            begin = starts(lengths[kept])
            h1, h2 = identities(flat, begin[:-1])
            s = sketches(flat, begin[:-1])
            words32 = (flat >> _U(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(source[kept])), pa.array(kept >= part.num_rows), pa.array((h1 ^ (h2 << _U(1))).view(np.int64)), pa.array(lengths[kept].astype(np.int32)),
                    pa.array((s[0] ^ s[2]).view(np.int64)), pa.array((s[1] ^ s[3]).view(np.int64)), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(words32)),
                ],
                ["id", "passage", "h", "n", "s0", "s1", "words"],
            )


def _hashed_texts(rows: DataFrame) -> DataFrame:
    """``rows`` of (id, text) or (id, text, passages) as one staged row for each text with a word."""
    longs = [StructField(c, LongType()) for c in ("s0", "s1")]
    kind = StructType(
        [rows.schema["id"], StructField("passage", BooleanType()), StructField("h", LongType()), StructField("n", IntegerType()), *longs, StructField("words", ArrayType(IntegerType()))]
    )
    passages = len(rows.columns) == 3
    return stage(spread(rows).mapInArrow(lambda batches: _hashed(batches, passages), kind))


# -- entries ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class _Plan:
    num: int
    den: int
    order: Order
    buckets: int
    hot: np.ndarray  # words in more texts than a group is meant to hold, sorted
    blocks: np.ndarray  # for each of them, how many times as many evaluation and training texts have it
    rounds: int


def make_plan(
    num: int, den: int, tokens: np.ndarray, counts: np.ndarray, texts: tuple[int, int], size: float, task_texts: int, cores: int
) -> _Plan:
    """``counts``: evaluation and training texts of each frequent word, by rising sum."""
    first = size * (1 - num / den) + 1
    buckets = max(buckets_needed(sum(texts), first, task_texts), cores if sum(texts) > 10_000 else 1)
    hot = np.nonzero(counts.sum(axis=1) > task_texts)[0]
    hot = hot[np.argsort(tokens[hot])]
    blocks = np.maximum(-(-2 * counts[hot] // task_texts), 1)
    sent = ENTRY_BYTES * buckets * (1 - (1 - 1 / buckets) ** first) + WORD_BYTES * first
    return _Plan(num, den, Order.of(tokens), buckets, tokens[hot], blocks, max(1, math.ceil(sent / max(size * ROUND_BYTES, 1))))


def _entries(n: np.ndarray, words32: np.ndarray, h: np.ndarray, side: int, plan: _Plan) -> tuple[np.ndarray, ...]:
    """Group, text, words, their places and number, an entry for each text and group.

    The words are the first ones of the string up to the place where the first shared word can be.  Bit 0 of
    a word is the side, bit 1 tells the last word of an entry; the other 30 bits are the word's.
    """
    rows, word, _ = plan.order.arrange(n, words32)
    place = np.arange(len(word), dtype=np.int64) - starts(n)[rows]
    kept = np.nonzero(place < (n - (-(-plan.num * n // plan.den)) + 1)[rows])[0]
    row, word, place = rows[kept], word[kept], place[kept]
    group = (mix(word, 11) % _U(plan.buckets)).astype(np.int64)
    if len(plan.hot):
        k = np.minimum(np.searchsorted(plan.hot, word), len(plan.hot) - 1)
        is_hot = plan.hot[k] == word
        f = np.nonzero(is_hot)[0]
        own, others = plan.blocks[k[f], side], plan.blocks[k[f], 1 - side]
        mine = (h[row[f]] % own.astype(np.uint64)).astype(np.int64)
        each = np.repeat(np.arange(len(f)), others)
        other = np.arange(len(each)) - np.repeat(np.cumsum(others) - others, others)
        cell = mine[each] * (1 << 20) + other if side == 0 else other * (1 << 20) + mine[each]
        block = (mix(word[f[each]].astype(np.uint64) << _U(24) ^ mix(cell, 5), 17) | _U(1 << 62)).astype(np.int64)
        calm = np.nonzero(~is_hot)[0]
        taken = np.concatenate([calm, f[each]])
        row, word, place, group = row[taken], word[taken], place[taken], np.concatenate([group[calm], block])
    by = np.lexsort((place, row, group))
    row, word, place, group = row[by], word[by], place[by], group[by]
    if not len(row):
        return group, row, word, place, row
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (row[1:] != row[:-1])])
    first = np.nonzero(new)[0]
    length = np.diff(np.append(first, len(row)))
    code = word & np.uint32(0xFFFFFFFC) | np.uint32(side)
    code[first + length - 1] |= np.uint32(2)
    return group[first], row[first], code, np.minimum(place, 65535).astype(np.uint16), length


def _packed_entries(broadcast, side: int, turn: int):
    def run(batches):
        plan = broadcast.value
        sent: set[int] = set()
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            fresh = np.zeros(len(h), bool)
            for i, identity in enumerate(h.tolist()):
                if identity not in sent:  # equal texts of a task are sent once
                    sent.add(identity)
                    fresh[i] = True
            if len(sent) > 2_000_000:
                sent.clear()
            part = batch.filter(pa.array(fresh))
            if not part.num_rows:
                continue
            h, n = h[fresh], part.column(1).to_numpy().astype(np.int64)
            sketch = np.stack([part.column(c).to_numpy() for c in (2, 3)], axis=1)
            group, row, code, place, length = _entries(n, part.column(4).flatten().to_numpy(), h, side, plan)
            if plan.rounds > 1:
                kept = np.nonzero(mix(group.astype(np.uint64), 29) % _U(plan.rounds) == turn)[0]
                taken = gather(starts(length)[:-1][kept], length[kept])
                group, row, code, place, length = group[kept], row[kept], code[taken], place[taken], length[kept]
            if not len(group):
                continue
            first = np.nonzero(np.concatenate([[True], group[1:] != group[:-1]]))[0]
            count = np.diff(np.append(first, len(group)))
            total = np.add.reduceat(length, first)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(group[first]), packed(as_bytes(h[row]), 8 * count), packed(as_bytes(n[row].astype(np.uint32)), 4 * count),
                    packed(as_bytes(sketch[row]).reshape(-1), 16 * count), packed(as_bytes(code), 4 * total), packed(as_bytes(place), 2 * total),
                ],
                ["group", "h", "n", "sketch", "codes", "places"],
            )

    return run


_ENTRY_TYPE = "group long, h binary, n binary, sketch binary, codes binary, places binary"


# -- candidates and verification ----------------------------------------------------------------


def _meet(num: int, den: int, chunk: int = 500_000):
    """Pairs of an evaluation and a training text that share a segment at allowed places and may overlap enough by the sketch."""

    def run(tbl: pa.Table) -> pa.Table:
        h = unpacked(tbl.column("h")).view(np.uint64)
        n = unpacked(tbl.column("n")).view(np.int32).astype(np.int64)
        sketch = unpacked(tbl.column("sketch")).view(np.uint64).reshape(-1, 2)
        code = unpacked(tbl.column("codes")).view(np.uint32)
        place = unpacked(tbl.column("places")).view(np.uint16).astype(np.int64)
        length = np.diff(np.nonzero(code & np.uint32(2))[0], prepend=-1)
        text = np.repeat(np.arange(len(h)), length)
        training = (code & np.uint32(1)) != 0
        word = (code >> np.uint32(2)).astype(np.uint64)
        # evaluation segments by word and size of the string
        posted = np.nonzero(~training)[0]
        key = word[posted] << _U(32) | n[text[posted]].astype(np.uint64)
        by = np.argsort(key, kind="stable")
        posted, key = posted[by], key[by]
        asking = np.nonzero(training)[0]
        size = n[text[asking]]
        low = np.searchsorted(key, word[asking] << _U(32) | (-(-num * size // den)).astype(np.uint64))
        high = np.searchsorted(key, word[asking] << _U(32) | (den * size // num).astype(np.uint64), side="right")
        count = np.maximum(high - low, 0)
        asking, low, count = asking[count > 0], low[count > 0], count[count > 0]
        total = np.cumsum(count)
        found, at = [np.zeros((0, 2), np.uint64)], 0
        while at < len(asking):
            to = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + chunk, side="right")), at + 1)
            there = posted[gather(low[at:to], count[at:to])]
            here = np.repeat(asking[at:to], count[at:to])
            at = to
            a, b = text[there], text[here]
            least = least_common(num, den, n[a] + n[b])
            apart = n[a] + n[b] - 2 * least
            apart = apart - np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64)
            keep = (apart >= 0) & (place[there] <= n[a] - least) & (place[here] <= n[b] - least)
            found.append(np.unique(np.stack([h[a[keep]], h[b[keep]]], axis=1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0).view(np.int64)
        return pa.table({"x": pairs[:, 0], "y": pairs[:, 1]})

    return run


def _verified(broadcast):
    """Pairs whose strings are at most the allowed distance apart, by the banded dynamic programme."""

    def run(batches):
        plan = broadcast.value
        for batch in batches:
            strings, size = [], []
            for c in (2, 3):
                n = batch.column(c).value_lengths().to_numpy().astype(np.int64)
                _, _, place = plan.order.arrange(n, batch.column(c).flatten().to_numpy())
                strings.append(place.astype(np.int64))
                size.append(n)
            both = size[0] + size[1]
            allowed = both - 2 * least_common(plan.num, plan.den, both)
            begin = [starts(n) for n in size]
            good = np.zeros(len(both), bool)
            order = np.lexsort((size[0], allowed))
            for at in range(0, len(order), 500):
                of = order[at : at + 500]
                a, b = (_padded(strings[i], begin[i][of], size[i][of], -1 - 2 * i) for i in (0, 1))
                good[of] = banded_distances(a, size[0][of], b, size[1][of], int(allowed[of].max())) <= allowed[of]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(good))

    return run


def cross_overlaps(
    evaluation: DataFrame, eval_key: str, eval_text: str, training: DataFrame, train_key: str, train_text: str,
    train_passages: str, threshold: float = 0.65, task_texts: int = TASK_TEXTS,
) -> DataFrame:
    """``(eval_id, train_id, field)``: evaluation texts whose words overlap by ``threshold`` or more
    with the text (field ``query``) or with any one passage (field ``pos``) of a training row.

    Null texts, null passages and texts without a word overlap with nothing; rows with a null key
    are left out; repeated rows and equal passages give one row.  Texts with the same words are compared
    once.  Words are compared by 32-bit hashes.  Other columns are not read.
    """
    spark = evaluation.sparkSession
    exact = Fraction(str(threshold))
    num, den = exact.numerator, exact.denominator
    asked = _hashed_texts(evaluation.select(F.col(eval_key).alias("id"), F.col(eval_text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL"))
    rows = training.select(F.col(train_key).alias("id"), F.col(train_text).alias("text"), F.col(train_passages).alias("passages")).where("id IS NOT NULL")
    trained = _hashed_texts(rows)
    sides = (asked, trained)

    texts, size = zip(*((r[0], r[1] or 0.0) for r in (t.agg(F.count("*"), F.avg("n")).first() for t in sides)))
    counted = [t.select("words").mapInArrow(word_counts, "word int, count long").groupBy("word").agg(F.sum("count").alias(c)) for t, c in zip(sides, "ab")]
    both = counted[0].withColumn("b", F.lit(0)).unionByName(counted[1].withColumn("a", F.lit(0))).groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    frequent = both.where(F.col("a") + F.col("b") > sum(texts) / FREQUENT_SHARE).orderBy(F.col("a") + F.col("b"), "word").toPandas()
    tokens = frequent["word"].to_numpy().astype(np.int32).view(np.uint32)
    counts = frequent[["a", "b"]].to_numpy().astype(np.int64).reshape(-1, 2)
    mean = sum(t * s for t, s in zip(texts, size)) / max(sum(texts), 1)
    plan = make_plan(num, den, tokens, counts, texts, mean, task_texts, spark.sparkContext.defaultParallelism)
    broadcast = spark.sparkContext.broadcast(plan)

    found = None
    for turn in range(plan.rounds):
        entries = [t.select("h", "n", "s0", "s1", "words").mapInArrow(_packed_entries(broadcast, i, turn), _ENTRY_TYPE) for i, t in enumerate(sides)]
        part = stage(entries[0].union(entries[1]).groupBy("group").applyInArrow(_meet(num, den), "x long, y long").distinct())
        if plan.rounds > 1:
            spark.sparkContext._jvm.System.gc()  # shuffles no longer referred to are removed from the disks
        found = part if found is None else found.union(part)
    found = found.distinct() if plan.rounds > 1 else found

    def strings(side: DataFrame, end: str, name: str) -> DataFrame:
        """The words of the texts of candidates, each text once."""
        wanted = side.join(found.select(F.col(end).alias("h")).distinct(), "h", "left_semi")
        return wanted.groupBy("h").agg(F.first("words").alias(name)).withColumnRenamed("h", end)

    listed = found.join(strings(asked, "x", "first"), "x").join(strings(trained, "y", "second"), "y").select("x", "y", "first", "second")
    links = listed.mapInArrow(_verified(broadcast), "x long, y long")
    a = asked.select(F.col("h").alias("x"), F.col("id").alias("eval_id")).distinct()
    b = trained.select(F.col("h").alias("y"), F.col("id").alias("train_id"), F.when(F.col("passage"), "pos").otherwise("query").alias("field")).distinct()
    return links.join(a, "x").join(b, "y").select("eval_id", "train_id", "field").distinct()


def _overlaps(spark, folder: str) -> DataFrame:
    from corpusloom.session import table

    return cross_overlaps(table(spark, folder, "dev_queries"), "qid", "query", table(spark, folder, "train_data"), "sample_id", "query", "pos")


def p2_found(spark, folder: str) -> DataFrame:
    return _overlaps(spark, folder).select(F.col("eval_id").alias("qid"), F.col("train_id").alias("sample_id"), "field")


def p2_report(spark, folder: str) -> DataFrame:
    """How many evaluation queries of each split and source overlap with the training split, and in how many rows."""
    from corpusloom.session import table

    asked = table(spark, folder, "dev_queries").select("qid", "split", "source").dropDuplicates(["qid"])
    hits = _overlaps(spark, folder).withColumnRenamed("eval_id", "qid")
    whole = asked.groupBy("split", "source").agg(F.count("*").alias("queries"))
    per = hits.join(asked, "qid").groupBy("split", "source", "field").agg(
        F.countDistinct("qid").alias("overlapping"), F.count("*").alias("pairs")
    )
    return per.join(whole, ["split", "source"]).select("split", "source", "field", "queries", "overlapping", "pairs")
