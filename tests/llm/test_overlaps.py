"""Near copies, cross-split overlaps and leaks against brute force."""
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from corpusloom.llm import crosssplit, leaks, nearcopies, spool, wordsets
from corpusloom.llm.textform import words


def overlap(a, b):
    a, b = set(words(a)), set(words(b))
    return len(a & b) / len(a | b) if a | b else 0.0


def texts(seed, n, size=(3, 60), vocabulary=90):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(vocabulary)]
    found = []
    for _ in range(n):
        if found and rng.random() < 0.6:
            w = rng.choice(found).split()
            for _ in range(rng.randint(0, max(1, len(w) // 4))):
                w[rng.randrange(len(w))] = rng.choice(pool)
            rng.shuffle(w)
        else:
            w = [rng.choice(pool) for _ in range(rng.randint(*size))]
        found.append(" ".join(w))
    return found


@pytest.mark.parametrize("threshold,task", [(0.65, 400_000), (0.8, 25)])
def test_near_copies(spark, threshold, task):
    made = texts(1, 130) + ["Same text here, five words!", "same TEXT here five words", "a b c", "", None, "long " * 3 + " ".join(f"v{i}" for i in range(900))]
    rows = [(i, t, "x", 1) for i, t in enumerate(made)] + [(3, made[3], "y", 2), (None, made[4], "z", 3)]
    df = spark.createDataFrame(rows, "id int, text string, words string, h1 int")
    want = {
        (i, j) for i in range(len(made)) for j in range(i + 1, len(made))
        if made[i] and made[j] and min(len(set(words(made[i]))), len(set(words(made[j])))) >= 5 and overlap(made[i], made[j]) >= threshold - 1e-12
    }
    got = nearcopies.pairs_of(nearcopies.near_copies(df, "id", "text", threshold, task_records=task)).collect()
    assert len(got) == len(set(got)) and {(r.a, r.b) for r in got} == want and want


def test_near_copies_classes_and_empty(spark):
    df = spark.createDataFrame([(i, "one two three four five") for i in range(40)] + [(99, "one two three four five six")], "k int, t string")
    found = nearcopies.near_copies(df, "k", "t", 0.65)
    assert found.classes.select("class_id").distinct().count() == 2
    assert [(r.class_a, r.class_b) for r in found.links.collect()] == [(0, 99)]
    empty = nearcopies.near_copies(df.limit(0), "k", "t", 0.65)
    assert empty.classes.count() == 0 and nearcopies.pairs_of(empty).count() == 0


def test_three_word_subsets(spark):
    made = texts(5, 90, (24, 60), 120)
    df = spark.createDataFrame(list(enumerate(made)), "k int, t string")
    bands = [nearcopies.Band(5, 24, 1, 3, 0), nearcopies.Band(24, 1 << 30, 4, 3, 1)]
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if overlap(made[i], made[j]) >= 0.65 - 1e-12}
    got = nearcopies.pairs_of(nearcopies.near_copies(df, "k", "t", 0.65, bands=bands)).collect()
    assert {(r.a, r.b) for r in got} == want and want
    # first words of more records than a task holds: blocks up to three tasks, second words beyond
    for task in (40, 4):
        got = nearcopies.pairs_of(nearcopies.near_copies(df, "k", "t", 0.65, task_records=task, bands=bands)).collect()
        assert {(r.a, r.b) for r in got} == want


def entry_bytes(records, known=(0.005, 0.05, 0.1, 0.2, 0.4, 0.6), each=40, task=nearcopies.TASK_RECORDS):
    """Bytes sent for a record of 138 words, and the share of the records that the largest group holds, at a size of the collection."""
    rng = np.random.default_rng(3)
    share = np.repeat(known, (8000, 200, 150, 100, 60, 40))
    tokens = np.arange(len(share), dtype=np.uint32) * np.uint32(2654435761)
    counts = (share * records).astype(np.int64)
    order = np.lexsort((tokens, counts))
    tokens, counts, share = tokens[order], counts[order], share[order]
    bands = nearcopies.allocate(13, 20, 5, records, 138.0, counts)
    held = [(records if b.lo <= 138 < b.hi else 0, 138.0) for b in bands]
    plan = nearcopies.make_plan(13, 20, bands, held, tokens, counts, records, 138.0, task, 8)
    made = [np.sort(rng.choice(len(share), 138, replace=False, p=share / share.sum())) for _ in range(each)]
    words32 = tokens[np.concatenate(made)].view(np.int32)
    n = np.full(each, 138)
    h1 = rng.integers(1, 1 << 62, each).astype(np.uint64)
    sent = sum(len(row) * nearcopies.ENTRY_BYTES + width * len(codes) for _, _, row, codes, _, width in nearcopies._entries(n, words32, h1, plan))
    return sent / each, plan


def test_bytes_of_a_record_are_bounded():
    sizes = {records: entry_bytes(records) for records in (200_000, 2_000_000, 20_000_000, 54_000_000, 10**9)}
    # the words of this made-up vocabulary are nearly all hot at 10**9 records: an entry for each pair of first and second word
    assert sizes[10**9][0] < 49 * 4 * (nearcopies.ENTRY_BYTES + 20)
    assert all(sent / plan.rounds <= 2 * nearcopies.ROUND_BYTES * 138 for sent, plan in sizes.values()), {r: (s, p.rounds) for r, (s, p) in sizes.items()}


def group_batches(records, subset, rng):
    """A group of the candidate search in batches: the first records have hardly a subset, the others many; each tenth is a copy with one word more."""
    lists = [rng.choice(1000, 2 if i < 1500 else 18, replace=False) if i % 10 or i < 1500 else None for i in range(records)]
    lists = [np.append(lists[i - 1], 1001) if words is None else words for i, words in enumerate(lists)]
    for at in range(0, records, 1000):
        some = lists[at : at + 1000]
        length = np.array([len(w) for w in some])
        begin = wordsets.starts(length)
        code = np.concatenate(some).astype(np.uint32) << np.uint32(3) | np.uint32(3)
        code[begin[1:] - 1] |= np.uint32(4)
        flat = wordsets.mix(np.concatenate(some), 1) << np.uint64(3)
        cells = [np.arange(at, at + len(some)).astype(np.uint64), length.astype(np.uint32), np.stack(wordsets.sketches(flat, begin[:-1]), axis=1), wordsets.as_bytes(code).reshape(-1, 4)[:, :2]]
        row = [pa.array([2 * 4 + subset], pa.int32()), pa.array([0]), *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cells)]
        yield pa.RecordBatch.from_arrays(row, ["key", "sub", "h1", "n", "sketch", "codes"])


@pytest.mark.parametrize("subset", [1, 2, 3])
def test_group_in_bounded_memory(monkeypatch, subset):
    monkeypatch.setattr(spool, "HELD", 1 << 14)
    monkeypatch.setattr(nearcopies, "_CODES", 20_000)
    records = 12_000 if subset == 3 else 4_000
    batches = list(group_batches(records, subset, np.random.default_rng(2)))
    tracemalloc.start()
    found = set()
    for batch in nearcopies._candidates(13, 20, chunk=20_000, keys_at_once=40_000)(iter([*batches, batches[3]])):
        found |= set(zip(*(c.to_pylist() for c in batch.columns)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(i - 1, i) for i in range(1510, records, 10)} <= found and all(a < b for a, b in found)
    # all subsets of three of 18 words of 12,000 records are 8.6 million keys of 8 bytes
    assert peak < 12e6, peak
    whole = nearcopies._candidates(13, 20, keys_at_once=10**9)(iter(batches))
    assert found == {pair for batch in whole for pair in zip(*(c.to_pylist() for c in batch.columns))}


def test_buckets_hold_a_task():
    for records in (10, 10**6, 10**8):
        b = wordsets.buckets_needed(records, 8.0, 10**6)
        assert records * (1 - (1 - 1 / b) ** 8.0) <= 10**6 * 1.01
    assert nearcopies.record_bits(1) == 1
    with pytest.raises(ValueError):
        nearcopies.record_bits(1 << 41)


def test_more_frequent_words_than_20_bits():
    common = np.arange(1 << 21, dtype=np.uint32)
    by_rank = common[::-1].copy()
    order = wordsets.Order.of(by_rank)
    assert np.array_equal(order.common, common)
    rows, word, _ = order.arrange(np.array([3, 2]), np.array([0, 2_000_000, 5_000_000, 7, 8], np.int32))
    assert rows.tolist() == [0, 0, 0, 1, 1] and word.tolist() == [5_000_000, 2_000_000, 0, 8, 7]


def test_allocation_keeps_the_pigeonhole():
    for records in (10, 10**6, 10**9):
        for band in nearcopies.allocate(13, 20, 5, records, 120.0, np.full(3000, records // 200)):
            assert band.shared <= nearcopies.least_common(13, 20, 2 * band.lo)


def test_cross_overlaps(spark):
    made = texts(2, 60, (1, 30), 60)
    evaluation = [(f"q{i}", t, 0) for i, t in enumerate(made[:30])] + [("q1", made[1], 1), ("n", None, 1), ("e", "", 1), (None, made[0], 1)]
    training = [(i, made[30 + i], [made[(7 * i) % 60], None, ""], "x") for i in range(30)] + [(3, made[33], [made[21], None, ""], "y"), (40, None, None, "z"), (41, made[0], [], "z")]
    ev = spark.createDataFrame(evaluation, "qid string, text string, id int")
    tr = spark.createDataFrame(training, "sid int, text string, passages array<string>, field string")
    want = set()
    for q, t, _ in evaluation:
        if q is None or not t:
            continue
        for s, own, passages, _ in training:
            if own and overlap(t, own) >= 0.65 - 1e-12:
                want.add((q, s, "query"))
            if any(p and overlap(t, p) >= 0.65 - 1e-12 for p in passages or []):
                want.add((q, s, "pos"))
    for task in (3_000_000, 40, 6):
        got = crosssplit.cross_overlaps(ev, "qid", "text", tr, "sid", "text", "passages", task_texts=task).collect()
        assert len(got) == len(set(got)) and set(map(tuple, got)) == want and want
    assert crosssplit.cross_overlaps(ev.limit(0), "qid", "text", tr, "sid", "text", "passages").count() == 0
    assert crosssplit.cross_overlaps(ev, "qid", "text", tr.limit(0), "sid", "text", "passages").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=9), st.lists(st.integers(1, 9), max_size=9), st.integers(0, 12))
def test_banded_distance(a, b, band):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            table[i][j] = max(i, j) if not i or not j else min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (0 if a[i - 1] == b[j - 1] else 2))
    got = crosssplit.banded_distances(np.array([a], dtype=np.int64).reshape(1, -1), np.array([len(a)]), np.array([b], dtype=np.int64).reshape(1, -1), np.array([len(b)]), band)[0]
    want = table[-1][-1]
    assert got == want if want <= band else got > band


def test_leaks(spark):
    rng = random.Random(4)
    pool = [f"t{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(3, 40)))) for i in range(12)] + [(50, None), (51, "")]
    documents = []
    for i in range(80):
        w = [rng.choice(pool) for _ in range(rng.randint(0, 60))]
        source = items[rng.randrange(12)][1].split()
        at = rng.randrange(len(source))
        cut = source[at : at + rng.randint(3, 25)]
        documents.append((i, " ".join(w[:20] + cut + w[20:]), 1))
    documents += [(5, documents[5][1], 2), (90, None, 1), (91, "", 1), (None, documents[0][1], 1)]
    dd = spark.createDataFrame(documents, "d int, text string, item int")
    ii = spark.createDataFrame(items + [items[0]], "i int, text string")
    grams = {}
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - 7):
            grams.setdefault(tuple(w[k : k + 8]), set()).add(i)
    want = {(d, i) for d, t, _ in documents if d is not None and t for k in range(len(words(t)) - 7) for i in grams.get(tuple(words(t)[k : k + 8]), ())}
    for block in (1_000_000, 60):
        got = leaks.leaked_passages(dd, "d", "text", ii, "i", "text", run=8, block_words=block).collect()
        assert len(got) == len(set(got)) and set(map(tuple, got)) == want and want
    assert leaks.leaked_passages(dd.limit(0), "d", "text", ii, "i", "text").count() == 0
    assert leaks.leaked_passages(dd, "d", "text", ii.limit(0), "i", "text").count() == 0
