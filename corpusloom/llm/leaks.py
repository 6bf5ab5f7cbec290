"""Passages of evaluation items inside training texts (problem 9).

A document carries part of an item if ``run`` or more words in a row of the document stand in a row in
the item.  Every window of ``run`` words of an item is represented by its two rarest terms, by document
frequency over all documents.  For these terms the documents have a positional index (term, document,
places), made from word hashes staged once; a posting at place p for a term at place q of an item is a hit on the diagonal p - q, a window can
only be present on a diagonal that both its terms hit, and what is left is compared word by word.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from corpusloom.llm.textform import WORD, consistent
from corpusloom.llm.wordsets import Memo, starts
from corpusloom.plans.staging import stage
from corpusloom.plans.spreading import spread

#: Words of the items of one block, all of which are broadcast.
BLOCK_WORDS = 1_000_000
_STEP = 2000


def _sequences(texts: list[str | None], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text in order, as hashes one after another, and how many there are in each."""
    flat: list[int] = []
    lengths = np.zeros(len(texts), dtype=np.int64)
    get = memo.__getitem__
    for i, text in enumerate(texts):
        if text:
            found = WORD.findall(consistent(text).lower())
            lengths[i] = len(found)
            flat.extend(map(get, found))
    return np.array(flat, dtype=np.uint64), lengths


def _located(vocabulary: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Places in the sorted vocabulary, -1 for other words."""
    if not len(vocabulary) or not len(flat):
        return np.full(len(flat), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
    return np.where(vocabulary[at] == flat, at, -1)


def _hashed(batches):
    """The words of each text in order, as 32-bit hashes."""
    memo = Memo()
    for batch in batches:
        for at in range(0, batch.num_rows, _STEP):
            part = batch.slice(at, _STEP)
            flat, lengths = _sequences(part.column(1).to_pylist(), memo)
            lists = pa.ListArray.from_arrays(pa.array(starts(lengths), pa.int32()), pa.array(_short(flat).view(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["key", "words"])


def _short(flat: np.ndarray) -> np.ndarray:
    return (flat >> np.uint64(32)).astype(np.uint32)


def _terms(batch: pa.RecordBatch, column: int, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of the vocabulary in a batch: the row, the term and the place in the text."""
    lists = batch.column(column)
    lengths = lists.value_lengths().to_numpy().astype(np.int64)
    term = _located(vocabulary, lists.flatten().to_numpy().view(np.uint32))
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(term)) - starts(lengths)[:-1][row]
    kept = np.nonzero(term >= 0)[0]
    return row[kept], term[kept], place[kept]


def _frequencies(broadcast):
    def run(batches):
        vocabulary = broadcast.value
        count = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            row, term, _ = _terms(batch, 0, vocabulary)
            once = np.unique(row * max(len(vocabulary), 1) + term)
            count += np.bincount(once % max(len(vocabulary), 1), minlength=len(vocabulary))
        seen = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(count[seen])], ["term", "documents"])

    return run


def _postings(broadcast):
    def run(batches):
        vocabulary = broadcast.value
        for batch in batches:
            row, term, place = _terms(batch, 1, vocabulary)
            if not len(row):
                continue
            by = np.argsort(row * len(vocabulary) + term, kind="stable")
            row, term, place = row[by], term[by], place[by]
            first = np.nonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])]))[0]
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(term[first].astype(np.int32)), batch.column(0).take(pa.array(row[first])), places], ["term", "key", "places"])

    return run


def _compared(broadcast, run_length: int):
    def run(batches):
        items, memo = broadcast.value, Memo()
        for batch in batches:
            keys, found = [], []
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                flat, lengths = _sequences(part.column(1).to_pylist(), memo)
                begin = starts(lengths)
                for i, hits in enumerate(part.column(2).to_pylist()):
                    document = flat[begin[i] : begin[i + 1]]
                    seen = set()
                    for hit in hits:
                        item, diagonal = hit["item"], hit["diagonal"]
                        if item in seen:
                            continue
                        words = items[item]
                        low, high = max(0, -diagonal), min(len(words), len(document) - diagonal)
                        equal = words[low:high] == document[low + diagonal : high + diagonal]
                        breaks = np.nonzero(np.concatenate([[True], ~equal, [True]]))[0]
                        if np.diff(breaks).max(initial=0) > run_length:
                            seen.add(item)
                            keys.append(at + i)
                            found.append(item)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(found, pa.int32())], ["key", "item"])

    return run


def leaked_passages(
    documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, run: int = 14, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``(key, item_id)``: documents with ``run`` or more words in a row that also stand in a row in the item.

    Words are taken from the consistent form in lower case.  Null and empty texts and items of fewer
    words carry nothing; rows with a null key are left out; repeated rows count once.  Items are
    handled in blocks of bounded size.  Other columns are not read.
    """
    if run < 2:
        raise ValueError("run must be 2 or more")
    spark = documents.sparkSession
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    source = spread(source)
    asked = items.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["item_id"])
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * block_words)))
    kind = StructType([source.schema["key"], StructField("words", ArrayType(IntegerType()))])
    hashed = stage(source.mapInArrow(_hashed, kind))  # read by every step up to the comparison, which takes the texts that are left
    found = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        pairs = _leaks_of(spark, source, hashed, part.toArrow(), run)
        found = pairs if found is None else found.union(pairs)
    return found.distinct().select(F.col("key").alias(key), F.col("item_id").alias(item_key))


def _leaks_of(spark, source: DataFrame, hashed: DataFrame, asked: pa.Table, run: int) -> DataFrame:
    flat, lengths = _sequences(asked.column("text").to_pylist(), Memo())
    begin = starts(lengths)
    words = [flat[begin[i] : begin[i + 1]] for i in range(len(lengths))]
    vocabulary = np.unique(_short(np.concatenate([flat[:0], *(w for w in words if len(w) >= run)])))
    counted = (
        hashed.select("words").mapInArrow(_frequencies(spark.sparkContext.broadcast(vocabulary)), "term int, documents long")
        .groupBy("term").agg(F.sum("documents").alias("documents")).toArrow()
    )
    frequency = np.zeros(len(vocabulary), dtype=np.int64)
    frequency[counted.column("term").to_numpy()] = counted.column("documents").to_numpy()
    anchors: set[tuple[int, int, int]] = set()  # term, item, place
    for item, sequence in enumerate(words):
        if len(sequence) < run:
            continue
        term = _located(vocabulary, _short(sequence))
        seen = frequency[term]
        for at in range(len(sequence) - run + 1):
            if seen[at : at + run].min() > 0:  # else no document has this window
                for q in at + np.argsort(seen[at : at + run], kind="stable")[:2]:
                    anchors.add((int(term[q]), item, int(q)))
    chosen, number = np.unique(np.array([a[0] for a in anchors], dtype=np.int64), return_inverse=True)
    index = stage(
        hashed.mapInArrow(
            _postings(spark.sparkContext.broadcast(vocabulary[chosen])),
            StructType([StructField("term", IntegerType()), source.schema["key"], StructField("places", ArrayType(IntegerType()))]),
        )
    )
    at = spark.createDataFrame(
        pa.table({
            "term": pa.array(number.astype(np.int32)),
            "item": pa.array([a[1] for a in anchors], pa.int32()),
            "q": pa.array([a[2] for a in anchors], pa.int32()),
        })
    )
    hits = index.join(F.broadcast(at), "term").select("key", "item", "q", F.explode("places").alias("p"))
    diagonals = (
        hits.groupBy("key", "item", (F.col("p") - F.col("q")).alias("diagonal"))
        .agg(F.min("q").alias("low"), F.max("q").alias("high"))
        .where("low < high")  # at least two different terms of the item
    )
    per_document = diagonals.groupBy("key").agg(F.collect_list(F.struct("item", "diagonal")).alias("hits"))
    checked = source.join(per_document, "key").mapInArrow(
        _compared(spark.sparkContext.broadcast(words), run), StructType([source.schema["key"], StructField("item", IntegerType())])
    )
    names = spark.createDataFrame(pa.table({"item": pa.array(range(len(words)), pa.int32()), "item_id": asked.column("item_id")}))
    return checked.join(F.broadcast(names), "item").select("key", "item_id")


def p9_found(spark, folder: str) -> DataFrame:
    from corpusloom.session import table

    return leaked_passages(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p9_items(spark, folder: str) -> DataFrame:
    """How many documents carry each leaked item, by split and source of the item."""
    from corpusloom.session import table

    items = table(spark, folder, "eval_items").select("item_id", "split", "source").dropDuplicates(["item_id"])
    return p9_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("documents")).join(F.broadcast(items), "item_id")
