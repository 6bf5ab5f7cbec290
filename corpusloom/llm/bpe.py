"""Byte-level BPE with a public vocabulary: token budgets and encoding (problems 7 and 8).

A sequence of tokens is the BPE encoding of its bytes exactly if every two adjacent tokens are, alone,
the encoding of their bytes.  Encoding speculates: the longest tokens are taken from left to right,
all adjacent pairs are checked at once against a growing table of pairs known to stand or to
fail, and only words with a failing pair are merged by the rule.  Counting needs no encoding: the
encoding of a prefix has one last token, which is the one suffix token that stands after the last
token of what precedes it, so along a sorted list of distinct pieces, a trie walked in depth, the
states of shared prefixes are carried on and each new byte costs a few look-ups.
"""
from __future__ import annotations

import base64
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from corpusloom.plans.staging import stage
from corpusloom.plans.spreading import spread

#: The vocabulary file in the folder of public tokenizers.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits a text into pieces before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The most frequent pieces, whose counts are broadcast; the occurrences of all others are shuffled to their counts.
BROADCAST_PIECES = 500_000
#: Pieces that a worker remembers before it starts afresh; only speed depends on it.
REMEMBERED = 1_000_000
_STEP = 1000
_PIECES = regex.compile(PATTERN)


class Merges:
    """The vocabulary with exact merging and the table of checked pairs."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self._exact = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self._stands: dict[tuple[int, int], bool] = {}  # checked pairs, up to REMEMBERED

    def merge(self, piece: bytes) -> list[int]:
        return self._exact._encode_single_piece(piece)

    def stands(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their bytes."""
        known = self._stands.get((left, right))
        if known is None:
            known = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            if len(self._stands) >= REMEMBERED:
                self._stands.clear()
            self._stands[left, right] = known
        return known

    def propose(self, piece: bytes) -> list[int]:
        """The longest token at each place, from the left."""
        found, at, ranks = [], 0, self.ranks
        while at < len(piece):
            to = min(len(piece), at + self.longest)
            while (token := ranks.get(piece[at:to])) is None:
                to -= 1
            found.append(token)
            at = to
        return found

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The encodings of many pieces: proposed, checked pair by pair together, merged where a pair fails."""
        proposed = [self.propose(p) for p in pieces]
        lengths = np.array([len(p) for p in proposed], dtype=np.int64)
        flat = np.fromiter((t for p in proposed for t in p), dtype=np.int64, count=int(lengths.sum()))
        row = np.repeat(np.arange(len(pieces)), lengths)
        inner = np.nonzero(row[1:] == row[:-1])[0]
        pairs, at = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        good = np.fromiter((self.stands(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in pairs), dtype=bool, count=len(pairs))
        for i in np.unique(row[inner[~good[at]]]) if len(inner) else ():
            proposed[i] = self.merge(pieces[i])
        return proposed

    def counts(self, pieces) -> list[int]:
        """Tokens of each of the pieces, which come in byte order, by the states along their trie."""
        found, before, last, count = [], b"", [-1], [0]
        for piece in pieces:
            shared = 0
            for x, y in zip(before, piece):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(piece) + 1):
                for begin in range(max(0, end - self.longest), end):
                    token = self.ranks.get(piece[begin:end])
                    if token is not None and (begin == 0 or self.stands(last[begin], token)):
                        break
                last.append(token)
                count.append(count[begin] + 1)
            found.append(count[len(piece)])
            before = piece
        return found


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


# -- encoding ----------------------------------------------------------------------------------


def _encode(path: str):
    def run(batches):
        bpe = merges(path)
        slots: dict[str, int] = {}
        held: list[list[int]] = []
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                texts = [_PIECES.findall(t) if t else [] for t in part.column(1).to_pylist()]
                if len(slots) > REMEMBERED:
                    slots, held = {}, []
                new = list({p for pieces in texts for p in pieces}.difference(slots))
                slots.update((p, len(held) + i) for i, p in enumerate(new))
                held.extend(bpe.encode([p.encode() for p in new]))
                lists = [[t for p in pieces for t in held[slots[p]]] for pieces in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, pa.list_(pa.int32()))], ["key", "ids"])

    return run


def encode_texts(df: DataFrame, key: str, text: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, ids)``: the token ids of every row's text, without special tokens.

    Strings of special tokens are ordinary text.  Empty and null texts have the empty list.  Every row
    gives one row, rows with a null or repeated key as well.  Other columns are not read.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = StructType([rows.schema["key"], StructField("ids", ArrayType(IntegerType()))])
    return spread(rows).mapInArrow(_encode(f"{tokenizers}/{vocabulary}"), kind).select(F.col("key").alias(key), "ids")


# -- token budgets -----------------------------------------------------------------------------


def _counted_pieces(batches):
    """The distinct pieces of a part of the table, and how often each stands there."""
    seen: Counter[str] = Counter()

    def sent():
        found = list(seen.items())
        seen.clear()
        for at in range(0, len(found), 20_000):
            piece, times = zip(*found[at : at + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.string()), pa.array(times, pa.int64())], ["piece", "times"])

    for batch in batches:
        for text in batch.column(0).flatten().to_pylist():
            if text:
                seen.update(_PIECES.findall(text))
        if len(seen) > REMEMBERED:
            yield from sent()
    yield from sent()


def _trie(path: str):
    def run(batches):
        bpe = merges(path)
        for batch in batches:
            counts = bpe.counts([p.encode() for p in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int32())], ["piece", "times", "tokens"])

    return run


def piece_counts(df: DataFrame, texts: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(piece, times, tokens)``: every distinct piece of the texts in an array column, how often it stands there and its number of tokens.

    Pieces are range-partitioned and sorted, so that each task walks one part of the trie.
    """
    found = df.select(F.col(texts)).mapInArrow(_counted_pieces, "piece string, times long").groupBy("piece").agg(F.sum("times").alias("times"))
    ordered = found.repartitionByRange("piece").sortWithinPartitions("piece")
    return ordered.mapInArrow(_trie(f"{tokenizers}/{vocabulary}"), "piece string, times long, tokens int")


def _sum_counts(broadcast):
    """For each row its keys, texts and the tokens of its frequent pieces; and a row for each other piece in it."""

    def run(batches):
        pieces, tokens = broadcast.value
        of = dict(zip(pieces.to_pylist(), tokens.to_pylist())).get
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                lists = part.column(part.num_columns - 1)
                count = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), count)
                each, rare = np.zeros(len(row), np.int64), Counter()
                texts = lists.flatten().to_pylist()
                for i, text in enumerate(texts):
                    if text:
                        found = list(map(of, split := _PIECES.findall(text)))
                        if None in found:
                            rare.update((row[i], p) for p, n in zip(split, found) if n is None)
                            found = [n for n in found if n is not None]
                        each[i] = sum(found)
                passages = np.bincount(row, weights=[t is not None for t in texts], minlength=part.num_rows).astype(np.int64)
                totals = np.bincount(row, weights=each, minlength=part.num_rows).astype(np.int64)
                numbers = np.arange(part.num_rows) + number
                number += part.num_rows
                names = ["row", *part.schema.names[:-1], "passages", "tokens", "piece"]
                yield pa.RecordBatch.from_arrays([pa.array(numbers), *part.columns[:-1], pa.array(passages), pa.array(totals), pa.nulls(part.num_rows, pa.string())], names)
                if rare:
                    at_row, piece = zip(*rare)
                    nothing = [pa.nulls(len(rare), c.type) for c in part.columns[:-1]]
                    times = pa.array(rare.values(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[list(at_row)]), *nothing, pa.nulls(len(rare), pa.int64()), times, pa.array(piece, pa.string())], names)

    return run


def token_counts(
    df: DataFrame, keys: list[str], texts: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, broadcast_pieces: int = BROADCAST_PIECES,
) -> DataFrame:
    """``keys``, ``passages`` and ``tokens``: how many tokens the texts in array column ``texts`` contain, a row for each row.

    Null and empty arrays, null and empty texts have no tokens; ``passages`` counts texts that are
    not null.  The counts of the ``broadcast_pieces`` most frequent pieces are broadcast and summed in the scan; the other
    pieces of a row, each rare, are joined to their counts by a shuffle.  Both parts are added for every row, at
    any size.  Names of other columns don't matter.
    """
    rows = spread(df.select(*keys, F.col(texts).alias("_texts")))
    pieces = stage(piece_counts(rows, "_texts", tokenizers, vocabulary))
    # pieces by how often they stand in the texts, on a scale of an eighth of a doubling: a few hundred cells
    cell = F.floor(F.log2("times") * 8).cast("int")
    left, cut = broadcast_pieces, -1
    for r in pieces.groupBy(cell.alias("cell")).count().orderBy(F.desc("cell")).collect():
        left -= r["count"]
        if left < 0:
            cut = r["cell"]
            break
    found = pieces.where(cell > cut).select("piece", "tokens").toArrow()
    table = tuple(found.column(c).combine_chunks() for c in ("piece", "tokens"))
    inner = [StructField(f"_{i}", rows.schema[k].dataType) for i, k in enumerate(keys)]
    kind = StructType([StructField("row", LongType()), *inner, *(StructField(c, LongType()) for c in ("passages", "tokens")), StructField("piece", StringType())])
    renamed = rows.toDF(*(f.name for f in inner), "_texts")
    summed = stage(renamed.mapInArrow(_sum_counts(rows.sparkSession.sparkContext.broadcast(table)), kind))
    rest = summed.where("piece IS NOT NULL").select("row", "piece", F.col("tokens").alias("times"))
    joined = rest.join(pieces.where(cell <= cut).select("piece", F.col("tokens").alias("each")), "piece")
    more = joined.groupBy("row").agg(F.sum(F.col("times") * F.col("each")).alias("more"))
    whole = summed.where("piece IS NULL").join(more, "row", "left")
    return whole.select(*(F.col(f.name).alias(k) for f, k in zip(inner, keys)), "passages", (F.col("tokens") + F.coalesce("more", F.lit(0))).alias("tokens"))


def language(code: Column) -> Column:
    """One spelling for each language code; ``und`` for none."""
    plain = F.lower(F.trim(code))
    return (
        F.when(plain.isin("vi", "vn", "vie", "vietnamese"), "vi").when(plain.isin("en", "eng", "english"), "en")
        .when(plain.isNull() | plain.isin("", "und", "unk", "unknown"), "und").otherwise(plain)
    )


def domain(name: Column) -> Column:
    plain = F.lower(F.trim(name))
    return F.when(plain.isNull() | (plain == ""), "none").otherwise(plain)


def _documents(spark, folder: str) -> DataFrame:
    from corpusloom.session import table

    corpus = table(spark, folder, "temp_legal_corpus_withstpvl").select(
        F.lit("temp_legal_corpus_withstpvl").alias("tbl"), F.col("oid").alias("key"), F.col("dataset").alias("source"), "lang", "domain", F.array("text").alias("texts")
    )
    nothing = F.array().cast("array<string>")
    mined = table(spark, folder, "train_data_minedhn").select(
        F.lit("train_data_minedhn").alias("tbl"), F.col("sample_id").alias("key"), "source", "lang", "domain",
        F.concat(F.coalesce("pos", nothing), F.coalesce("neg", nothing)).alias("texts"),
    )
    both = corpus.union(mined).where("key IS NOT NULL")
    return both.withColumns({"lang": language(F.col("lang")), "domain": domain(F.col("domain")), "source": F.coalesce(F.trim("source"), F.lit("none"))})


def p7_documents(spark, folder: str) -> DataFrame:
    """Tokens of every document, each key once."""
    return token_counts(_documents(spark, folder), ["tbl", "key", "source", "lang", "domain"], "texts").dropDuplicates(["tbl", "key"])


def p7_budget(spark, folder: str) -> DataFrame:
    """Documents, passages and tokens by table, source, language and domain."""
    return p7_documents(spark, folder).groupBy("tbl", "source", "lang", "domain").agg(
        F.count("*").alias("documents"), F.sum("passages").alias("passages"), F.sum("tokens").alias("tokens")
    )


def p8_ids(spark, folder: str) -> DataFrame:
    from corpusloom.session import table

    return encode_texts(table(spark, folder, "documents"), "doc_id", "text")
