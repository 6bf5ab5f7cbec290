"""Places for models: encoders, pair scorers, language models and translators, with offline defaults."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, StringType, StructField, StructType

from corpusloom.functions.text import split_with_fillers, tokens
from corpusloom.plans.spreading import spread
from corpusloom.plans.staging import stage


def hashed_encoder(dimensions: int = 64):
    """A deterministic encoder: signed hashed word counts, normalised.  Any callable from texts to vectors can take its place."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), dtype=np.float32)
        for i, text in enumerate(texts):
            for w in (text or "").lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                out[i, h % dimensions] += 1.0 if h >> 63 else -1.0
        norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

    return encode


def overlap_scorer(pairs: list[tuple[str, str]]) -> list[float]:
    """A deterministic pair scorer: the share of query words in the passage, as a logit-like number."""
    found = []
    for q, p in pairs:
        a, b = set((q or "").lower().split()), set((p or "").lower().split())
        found.append(4.0 * len(a & b) / len(a) - 2.0 if a else -2.0)
    return found


def encode(df: DataFrame, key: str, text: str, encoder, batch: int = 256) -> DataFrame:
    """``(key, embedding)``; texts go to the encoder by rising length within a batch, so that little is padded."""
    source = df.select(key, text)

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            vectors: list = [None] * len(texts)
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                for i, v in zip(part, encoder([texts[i] for i in part])):
                    vectors[i] = [float(x) for x in v]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float32()))], [key, "embedding"])

    return source.mapInArrow(run, StructType([source.schema[key], StructField("embedding", ArrayType(FloatType()))]))


def score_pairs(df: DataFrame, query: str, passage: str, scorer=overlap_scorer, normalize: bool = False, out: str = "score") -> DataFrame:
    """``out``: the pair scorer's number for each row, as a sigmoid if ``normalize``."""

    @F.pandas_udf(DoubleType())
    def score(q: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([float(x) for x in scorer(list(zip(q, p)))])

    scored = df.withColumn(out, score(query, passage))
    return scored.withColumn(out, 1 / (1 + F.exp(-F.col(out)))) if normalize else scored


def unigram_perplexity(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, perplexity)`` under an add-one unigram model of the table itself: 10 to the negative mean log10 probability.

    The end of the text counts as one more token with the share of texts.  Counts are joined by word; texts without words
    have the perplexity of the end alone.  Null texts are left out.
    """
    rows = stage(spread(df).where(F.col(text).isNotNull()).select(key, F.filter(tokens(F.col(text)), lambda t: t != "").alias("_w")))
    words = rows.select(key, F.explode("_w").alias("_word")).groupBy(key, "_word").agg(F.count("*").alias("_times"))
    counts = words.groupBy("_word").agg(F.sum("_times").alias("_count"))
    total, kinds = counts.agg(F.coalesce(F.sum("_count"), F.lit(0)), F.count("*")).first()
    texts = rows.count()
    whole = total + texts + kinds + 1
    logs = words.join(counts, "_word").groupBy(key).agg(F.sum(F.col("_times") * F.log10((F.col("_count") + 1) / float(whole))).alias("_log"))
    end = math.log10((texts + 1) / whole) if whole else 0.0
    joined = rows.select(key, (F.size("_w") + 1).alias("_n")).join(logs, key, "left")
    return joined.select(key, F.pow(F.lit(10.0), -(F.coalesce("_log", F.lit(0.0)) + end) / F.col("_n")).alias("perplexity"))


def perplexity(df: DataFrame, key: str, text: str, model) -> DataFrame:
    """``(key, perplexity)`` by a callable from text to (log10 probability, tokens), rounded to one place."""
    source = df.where(F.col(text).isNotNull()).select(key, text)

    def run(batches):
        for b in batches:
            found = []
            for t in b.column(1).to_pylist():
                log, n = model(t)
                found.append(round(10.0 ** (-log / (n + 1)), 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], [key, "perplexity"])

    return source.mapInArrow(run, StructType([source.schema[key], StructField("perplexity", DoubleType())]))


def translation_batches(lengths: list[int]) -> list[list[int]]:
    """Indices of sentences in batches by length: eight up to 128, four up to 192, else one."""
    order, batches = sorted(range(len(lengths)), key=lambda i: lengths[i]), []
    at = 0
    while at < len(order):
        size = 8
        while size > 1 and lengths[order[min(at + size, len(order)) - 1]] > {8: 128, 4: 192}[size]:
            size = 4 if size == 8 else 1
        batches.append(order[at : at + size])
        at += size
    return batches


def longest_output(length: int) -> int:
    return int(10 + 1.2 * length)


def translate(df: DataFrame, key: str, text: str, translator, measure=lambda s: len(s.split())) -> DataFrame:
    """``(key, translation)``: sentences translated in batches and joined by what stood between them.

    translator: a callable from (sentences, longest output) to sentences.  Null texts stay null.
    """
    source = df.select(key, text)

    def one(t):
        if t is None:
            return None
        sentences, fillers = split_with_fillers(t)
        done: list = [None] * len(sentences)
        lengths = [measure(s) for s in sentences]
        for batch in translation_batches(lengths):
            for i, s in zip(batch, translator([sentences[i] for i in batch], longest_output(max(lengths[i] for i in batch)))):
                done[i] = s
        return fillers[0] + "".join(s + f for s, f in zip(done, fillers[1:]))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(t) for t in b.column(1).to_pylist()], pa.string())], [key, "translation"])

    from pyspark.sql.types import StringType

    return source.mapInArrow(run, StructType([source.schema[key], StructField("translation", StringType())]))


def segment(df: DataFrame, column: str, segmenter=str.split, out: str = "segmented") -> DataFrame:
    """Words of a text joined by blanks, by a callable from text to words."""

    @F.pandas_udf("string")
    def udf(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else " ".join(segmenter(t)))

    return df.withColumn(out, udf(column))


def hashed_multi_encoder(dimensions: int = 32):
    """A deterministic encoder of all three kinds: (dense vector, token weights, a vector for each word) of each text."""
    dense = hashed_encoder(dimensions)

    def encode_texts(texts: list[str]) -> list[tuple]:
        vectors = dense(texts)
        found = []
        for text, vector in zip(texts, vectors):
            words = (text or "").lower().split()
            weights: dict[str, float] = {}
            for w in words:  # the largest weight of a token holds
                weights[w] = max(weights.get(w, 0.0), 1.0 / (1.0 + len(weights)))
            found.append((vector, weights, dense(words) if words else np.zeros((0, dimensions), np.float32)))
        return found

    return encode_texts


def encode_all(df: DataFrame, key: str, text: str, encoder, batch: int = 256) -> DataFrame:
    """``(key, dense, lexical, vectors)``: the dense vector, token weights and word vectors of each text.

    Null texts count as empty.  ``encoder`` maps a list of texts to such triples; it is built once for each task.
    """
    source = df.select(key, text)
    kind = StructType(
        [source.schema[key], StructField("dense", ArrayType(FloatType())), StructField("lexical", MapType(StringType(), FloatType())), StructField("vectors", ArrayType(ArrayType(FloatType())))]
    )

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                found = encoder([t if isinstance(t, str) else "" for t in part[text]])
                yield pd.DataFrame({
                    key: part[key].to_numpy(), "dense": [np.asarray(d, np.float32) for d, _, _ in found], "lexical": [{k: float(v) for k, v in w.items()} for _, w, _ in found],
                    "vectors": [[np.asarray(v, np.float32) for v in m] for _, _, m in found],
                })

    return spread(source).mapInPandas(run, kind)


def token_strings(weights: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Token ids as their strings: ``weights`` with column ``token_id``, ``vocabulary`` (token_id, token).  Unknown ids are left out;
    of ids with the same string the largest weight of a key holds."""
    keys = [c for c in weights.columns if c not in ("token_id", "weight")]
    named = weights.join(vocabulary.select("token_id", "token").dropDuplicates(["token_id"]), "token_id")
    return named.groupBy(*keys, "token").agg(F.max("weight").alias("weight"))
