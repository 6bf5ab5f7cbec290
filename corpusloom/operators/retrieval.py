"""Retrieval: exact nearest neighbours, BM25+, rank fusion, reranking and chunk collapse."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corpusloom.functions import text as T
from corpusloom.plans.spreading import spread
from corpusloom.plans.staging import stage

#: Numbers in one broadcast block of query vectors.
BLOCK_NUMBERS = 16_000_000
#: Scores a task holds at once: the passages of a step times the queries of a block.
SCORES = 8_000_000


def ranked(scores: DataFrame, query: str = "qid", passage: str = "pid", score: str = "score", rank: str = "rank") -> DataFrame:
    """Unique ranks from 1 by falling score within each query, ties by passage id."""
    window = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(passage))
    return scores.withColumn(rank, F.row_number().over(window))


def top_k(scores: DataFrame, k: int, query: str = "qid", passage: str = "pid", score: str = "score") -> DataFrame:
    return ranked(scores, query, passage, score).where(F.col("rank") <= k)


def knn_join(
    queries: DataFrame, corpus: DataFrame, k: int = 100, query_id: str = "qid", corpus_id: str = "pid", vector: str = "embedding", metric: str = "cosine",
    skip_self: bool = False, block_numbers: int = BLOCK_NUMBERS,
) -> DataFrame:
    """``(qid, pid, score, rank)``: the ``k`` nearest corpus rows of each query, exactly, by ``cosine`` or ``dot``.

    Query vectors are the stated query set and are broadcast in blocks of bounded size; the corpus is scanned
    once per block, in parallel and without a shuffle, and every task keeps its best ``k`` of each query.  Null vectors
    are left out; a zero vector has cosine 0.  ``skip_self`` leaves out equal ids.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col(query_id).alias("qid"), F.col(vector).cast("array<double>").alias("v")).where("qid IS NOT NULL AND v IS NOT NULL")
    rows = corpus.select(F.col(corpus_id).alias("pid"), F.col(vector).cast("array<double>").alias("v")).where("pid IS NOT NULL AND v IS NOT NULL")
    kind = StructType([asked.schema["qid"], rows.schema["pid"], StructField("score", DoubleType())])
    numbers = asked.agg(F.sum(F.size("v"))).first()[0] or 0
    blocks = max(1, -(-numbers // block_numbers))
    found = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).toArrow() if blocks > 1 else asked.toArrow()
        ids = part.column("qid").combine_chunks()
        matrix = _matrix(part.column("v").combine_chunks(), metric)
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(batches, shared=shared):
            ids, matrix = shared.value
            own = ids.to_pylist() if skip_self else None
            at_own = {v: i for i, v in enumerate(own)} if skip_self else {}
            best = np.full((len(ids), 0), 0.0)
            held = np.zeros((len(ids), 0), np.int64)  # rows of this task, numbered through
            names, type_, seen = [], None, 0
            rows_at_once = max(64, min(4096, SCORES // max(len(ids), 1)))
            for batch in batches:
                type_ = batch.schema.field(0).type
                for at in range(0, batch.num_rows if len(ids) else 0, rows_at_once):
                    piece = batch.slice(at, rows_at_once)
                    # in order of ids within the piece, so that of equal scores the least id is found first
                    order = pa.compute.sort_indices(piece.column(0))
                    piece = piece.take(order)
                    scores = matrix @ _matrix(piece.column(1), metric).T
                    if skip_self:
                        for j, v in enumerate(piece.column(0).to_pylist()):
                            if v in at_own:
                                scores[at_own[v], j] = -np.inf
                    names.append(piece.column(0))
                    both = np.concatenate([best, scores], axis=1)
                    numbers = np.concatenate([held, np.broadcast_to(np.arange(seen, seen + piece.num_rows), scores.shape)], axis=1)
                    seen += piece.num_rows
                    best, held = _keep_best(both, numbers, names, k)
                    names, held = _compacted(names, held)
                    seen = sum(map(len, names))
            if held.shape[1]:
                row, column = np.nonzero(np.isfinite(best))
                pids = pa.concat_arrays([n.combine_chunks() if isinstance(n, pa.ChunkedArray) else n for n in names]).take(pa.array(held[row, column])).cast(type_)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pids, pa.array(best[row, column])], ["qid", "pid", "score"])

        local = rows.mapInArrow(run, kind)
        found = local if found is None else found.union(local)
    return top_k(found, k)


def _keep_best(scores: np.ndarray, numbers: np.ndarray, names: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best columns of each row, and all that tie with the last of them if that is more than k."""
    if scores.shape[1] <= k:
        return scores, numbers
    edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    tied = (scores >= edge).sum(axis=1)
    width = min(int(tied.max(initial=k)), scores.shape[1])
    if width > k:  # ties at the edge: the least ids stay
        ids = pa.concat_arrays(names).to_pylist()
        for r in np.nonzero(tied > k)[0]:
            at = np.nonzero(scores[r] == edge[r])[0]
            drop = sorted(at, key=lambda c: ids[numbers[r, c]])[k - int((scores[r] > edge[r]).sum()) :]
            scores[r, drop] = -np.inf
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return np.take_along_axis(scores, best, 1), np.take_along_axis(numbers, best, 1)


def _compacted(names: list, held: np.ndarray) -> tuple[list, np.ndarray]:
    """Only the ids that are still among the best of a query, renumbered."""
    used, at = np.unique(held, return_inverse=True)
    return [pa.concat_arrays(names).take(pa.array(used))], at.reshape(held.shape)


def _matrix(column, metric: str) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    matrix = values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    if metric == "cosine":
        norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)
    return matrix


# -- BM25+ -------------------------------------------------------------------------------------


def postings(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """``(pid, term, tf, dl)``: terms of each document with their count and the document's length."""
    rows = spread(docs).select(F.col(key).alias("pid"), terms.alias("_terms")).where("pid IS NOT NULL AND _terms IS NOT NULL")
    each = rows.select("pid", F.size("_terms").alias("dl"), F.explode("_terms").alias("term"))
    return each.groupBy("pid", "term", "dl").agg(F.count("*").alias("tf")).select("pid", "term", "tf", "dl")


def document_frequencies(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


@dataclass(frozen=True)
class Bm25Index:
    """Postings with document frequencies, the number of documents and their mean length in terms."""

    postings: DataFrame  # pid, term, tf, dl, df
    documents: int
    mean: float


def build_bm25(docs: DataFrame, doc_id: str, doc_terms: Column, path: str | None = None) -> Bm25Index:
    """An index of ``docs``, written to ``path`` (or the shared folder), so that the corpus is split into terms once.

    Empty documents count for the mean length; null texts and ids are left out.
    """
    spark = docs.sparkSession
    terms = stage(spread(docs).select(F.col(doc_id).alias("pid"), doc_terms.alias("_terms")).where("pid IS NOT NULL AND _terms IS NOT NULL"))
    n, mean = terms.agg(F.count("*"), F.avg(F.size("_terms"))).first()
    posts = terms.select("pid", F.size("_terms").alias("dl"), F.explode("_terms").alias("term")).groupBy("pid", "term", "dl").agg(F.count("*").alias("tf"))
    posts = stage(posts)
    held = posts.join(document_frequencies(posts), "term").select("pid", "term", "tf", "dl", "df")
    if path is None:
        return Bm25Index(held, n or 0, mean or 0.0)
    held.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    spark.createDataFrame([(n or 0, mean or 0.0)], "documents long, mean double").coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")
    return load_bm25(spark, path)


def load_bm25(spark, path: str) -> Bm25Index:
    """An index that ``build_bm25`` has written."""
    n, mean = spark.read.parquet(f"{path}/statistics").first()
    return Bm25Index(spark.read.parquet(f"{path}/postings"), n, mean)


def search_bm25(index: Bm25Index, queries: DataFrame, query_id: str, query_terms: Column, k1: float = 0.6, b: float = 0.9, delta: float = 1.0, k: int | None = 100) -> DataFrame:
    """``(qid, pid, score, rank)`` by BM25+ for documents that share a term with the query.

    Every document has the constant ``sum(idf * delta)`` over the query's terms, so documents without a common
    term follow, all with that score, and are not listed.  Repeated query terms count repeatedly.
    """
    asked = (
        queries.select(F.col(query_id).alias("qid"), F.explode(query_terms).alias("term")).where("qid IS NOT NULL").groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    )
    held = index.postings.join(asked.select("term").distinct(), "term", "left_semi")
    idf = held.select("term", "df").distinct().select("term", F.log((F.lit(index.documents) + 1) / F.col("df")).alias("idf"))
    weighted = asked.join(idf, "term")
    constant = weighted.groupBy("qid").agg(F.sum(F.col("qtf") * F.col("idf") * delta).alias("_constant"))
    part = F.col("tf") * (k1 + 1) / (k1 * (1 - b + b * F.col("dl") / index.mean) + F.col("tf"))
    scored = weighted.join(held, "term").groupBy("qid", "pid").agg(F.sum(F.col("qtf") * F.col("idf") * part).alias("_part"))
    scores = scored.join(constant, "qid").select("qid", "pid", (F.col("_part") + F.col("_constant")).alias("score"))
    return top_k(scores, k) if k else ranked(scores)


def bm25(
    queries: DataFrame, query_id: str, query_terms: Column, docs: DataFrame, doc_id: str, doc_terms: Column, k1: float = 0.6, b: float = 0.9, delta: float = 1.0, k: int | None = 100,
) -> DataFrame:
    """``search_bm25`` over an index made for this call."""
    return search_bm25(build_bm25(docs, doc_id, doc_terms), queries, query_id, query_terms, k1, b, delta, k)


# -- fusion and reranking --------------------------------------------------------------------------


def rrf(dense: DataFrame, sparse: DataFrame, k: int = 60, weight: float | list[float] = 0.1) -> DataFrame:
    """Weighted reciprocal ranks of two ranked lists of (qid, pid, rank): ``(weight, qid, pid, score, rank)``.

    A passage that one list lacks gets nothing from it.  Several weights are fused in one pass over the joined ranks.
    """
    weights = weight if isinstance(weight, list) else [weight]
    both = dense.select("qid", "pid", F.col("rank").alias("_d")).join(sparse.select("qid", "pid", F.col("rank").alias("_s")), ["qid", "pid"], "full")
    each = both.withColumn("weight", F.explode(F.array(*map(F.lit, map(float, weights)))))
    score = (1 - F.col("weight")) * F.coalesce(1 / (F.col("_d") + k), F.lit(0.0)) + F.col("weight") * F.coalesce(1 / (F.col("_s") + k), F.lit(0.0))
    window = Window.partitionBy("weight", "qid").orderBy(F.col("score").desc(), "pid")
    return each.select("weight", "qid", "pid", score.alias("score")).withColumn("rank", F.row_number().over(window))


def rrf_from_scores(first: DataFrame, second: DataFrame, k: int = 10, weight: float = 0.1) -> DataFrame:
    return rrf(ranked(first), ranked(second), k, weight)


def lexical_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Sums of weight products over common tokens, of ``(qid, token, weight)`` and ``(pid, token, weight)``."""
    q = queries.select("qid", "token", F.col("weight").alias("_q"))
    d = docs.select("pid", "token", F.col("weight").alias("_d"))
    return q.join(d, "token").groupBy("qid", "pid").agg(F.sum(F.col("_q") * F.col("_d")).alias("score"))


def pooled_weights(weights: DataFrame, key: str, special: list[str] | None = None) -> DataFrame:
    """The largest positive weight of each token of a text, special tokens left out."""
    kept = weights.where(F.col("weight") > 0)
    kept = kept.where(~F.col("token").isin(special)) if special else kept
    return kept.groupBy(key, "token").agg(F.max("weight").alias("weight"))


def max_sim(pairs: DataFrame, query_vectors: str, passage_vectors: str, out: str = "score") -> DataFrame:
    """Late interaction: the mean over query vectors of the best inner product with a passage vector."""

    @F.pandas_udf(DoubleType())
    def score(q: pd.Series, p: pd.Series) -> pd.Series:
        def one(a, b):
            if a is None or b is None or not len(a) or not len(b):
                return 0.0
            return float((np.stack(a).astype(float) @ np.stack(b).astype(float).T).max(axis=1).mean())

        return pd.Series([one(a, b) for a, b in zip(q, p)])

    return pairs.withColumn(out, score(query_vectors, passage_vectors))


def pair_scores(pairs: DataFrame, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """All scores of pairs of encoded texts: columns dense, sparse, colbert and their weighted means.

    pairs: (qid, pid, q_dense, p_dense array<float>, q_lexical, p_lexical map<string, float>, q_vectors, p_vectors
    array<array<float>>), as ``models.encode_all`` makes them.
    """
    dense = F.aggregate(F.zip_with("q_dense", "p_dense", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    shared = F.transform(F.map_keys("q_lexical"), lambda t: F.col("q_lexical")[t].cast("double") * F.coalesce(F.try_element_at("p_lexical", t), F.lit(0.0)))
    scored = pairs.withColumns({"dense": F.coalesce(dense, F.lit(0.0)), "sparse": F.coalesce(F.aggregate(shared, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))})
    return mixed_scores(max_sim(scored, "q_vectors", "p_vectors", "colbert"), weights)


def mixed_scores(pairs: DataFrame, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Weighted means of the columns dense, sparse and colbert: all three, and dense with sparse."""
    w1, w2, w3 = weights
    dense, sparse, colbert = F.col("dense"), F.col("sparse"), F.col("colbert")
    return pairs.withColumns({
        "sparse_dense": (dense * w1 + sparse * w2) / (w1 + w2),
        "colbert_sparse_dense": (dense * w1 + sparse * w2 + colbert * w3) / (w1 + w2 + w3),
    })


def rerank(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates ``(qid, pid, rank)`` in the order of new scores, ties by the former rank; unscored ones last."""
    joined = candidates.select("qid", "pid", F.col("rank").alias("_before")).join(scores.select("qid", "pid", "score"), ["qid", "pid"], "left")
    window = Window.partitionBy("qid").orderBy(F.col("score").desc_nulls_last(), "_before")
    return joined.withColumn("rank", F.row_number().over(window)).drop("_before")


PLACEHOLDER = "already_exist"


def collapse_chunks(results: DataFrame) -> DataFrame:
    """Chunk ids as ids of their parents; later chunks of a parent keep their place under a placeholder."""
    parent = T.parent_id(F.col("pid"))
    window = Window.partitionBy("qid", "_parent").orderBy("rank")
    marked = results.withColumn("_parent", parent).withColumn("_n", F.row_number().over(window))
    return marked.withColumn("pid", F.when(F.col("_n") == 1, F.col("_parent")).otherwise(PLACEHOLDER)).drop("_parent", "_n")


def search(query: str, corpus: DataFrame, encoder, key: str = "pid", text: str = "text", vector: str = "embedding", scorer=None, top: int = 5, candidates: int = 100) -> DataFrame:
    """The ``top`` texts for one query: nearest ``candidates`` by vectors, optionally reordered by a pair scorer."""
    spark = corpus.sparkSession
    asked = spark.createDataFrame([("q", [float(x) for x in encoder([query])[0]])], "qid string, embedding array<double>")
    near = knn_join(asked, corpus, candidates, "qid", key, vector).withColumnRenamed("pid", key)
    found = near.join(corpus.select(key, text), key)
    if scorer is not None:
        rows = found.toPandas()
        rows["score"] = scorer([(query, t) for t in rows[text]])
        found = spark.createDataFrame(rows.sort_values(["score", "rank"], ascending=[False, True]).assign(rank=range(1, len(rows) + 1)))
    return found.where(F.col("rank") <= top).select("rank", key, text, "score").orderBy("rank")
