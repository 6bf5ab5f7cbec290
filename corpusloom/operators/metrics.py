"""Retrieval metrics at k over long-form ranked lists and judgements."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

RANK_KS, COUNT_KS = (5, 10, 100), (1, 5, 10, 100)
PLACEHOLDER = "already_exist"


def per_query(results: DataFrame, qrels: DataFrame, acc_ks=COUNT_KS, rank_ks=RANK_KS) -> DataFrame:
    """One row per result query that has judgements, with every metric at every k.

    results: (qid, pid, rank), qrels: (qid, pid).  Precision divides by k even for shorter lists; the ideal gain and the
    mean precision divide by at most k relevant passages.
    """
    judged = qrels.select("qid", "pid").distinct()
    relevant = judged.groupBy("qid").agg(F.count("*").alias("_n"))
    marked = results.join(judged.withColumn("_hit", F.lit(1)), ["qid", "pid"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(0)))
    return _summed(marked, relevant, acc_ks, rank_ks)


def _summed(marked: DataFrame, relevant: DataFrame, acc_ks, rank_ks) -> DataFrame:
    running = F.sum("_hit").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = marked.withColumn("_precision", running / F.col("rank")).join(relevant, "qid")
    gain = F.col("_hit") / F.log2(F.col("rank") + 1)
    out = [F.first("_n").alias("_n")]
    for k in sorted({*acc_ks, *rank_ks}):
        within = F.col("rank") <= k
        out += [
            F.sum(F.when(within, F.col("_hit")).otherwise(0)).alias(f"_hits{k}"),
            F.min(F.when(within & (F.col("_hit") == 1), F.col("rank"))).alias(f"_first{k}"),
            F.sum(F.when(within, gain).otherwise(0.0)).alias(f"_dcg{k}"),
            F.sum(F.when(within, F.col("_hit") * F.col("_precision")).otherwise(0.0)).alias(f"_ap{k}"),
        ]
    summed = rows.groupBy("qid").agg(*out)
    found = [F.col("qid")]
    for k in acc_ks:
        found += [
            (F.col(f"_hits{k}") > 0).cast("double").alias(f"accuracy_{k}"),
            (F.col(f"_hits{k}") / k).alias(f"precision_{k}"),
            (F.col(f"_hits{k}") / F.col("_n")).alias(f"recall_{k}"),
        ]
    for k in rank_ks:
        top = F.least(F.col("_n"), F.lit(k)).cast("int")
        ideal = F.aggregate(F.sequence(F.lit(1), top), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
        found += [
            F.coalesce(1 / F.col(f"_first{k}"), F.lit(0.0)).alias(f"mrr_{k}"),
            (F.col(f"_dcg{k}") / ideal).alias(f"ndcg_{k}"),
            (F.col(f"_ap{k}") / top).alias(f"map_{k}"),
        ]
    return summed.select(*found)


def evaluate_marked(results: DataFrame, counts: DataFrame, acc_ks=COUNT_KS, rank_ks=RANK_KS) -> DataFrame:
    """``evaluate`` where the results say themselves whether they are relevant: results (qid, pid, rank, hit), counts
    (qid, relevant) of all queries asked.  For judgements by a rule, such as equal labels, of which no list of pairs is made."""
    rows = results.select("qid", "pid", "rank", F.col("hit").cast("int").alias("_hit"))
    each = _summed(rows, counts.where("relevant > 0").select("qid", F.col("relevant").alias("_n")), acc_ks, rank_ks)
    return _averages(each, counts.where("relevant > 0").agg(F.count("*").alias("_asked")), acc_ks, rank_ks)


def evaluate(results: DataFrame, qrels: DataFrame, queries: DataFrame | None = None, acc_ks=COUNT_KS, rank_ks=RANK_KS) -> DataFrame:
    """``(metric, k, value)``: accuracy and MRR over all ``queries`` with judgements, the others over queries with results."""
    each = per_query(results, qrels, acc_ks, rank_ks)
    asked = None if queries is None else queries.select("qid").distinct().join(qrels.select("qid").distinct(), "qid", "left_semi").agg(F.count("*").alias("_asked"))
    return _averages(each, asked, acc_ks, rank_ks)


def _averages(each: DataFrame, asked: DataFrame | None, acc_ks, rank_ks) -> DataFrame:
    names = [(m, k) for m in ("accuracy", "precision", "recall") for k in acc_ks] + [(m, k) for m in ("mrr", "ndcg", "map") for k in rank_ks]
    rows = each.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), F.col(f"{m}_{k}").alias("v")) for m, k in names])).alias("_m")).select("_m.*")
    sums = rows.groupBy("metric", "k").agg(F.sum("v").alias("_sum"), F.count("*").alias("_count"))
    if asked is None:
        return sums.select("metric", "k", (F.col("_sum") / F.col("_count")).alias("value"))
    whole = F.when(F.col("metric").isin("accuracy", "mrr"), F.col("_asked")).otherwise(F.col("_count"))
    return sums.join(F.broadcast(asked)).select("metric", "k", (F.col("_sum") / whole).alias("value"))


def formatted(metrics: DataFrame) -> DataFrame:
    """``(name, text)``: shares as percent with two places, the others with four."""
    share = F.col("metric").isin("accuracy", "precision", "recall")
    text = F.when(share, F.format_string("%.2f%%", F.col("value") * 100)).otherwise(F.format_string("%.4f", F.col("value")))
    return metrics.select(F.concat("metric", F.lit("@"), F.col("k").cast("string")).alias("name"), text.alias("text"))


def report(metrics: DataFrame, title: str) -> str:
    """The text of a report: a title and a line for each metric, in order of name and k."""
    rows = formatted(metrics.orderBy("metric", "k")).collect()
    return "\n".join([title, *(f"{r['name']}: {r['text']}" for r in rows)])


def main_score(metrics_by_function: dict[str, DataFrame]) -> float:
    """The best of several score functions by mean average precision at the largest k."""
    best = [m.where("metric = 'map'").orderBy(F.col("k").desc()).first() for m in metrics_by_function.values()]
    return max(r["value"] for r in best if r is not None)
