"""Hard negatives: from neighbour ranks, from scored candidate lists, and audits of both."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.text import seeded


def draw_order(seed: int, *keys: str) -> Column:
    """A reproducible order that any SQL engine can compute."""
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def mine_negatives(
    neighbours: DataFrame, positives: DataFrame, low: int = 2, high: int = 200, count: int = 15, seed: int = 42, clusters: DataFrame | None = None,
    query_clusters: DataFrame | None = None, texts: DataFrame | None = None, query_texts: DataFrame | None = None,
) -> DataFrame:
    """``(qid, pid, place)``: up to ``count`` negatives of each query, drawn from neighbours of rank low < rank <= high.

    Left out are positives (qid, pid), passages of a cluster of the query (query_clusters (qid, cluster), clusters (pid,
    cluster)), and passages that say what the query says (texts (pid, text), query_texts (qid, text)).  Ids
    are compared as strings, so that differing types do not hide a match.
    """
    pool = neighbours.where((F.col("rank") > low) & (F.col("rank") <= high)).select("qid", "pid")
    known = positives.select(F.col("qid").cast("string").alias("_q"), F.col("pid").cast("string").alias("_p")).distinct()
    pool = pool.join(known, (F.col("qid").cast("string") == F.col("_q")) & (F.col("pid").cast("string") == F.col("_p")), "left_anti")
    if clusters is not None and query_clusters is not None:
        own = query_clusters.select(F.col("qid").alias("_q"), F.col("cluster").cast("string").alias("_c")).distinct()
        labelled = pool.join(clusters.select("pid", F.col("cluster").cast("string").alias("_cluster")), "pid", "left")
        pool = labelled.join(own, (F.col("qid") == F.col("_q")) & (F.col("_cluster") == F.col("_c")), "left_anti").drop("_cluster")
    if texts is not None and query_texts is not None:
        said = pool.join(texts.select("pid", F.col("text").alias("_t")), "pid", "left").join(query_texts.select("qid", F.col("text").alias("_qt")), "qid", "left")
        pool = said.where(~F.col("_t").eqNullSafe(F.col("_qt"))).drop("_t", "_qt")
    window = Window.partitionBy("qid").orderBy(draw_order(seed, "qid", "pid"))
    return pool.withColumn("place", F.row_number().over(window)).where(F.col("place") <= count)


def top_up(negatives: DataFrame, queries: DataFrame, corpus: DataFrame, positives: DataFrame, count: int = 15, seed: int = 42, exclude_positives: bool = True) -> DataFrame:
    """Queries with fewer than ``count`` negatives get more from the whole corpus, drawn by hash.

    Candidates of a query are the passages of the cell of a hashed ring that its own hash falls into, on average
    ``8 * count`` of them, so nothing is crossed.
    """
    lacking = queries.select("qid").join(negatives.groupBy("qid").agg(F.count("*").alias("_n")), "qid", "left").select("qid", (F.lit(count) - F.coalesce("_n", F.lit(0))).alias("_need")).where("_need > 0")
    size = max(corpus.count(), 1)
    cells = max(1, size // (8 * count))
    ring = corpus.select("pid", F.floor(seeded(seed, "pid") * cells).alias("_cell"))
    points = lacking.withColumn("_cell", F.floor(seeded(seed + 1, "qid") * cells))
    drawn = points.join(ring, "_cell").join(negatives.select("qid", "pid"), ["qid", "pid"], "left_anti")
    if exclude_positives:
        drawn = drawn.join(positives.select("qid", "pid"), ["qid", "pid"], "left_anti")
    window = Window.partitionBy("qid").orderBy(draw_order(seed, "qid", "pid"))
    more = drawn.withColumn("_at", F.row_number().over(window)).where(F.col("_at") <= F.col("_need"))
    return negatives.select("qid", "pid", "place").union(more.select("qid", "pid", (F.lit(count) - F.col("_need") + F.col("_at")).cast("int")))


def resolve_positives(ids: DataFrame, reindexed: DataFrame, filtered: DataFrame) -> DataFrame:
    """Texts of ids such as ``oid_5`` (from ``reindexed`` (id, text)) and ``cluster_5`` (from ``filtered`` (id, text))."""
    names = reindexed.select(F.concat(F.lit("oid_"), F.col("id").cast("string")).alias("pid"), "text").union(
        filtered.select(F.concat(F.lit("cluster_"), F.col("id").cast("string")).alias("pid"), "text")
    )
    return ids.join(names, "pid")


def margin_negatives(scored: DataFrame, margin: float = 3.0, per_system: int = 3) -> DataFrame:
    """Negatives well below the worst positive, a few of each system.

    scored: (qid, pos array<struct<pid, ce_score>>, neg map<system, array<struct<pid, ce_score>>>).  In the order of the
    map, each system adds up to ``per_system`` passages that score at most min(pos) - margin; one that
    an earlier system added does not use up the quota.
    """
    limit = F.array_min(F.transform("pos", lambda p: p["ce_score"])) - margin
    systems = F.map_entries("neg")

    def add(picked: Column, system: Column) -> Column:
        low = F.filter(system["value"], lambda c: (c["ce_score"] <= F.col("_limit")) & ~F.array_contains(picked, c["pid"]))
        return F.concat(picked, F.slice(F.array_distinct(F.transform(low, lambda c: c["pid"])), 1, per_system))

    picked = F.aggregate("_systems", F.array().cast("array<string>"), add)
    return scored.withColumn("_limit", limit).withColumn("_systems", systems).select("qid", F.transform("pos", lambda p: p["pid"]).alias("pos"), picked.alias("neg"))


def margin_filter(df: DataFrame, margin: float, positive_scores: str = "pos_scores", negative_scores: str = "neg_scores", negatives: str = "neg") -> DataFrame:
    """``neg_kept``: negatives whose own score is at most the least positive score less ``margin``; unscored ones go."""
    limit = F.array_min(F.filter(positive_scores, lambda s: s.isNotNull())) - margin
    zipped = F.arrays_zip(F.col(negatives).alias("n"), F.col(negative_scores).alias("s"))
    kept = F.filter(zipped, lambda z: z["n"].isNotNull() & (z["s"] <= limit))
    return df.withColumn("neg_kept", F.coalesce(F.transform(kept, lambda z: z["n"]), F.array().cast("array<string>")))


def leaking_negatives(negatives: DataFrame, positives: DataFrame) -> int:
    """How many negatives are positives of their query."""
    return negatives.join(positives.select("qid", "pid").distinct(), ["qid", "pid"], "left_semi").count()
