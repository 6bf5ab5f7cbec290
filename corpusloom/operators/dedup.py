"""Deduplication: exact, by MinHash buckets with three ways of verification, and what follows from clusters."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions import text as T
from corpusloom.functions.hashing import band_keys, optimal_bands
from corpusloom.operators.graph import connected_components
from corpusloom.plans.staging import stage


def exact_dedup(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first row, by ``order``, of all rows that are equal in ``by``; nulls are equal to each other.

    A partial aggregate finds the first order value, so equal rows are never gathered in one task.  Rows that are
    equal in ``by`` and ``order`` both are all kept if that is the first value.
    """
    first = df.select(F.struct(*by).alias("_by"), F.col(order).alias("_order")).groupBy("_by").agg(F.min("_order").alias("_order"))
    keyed = df.withColumn("_own", F.struct(*by))
    return keyed.join(first, (F.col("_own").eqNullSafe(F.col("_by"))) & F.col(order).eqNullSafe(F.col("_order")), "left_semi").drop("_own")


def jaccard(a: Column, b: Column) -> Column:
    """Common over all members of two arrays; 0 if nothing is common."""
    common = F.size(F.array_intersect(a, b))
    return F.when(common > 0, common / F.size(F.array_union(a, b))).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Common members over the smaller array; 0 if nothing is common."""
    common = F.size(F.array_intersect(a, b))
    return F.when(common > 0, common / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))).otherwise(0.0)


def lsh_edges(bands: DataFrame, key: str) -> DataFrame:
    """``(src, dst)``: every member of a bucket linked to the bucket's least key, so a bucket of n rows gives n - 1 links."""
    least = bands.groupBy("band", "sig").agg(F.min(key).alias("dst"), F.count("*").alias("_n")).where("_n > 1")
    return (
        bands.join(least, ["band", "sig"]).where(F.col(key) != F.col("dst")).select(F.col(key).alias("src"), "dst").distinct()
    )


def lsh_clusters(
    df: DataFrame, key: str, text: str, threshold: float = 0.7, count: int = 250, ngram: int = 5, least: int = 5, bands: tuple[int, int] | None = None,
    bits: int = 32, seed: int = 42, hasher=None, drop_short: bool = False,
) -> DataFrame:
    """``(key, cluster)`` for rows with ``least`` or more parts; the label of a cluster is its least key.

    Rows with fewer than ``least`` words have no shingles and share all buckets, unless ``drop_short`` leaves
    them out; verification separates them.  Null texts are left out.  Bands are compared by 64-bit numbers.
    """
    b, r = bands or optimal_bands(threshold, count)
    signed = stage(band_keys(df, key, text, b, r, ngram, least, count, bits, seed, hasher, drop_short))
    labels = connected_components(lsh_edges(signed.where("band >= 0"), key)).select(F.col("node").alias(key), F.col("component").alias("cluster"))
    return signed.where("band < 0").select(key).join(labels, key, "left").select(key, F.coalesce("cluster", key).alias("cluster"))


def cluster_pairs(df: DataFrame, key: str, text: str, clusters: DataFrame) -> DataFrame:
    """``(cluster, a, b, score)``: all pairs a < b inside a cluster with the similarity of their numbered words.

    Quadratic in the largest cluster, which is what the mode "full" asks for; equal texts are compared once, through
    their least member.
    """
    sets = df.join(clusters, key).withColumn("_words", T.numbered_words(F.col(text)))
    heads = sets.groupBy("cluster", text).agg(F.min(key).alias("_head"), F.first("_words").alias("_words"))
    a = heads.select("cluster", F.col("_head").alias("a"), F.col("_words").alias("_wa"))
    b = heads.select("cluster", F.col("_head").alias("b"), F.col("_words").alias("_wb"))
    across = a.join(b, "cluster").where("a < b").select("cluster", "a", "b", jaccard(F.col("_wa"), F.col("_wb")).alias("score"))
    member = sets.join(heads.select("cluster", text, "_head"), ["cluster", text]).where(F.col(key) != F.col("_head"))
    equal = F.when(F.size("_words") > 0, 1.0).otherwise(0.0)
    return across.union(member.select("cluster", F.col("_head").alias("a"), F.col(key).alias("b"), equal.alias("score")))


def similar_pairs(sets: DataFrame, key: str, threshold: float) -> DataFrame:
    """``(cluster, a, b, score)``: pairs a < b of a cluster whose ``_words`` resemble each other more than ``threshold``.

    Two sets that do share one of their rarest words, of which each set has n - ceil(threshold n) + 1; only
    members of a cluster that have such a word in common are compared.  Equal sets are compared through their least member.
    """
    heads = sets.withColumn("_words", F.array_sort("_words")).groupBy("cluster", "_words").agg(F.min(key).alias("_head"))
    words = heads.select("cluster", "_head", F.size("_words").alias("_n"), F.explode("_words").alias("_word"))
    counts = words.groupBy("_word").agg(F.count("*").alias("_df"))
    ranked = words.join(counts, "_word").groupBy("cluster", "_head", "_n").agg(F.array_sort(F.collect_list(F.struct("_df", "_word"))).alias("_ranked"))
    prefix = F.slice("_ranked", 1, (F.col("_n") - F.ceil(F.col("_n") * threshold - 1e-9) + 1).cast("int"))
    posted = ranked.select("cluster", "_head", "_n", F.explode(F.transform(prefix, lambda x: x["_word"])).alias("_word"))
    a = posted.select("cluster", "_word", F.col("_head").alias("a"), F.col("_n").alias("_na"))
    b = posted.select("cluster", "_word", F.col("_head").alias("b"), F.col("_n").alias("_nb"))
    fits = (F.least("_na", "_nb") >= F.greatest("_na", "_nb") * threshold) & (F.col("a") < F.col("b"))
    near = a.join(b, ["cluster", "_word"]).where(fits).select("cluster", "a", "b").distinct()
    left = heads.select(F.col("_head").alias("a"), F.col("_words").alias("_wa"))
    right = heads.select(F.col("_head").alias("b"), F.col("_words").alias("_wb"))
    scored = near.join(left, "a").join(right, "b").select("cluster", "a", "b", jaccard(F.col("_wa"), F.col("_wb")).alias("score"))
    member = sets.withColumn("_words", F.array_sort("_words")).where(F.size("_words") > 0).join(heads, ["cluster", "_words"]).where(F.col(key) != F.col("_head"))
    equal = member.select("cluster", F.col("_head").alias("a"), F.col(key).alias("b"), F.lit(1.0).alias("score"))
    return scored.union(equal).where(F.col("score") > threshold)


def _clustered_sets(df: DataFrame, key: str, text: str, clusters: DataFrame) -> DataFrame:
    """Word sets of the members of clusters of several rows."""
    several = clusters.groupBy("cluster").agg(F.count("*").alias("_n")).where("_n > 1").select("cluster")
    return df.select(key, text).join(clusters.select(key, "cluster").join(several, "cluster", "left_semi"), key).select(key, "cluster", T.numbered_words(F.col(text)).alias("_words"))


def verify_centroid(df: DataFrame, key: str, text: str, clusters: DataFrame, threshold: float) -> DataFrame:
    """``(key, cluster, score, parent)``: rows keep the label if they resemble its root more than ``threshold``, else stand alone."""
    sets = df.select(key, T.numbered_words(F.col(text)).alias("_words"))
    rows = clusters.join(sets, key)
    roots = sets.select(F.col(key).alias("cluster"), F.col("_words").alias("_root"))
    scored = rows.join(roots, "cluster").withColumn("score", jaccard(F.col("_root"), F.col("_words")))
    return scored.select(key, F.when(F.col("score") > threshold, F.col("cluster")).otherwise(F.col(key)).alias("cluster"), "score", F.col("cluster").alias("parent"))


def verify_full(df: DataFrame, key: str, text: str, clusters: DataFrame, threshold: float) -> DataFrame:
    """``(key, cluster)``: components over the pairs of a cluster that resemble each other more than ``threshold``."""
    edges = similar_pairs(stage(_clustered_sets(df, key, text, clusters)), key, threshold).select(F.col("b").alias("src"), F.col("a").alias("dst"))
    parts = connected_components(edges).select(F.col("node").alias(key), F.col("component").alias("_part"))
    return clusters.join(parts, key, "left").select(key, F.coalesce("_part", key).alias("cluster"))


def verify_previous(df: DataFrame, key: str, text: str, clusters: DataFrame, threshold: float) -> DataFrame:
    """``(key, cluster)``: in order of keys, each row takes the label of the first earlier member it resembles, else its own.

    The label chain is a forest: each row points to its first match, and its label is the root above it, which is the
    least key of its tree; so the labels are the components over first matches.
    """
    sets = stage(_clustered_sets(df, key, text, clusters))
    heads = similar_pairs(sets, key, threshold)
    # a copy resembles whatever its least equal member resembles, and that member
    ordered = sets.select(key, "cluster", F.array_sort("_words").alias("_words"))
    least = ordered.where(F.size("_words") > 0).groupBy("cluster", "_words").agg(F.min(key).alias("_head"))
    member = stage(ordered.join(least, ["cluster", "_words"]).select(F.col(key).alias("b"), "_head"))
    first = heads.groupBy("b").agg(F.min("a").alias("a"))
    of_head = member.join(first.withColumnRenamed("b", "_head"), "_head", "left").select("b", F.least(F.coalesce("a", "_head"), "_head").alias("a")).where("a < b")
    parts = connected_components(of_head, "b", "a").select(F.col("node").alias(key), F.col("component").alias("_part"))
    return clusters.join(parts, key, "left").select(key, F.coalesce("_part", key).alias("cluster"))


VERIFY = {"centroid": verify_centroid, "previous": verify_previous, "full": verify_full}


def near_dedup(
    df: DataFrame, key: str, text: str, threshold: float = 0.7, jaccard_threshold: float | None = None, mode: str = "centroid", cluster: str = "__cluster__", **lsh,
) -> DataFrame:
    """``df`` with a cluster column; rows too short to be compared are left out.

    If ``cluster`` is there already, a numbered name is taken.  Without a ``jaccard_threshold`` the clusters are those
    of the buckets.
    """
    name, n = cluster, 0
    while name in df.columns:
        n += 1
        name = f"{cluster}{n}"
    found = lsh_clusters(df, key, text, threshold, **lsh)
    if jaccard_threshold is not None:
        found = VERIFY[mode.lower()](df, key, text, stage(found), jaccard_threshold).select(key, "cluster")
    return df.join(found.withColumnRenamed("cluster", name), key)


def sweep(df: DataFrame, key: str, text: str, clusters: DataFrame, mode: str, thresholds: list[float]) -> DataFrame:
    """``(threshold, key, cluster)`` for several thresholds over the same buckets."""
    parts = [VERIFY[mode](df, key, text, clusters, t).select(F.lit(float(t)).alias("threshold"), key, "cluster") for t in sorted(set(thresholds))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def cluster_roots(df: DataFrame, key: str, cluster: str) -> DataFrame:
    """The rows whose cluster is their own key."""
    return df.where(F.col(cluster) == F.col(key))


def cluster_members(df: DataFrame, key: str, cluster: str) -> DataFrame:
    """``(cluster, members, size)`` with the members in order."""
    return df.groupBy(cluster).agg(F.array_sort(F.collect_list(key)).alias("members"), F.count("*").alias("size"))


def representatives(df: DataFrame, key: str, text: str, cluster: str, preferred: Column) -> DataFrame:
    """``(cluster, key)``: preferred rows first, then the longest text, then the least key; by a partial aggregate."""
    rank = F.struct(preferred.cast("int").alias("p"), F.coalesce(F.length(text), F.lit(-1)).alias("n"))
    best = df.groupBy(cluster).agg(F.max(rank).alias("_best"))
    return (
        df.withColumn("_rank", rank).join(best, cluster).where("_rank = _best").groupBy(cluster).agg(F.min(key).alias(key))
    )


def remap(df: DataFrame, column: str, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """``column`` replaced by the value of its key; keys without one stay."""
    names = mapping.select(F.col(key).alias("_from"), F.col(value).alias("_to"))
    return df.join(names, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def remap_array(df: DataFrame, row: str, column: str, mapping: DataFrame, key: str, value: str, field: str | None = None) -> DataFrame:
    """The same inside an array of ids, or of structs with the id in ``field``; order and length stay."""
    names = mapping.select(F.col(key).alias("_from"), F.col(value).alias("_to"))
    items = df.select(row, F.posexplode(column).alias("_at", "_item"))
    old = F.col("_item")[field] if field else F.col("_item")
    new = F.coalesce("_to", old)
    item = F.col("_item").withField(field, new) if field else new
    rebuilt = (
        items.join(names, old == F.col("_from"), "left").groupBy(row)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", item.alias("_new")))), lambda s: s["_new"]).alias("_rebuilt"))
    )
    return df.join(rebuilt, row, "left").withColumn(column, F.coalesce("_rebuilt", column)).drop("_rebuilt")


def leak_free_split(df: DataFrame, cluster: str, order: str, test_rows: int) -> DataFrame:
    """``df`` with ``split``: the last ``test_rows`` rows in cluster order, back to the beginning of a cluster, are ``test``.

    Counts per cluster and a running sum over the clusters decide; the rows themselves are not sorted.  The running
    sum is computed per range of clusters and over the few ranges.
    """
    counts = df.groupBy(cluster).agg(F.count("*").alias("_n"))
    spark = df.sparkSession
    ranged = stage(counts.repartitionByRange(cluster).withColumn("_part", F.spark_partition_id()))
    per_part = {r["_part"]: r["_n"] for r in ranged.groupBy("_part").agg(F.sum("_n").alias("_n")).collect()}
    total = sum(per_part.values())
    before, starts = 0, []
    for p in sorted(per_part):
        starts.append((p, before))
        before += per_part[p]
    base = spark.createDataFrame(starts or [(-1, 0)], "_part int, _base long")
    within = F.sum("_n").over(Window.partitionBy("_part").orderBy(cluster)) - F.col("_n")
    begin = ranged.withColumn("_begin", within).join(F.broadcast(base), "_part").withColumn("_begin", F.col("_begin") + F.col("_base"))
    cutoff = begin.where(F.col("_begin") <= max(total - test_rows, 0)).agg(F.max(cluster)).first()[0]
    test = F.lit(False) if cutoff is None or test_rows <= 0 else F.col(cluster) >= F.lit(cutoff)
    return df.withColumn("split", F.when(test, "test").otherwise("train"))
