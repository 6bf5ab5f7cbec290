"""Training data: length buckets, batch plans, sampled groups, language choice and pair choice."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.text import seeded
from corpusloom.operators.etl import row_index

# Rows per batch by length bucket, by the number of texts in a group; the last two are for devices of 24 GB.
BATCH_ROWS = {"0-500": 48, "500-1000": 32, "1000-2000": 20, "2000-3000": 18, "3000-4000": 14, "4000-5000": 14, "5000-6000": 12, "6000-7000": 10, "7000-inf": 8}
BATCH_ROWS_OF_GROUPS = {
    8: BATCH_ROWS,
    3: {"0-512": 86, "512-1024": 56, "1024-2048": 24, "2048-3072": 16, "3072-4096": 10, "4096-5120": 8, "5120-6144": 8, "6144-7168": 8, "7168-inf": 8},
    2: {"0-512": 88, "512-1024": 58, "1024-2048": 24, "2048-inf": 16},
    1: {"0-512": 144, "512-1024": 80, "1024-2048": 56, "2048-3072": 44, "3072-4096": 32, "4096-5120": 24, "5120-6144": 24, "6144-7168": 24, "7168-inf": 24},
}
SMALL_DEVICE_ROWS_OF_GROUPS = {
    3: {"0-512": 60, "512-1024": 44, "1024-2048": 24, "2048-inf": 24},
    2: {"0-512": 88, "512-1024": 58, "1024-2048": 24, "2048-inf": 16},
}


def _draw(key: str, place: Column, seed: int) -> Column:
    """A hash by which entries of a list are drawn."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), place.cast("string"), F.lit(str(seed))))


def longest_text(texts: list[Column], measure) -> Column:
    """The largest ``measure`` over texts and arrays of texts (nulls count 0); measure maps a column to a column."""
    return F.array_max(F.transform(F.concat(*texts), lambda t: F.coalesce(measure(t), F.lit(0))))


def length_bucket(length: Column, edges: list[int]) -> Column:
    """``a-b`` for a <= length < b, ``a-inf`` from the last edge on; null below the first."""
    found = F.when(length >= edges[-1], f"{edges[-1]}-inf")
    for a, b in reversed(list(zip(edges, edges[1:]))):
        found = found.when((length >= a) & (length < b), f"{a}-{b}")
    return found


def bucket_summary(df: DataFrame, bucket: str, length: str) -> DataFrame:
    return df.groupBy(bucket).agg(F.count("*").alias("rows"), F.avg(length).alias("avg_length"))


def batch_rows(bucket: Column, default: int, table: dict[str, int] | None = None) -> Column:
    """Rows per batch of a bucket, ``default`` for others; ``table`` is for groups of another size or other devices."""
    entries = [F.lit(x) for p in (table or BATCH_ROWS).items() for x in p]
    return F.coalesce(F.try_element_at(F.create_map(*entries), bucket), F.lit(default))


def group_batch_rows(bucket: Column, group_size: int, default: int, small_device: bool = False) -> Column:
    """Rows per batch of a bucket for groups of ``group_size`` texts; ``default`` for other buckets and sizes."""
    known = (SMALL_DEVICE_ROWS_OF_GROUPS if small_device else BATCH_ROWS_OF_GROUPS).get(group_size)
    return batch_rows(bucket, default, known) if known else F.lit(default)


def merge_small(df: DataFrame, file: str, small: int, drop: int) -> DataFrame:
    """Files of fewer than ``small`` rows become one, ``merged``; it is dropped if it has fewer than ``drop``.  ``batch`` is the least of a file's."""
    counts = df.groupBy(file).agg(F.count("*").alias("_n"))
    named = counts.select(file, F.when(F.col("_n") < small, "merged").otherwise(F.col(file)).alias("dataset"), "_n")
    size = named.groupBy("dataset").agg(F.sum("_n").alias("_size"))
    kept = named.join(size, "dataset").where((F.col("dataset") != "merged") | (F.col("_size") >= drop)).select(file, "dataset")
    return df.join(kept, file)


def cap_rows(df: DataFrame, group: str, key: str, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows of each group, drawn by hash; by a range of hash values first, so hot groups are thinned before the window."""
    counts = df.groupBy(group).agg(F.count("*").alias("_n"))
    drawn = df.join(counts, group).withColumn("_h", seeded(seed, key)).where(F.col("_h") <= 2.0 * most / F.col("_n") + 64.0 / F.col("_n"))
    window = Window.partitionBy(group).orderBy("_h", key)
    return drawn.withColumn("_at", F.row_number().over(window)).where(F.col("_at") <= most).drop("_h", "_at", "_n")


def epoch_plan(df: DataFrame, dataset: str, key: str, rows: Column, processes: int = 1, seed: int = 0, epoch: int = 0) -> DataFrame:
    """``df`` with ``batch`` (in a shuffled order over all data sets) and ``place``: one step's rows each.

    Rows of a data set are shuffled and cut to ``rows * processes``; a last batch of fewer than two rows for each
    process is dropped.  Rows are placed by a window per (data set, hash cell) and offsets of the cells, so a large
    data set is spread over many tasks.
    """
    cells = 256
    turned = df.withColumn("_h", seeded(seed + 1000003 * epoch, dataset, key)).withColumn("_cell", F.floor(F.col("_h") * cells).cast("int"))
    counts = turned.groupBy(dataset, "_cell").agg(F.count("*").alias("_n"))
    offsets = counts.select(dataset, "_cell", (F.sum("_n").over(Window.partitionBy(dataset).orderBy("_cell")) - F.col("_n")).alias("_offset"), F.sum("_n").over(Window.partitionBy(dataset)).alias("_total"))
    size = (rows * processes).cast("long")
    inner = F.row_number().over(Window.partitionBy(dataset, "_cell").orderBy("_h", key)) - 1
    placed = turned.withColumn("_inner", inner).join(offsets, [dataset, "_cell"]).withColumn("_at", F.col("_inner") + F.col("_offset")).withColumn("_size", size)
    step = F.floor(F.col("_at") / F.col("_size"))
    full = F.least(F.col("_size"), F.col("_total") - step * F.col("_size"))
    kept = placed.withColumn("_step", step).withColumn("_rows", full).where((F.col("_rows") == F.col("_size")) | (F.col("_rows") >= 2 * processes))
    steps = row_index(kept.select(dataset, "_step").distinct().withColumn("_draw", seeded(seed + 7 + epoch, dataset, "_step")), ["_draw", dataset, "_step"], "batch").drop("_draw")
    out = kept.join(steps, [dataset, "_step"]).withColumn("place", (F.col("_at") - F.col("_step") * F.col("_size")).cast("int"))
    return out.drop("_h", "_cell", "_inner", "_offset", "_total", "_at", "_size", "_step").withColumnRenamed("_rows", "batch_rows")


def process_slice(plan: DataFrame, processes: int) -> DataFrame:
    """``process`` of each row of a plan; what does not divide evenly among the processes is dropped."""
    share = F.floor(F.col("batch_rows") / processes)
    return plan.withColumn("process", F.floor(F.col("place") / share).cast("int")).where(F.col("place") < share * processes)


def sampled_group(df: DataFrame, key: str, size: int, seed: int, positives: str = "pos", negatives: str = "neg", negative_scores: str | None = None) -> DataFrame:
    """``passages``: one positive and ``size - 1`` negatives, drawn by hash, and ``labels`` 1, 0, 0, ...

    Too short a list of negatives is repeated as often as needed first.  With scores the drawn negatives come by
    falling score.  Rows without positives have null; without negatives the positive alone.
    """
    need = size - 1
    count = F.size(F.coalesce(positives, F.array().cast("array<string>")))
    one = F.when(count > 0, F.element_at(positives, (F.floor(seeded(seed, key) * count) + 1).cast("int")))
    own = F.coalesce(negatives, F.array().cast("array<string>"))
    times = F.when(F.size(own) > 0, F.ceil(F.lit(need) / F.size(own)).cast("int")).otherwise(F.lit(0))
    repeated = F.flatten(F.array_repeat(own, F.greatest(times, F.lit(1))))
    scored = F.flatten(F.array_repeat(F.coalesce(negative_scores, F.array().cast("array<float>")), F.greatest(times, F.lit(1)))) if negative_scores else None
    tagged = F.transform(
        repeated,
        lambda t, i: F.struct(_draw(key, i, seed).alias("h"), t.alias("t"), (F.get(scored, i) if scored is not None else F.lit(0.0)).cast("double").alias("s")),
    )
    drawn = F.slice(F.array_sort(tagged), 1, need)
    if negative_scores:
        drawn = F.array_sort(F.transform(drawn, lambda x: F.struct((-x["s"]).alias("s"), x["h"].alias("h"), x["t"].alias("t"))))
    passages = F.concat(F.array(one), F.transform(drawn, lambda x: x["t"]))
    out = df.withColumn("passages", F.when(one.isNotNull(), passages))
    return out.withColumn("labels", F.when(F.col("passages").isNotNull(), F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), F.size("passages") - 1))))


def size_suffix(file: Column) -> Column:
    """The part of a file name behind the last ``_``, by which files are mixed."""
    return F.element_at(F.split(file, "_"), -1)


def picked_language(key: str, seed: int, first: str = "text_vi", second: str = "text_en", share: float = 0.5) -> tuple[Column, Column]:
    """One of two languages for each id, by hash, and the other one."""
    vi = seeded(seed, key) < share
    return F.when(vi, F.col(first)).otherwise(F.col(second)), F.when(vi, F.col(second)).otherwise(F.col(first))


def chosen_pair(title: str, lead: str, body: str, key: str, seed: int) -> tuple[Column, Column]:
    """Query and passage of a news item: without lead (title, body), without body (title, lead), else one of three by hash."""
    no_lead, no_body = F.coalesce(F.trim(lead), F.lit("")) == "", F.coalesce(F.trim(body), F.lit("")) == ""
    draw = F.floor(seeded(seed, key) * 3)
    query = F.when(no_lead | no_body, F.col(title)).when(draw == 2, F.col(lead)).otherwise(F.col(title))
    passage = F.when(no_lead, F.col(body)).when(no_body, F.col(lead)).when(draw == 0, F.col(lead)).otherwise(F.col(body))
    return query, passage


def chunk_pair(df: DataFrame, chunks: str, key: str, measure, least: int = 64, seed: int = 0) -> DataFrame:
    """Two different chunks of ``least`` or more by ``measure``, drawn by hash, as ``query`` and ``passage``; rows without two give none."""
    fit = F.filter(chunks, lambda c: measure(c) >= least)
    drawn = F.array_sort(F.transform(fit, lambda c, i: F.struct(_draw(key, i, seed).alias("h"), c.alias("c"))))
    return df.withColumn("_drawn", drawn).where(F.size("_drawn") >= 2).withColumns({"query": F.col("_drawn")[0]["c"], "passage": F.col("_drawn")[1]["c"]}).drop("_drawn")
