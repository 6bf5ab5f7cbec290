"""Relational steps that build corpora, judgements and training tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.text import id_number
from corpusloom.plans.staging import stage


def row_index(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Dense positions from 0 in the given order, without sorting everything in one task.

    Rows are range-partitioned and sorted; counts per partition, one number each, give the offsets.  The order
    should be total: ties are placed in any order.
    """
    spark = df.sparkSession
    part = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["n"] for r in part.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    base = spark.createDataFrame(offsets or [(-1, 0)], "_part int, _offset long")
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return part.withColumn("_inner", inner).join(F.broadcast(base), "_part").withColumn(name, (F.col("_inner") + F.col("_offset")).cast("long")).drop("_part", "_inner", "_offset")


def dense_ids(df: DataFrame, value: str, order: str, prefix: str, name: str) -> DataFrame:
    """``(value, name)``: ids ``prefix0``, ``prefix1``, ... by the first appearance of each value; nulls have none."""
    first = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("_first"))
    return row_index(first, ["_first", value], "_n").select(value, F.concat(F.lit(prefix), F.col("_n").cast("string")).alias(name))


def union_with_oids(parts: list[tuple[str, DataFrame]], text: str, order: str, keep: list[str] | None = None) -> DataFrame:
    """``(oid, dataset, text)`` and the columns ``keep``, null where a source lacks one: sources one after another, numbered through."""
    tagged = None
    for i, (name, df) in enumerate(parts):
        rows = df.select(F.lit(i).alias("_source"), F.col(order).cast("string").alias("_order"), F.col(order).alias("_key").cast("long"), F.lit(name).alias("dataset"), F.col(text).alias("text"), *(F.col(c) if c in df.columns else F.lit(None).alias(c) for c in keep or ()))
        tagged = rows if tagged is None else tagged.union(rows)
    return row_index(tagged, ["_source", "_key", "_order"], "oid").select("oid", "dataset", "text", *(keep or ()))


def prefixed_union(parts: list[tuple[str, DataFrame]], key: str, text: str) -> DataFrame:
    """``(id, text)`` of several maps with prefixed ids; of equal ids the later map's text holds."""
    rows = None
    for i, (prefix, df) in enumerate(parts):
        part = df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.col(text).alias("text"), F.lit(i).alias("_at"))
        rows = part if rows is None else rows.union(part)
    return rows.where("id IS NOT NULL").groupBy("id").agg(F.max_by("text", "_at").alias("text"))


def texts_of_ids(df: DataFrame, row: str, ids: str, corpus: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """Array ``out`` with the texts of an array of ids, in its order; unknown ids are left out."""
    items = df.select(row, F.posexplode(ids).alias("_at", "_id"))
    found = items.join(corpus.select(F.col(key).alias("_id"), F.col(text).alias("_text")), "_id").groupBy(row).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda s: s["_text"]).alias(out)
    )
    return df.join(found, row, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def ids_of_texts(texts: DataFrame, text: str, corpus: DataFrame, key: str, order: str) -> DataFrame:
    """``texts`` with the id of an equal corpus text; of several ids the last by ``order``."""
    last = corpus.groupBy(F.col(text).alias("_text")).agg(F.max_by(key, order).alias(key))
    return texts.join(last, F.col(text) == F.col("_text")).drop("_text")


def merge_by(df: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """One row per key with the sorted union of each array column; null keys, arrays and entries are left out."""
    rows = df.where(F.col(key).isNotNull())
    out = rows.select(key).distinct()
    for c in lists:  # entries are made distinct before they are gathered, so a hot key holds each of them once
        entries = rows.select(key, F.explode(c).alias("_entry")).where("_entry IS NOT NULL").distinct()
        out = out.join(entries.groupBy(key).agg(F.array_sort(F.collect_list("_entry")).alias(c)), key, "left").withColumn(c, F.coalesce(c, F.array().cast(df.schema[c].dataType)))
    return out


def keep_in(df: DataFrame, row: str, ids: str, labels: str, allowed: DataFrame, key: str) -> DataFrame:
    """Two parallel arrays reduced to the places whose label is in ``allowed``; arrays of different length are an error."""
    checked = df.withColumn("_zip", F.when(F.size(ids) == F.size(labels), F.arrays_zip(F.col(ids).alias("i"), F.col(labels).alias("l"))).otherwise(F.raise_error(F.lit("arrays of different length"))))
    items = checked.select(row, F.posexplode("_zip").alias("_at", "_z"))
    kept = items.join(allowed.select(F.col(key).alias("_k")).distinct(), F.col("_z.l") == F.col("_k"), "left_semi").groupBy(row).agg(F.array_sort(F.collect_list(F.struct("_at", "_z"))).alias("_kept"))
    none = df.schema
    return (
        df.join(kept, row, "left")
        .withColumns({ids: F.coalesce(F.transform("_kept", lambda s: s["_z"]["i"]), F.array().cast(none[ids].dataType)), labels: F.coalesce(F.transform("_kept", lambda s: s["_z"]["l"]), F.array().cast(none[labels].dataType))})
        .drop("_kept")
    )


def non_empty(df: DataFrame, *arrays: str) -> DataFrame:
    """Rows whose arrays have at least one entry each; a null array has none."""
    for a in arrays:
        df = df.where(F.coalesce(F.size(a), F.lit(0)) > 0)
    return df


def sound_pairs(df: DataFrame, first: str, second: str, measure, most: int = 8192) -> DataFrame:
    """Pairs without a null side of which neither exceeds ``most`` by ``measure`` (a column to a column)."""
    return df.where(F.col(first).isNotNull() & F.col(second).isNotNull()).where((measure(F.col(first)) <= most) & (measure(F.col(second)) <= most))


def at_positions(df: DataFrame, position: str, chosen: DataFrame, name: str) -> DataFrame:
    """Rows at the positions listed in column ``name`` of ``chosen``, each once however often it is listed."""
    return df.join(chosen.select(F.col(name).alias("_chosen")).distinct(), F.col(position) == F.col("_chosen"), "left_semi")


def common_keys(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys that both tables have."""
    return first.select(key).distinct().join(second.select(key).distinct(), key, "left_semi")


def parallel_texts(first: DataFrame, second: DataFrame, key: str, text: str, names: tuple[str, str] = ("vi", "en")) -> DataFrame:
    """Texts of two languages side by side, by their common key."""
    return first.select(key, F.col(text).alias(f"{text}_{names[0]}")).join(second.select(key, F.col(text).alias(f"{text}_{names[1]}")), key)


def file_language(path: Column, suffixes: tuple[str, ...] = ("en", "vi"), default: str = "vi") -> Column:
    """The language of a file by the suffix of its name (``queries_en.json``); ``default`` without one."""
    found = F.regexp_extract(path, rf"_({'|'.join(suffixes)})(?:\.[A-Za-z0-9]+)*$", 1)
    return F.when(F.coalesce(found, F.lit("")) != "", found).otherwise(default)


def missing_ids(ids: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """Ids that the corpus lacks; empty if all references hold."""
    return ids.join(corpus.select(key).distinct(), key, "left_anti")


def grouped_labels(items: DataFrame, labels: DataFrame, item: str, label: str, nothing: str = "NOT FOUND") -> DataFrame:
    """Each item with the sorted set of its labels, or one entry that says there are none."""
    found = labels.groupBy(item).agg(F.array_sort(F.collect_set(label)).alias(label))
    return items.select(item).distinct().join(found, item, "left").withColumn(label, F.coalesce(label, F.array(F.lit(nothing))))


def routed_ids(value: Column, prefixes: list[str]) -> tuple[Column, Column]:
    """The prefix of an id, of those given, and what follows it; null for other ids."""
    prefix, rest = F.lit(None).cast("string"), F.lit(None).cast("string")
    for p in prefixes:
        prefix, rest = F.when(value.startswith(p), p).otherwise(prefix), F.when(value.startswith(p), F.substr(value, F.lit(len(p) + 1))).otherwise(rest)
    return prefix, rest


def by_number(df: DataFrame, column: str) -> DataFrame:
    """Sorted by the number behind the last ``_``."""
    return df.orderBy(id_number(F.col(column)), column)


def shard(df: DataFrame, index: str, shards: int, total: int) -> DataFrame:
    """``shard`` of each row: contiguous ranges of positions of equal length but for the last."""
    return df.withColumn("shard", F.floor(F.col(index) / F.lit(-(-total // shards))).cast("int"))


def last_rows_as_test(df: DataFrame, index: str, test: int, total: int) -> DataFrame:
    return df.withColumn("split", F.when(F.col(index) >= total - test, "test").otherwise("train"))


def flatten_squad(df: DataFrame, data: str = "data") -> DataFrame:
    """``(doc_id, qid, title, context, question)`` of answerable questions, numbered through in document order."""
    docs = df.select(F.posexplode(data).alias("_d", "_doc")).select("_d", "_doc.title", F.posexplode("_doc.paragraphs").alias("_p", "_par"))
    asked = docs.select("_d", "_p", "title", F.col("_par.context").alias("context"), F.posexplode("_par.qas").alias("_q", "_qa")).where(~F.coalesce(F.col("_qa.is_impossible"), F.lit(False)))
    numbered = row_index(asked, ["_d", "_p", "_q"], "_n")
    contexts = row_index(asked.select("_d", "_p").distinct(), ["_d", "_p"], "_c")
    return numbered.join(contexts, ["_d", "_p"]).select(F.concat(F.lit("doc_"), F.col("_c").cast("string")).alias("doc_id"), F.concat(F.lit("query_"), F.col("_n").cast("string")).alias("qid"), "title", "context", F.col("_qa.question").alias("question"))


def complete_rows(df: DataFrame, columns: list[str], text: str, most_words: int = 16384) -> DataFrame:
    """Rows without nulls in ``columns`` whose ``text`` has fewer than ``most_words`` words."""
    words = F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))
    return df.dropna(subset=columns).where(words < most_words)
