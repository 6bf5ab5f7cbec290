"""Writers: tables, JSON lines, length buckets, score files, logs and resumable output."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Parquet, JSON lines, CSV or ORC files."""
    writer = df.write.format(kind).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_buckets(df: DataFrame, path: str, bucket: str = "bucket", overwrite: bool = False) -> None:
    """JSON lines, one folder for each bucket that has rows; buckets there already are kept unless ``overwrite``."""
    if overwrite:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket).json(path)
        return
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [s.getPath().getName().partition("=")[2] for s in files.listStatus(target) if s.isDirectory()] if files.exists(target) else []
    (df.where(~F.col(bucket).isin(there)) if there else df).write.mode("append").partitionBy(bucket).json(path)


def write_id_text(df: DataFrame, path: str, key: str = "id", text: str = "text") -> None:
    """One JSON object ``{key: text}`` in key order; only for tables that fit one task, as its readers expect one file."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, text))))
    df.coalesce(1).agg(F.to_json(pairs).alias("value")).write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str, **stamps: str) -> None:
    """Append the rows of a small summary as JSON lines, with the time and further texts."""
    stamped = df.withColumns({"at": F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")} | {k: F.lit(v) for k, v in stamps.items()})
    stamped.coalesce(1).write.mode("append").json(path)


def append_scores(df: DataFrame, path: str) -> None:
    """Append metric rows as CSV files with a header each, which ``spark.read.csv(header=True)`` reads as one table."""
    df.coalesce(1).write.mode("append").option("header", True).csv(path)


def exists(spark, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def remaining(df: DataFrame, path: str, key: str) -> DataFrame:
    """Rows whose key has not been written to the Parquet folder yet, for resuming."""
    spark = df.sparkSession
    if not exists(spark, path):
        return df
    return df.join(spark.read.parquet(path).select(key), key, "left_anti")


def write_in_steps(df: DataFrame, path: str, key: str, transform, steps: int = 10) -> None:
    """Transform and append what remains in ``steps`` parts, so that an interrupted run can be taken up again."""
    for step in range(steps):
        part = remaining(df, path, key).where(F.pmod(F.xxhash64(key), F.lit(steps)) == step)
        transform(part).write.mode("append").parquet(path)
