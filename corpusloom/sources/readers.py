"""Readers of the file layouts that corpora, queries, judgements and embeddings come in."""
from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

SAMPLE = StructType([StructField("query", StringType()), StructField("pos", ArrayType(StringType())), StructField("neg", ArrayType(StringType()))])
SCORED_SAMPLE = StructType([*SAMPLE.fields, StructField("pos_scores", ArrayType(FloatType())), StructField("neg_scores", ArrayType(FloatType()))])


def read_dataset(spark: SparkSession, path, kind: str = "parquet", schema=None, **options) -> DataFrame:
    """Any built-in format by name; ``path`` is one path or a list.  Compressed text is read as it is."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_samples(spark: SparkSession, path, scored: bool | None = None) -> DataFrame:
    """JSON lines of training samples; score columns are kept if asked for, or by default if any row has scores."""
    rows = spark.read.schema(SCORED_SAMPLE).option("mode", "PERMISSIVE").json(path)
    if scored is None:
        scored = not rows.where("pos_scores IS NOT NULL OR neg_scores IS NOT NULL").isEmpty()
    return rows if scored else rows.select("query", "pos", "neg")


def read_id_text(spark: SparkSession, path: str) -> DataFrame:
    """A file with one JSON object ``{id: text}`` as ``(pos, id, text)``, in the order of the file."""
    whole = spark.read.text(path, wholetext=True)
    pairs = whole.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("pos", "pair"))
    return pairs.select(F.col("pos").cast("long"), F.col("pair.key").alias("id"), F.col("pair.value").alias("text"))


def read_json_items(spark: SparkSession, path: str, schema, field: str | None = None) -> DataFrame:
    """A file with one JSON array, or an object whose ``field`` is one (``items``, ``data``), one row per entry."""
    if field is None:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    wrapped = StructType([StructField(field, ArrayType(schema))])
    return spark.read.schema(wrapped).option("multiLine", True).json(path).select(F.explode(field).alias("_item")).select("_item.*")


def read_tsv(spark: SparkSession, path, columns: list[str]) -> DataFrame:
    """Tab-separated text without header and quoting; every field is trimmed."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    rows = spark.read.schema(schema).option("sep", "\t").option("quote", "").option("escape", "").csv(path)
    return rows.select(*(F.trim(c).alias(c) for c in columns))


def read_qrels_tsv(spark: SparkSession, path) -> DataFrame:
    """Judgements with four columns, query, unused, passage, unused, as ``(qid, pid)``."""
    return read_tsv(spark, path, ["qid", "_0", "pid", "_1"]).select("qid", "pid").distinct()


def qrels_of_map(df: DataFrame, column: str = "value") -> DataFrame:
    """A JSON object ``{qid: [pid, ...]}`` in a text column as ``(qid, pid)``."""
    pairs = df.select(F.explode(F.from_json(column, "map<string,array<string>>")).alias("qid", "_pids"))
    return pairs.select("qid", F.explode("_pids").alias("pid")).distinct()


def read_arrow(spark: SparkSession, pattern: str, schema) -> DataFrame:
    """Arrow IPC files or streams by glob, as the shards of a data set are; a shard is read whole, each by one task."""
    return arrow_rows(spark.read.format("binaryFile").load(pattern).select("content"), schema)


def arrow_rows(files: DataFrame, schema) -> DataFrame:
    """The rows of Arrow IPC files or streams that are the values of a binary column."""

    def rows(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                try:
                    source = pa.ipc.open_file(io.BytesIO(content)).read_all()
                except pa.ArrowInvalid:
                    source = pa.ipc.open_stream(io.BytesIO(content)).read_all()
                yield from source.select(names).cast(target).to_batches(max_chunksize=5000)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = schema if isinstance(schema, StructType) else files.sparkSession.createDataFrame([], schema).schema
    names, target = schema.fieldNames(), to_arrow_schema(schema)
    return files.mapInArrow(rows, schema)


def read_npy(spark: SparkSession, pattern: str) -> DataFrame:
    """Matrices in .npy files as ``(file, pos, embedding)``, one row per matrix row."""

    def rows(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                matrix = np.load(io.BytesIO(content)).astype(np.float32)
                for at in range(0, len(matrix), 2000):
                    part = matrix[at : at + 2000]
                    yield pd.DataFrame({"file": path, "pos": np.arange(at, at + len(part)), "embedding": list(part)})

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInPandas(rows, "file string, pos long, embedding array<float>")


def read_folder(spark: SparkSession, path: str, schema=SCORED_SAMPLE, parallel_mark: str = "parallel_") -> DataFrame:
    """All .json and .jsonl files of a folder with their ``file`` and whether its path marks a parallel corpus."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isDirectory(target):
        raise NotADirectoryError(path)
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.{json,jsonl}").json(path)
    file = F.col("_metadata.file_path")
    return rows.select("*", F.element_at(F.split(file, "/"), -1).alias("file"), file.contains(parallel_mark).alias("parallel"))
