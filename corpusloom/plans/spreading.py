"""Using all cores on inputs that come in few pieces."""
from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    A small file is one partition however costly its rows are; large inputs have more partitions than cores
    and are not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df  # its partitions come from a shuffle; counting them would run it
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
