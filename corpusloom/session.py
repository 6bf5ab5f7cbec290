"""Sessions for local work; on a cluster the caller brings its own session."""
from __future__ import annotations

import os

from pyspark.sql import SparkSession

from corpusloom.plans.shipping import ship


def local_session(cpus: int | None = None, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A local session with adaptive execution; ``cpus`` defaults to $BENCH_CPUS or 8."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corpusloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str):
    """One Parquet table (a file or a folder of files)."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
