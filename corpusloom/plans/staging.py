"""Writing intermediate tables to the folder that all executors share.

A staged table cuts the lineage: what follows reads files, so a lost executor costs
the reading of some files and not the work before them.
"""
from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans.shipping import ship

SETTING = "spark.checkpoint.dir"
_own: list[str] = []
_staged: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode without it a temporary one."""
    place = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if place:
        return place.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="corpusloom-"))
    return _own[0]


def stage(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again; removed when the driver ends."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _staged.append(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._staged_at = path
    return found


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for files other than staged tables; removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def discard(df: DataFrame) -> None:
    """Remove a staged table that nothing needs any more, neither read later nor part of a plan not yet run."""
    path = getattr(df, "_staged_at", None)
    if path in _staged:
        _staged.remove(path)
        _remove(path)


def _remove(path: str) -> None:
    if re.match(r"(file:)?/", path):
        shutil.rmtree(re.sub(r"^file:/*", "/", path), ignore_errors=True)
        return
    spark = SparkSession.getActiveSession()
    if spark is not None:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Remove the staged tables; results that still depend on them can't be read afterwards."""
    for path in [*_staged, *_own]:
        _remove(path)
    _staged.clear()
    _own.clear()


atexit.register(release)
