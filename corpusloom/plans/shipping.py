"""Making this package importable in the Python workers of every executor."""
from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    if package.is_dir():
        path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{package.name}.zip")
        with zipfile.ZipFile(path, "w") as bundle:
            for file in sorted(package.rglob("*.py")):
                bundle.write(file, file.relative_to(package.parent))
        context.addPyFile(path)
    _shipped.add(context.applicationId)
