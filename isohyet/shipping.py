"""Makes the package importable in Python workers that do not share the driver's path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def reachable() -> bool:
    """Whether workers find the package by the path or folder that they inherit."""
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    return any((Path(p) / "isohyet").is_dir() for p in [*paths, os.getcwd()])


def ship(spark: SparkSession) -> None:
    """Send the package's source to the workers, once for each application that needs it."""
    context = spark.sparkContext
    if reachable() or context.applicationId in _shipped:
        return
    path = Path(tempfile.mkdtemp()) / "isohyet_source.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "isohyet").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
