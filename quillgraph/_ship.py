"""Makes this package importable on executors, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's Python files, once for each SparkContext."""
    context = spark.sparkContext
    if getattr(context, "_quillgraph_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quillgraph-")
    archive = os.path.join(folder, "quillgraph_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(archive)
    context._quillgraph_shipped = True
