"""Make the package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors once a Spark application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    _sent.add(app)
    folder = tempfile.mkdtemp(prefix="prismalake-src-")
    path = os.path.join(folder, "prismalake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    spark.sparkContext.addPyFile(path)
