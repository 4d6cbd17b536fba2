"""This package on the executors' Python path."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once an application, so that they need no shared folder for it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        top = Path(__file__).resolve().parent
        if top.parent.is_dir():  # else it came as a zip of its own (--py-files), which executors have
            made = tempfile.mkdtemp(prefix="riskloom-package-")
            atexit.register(shutil.rmtree, made, True)
            with zipfile.ZipFile(f"{made}/riskloom.zip", "w", zipfile.ZIP_DEFLATED) as out:
                for p in sorted(top.rglob("*.py")):
                    out.write(p, p.relative_to(top.parent))
            spark.sparkContext.addPyFile(f"{made}/riskloom.zip")
    return spark
