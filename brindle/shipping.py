"""Make the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ensure_importable(spark: SparkSession) -> None:
    """Ship the package to the workers, once a context, unless PYTHONPATH already leads them to it."""
    sc = spark.sparkContext
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if any(p and Path(p).resolve() == ROOT.parent for p in paths) or getattr(sc, "_brindle_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="brindle-zip-")
    target = f"{folder}/brindle.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    sc.addPyFile(target)
    sc._brindle_shipped = True
