"""Gives Python workers this package where their path doesn't have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: workers get the package as an archive that the driver serves, unless PYTHONPATH or the working folder has it."""
    sc = spark.sparkContext
    on_path = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if sc.applicationId in _SHIPPED or any(p and Path(p).resolve() == ROOT for p in on_path):
        return
    _SHIPPED.add(sc.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="voxlog-")) / "voxlog.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / "voxlog").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(archive))
