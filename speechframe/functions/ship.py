"""Gives executors' Python this package, where they don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: dict[str, str] = {}


def package(spark: SparkSession) -> None:
    """Once per application: a zip of the package, handed out by the driver."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(__file__).resolve().parents[1]
    _sent[app] = os.path.join(tempfile.mkdtemp(prefix="speechframe-"), f"{root.name}.zip")
    with zipfile.ZipFile(_sent[app], "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(_sent[app])
