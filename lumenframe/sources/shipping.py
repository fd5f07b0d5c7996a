"""Sends this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once a session, so that Python workers need no copy of their own. The archive is made on the driver and served by it."""
    context = spark.sparkContext
    if getattr(context, "_lumenframe_shipped", False):
        return
    top = Path(__file__).parents[1]
    target = Path(tempfile.mkdtemp(prefix="lumenframe-")) / "lumenframe.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(top.rglob("*.py")):
            archive.write(source, source.relative_to(top.parent))
    context.addPyFile(str(target))
    context._lumenframe_shipped = True
