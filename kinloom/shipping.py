"""Making the package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once an application.

    Python workers import what their functions refer to; on a cluster without the package installed,
    or in a session started elsewhere, they find it in this archive.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parent
    if not root.is_dir():
        return  # already runs from an archive
    folder = tempfile.mkdtemp(prefix="kinloom-")
    path = os.path.join(folder, "kinloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"kinloom/{p.relative_to(root)}")
    context.addPyFile(path)


def shipped(query):
    """A query of (spark, ...) that ships the package first."""

    def run(spark, *rest):
        ship(spark)
        return query(spark, *rest)

    run.__name__ = getattr(query, "__name__", "query")
    run.__doc__ = query.__doc__
    return run
