"""The package on the workers.

Functions handed to Python workers are found by import there.  A cluster's
workers do not share the driver's path, so the package is shipped once per
context through Spark's own file server.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes ``import lexweave`` work on every worker of the session; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="lexweave-package-")  # the driver serves it until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/lexweave-package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(_PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(_PACKAGE.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
