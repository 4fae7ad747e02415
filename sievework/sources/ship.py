"""Sending this package, and files it reads, to the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_FILES: set[tuple[str, str]] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in every Python worker of the session's application, once.

    The archive is made on the driver and served by it, so executors need no copy of the repository.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="sievework-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
    _SHIPPED.add(app)


def ship_file(path: str) -> None:
    """Serve a file of the driver to the executors of the active session, once; tasks find it by ``local_file``."""
    spark = SparkSession.getActiveSession()
    if spark is not None and (spark.sparkContext.applicationId, path) not in _FILES:
        spark.sparkContext.addFile(path)
        _FILES.add((spark.sparkContext.applicationId, path))


def local_file(path: str) -> str:
    """Where this process has its copy of a shipped file; ``path`` itself where it was not shipped."""
    try:
        copy = Path(SparkFiles.get(Path(path).name))
    except Exception:  # noqa: BLE001  no Spark in this process
        return path
    return str(copy) if copy.exists() else path
