"""What a session needs so that Python workers can import this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, unless they are threads of the driver that find it by themselves."""
    app = spark.sparkContext.applicationId
    # The driver's own folders say nothing about other machines; only in local mode are they the workers' folders as well.
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if spark.sparkContext.master.startswith("local[") else []
    if app in _SHIPPED or any(p and Path(p).resolve() == ROOT.parent for p in paths):
        return
    target = Path(tempfile.mkdtemp()) / "sparkledger.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, Path(ROOT.name) / p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
