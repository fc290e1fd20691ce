"""This package's source for the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED = "spark.agoraspark.shipped"


def ship_package(spark: SparkSession) -> None:
    """Give this package's source to the executors, once a session; they need not have it installed."""
    if spark.conf.get(_SHIPPED, "") == spark.sparkContext.applicationId:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    spark.conf.set(_SHIPPED, spark.sparkContext.applicationId)
