"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once an application, so that functions which name it can be unpickled there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="package-")
    target = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def session(name: str = "scriptorium", cores: str = "*", shuffle_partitions: int = 8, **options: str) -> SparkSession:
    """A local session with adaptive execution and UTC."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.ui.enabled", "false")
    for k, v in options.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
