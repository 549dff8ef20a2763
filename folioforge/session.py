"""The Spark session, and the package's way to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with adaptive execution; conf overrides or adds settings (dots as double underscores)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("folioforge")
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors this package's modules, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = Path(tempfile.mkdtemp(prefix="folioforge-code-"))
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(folder / "folioforge_code.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, os.path.join(root.name, path.relative_to(root)))
    context.addPyFile(str(folder / "folioforge_code.zip"))
    atexit.register(shutil.rmtree, folder, True)
    _shipped.add(context.applicationId)
