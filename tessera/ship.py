"""Makes the package importable by executors that do not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    top = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="tessera-ship-")) / "tessera_package.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(Path(top.name) / p.relative_to(top)))
    sc.addPyFile(str(out))
    sc._tessera_shipped = True
