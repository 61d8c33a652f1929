"""Folders for intermediate tables that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, the warehouse, or with a local master a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        local = spark.sparkContext.master.startswith("local")
        base = tempfile.mkdtemp(prefix="tessera-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tessera"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone already; what is left is scratch
        pass


def new_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/tessera-work/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path
