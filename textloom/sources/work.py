"""Working tables: Parquet in the folder that driver and executors share, removed when the session ends."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession

#: Used only where the session names no folder (tests, one machine).
LOCAL_SHARED = "/tmp/textloom-shared"
_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, label: str) -> str:
    """A new path in ``spark.checkpoint.dir``; on one machine a local one will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{base or LOCAL_SHARED}/textloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove)
    _made.append((spark, path))
    return path


def _remove() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is over; a cluster's own clean-up takes the folder
            return
