"""Folders for tables between two jobs."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share; it goes with the session's process.

    Where that setting is unset, which is an error on a cluster, local mode has a
    temporary folder of its machine.
    """
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="provenia-")
        _OWN[app] = f"{root.rstrip('/')}/provenia-engine/{app}"
        atexit.register(delete, spark, _OWN[app])
    return f"{_OWN[app]}/{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder and what is in it; nothing happens once the session has ended."""
    if spark.sparkContext._jsc is None:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
