"""Reliable cuts of lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Where that is unset one is made here in local mode; on a cluster RuntimeError is raised."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="kakari-core-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def temporary(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; it is removed when the driver ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, at)
    return at


def remove(spark: SparkSession, at: str) -> None:
    """Removes a folder, if it is there."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
