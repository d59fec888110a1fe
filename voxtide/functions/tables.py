"""Tables kept in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The application's own folder below spark.checkpoint.dir; it goes when the driver ends.

    Where that is unset a temporary folder serves on one machine (tests); on a
    cluster, whose executors would each write to a disk of their own, it is an
    error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS[folder] = spark
        atexit.register(_delete, spark, folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended; what is left is the folder's owner's
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._stored_at = path
    return kept


def discard(*frames: DataFrame) -> None:
    """Delete tables that stored() made and that no plan will read again."""
    for frame in frames:
        if path := getattr(frame, "_stored_at", None):
            _delete(frame.sparkSession, path)
