"""Tables written to the cluster's shared folder to cut lineage.

The folder is ``spark.checkpoint.dir`` of the session. Where it is unset, a session
on one machine (a local master) uses a folder under the warehouse directory; any
other fails, as its executors need not share a folder.
"""

from __future__ import annotations

import atexit
import re
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there goes when the session's process ends, or by :func:`dropped`."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_at_exit, spark, path)
    return path


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df``; what is returned reads the files, so that a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def renamed(spark: SparkSession, path: str, to: str) -> None:
    """Move a file or folder in one step; an error if that fails."""
    jvm = spark.sparkContext._jvm
    p, q = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(p, q):
        raise OSError(f"{path} could not be moved to {to}")


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path) of a URI as Spark writes it, for workers that read and write files of a binary format.

    ``file:/x`` is the same as ``file:///x``, and ``s3a:`` or ``s3n:`` the same as
    ``s3:``. For ``hdfs:`` the workers need the Hadoop client's native library.
    """
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", uri)))


def _at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        dropped(spark, path)
