"""Lineage cuts: tables written to the cluster's shared folder.

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


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_quiet_drop, spark, path)
    return path


def cut(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; what is returned reads the written files, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path) of a URI as Spark writes it.

    ``file:/x`` is the same as ``file:///x``, and ``s3a:`` or ``s3n:`` the same as
    ``s3:``. For ``hdfs:`` the workers need the Hadoop client's native library.
    """
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", uri)))


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _quiet_drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        drop(spark, path)
