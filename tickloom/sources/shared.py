"""Intermediate results as tables in the folder that all executors share.

A written result is computed once, survives lost executors, and ends the plan behind it: what is built on it is planned from a scan, whose size
is known, however much led to it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the cluster names one; on a local master without one a new folder under /tmp/checkpoints, once a session."""
    own = "spark.tickloom.folder"
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(own, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        named = "file://" + tempfile.mkdtemp(dir="/tmp/checkpoints")
        spark.conf.set(own, named)
    return named.rstrip("/")


def written(frame: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a table that is written now, and its path."""
    spark = frame.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a written result that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
