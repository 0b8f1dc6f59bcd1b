"""What the training-data operators share: table access, the shared folder, written intermediates."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, read by Spark only: the path may be in any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Where it is unset and all runs in this one process (a local master, as in tests), a new folder under /tmp/checkpoints becomes the
    checkpoint folder; on a cluster that is an error, since its machines do not share their own folders.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.tickloom.shared", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        named = "file://" + tempfile.mkdtemp(dir="/tmp/checkpoints")
        spark.conf.set("spark.tickloom.shared", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, lineage cut, safe when executors are lost."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of a column's text, modulo a number; null for a null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def ascii_lower(column: Column | str) -> Column:
    """A-Z lower-cased, all else kept (``lower`` would change other letters too)."""
    return F.translate(F.col(column) if isinstance(column, str) else column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def only(docs: DataFrame, *columns: str) -> DataFrame:
    """Just these columns: other columns, whatever their names, can't clash with what an operator adds."""
    return docs.select(*[F.col(f"`{c}`").alias(c) for c in columns])


def quoted(docs: DataFrame) -> list[Column]:
    """All columns, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that none of the frame's columns has, in any case of letters."""
    held, out = {c.lower() for c in docs.columns}, []
    for name in wanted:
        free = f"__{name}"
        while free.lower() in held:
            free += "_"
        held.add(free.lower())
        out.append(free)
    return out


def mapped(docs: DataFrame, run: Callable, **added: str) -> DataFrame:
    """``mapInArrow`` over all columns, whatever their names, and added ones (name=type): the function sees and gives columns by place."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kinds = [*[kind for _, kind in docs.dtypes], *added.values()]
    out = plain.mapInArrow(run, ", ".join(f"c{i} {kind}" for i, kind in enumerate(kinds)))
    return out.toDF(*docs.columns, *added)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a written intermediate that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(df: DataFrame, rows: int = 1_000) -> DataFrame:
    """The frame, with Arrow batches of at most so many rows from now on: whole texts are long, and a Python worker holds a batch at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(df.sparkSession.conf.get(name))
    if held <= 0 or held > rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for the jobs that run inside; the session's own setting is put back after them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: What a Python worker keeps between tasks: the caches of one operator, the last that ran.
_KEPT: dict[Any, Any] = {}


def worker_keeps(key: Any, make: Callable[[], Any] | None = None) -> Any:
    """This worker's object of a key, made where it is not there; whatever another operator kept is let go first.

    Workers are reused by all tasks of an executor, so each operator calls this when a task starts, with nothing to make if it
    keeps nothing. Freed memory is given back to the system.
    """
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
        _KEPT[key] = make() if make else None
    return _KEPT[key]
