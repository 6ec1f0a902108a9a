"""Shared helpers: the shared scratch folder, cutting lineage, and Arrow batch sizes."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes in an Arrow batch: texts can be long, so batches hold few rows.
ARROW_ROWS, ARROW_BYTES = 250, "16m"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares.

    The cluster names the folder in spark.checkpoint.dir; without one nothing can be stored in between.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: the lineage ends at a table that survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def cut_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """The union of parts as by cut(), one written after the other: what a part shuffles is gone before the next begins."""
    path, out = None, None
    for df in parts:
        path = path or scratch(df.sparkSession, name)
        df.write.mode("append").option("compression", "zstd").parquet(path)
        out = df
    out = out.sparkSession.read.schema(out.schema).parquet(path)
    out._cut_at = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the query that wrote them ends, from here on in this session, and not when the driver collects garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def discard(*tables: DataFrame | None) -> None:
    """Removes tables that cut() wrote and that nothing reads any more."""
    for df in tables:
        if df is not None:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_at)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def text_of(value: pa.StringScalar) -> str | None:
    """A text as it came from Spark. Ill-formed UTF-8 counts as U+FFFD."""
    held = value.as_buffer()
    return None if held is None else held.to_pybytes().decode("utf-8", "replace")


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small enough for long texts, from here on in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_held: dict[tuple, Any] = {}


def worker_cache(key: tuple, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from one task to the next: one thing at a time.

    Workers live on from stage to stage; without this each would hold the tables of every operator it has
    served.
    """
    if key not in _held:
        _held.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass
        _held[key] = make()
    return _held[key]
