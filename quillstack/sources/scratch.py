"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_passing = threading.local()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir, which all machines share; without one nothing can be stored in between."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: what follows neither computes it twice nor plans it again, and it outlives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if (made := getattr(_passing, "made", None)) is not None:
        made.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def stored_bytes(df: DataFrame) -> int:
    """The bytes of the files of a table that cut() made."""
    at, files = _at(df.sparkSession, df._cut_at)
    return files.getContentSummary(at).getLength()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """The tables that cut() makes within, in this thread, are removed at the end: nothing that is read later may depend on them."""
    outer, _passing.made = getattr(_passing, "made", None), []
    try:
        yield
    finally:
        made, _passing.made = _passing.made, outer
        for path in made:
            at, files = _at(spark, path)
            files.delete(at, True)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the query that wrote them ends, from here on in this session, and not when the driver collects garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
