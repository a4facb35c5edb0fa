"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import ctypes

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwatt.session import scratch_path


def without(docs: DataFrame, *added: str) -> DataFrame:
    """``docs`` less the columns whose names the caller is about to add; names are compared as Spark does, without case."""
    names = {a.lower() for a in added}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below spark.checkpoint.dir and read it back.

    Lineage ends there, so the loss of an executor costs a reread, and the files are compressed, which
    ``checkpoint()`` does not do by default. The folder goes when the application's file system closes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def give_back_memory() -> None:
    """Return what freed arrays leave in this Python worker's heap to the system; workers live on through later stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
