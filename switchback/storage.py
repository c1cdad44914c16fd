"""Tables written to the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_scopes = threading.local()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, or else the context's own checkpoint folder. Where neither is set, a local session (as in tests) gets a temporary
    one; on a cluster that is an error, as executors do not see one another's folders."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if not base:
        master = context.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if inner := getattr(_scopes, "inner", None):
        inner[-1].append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    This cuts the lineage, survives lost executors, and gives later joins a plain scan on this side, so that
    adaptive execution can split skewed partitions of the other side.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """stored() of what make returns, after which all other tables that it has written are deleted. Scopes are a thread's own, and may lie within one another.

    Spark deletes the shuffle files of finished steps when its driver collects garbage, which is asked for here, as a step may leave as much as its input.
    """
    path = shared_dir(spark, name)
    if not hasattr(_scopes, "inner"):
        _scopes.inner = []
    _scopes.inner.append([])
    try:
        df = make()
        df.write.parquet(path)
        schema = df.schema
        del df
    finally:
        for one in _scopes.inner.pop():
            delete(spark, one)
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table, once no DataFrame that is still to be read needs it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
