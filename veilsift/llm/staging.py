"""Cutting lineage through storage that every executor shares."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a new temporary one if Spark runs in this process, as in
    tests; on a cluster, where executors don't see the driver's disk, an error."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="veilsift-"))
    return context.getCheckpointDir().rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder as a reliable checkpoint, for slim tables."""
    shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read back, for wide tables."""
    path = f"{shared_dir(df.sparkSession)}/veilsift-{uuid.uuid4().hex}"
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[staged] = path
    return staged


def discard(*staged: DataFrame) -> None:
    """Deletes tables that stage() wrote, once nothing that is still to run reads them."""
    for df in staged:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of plans that are no longer referenced, instead of at its next full collection.

    The driver's references go in two steps, first those of the plans, then those of their shuffles.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
