"""Shared work tables.

Operators that use one intermediate result several times write it as Parquet into the folder every
executor shares and read it back.  That cuts the lineage, survives the loss of an executor and keeps
nothing in any machine's local storage.  The folder is the session's ``spark.checkpoint.dir``; only
where that is unset and the master is local does the library choose one itself.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; set here only for local masters that name none."""
    base = spark.sparkContext.getConf().get(_OWN) or spark.conf.get(_OWN, None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_OWN} to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="scanloom-")
    spark.conf.set(_OWN, base)
    return base


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    jvm = spark.sparkContext._jvm
    root = f"{shared_dir(spark)}/scanloom-{spark.sparkContext.applicationId}"
    path = jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a work table and read it back (schema kept, so no inference job)."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
