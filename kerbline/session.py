"""Session settings and the shared folder used for written intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Settings a job can change at run time.  Partition counts are left to the
# cluster: AQE coalesces small shuffles and splits skewed join partitions.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # geometry and window steps cost far more than their bytes suggest
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the operators rely on (UTC clock, AQE)."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, from ``spark.checkpoint.dir``.

    Only a session whose tasks run in the driver's own process may go without: it gets a temporary folder, removed
    when the process ends.  Anywhere else executors would write to disks that others can't read.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("kerbline.scratch.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master: {master})")
        root = tempfile.mkdtemp(prefix="kerbline-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("kerbline.scratch.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, in the application's own part of it."""
    return f"{shared_dir(spark)}/kerbline/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; results read from them must have been written before."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/kerbline/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Tasks started inside get Arrow batches of about ``size`` bytes, one row at least, whatever the length of the rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table that several later stages read, and read it back.

    Used where recomputing costs more than storing; unlike a cache the table
    survives the loss of executors.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
