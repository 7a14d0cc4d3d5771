"""Spark session and cluster-facing settings.

Everything here is ordinary session configuration.  The library never
assumes local mode: shuffle width comes from the session, checkpoints go
to the shared folder named by ``spark.checkpoint.dir``, and adaptive query
execution is left on so that joins on small runtime inputs become
broadcast joins only after Spark has measured them.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: set[str] = set()

# Settings a cluster deployment would carry in spark-defaults; tests use them
# on local[*].  AQE coalesces small shuffles, splits skewed partitions of
# sort-merge joins and turns a join side into a broadcast only when its
# measured shuffle output is under the threshold.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files of DataFrames that are gone are removed by the cleaner
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # local runs only: the driver JVM is the whole "cluster" there
    "spark.driver.memory": "8g",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "custspark") -> SparkSession:
    """Return the active session, or build one with :data:`DEFAULT_CONF`."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.  Only
    a local master, where driver and executors are one process, may go
    without the setting and gets a temporary folder; elsewhere such a folder
    would be invisible to the executors, so the call fails."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all "
                             f"executors share (master {sc.master})")
        configured = tempfile.mkdtemp(prefix="custspark-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` from here on as a table of the shared folder (see :func:`materialize`)."""
    return materialize(df, "cut")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for an intermediate
    table.  The tables go when the driver program ends."""
    base = f"{ensure_checkpoint_dir(spark)}/tables"
    if base not in _SCRATCH:
        _SCRATCH.add(base)
        atexit.register(_remove, spark, base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, sc = spark._jvm, spark.sparkContext
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone: the cluster's own cleaning is left
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it
    back: lineage is cut, a lost executor costs nothing, and later scans are
    pruned to the columns they use (which a row checkpoint is not)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
