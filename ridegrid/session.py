"""Session creation and the runtime settings every operator relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# SQL settings that can be changed on a running session.  They do not change
# results, only how the plans execute: AQE re-plans joins from runtime sizes
# (broadcast only below the size threshold, otherwise sort-merge), splits
# skewed shuffle partitions and coalesces small ones.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; leave anything the cluster already set."""
    for key, value in RUNTIME_CONF.items():
        if key == "spark.sql.session.timeZone" or spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is.  Only when nothing is set and the master is local (unit tests, a
    laptop) a folder under the system temp dir is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            # On a cluster a folder of this machine is another folder on every executor.
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ridegrid-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Used by iterative operators between rounds: the result has a one-node
    plan (no lineage and no accumulated plan constraints, which otherwise grow
    with every round), survives lost executors, and pins nondeterministic
    columns.  The folder is the cluster's ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = remember(f"{base}/ridegrid-{label}-{uuid.uuid4().hex}")
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def wide_rows(spark: SparkSession, fields: int = 20) -> Iterator[None]:
    """Leaves rows of more than ``fields`` columns out of whole-stage code generation, for what runs inside.

    One generated method that handles dozens of columns and long expressions is larger than the JVM compiles, so
    it is interpreted for every row; without it each operator has methods of its own, split to a size that is compiled.
    """
    key = "spark.sql.codegen.maxFields"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(int(was), fields)))
    try:
        yield
    finally:
        spark.conf.set(key, was)


_folders: list[str] = []


def remember(path: str) -> str:
    """Note a folder of intermediate data for ``cleanup``."""
    _folders.append(path)
    return path


def cleanup(spark: SparkSession) -> int:
    """Delete the intermediate folders written so far; returns how many.

    Results are lazy and read those folders, so only the caller knows when they are
    no longer needed: call this after the last result was written or collected.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _folders:
        path = jvm.org.apache.hadoop.fs.Path(_folders.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Local/test session builder.  Cluster jobs receive their session instead."""
    master = master or os.environ.get("RIDEGRID_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master)
        .appName("ridegrid")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.driver.memory", os.environ.get("RIDEGRID_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
