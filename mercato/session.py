"""SparkSession settings used by the tests, the bench and the catalogue."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

# Settings every mercato job assumes: AQE re-plans joins and partition counts at
# run time (size-checked broadcast, skew-join splitting, partition coalescing),
# and timestamps are compared in UTC so day arithmetic never shifts.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files (sequence slices, order grain, training table) are
    # removed once the checkpointed data is no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(cpus: int | None = None, shuffle_partitions: int | None = None,
              app: str = "mercato", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (a cluster passes its own master)."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.appName(app)
    if not SparkContext._active_spark_context and not SparkConf().get("spark.master", None):
        builder = builder.master(f"local[{cpus}]")  # a submitted master is kept
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf["spark.driver.memory"] = os.environ.get("MERCATO_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for materialised tables and checkpoints.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared file
    system).  Only a local session without one gets a folder of its own; on a
    cluster that would be each machine's own disk, so it raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="mercato-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir().rstrip("/")
