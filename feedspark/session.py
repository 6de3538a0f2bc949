"""Session helpers: the few settings every job relies on.

Nothing here creates cluster resources on its own. ``get_session`` is for
local runs and tests; on a cluster the caller passes its own session and
``prepare`` only fills in settings that are unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the queries need for correct results (UTC wall clock) and for a
# good plan (AQE re-plans joins and coalesces small partitions at runtime).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # Let a join on (uid, bucket) reuse an existing partitioning on uid, so
    # attempts are not shuffled again after the fan-out.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "feedspark") -> SparkSession:
    """Local session for tests and the bench (UI off, UTC, AQE on)."""
    master = master or os.environ.get("FEEDSPARK_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("FEEDSPARK_DRIVER_MEM", "16g"))
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for k, v in {**REQUIRED_CONF, **DEFAULT_CONF}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Set the settings results depend on; keep everything else as given."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in spark.checkpoint.dir.

    Read from the session; only when it is unset on a local master (tests) a fresh
    folder is made and registered. On a cluster a folder of one machine would not do.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="feedspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf)
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for job output."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/feedspark-scratch/{name}-{uuid.uuid4().hex[:12]}"


def release_scratch(spark: SparkSession) -> None:
    """Removes the job output below the shared checkpoint folder. DataFrames that read it cannot be run again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/feedspark-scratch")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
