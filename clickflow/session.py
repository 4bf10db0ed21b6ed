"""Spark session helpers.

The library never creates a session behind the caller's back: every operator
takes DataFrames. These helpers exist for tests, the bench and scripts.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every analytics job here relies on. Time zone must be UTC: event
# timestamps are UNIX microseconds and day boundaries are UTC days.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# What the plans assume on a large cluster (100 TB of events). Apply with
# ``apply_missing(spark.conf, CLUSTER_CONF)`` or put them in the cluster's
# Spark config; ``spark.checkpoint.dir`` must name shared storage there.
CLUSTER_CONF = {
    **BASE_CONF,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    # reports checkpoint their session-grain tables; remove the files once the
    # checkpointed data is no longer referenced (measured ~0.5 s per report on
    # local[8], so it is left off for local sessions)
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def cluster_conf(input_bytes: int, shuffle_fraction: float = 0.25,
                 partition_bytes: int = 256 * 1024 ** 2) -> dict:
    """``CLUSTER_CONF`` with shuffle partitions sized for ``input_bytes`` of events.

    The first shuffle of every report carries projected, map-side
    pre-aggregated rows -- ``shuffle_fraction`` of the scanned bytes is a
    conservative estimate. The initial partition count puts about
    ``partition_bytes`` in each reduce task (fits executor memory with room
    to spare); AQE coalesces partitions that turn out smaller and splits
    skewed ones.
    """
    n = max(200, min(200_000, -(-int(input_bytes * shuffle_fraction) // partition_bytes)))
    size = f"{partition_bytes // 1024 ** 2}m"
    return {
        **CLUSTER_CONF,
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.files.maxPartitionBytes": size,
    }


def apply_missing(conf, settings: dict) -> None:
    """Set each runtime-settable entry of ``settings`` that ``conf`` does not have yet."""
    for k, v in settings.items():
        if conf.get(k, None) is None:
            try:
                conf.set(k, v)
            except Exception:  # noqa: BLE001 - static / core settings belong in the cluster config
                pass


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "clickflow", extra: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks (single JVM)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("CLICKFLOW_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, taking it from the session.

    On a cluster ``spark.checkpoint.dir`` names a shared (distributed) folder
    and is used as is. Only where it is unset (local tests, scripts) is a
    local folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            # a machine-local folder is not visible to the other executors
            raise ValueError("set spark.checkpoint.dir to a shared folder (HDFS, object store) "
                             "in the cluster's Spark configuration")
        conf_dir = tempfile.mkdtemp(prefix="clickflow-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return conf_dir
