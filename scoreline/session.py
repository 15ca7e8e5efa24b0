"""Spark session settings shared by tests, the bench and the entry points."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job here relies on. AQE re-plans joins from runtime sizes
# (so dimension tables are broadcast only when they really are small) and
# splits skewed shuffle partitions of sort-merge joins; timestamps are kept
# zone-free so results never depend on the machine's zone.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def sized_conf(input_bytes: float, partition_bytes: int = 256 << 20) -> dict:
    """Shuffle and scan sizing for an input of ``input_bytes``.

    Aims at ~``partition_bytes`` per scan split and per shuffle partition, so
    a partition fits comfortably in an executor core's memory share: e.g.
    100 TB -> ~400k initial shuffle partitions, which AQE then coalesces
    towards the advisory size where stages shrink (aggregations, filters).
    """
    partitions = max(200, int(input_bytes // partition_bytes) + 1)
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
    }


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "scoreline", extra: dict | None = None,
                input_bytes: float | None = None) -> SparkSession:
    """Return the active session, or build one with ``BASE_CONF``.

    ``master`` and ``shuffle_partitions`` are for local runs (tests, bench);
    on a cluster leave them unset so the submit-time settings win, or pass
    ``input_bytes`` to size scans and shuffles with ``sized_conf``.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if input_bytes:
        conf.update(sized_conf(input_bytes))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Read from ``spark.checkpoint.dir`` (what the cluster names). Only when it
    is unset — local tests — a fresh scratch folder is created and set.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="scoreline-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or os.path.abspath(configured)
