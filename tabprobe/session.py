"""Session helpers: the configuration every entry point expects."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # remove checkpoint files once their RDDs are garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str = "local[*]", shuffle_partitions: int = 8,
                app_name: str = "tabprobe", extra: dict | None = None) -> SparkSession:
    """Local session for tests and benchmarks; clusters pass their own."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


TARGET_PARTITION_BYTES = 256 * 1024 * 1024


def configure_for_input(spark: SparkSession, input_bytes: int) -> int:
    """Size shuffles for an input of ``input_bytes`` (e.g. the sum of the
    parquet files of a sweep): about 256 MB per shuffle partition, never
    fewer than twice the cores; AQE then coalesces small partitions and splits
    skewed ones.  Returns the shuffle partition count it set."""
    cores = spark.sparkContext.defaultParallelism
    n = max(2 * cores, min(200_000, -(-int(input_bytes) // TARGET_PARTITION_BYTES)))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TARGET_PARTITION_BYTES))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(TARGET_PARTITION_BYTES))
    return n


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint directory from the session (``spark.checkpoint.dir``).

    On a cluster it must be a shared folder the cluster names; only a local
    master may fall back to a private temporary folder (tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="tabprobe-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path
