"""Session settings and the checkpoint folder."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

CHECKPOINTS = os.path.abspath(os.path.join("spark-warehouse", "checkpoints"))


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "paddock") -> SparkSession:
    """Session for tests and benches; on a cluster use the session the cluster gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", CHECKPOINTS)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session: the one spark.checkpoint.dir names, which a cluster must
    set; local mode without the setting uses a folder in its warehouse."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    context.setCheckpointDir(shared)
    return shared
