"""Session settings the operators rely on.

``configure`` only touches runtime SQL confs, so it is safe to call on a
session someone else built (the driver, a notebook, a cluster job).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Runtime confs every operator assumes.
#  - mapKeyDedupPolicy LAST_WIN: JSON objects with duplicate keys keep the
#    last value (Python dict semantics) instead of raising.
#  - chunkBase64String off: base64() must not insert line breaks (data URLs).
#  - session time zone pinned so timestamps compare with DuckDB.
REQUIRED_CONF = {
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.chunkBase64String.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in REQUIRED_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a foreign session: leave it
            pass
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/S3/...) folder
    and we use it as given. Only when it is unset (local tests) do we create
    a scratch folder and register it.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="labelweave-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def get_session(master: str | None = None, app: str = "labelweave",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Session for scripts and tests (local mode unless a master is given)."""
    master = master or os.environ.get("LABELWEAVE_MASTER", "local[*]")
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("LABELWEAVE_DRIVER_MEM", "8g"))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in REQUIRED_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
