"""Spark session helpers.

The library never builds its own cluster configuration beyond what a test or
the local benchmark needs: on a cluster the session comes from the caller and
only the settings that are unset get a default.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job in this library relies on. AQE re-plans joins at runtime
# (broadcast only when the measured shuffle output is small), coalesces small
# partitions and splits skewed join partitions (one account may hold a third
# of all rows).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "ledgerspark",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build a local one for tests and benchmarks."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (SparkSession.builder
               .master(master or f"local[{cpus}]")
               .appName(app)
               .config("spark.driver.memory", "16g")
               .config("spark.sql.shuffle.partitions",
                       str(shuffle_partitions or int(cpus)))
               .config("spark.sql.files.maxPartitionBytes", str(128 << 20))
               # small inputs: do not pack many small files into a few splits
               .config("spark.sql.files.openCostInBytes", str(1 << 20)))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: what ``spark.checkpoint.dir`` names.

    Only when it is unset -- local tests -- a scratch folder is created and kept in
    the session, so every call returns the same one. On a cluster, where executors
    could not see such a folder, that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        d = tempfile.mkdtemp(prefix="ledgerspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d
