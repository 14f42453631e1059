"""The folder that driver and executors share, for tables and checkpoints that cut a lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder given to setCheckpointDir. Where both are unset, a temporary one, but only where all
    runs in one JVM: on a cluster that would be a disk which the executors can't see."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="floodstats-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path
