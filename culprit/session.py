"""Session settings used by the tests, the bench and the entry module."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# UTC keeps NTZ and LTZ timestamps comparable; AQE re-plans joins from real sizes,
# splits skewed join partitions and merges small shuffle partitions.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Off, because every column call would walk the Python stack; plans build twice as fast.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "culprit", cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session; on a cluster the submitter's own session is used instead."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    local = {
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": str(cpus if cpus != "*" else os.cpu_count() or 8),
    }
    for key, value in {**DEFAULTS, **local, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path that driver and executors share, for files that are read again.

    Below the folder that spark.checkpoint.dir names, else below the warehouse, which
    Spark itself shares.  What is written there is the caller's to keep or delete.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/culprit/{name}-{uuid.uuid4().hex}"
