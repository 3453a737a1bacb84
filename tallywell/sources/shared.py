"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """As spark.checkpoint.dir names it; a temporary one of this machine only where that is unset and all runs here."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where and not sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc._jsc.sc().getCheckpointDir().get()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")
