"""Folders for tables that a job writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def staging_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Where that is unset and all runs in one process (tests), a fresh temporary folder is made the session's checkpoint folder; on a cluster, where executors would not see it, that is an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tallyforge-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def staging_dir(spark: SparkSession, name: str) -> str:
    """A new folder below staging_root()."""
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
