"""Where intermediate tables go: a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only where the session names none, and in local mode alone (tests), a temporary folder is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.sparkContext.getCheckpointDir()
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def pinned(df: DataFrame) -> DataFrame:
    """``df`` worked out once and read from the shared folder, without its lineage."""
    shared_root(df.sparkSession)
    return df.checkpoint()
