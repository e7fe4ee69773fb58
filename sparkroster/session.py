"""Shared working folder of a session."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder path below the shared folder that the cluster names.

    Every executor must see the folder, so a missing setting is an error.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
