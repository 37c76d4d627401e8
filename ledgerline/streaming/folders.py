"""Where streams keep their state, checkpoints and results."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession) -> str:
    """Shared folder for state and checkpoints: the one the cluster names.

    Only a local session may fall back to a folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="ledgerline-")
