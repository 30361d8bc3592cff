"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointer(spark: SparkSession, job: str):
    """A function (frame, name) -> frame that writes Parquet and reads it back, cutting lineage.

    Tables lie under ``spark.checkpoint.dir``; only where it is unset and the
    session runs in one process, as in tests, a temporary folder is made.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    base = f"{root.rstrip('/')}/{job}-{uuid.uuid4().hex}"

    def checkpoint(frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{base}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{base}/{name}")

    return checkpoint
