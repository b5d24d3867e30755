"""Where all executors can write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, stem: str) -> str:
    """A new folder's path under spark.checkpoint.dir. Only a session of one machine that has not set it gets a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="inkwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{stem}-{uuid.uuid4().hex}"
