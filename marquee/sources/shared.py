"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Where the setting is absent, a session in one process (as in tests)
    takes the system's temporary folder; on a cluster that folder is not shared, and this raises ValueError."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
