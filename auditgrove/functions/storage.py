"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all machines of a cluster must share.

    Only a local session may do without the setting; it gets a folder of its own machine. On a cluster executors would write to their own disks,
    so there the missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="auditgrove-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
