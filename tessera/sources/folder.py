"""Where a store can go when nobody named a place."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def new_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, in spark.checkpoint.dir; where that is unset and Spark runs in one
    process, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="tessera-")
        base = _local[app]
    return f"{base.rstrip('/')}/tessera/store-{uuid.uuid4().hex}"
