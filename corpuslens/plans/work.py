"""The folder for intermediate tables, which the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one in ``spark.checkpoint.dir``. Where that is unset, under a temporary one in local mode; on a cluster that is an
    error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _local.setdefault(app, "") or _local.update({app: f"file://{tempfile.mkdtemp(prefix='corpuslens-')}"}) or _local[app]
    return f"{base.rstrip('/')}/corpuslens/{name}-{uuid.uuid4().hex[:12]}"
