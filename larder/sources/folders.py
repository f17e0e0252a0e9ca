"""Where jobs may write: the folder that the cluster shares."""

from __future__ import annotations

import tempfile
from functools import lru_cache

from pyspark.sql import SparkSession


@lru_cache(maxsize=1)
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="larder-")


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset and all runs on one machine, as in tests, a folder of our own."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (told or _own()).rstrip("/") + "/larder"
