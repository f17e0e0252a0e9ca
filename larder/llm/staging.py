"""Written tables in the folder that the executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="larder-")


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset and all runs on one machine, as in tests, a folder of our own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return shared or own_folder()


def stage(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: what is read afterwards no longer depends on how df was computed."""
    path = f"{folder(df.sparkSession).rstrip('/')}/larder/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
    for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


#: Rows and bytes of an Arrow batch between Spark and a Python worker.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches by which texts go to and from Python workers, which by default hold 10,000 texts each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def steady_splits(spark: SparkSession) -> None:
    """Files are cut into partitions by the cores of now, not of each later read, so that row numbers of a scan stay when executors are lost."""
    if not spark.conf.get("spark.sql.leafNodeDefaultParallelism", None):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", spark.sparkContext.defaultParallelism)
