"""How much of a table goes to a Python worker at a time."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch between Spark and a Python worker.
ROWS, BYTES = 500, 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches by which pages and texts go to and from Python workers, which by default hold 10,000 of them each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)


def bounded(query):
    """The query, in a session whose Arrow batches are small."""

    @wraps(query)
    def run(spark, sf_dir):
        small_batches(spark)
        return query(spark, sf_dir)

    return run
