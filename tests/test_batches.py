"""Pages go to a worker in small batches, whatever a partition holds."""

import pandas as pd

from larder.operators.pages import best_layer
from larder.plans import registry
from larder.sources.batches import ROWS


def _largest(spark, text):
    """The largest batch of 3,000 rows of a partition: rows, and characters."""
    sizes = lambda frames: (pd.DataFrame({"n": [len(f)], "c": [int(f["t"].str.len().sum())]}) for f in frames)
    rows = spark.range(3_000, numPartitions=1).selectExpr(f"{text} as t").mapInPandas(sizes, "n long, c long").collect()
    assert sum(r.n for r in rows) == 3_000
    return max(r.n for r in rows), max(r.c for r in rows)


def _as_given(spark):
    for c in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{c}")


def test_pages_of_a_batch(spark):
    _as_given(spark)
    assert _largest(spark, "'x'")[0] > ROWS
    best_layer(spark.createDataFrame([(1, "<p>x</p>")], "page_id long, html string"))
    assert _largest(spark, "'x'")[0] <= ROWS
    assert _largest(spark, "repeat('x', 20000)")[1] <= 4 << 20
    _as_given(spark)


def test_queries_bound_their_batches(spark):
    _as_given(spark)
    registry.queries()["x14_decode_entities"](spark, "/root/testdata/sf0.001")
    assert _largest(spark, "'x'")[0] <= ROWS
