"""Ingredient lines of the same text are parsed once, and every line keeps its row."""

import pytest

from larder.plans import nutrition

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["i1_parse_ingredients", "i9_parse_lite"])
def test_each_text_once(spark, name):
    df = nutrition.QUERIES[name](spark, DATA)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [raw" in plan
    above, below = plan.split("Aggregate [raw", 1)
    assert "rlike" in above.lower() and "rlike" not in below.lower()
    assert df.count() == spark.read.parquet(f"{DATA}/lineitem.parquet").count()
