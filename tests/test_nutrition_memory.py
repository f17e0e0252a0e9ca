"""Nutrition: what a task holds does not hang on how many lines have one name."""

from __future__ import annotations

import re

import pytest

from larder.plans import nutrition


@pytest.mark.parametrize("name", ["a5_recipe_nutrition", "a7_day_nutrition", "a8_day_source_first", "d9_nutrition_line", "j2_meals_with_nutrition", "q12_rescale"])
def test_lines_are_dealt_by_recipe_and_never_by_name(spark, name):
    plan = nutrition.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\((\w+)#", plan)
    assert "recipe_id" in dealt and "name" not in dealt


@pytest.mark.parametrize("name", ["a5_recipe_nutrition", "a7_day_nutrition", "j2_meals_with_nutrition", "q12_rescale"])
def test_tasks_grow_in_number_with_the_lines_and_not_in_size(spark, monkeypatch, name):
    def tasks():
        plan = nutrition.QUERIES[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
        return {int(n) for n in re.findall(r"hashpartitioning\(recipe_id#\w+, (\d+)\), REPARTITION_BY_NUM", plan)}

    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").count()
    assert tasks() == {spark.sparkContext.defaultParallelism}
    monkeypatch.setattr(nutrition, "LINES_OF_A_TASK", lines // 30)
    assert tasks() in ({30}, {31})
