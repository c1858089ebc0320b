"""Medians by rank selection, against sorting."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from docledger.operators.rollup import medians


@pytest.mark.parametrize("draw", [
    lambda rng: rng.random() * 1000, lambda rng: rng.choice([1.0, 2.0]), lambda rng: rng.choice([0.0, -1.5, 3.25, -1e-9, 1e9]),
    lambda rng: 7.0, lambda rng: 1000 + rng.random() * 1e-6,
])
def test_medians_equal_sorting(spark, draw):
    rng = random.Random(3)
    rows = [("hot", draw(rng)) for _ in range(901)] + [(f"k{k % 7}", draw(rng)) for k in range(60)] + [("one", 4.0), ("hot", None), ("none", None)]
    found = {r.run: r.median for r in medians(spark.createDataFrame(rows, "run string, v double"), "run", "v").collect()}
    want = {key: median([v for k, v in rows if k == key and v is not None]) for key, value in rows if key != "none"}
    assert found == pytest.approx(want, rel=1e-15)


def test_one_run_is_many_tasks(spark):
    rows = spark.range(100_000).select(F.lit("run").alias("run"), (F.col("id") + 1).cast("double").alias("v"))
    counted = medians(rows, "run", "v")
    assert counted.first()[1] == 50_000.5
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan
