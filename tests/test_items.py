"""Item rows and fields: against a plain walk, copies, skew; evaluation plans."""

import random

import pytest
from pyspark.sql import functions as F

from docledger.operators.fields import _item_runs, item_field_accuracy, item_metrics, item_row_metrics
from docledger.workload.q_metrics import m16, m22

COLUMNS = ["name", "lot"]
SCHEMA = "document_id string, item_index long, name string, lot string"


def walk(predicted, expected):
    """Expected rows in order each take the best free row, then the lowest; without a shared value the lowest free one is used up."""
    free, correct = dict(enumerate(predicted)), 0
    for row in expected:
        scored = sorted((-sum(a == b for a, b in zip(row, other, strict=True)), at) for at, other in free.items())
        if scored:
            correct += -scored[0][0]
            free.pop(scored[0][1])
    return correct


def frame(spark, documents, side):
    rows = [(d, k, *row) for d, sides in documents.items() for k, row in enumerate(sides[side])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seed", range(3))
def test_items_equal_the_plain_walk(spark, seed):
    rng = random.Random(seed)

    def some(count):
        rows = []
        while len(rows) < count:
            rows += [(rng.choice("abcd"), rng.choice(["x", "y", None]))] * rng.choice([1, 1, 3])
        return rows[:count]

    documents = {f"d{k}": (some(rng.randrange(14)), some(rng.randrange(14))) for k in range(60)}
    found = {r.document_id: r for r in item_metrics(frame(spark, documents, 0), frame(spark, documents, 1), COLUMNS).collect()}
    for name, (predicted, expected) in documents.items():
        if not predicted and not expected:
            assert name not in found
            continue
        row = found[name]
        assert (row.predicted_rows, row.expected_rows) == (len(predicted), len(expected))
        assert row.correct_fields == walk(predicted, expected)
        assert row.matching_rows == sum(min(predicted.count(r), expected.count(r)) for r in set(expected))
        assert (row.item_field_accuracy is None) == (not expected)


def test_row_metrics_agree(spark):
    documents = {"a": ([("p", "1"), ("p", "1"), ("q", None)], [("p", "1"), ("r", "2")]), "b": ([], [("z", "z")]), "c": ([("z", "z")], [])}
    sides = frame(spark, documents, 0), frame(spark, documents, 1)
    names = ["document_id", "matching_rows", "predicted_rows", "expected_rows", "item_row_precision", "item_row_recall", "item_row_f1"]
    assert sorted(map(tuple, item_metrics(*sides, COLUMNS).select(names).collect())) == sorted(
        map(tuple, item_row_metrics(*sides, COLUMNS).select(names).collect()))


def test_copies_cost_one_pair(spark):
    rows = spark.range(4000).select(F.lit("hot").alias("document_id"), F.col("id").alias("item_index"), F.lit("a").alias("name"), F.lit("b").alias("lot"))
    runs = _item_runs(rows, COLUMNS, "e").select("e_start", "e_count").distinct().collect()
    assert [tuple(r) for r in runs] == [(0, 4000)]
    assert item_field_accuracy(rows, rows, COLUMNS).first()[1:] == (8000, 8000, 1.0)


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_evaluation_reads_each_input_once(spark):
    sf = "/root/testdata/sf0.001"
    assert scans(m16(spark, sf)) < 24 and scans(m22(spark, sf)) < 60
