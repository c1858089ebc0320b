"""Broken records, regions and stages cost themselves only."""

import numpy as np
from pyspark.sql import functions as F

from docledger.operators.rollup import experiment_outcome, reason_rows
from docledger.operators.scoring import linear_head, score_table
from docledger.operators.training import linear_probe, probe_head
from docledger.plans.evaluation import evaluate_run
from docledger.plans.labelling import build_labels, label_errors
from docledger.workload.fixtures import fixture

REGION = "document_id string, page_index bigint, region_id string, text string, x_min double, y_min double, x_max double, y_max double"
NAN = float("nan")
BOXES = {
    "sound": (1.0, 1.0, 5.0, 5.0), "nan": (NAN, 1.0, 5.0, 5.0), "null": (None, 1.0, 5.0, 5.0), "turned": (9.0, 1.0, 5.0, 5.0), "endless": (1.0, 1.0, float("inf"), 5.0),
}


def test_every_fault_is_named(spark):
    regions = spark.createDataFrame([
        ("a", 0, "r1", "x", *BOXES["sound"]), ("a", 0, "r2", "x", *BOXES["nan"]), ("a", 0, "r3", "x", *BOXES["null"]), ("a", 0, "r4", "x", *BOXES["endless"]),
        ("a", 0, "r5", "x", *BOXES["turned"]), ("a", 0, None, None, *BOXES["sound"]), ("b", None, "r1", "x", *BOXES["sound"]), ("z", 0, "r1", None, *BOXES["null"]),
    ], REGION)
    targets = spark.createDataFrame([(d,) for d in "abcde"], "document_id string")
    fields = spark.createDataFrame([("a",), ("a",), ("z",)], "document_id string")
    payloads = spark.createDataFrame([("b", "{"), ("b", None), ("c", "{}"), ("c", "oops"), ("d", "[1]")], "document_id string, payload string")
    got = {(r.document_id, r.message): (r.stage, r.recoverable, r.records) for r in label_errors(targets, regions, fields, payloads).collect()}
    seen, truth = "recognition", "ground_truth"
    assert got == {
        ("a", "region without a finite box"): (seen, True, 3), ("a", "region whose box ends before it begins"): (seen, True, 1),
        ("a", "region without id"): (seen, True, 1), ("a", "region without text"): (seen, True, 1),
        ("b", "region without page"): (seen, True, 1), ("b", "no usable region"): (seen, True, 1),
        **{(d, "no regions recognised"): (seen, True, 1) for d in "cde"},
        ("b", "record is not a JSON object"): (truth, False, 1), ("c", "no labelled value"): (truth, False, 1),
        ("d", "record is not a JSON object"): (truth, False, 1), ("e", "no record"): (truth, False, 1),
    }
    assert label_errors(targets.where("false"), regions, fields, payloads).isEmpty()


def test_broken_regions_leave_the_labels_of_others_alone(spark):
    sf = "/root/testdata/sf0.001"
    few = [row.document_id for row in fixture(spark, sf, "fx_print").select("document_id").orderBy("document_id").limit(6).collect()]
    regions, fields = (fixture(spark, sf, name).where(F.col("document_id").isin(few)) for name in ("fx_regions", "fx_fields"))
    index = spark.createDataFrame([(d, "p") for d in few], "document_id string, gt_path string")
    broken = regions.limit(5).select(*[F.lit(None).cast(t).alias(c) if c in ("x_min", "text") else F.concat("region_id", F.lit("-b")).alias(c) if c == "region_id" else c
                                       for c, t in regions.dtypes])
    plain = build_labels(index, regions, fields)[1]
    _, tokens, errors = build_labels(index, regions.unionByName(broken), fields)
    columns = ["document_id", "region_id", "region_label"]
    assert sorted(map(tuple, tokens.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))
    assert {row.message for row in errors.collect()} == {"region without text", "region without a finite box"}


def test_a_failing_stage_leaves_the_others_alone(spark):
    texts = spark.createDataFrame([("1", "1"), ("a", "b")], "predicted string, expected string")
    boxes = texts.withColumnRenamed("predicted", "nothing")
    got = {(r.stage, r.metric): (r.value, r.reason) for r in evaluate_run(boxes=(boxes, boxes), transcriptions=texts).collect()}
    assert got[("recognition", "recognition_exact_match")] == (0.5, None)
    assert got[("detection", "status")][1].startswith("failed: ") and got[("layout", "status")] == (None, "GT/layout missing")
    torn = texts.withColumn("predicted", F.expr("if(expected = 'b', raise_error('torn'), predicted)"))
    reasons = {(r.stage, r.metric): r.reason for r in evaluate_run(transcriptions=torn, isolate=True).collect()}
    assert reasons[("recognition", "status")].startswith("failed: ") and ("final", "status") in reasons
    words = evaluate_run(transcriptions=texts.where("expected = 'b'"), isolate=True).where("metric = 'recognition_numeric_accuracy'").first()
    assert words.value is None and words.reason == "no numeric text"


def test_scores_are_those_of_the_fitted_head(spark):
    draw = np.random.default_rng(3)
    rows = [(k, ["train", "validation", "test"][k % 3], k % 2, (draw.normal(size=4) + 2 * (k % 2)).tolist()) for k in range(120)]
    features = spark.createDataFrame(rows, "vec_id bigint, split string, label int, embedding array<double>")
    model, report = linear_probe(features, grid=(0.01,))
    weights, bias = probe_head(model)
    odd = spark.createDataFrame([(900, None), (901, [1.0]), (902, [1.0, None, 2.0, 3.0]), (903, [NAN] * 4)], "vec_id bigint, embedding array<double>")
    scored = score_table(features.select("vec_id", "embedding").unionByName(odd), linear_head(spark, weights, bias), "vec_id bigint, logits array<double>",
                         model_name="m", model_revision="1")
    got = {row.vec_id: row.logits for row in scored.collect()}
    assert all(got[k] is None for k in (900, 901, 902, 903))
    for k, _, _, vector in rows:
        assert np.allclose(got[k], weights @ np.array(vector) + bias)
    assert sum(int(np.argmax(got[k])) == label for k, split, label, _ in rows if split == "test") / 40 == report.first().test_accuracy


def test_reasons_as_rows_and_in_one_line(spark):
    runs = spark.createDataFrame(
        [(1, "failed", "late"), (2, "success", None), (3, "failed", "early"), (4, "failed", "late"), (0, "skipped", "early")], "position int, status string, reason string")
    row = experiment_outcome(runs).first()
    assert (row.combination_count, row.failed_count, row.skipped_count, row.successful_count, row.reasons, row.all_failed) == (5, 3, 1, 1, "early; late", False)
    assert {tuple(r) for r in reason_rows(runs, None, "position").collect()} == {("late", 1, 2), ("early", 0, 2)}
    empty = experiment_outcome(runs.where("false")).first()
    assert (empty.combination_count, empty.reasons, empty.all_failed) == (0, None, False)
