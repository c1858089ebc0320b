"""Values at and beyond former limits: nothing is cut, rounded or allowed to end a job."""

from pyspark.sql import functions as F

from docledger.functions.text import casefold, fold_text
from docledger.functions.values import number_text, parse_number
from docledger.operators.checks import validate_annotations, validation_summary
from docledger.operators.flatten import flatten_json, gt_fields
from docledger.operators.training import best_checkpoint, token_dataset
from docledger.operators.transcription import pair_transcriptions
from docledger.plans.totals import totals_check


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_numbers_of_any_length(spark):
    long = "9" * 30
    assert one(spark, number_text(F.lit(long))) == long
    assert one(spark, number_text(F.lit("0,12345678901"))) == "0.12345678901"
    assert [one(spark, number_text(F.lit(text))) for text in ("007", "1.50", "-0", "1.234.567", ".5", "x", "-1,20", "10")] == [
        "7", "1.5", "0", "1234567", "0.5", None, "-1.2", "10"]
    assert one(spark, parse_number(F.lit(long))) is None


def test_wide_amounts_leave_checks_unknown(spark):
    heads = spark.createDataFrame([(1, "1", "0", "1"), (2, "9" * 40, "1", "2"), (3, "5", "0", "5")], "doc_key long, sub_text string, vat_text string, total_text string")
    lines = spark.createDataFrame([(1, "9" * 28), (1, "9" * 28), (2, "1"), (3, "2"), (3, "3")], "doc_key long, amount_text string")
    rows = {(row.subtotal_plus_vat, row.sum_of_items): row.documents for row in totals_check(heads, lines).collect()}
    assert sum(rows.values()) == 3 and rows["equal", "equal"] == 1 and rows["unknown", "unknown"] == 1


def test_deep_records_are_followed(spark):
    deep = "1"
    for level in range(12):
        deep = '{"k":%s}' % deep if level % 2 else "[%s]" % deep
    records = spark.createDataFrame([("a", deep), ("b", '{"x":"[[[{{\\\\\\"["}'), ("c", "[" * 50)], "id string, payload string")
    rows = {(row.id, row.kind, row.text) for row in flatten_json(records, "payload", ["id"]).collect()}
    assert ("a", "number", "1") in rows and not any(kind == "deeper" for _, kind, _ in rows)


def test_a_float_is_not_an_integer(spark):
    records = spark.createDataFrame([("a", '{"i":1,"f":1.0,"h":1.50,"s":"1","big":100000000000000000000}')], "id string, payload string")
    got = {row.path: (row.kind, row.text) for row in flatten_json(records, "payload", ["id"]).collect()}
    assert got == {"i": ("number", "1"), "f": ("number", "1.0"), "h": ("number", "1.5"), "s": ("string", "1"), "big": ("number", "100000000000000000000")}


def test_impossible_page_numbers_fall_back(spark):
    record = '{"invoices":[{"page_number":99999999999,"invoice":{"invoice_number":"7"},"items":[{"line_number":99999999999,"quantity":3}]}]}'
    rows = gt_fields(spark.createDataFrame([("d", record)], "document_id string, payload string")).collect()
    assert rows and {row.page_index for row in rows} == {0}


def test_folds_cover_all_letters(spark):
    assert one(spark, fold_text(F.lit("й ά é"))) == "и α e"
    for text in ("Straße ΣΑΣ ŉ ǰ İ ﬀ Ꭰ µ ſ", "plain"):
        assert one(spark, casefold(F.lit(text))) == text.casefold()


def test_repeated_prediction_ids_count_once(spark):
    predicted = spark.createDataFrame([("d", "r", "first", 1), ("d", "r", "second", 2)], "document_id string, region_id string, text string, pos int")
    expected = spark.createDataFrame([("d", "r", "second", 1)], "document_id string, region_id string, text string, pos int")
    for fallback in (True, False):
        rows = pair_transcriptions(predicted, expected, "pos", ordinal_fallback=fallback).collect()
        assert [row.predicted for row in rows] == ["second"]


def test_ignored_and_unknown_token_labels(spark):
    pages = spark.createDataFrame(
        [(1, ["a", "b"], ["IGNORE", "O"], [False, False]), (2, ["a"], ["NO-SUCH"], None)],
        "id int, tokens array<string>, labels array<string>, ignore_mask array<boolean>")
    rows = {row.id: row.label_ids for row in token_dataset(pages).collect()}
    assert rows[1][0] == -100 and rows[1][1] is not None and rows[2] is None


def test_best_checkpoint_of_one_large_run(spark):
    rows = spark.range(5000).select(
        F.lit("run").alias("run_id"), F.lit("validation").alias("evaluated_split"), (F.col("id") % 100).cast("double").alias("metric_value"), F.col("id").cast("int").alias("epoch"))
    best, refused = best_checkpoint(rows)
    assert best.first().epoch == 99 and refused.isEmpty()
    assert best_checkpoint(rows, greater_is_better=False)[0].first().epoch == 0


def test_unreadable_records_are_named(spark):
    records = spark.createDataFrame(
        [("a", '{"x":1}'), ("b", "[1]"), ("c", "{oops"), ("d", None), ("e", '{"x":1,"x":2}')], "document_id string, payload string")
    for stage in ("final", "tables"):
        checked = validate_annotations(records, stage)
        assert {row.document_id for row in checked.collect() if not row.failed_rules} == {"a"}
        assert validation_summary(checked).first().valid == 1
