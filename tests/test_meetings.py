"""Sides that are dealt together meet where they lie: exchanges, copies and missing keys."""

from docledger.operators import align as L
from docledger.operators import clean as K
from docledger.operators.fields import document_counts, paired_fields, per_field_accuracy

FIELDS = "document_id string, path string, kind string, text string"
REGIONS = ("document_id string, region_id string, page_index bigint, text string, x_min double, y_min double, x_max double, y_max double, "
           "detection_confidence double, recognition_confidence double")
VALUES = "document_id string, field_path string, gt_value string, invoice_index bigint, item_index bigint, line_number bigint"
MATCHES = "document_id string, field_path string, label string, page_index bigint, region_ids array<string>, ambiguous boolean"
DECIDED = "document_id string, field_path string, label string, region_ids array<string>, decision string, reason string"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD")


def both_sides(spark):
    expected = [("d", "a", "string", "X y"), ("d", "b", "number", "1"), ("d", "b", "number", "2"), (None, "a", "string", "n"), ("e", None, "string", "n"), ("f", "a", "null", None)]
    predicted = [("d", "a", "string", "x  Y"), ("d", "b", "number", "1.0"), ("d", "b", "number", "3"), ("d", "b", "number", "4"), (None, "a", "string", "n"),
                 ("e", None, "string", "n"), ("g", "a", "string", "　")]
    return spark.createDataFrame(predicted, FIELDS), spark.createDataFrame(expected, FIELDS)


def test_flags_are_dealt_by_document_before_they_are_counted(spark):
    counts = document_counts(paired_fields(*both_sides(spark))).select("document_id", "true_positives")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert exchanges(counts) == 4  # either side by path, the flags by document and share, the counts by document
    dealt = next(line for line in plan.splitlines() if "REPARTITION_BY_COL" in line)
    assert plan.index("partial_count") < plan.index(dealt) < plan.index("SortMergeJoin")
    assert "text" not in dealt and "path" not in dealt


def test_copies_of_a_path_are_paired_each_with_each(spark):
    paired = paired_fields(*both_sides(spark))
    found = sorted(map(str, ((r.document_id, r.path, r.g_kind, r.g_text, r.p_kind, r.p_text) for r in paired.collect())))
    want = [("d", "a", "string", "X y", "string", "x  Y"), (None, "a", "string", "n", None, None), (None, "a", None, None, "string", "n"),
            ("e", None, "string", "n", None, None), ("e", None, None, None, "string", "n"), ("f", "a", "null", None, None, None), ("g", "a", None, None, "string", "　")]
    want += [("d", "b", "number", g, "number", p) for g in "12" for p in ("1.0", "3", "4")]
    assert found == sorted(map(str, want))


def test_counts_of_equal_alike_and_blank_values(spark):
    rows = {r.document_id: r for r in document_counts(paired_fields(*both_sides(spark))).collect()}
    d = rows["d"]
    assert (d.true_positives, d.normalized_true_positives, d.predicted_fields, d.expected_fields) == (0, 1, 7, 7)
    assert (d.exact_paths, d.normalized_paths, d.document_exact) == (1, 2, False)
    assert (rows["f"].exact_paths, rows["f"].normalized_paths, rows["f"].expected_fields) == (1, 1, 0)
    assert (rows["g"].predicted_fields, rows["g"].character_errors) == (0, 0)
    accuracy = {r.path: (r.correct, r.total) for r in per_field_accuracy(paired_fields(*both_sides(spark))).collect()}
    assert accuracy == {"a": (2, 3), "b": (1, 6), None: (0, 1)}


def test_alignment_rows_meet_once(spark):
    regions = spark.createDataFrame([
        ("d", "r1", 0, " one ", 0.0, 0.0, 1.0, 1.0, 0.9, 0.8), ("d", "r2", 0, "two", 0.0, 0.0, 1.0, 1.0, 0.7, 0.6), ("d", "r3", 0, " ", 0.0, 0.0, 1.0, 1.0, 0.5, 0.5),
        ("d", None, 0, "lost", 0.0, 0.0, 1.0, 1.0, 0.1, 0.1), (None, "r1", 0, "lost", 0.0, 0.0, 1.0, 1.0, 0.1, 0.1), ("d", "r2", 0, "two", 0.0, 0.0, 1.0, 1.0, 0.4, 0.6)], REGIONS)
    matches = spark.createDataFrame([
        ("d", "f1", "A", 0, ["r2", "r1"], False), ("d", "f2", "B", 1, ["r3"], True), ("d", "f3", "C", 0, ["gone"], False), ("d", "f4", "D", 0, [], False),
        ("d", "f5", "E", 0, [None], False), (None, "f1", "A", 0, ["r1"], False), ("d", "f6", "F", 0, ["gone", "r1"], False), ("d", "f7", "G", 0, ["r1"], False)], MATCHES)
    values = spark.createDataFrame([("d", f"f{k}", f"v{k}", 0, None, None) for k in range(1, 7)] + [("d", "f6", "again", 0, 1, 2), (None, "f1", "v", 0, None, None)], VALUES)
    rows = L.alignment_rows(matches, values, regions)
    assert exchanges(rows) == 1
    assert rows.columns == ["document_id", "field_path", "label", "page_index", "region_ids", "ambiguous", "ocr_text", "detection_confidence", "recognition_confidence",
                            "gt_value", "invoice_index", "item_index", "line_number", "page", "training_eligible"]
    found = sorted((r.field_path, r.ocr_text, r.detection_confidence, r.recognition_confidence, r.gt_value, r.page, r.training_eligible) for r in rows.collect())
    assert found == [("f1", "two two one", 0.4, 0.6, "v1", 1, True), ("f2", None, 0.5, 0.5, "v2", 2, False),
                     ("f6", "one", 0.9, 0.8, "again", 1, True), ("f6", "one", 0.9, 0.8, "v6", 1, True)]


def test_layout_pages_with_copies_and_missing_keys(spark):
    place = (0.0, 10.0, 35.0, 20.0, 0.9, 0.9)
    regions = spark.createDataFrame([
        ("d", "b", 0, "B", *place), ("d", "a", 0, "A", *place), ("d", "c", 1, "C", *place), ("d", None, 0, "N", *place), (None, "a", 0, "lost", *place), ("e", "a", 0, "unsized", *place)], REGIONS)
    labels = spark.createDataFrame([("d", "a", "B-X"), ("d", None, "B-N"), ("d", "c", "B-Y"), ("d", "c", "B-Z")], "document_id string, region_id string, region_label string")
    sizes = spark.createDataFrame([("d", 0, 70, 100), ("d", 1, 700, 1000), ("g", 0, 70, 100), (None, 0, 70, 100)], "document_id string, page_index bigint, width int, height int")
    pages = L.layout_pages(regions, labels, sizes)
    found = {(r.document_id, r.page_index): (r.tokens, r.labels, r.region_ids, r.boxes[0]) for r in pages.collect()}
    assert found == {("d", 0): (["N", "A", "B"], ["O", "B-X", "O"], [None, "a", "b"], [0, 100, 500, 200]),
                     ("d", 1): (["C", "C"], ["B-Y", "B-Z"], ["c", "c"], [0, 10, 50, 20])}


def resolved_fields(spark):
    decided = spark.createDataFrame([
        ("d", "f1", "A", ["r1"], "KEEP", "k"), ("d", "f2", "A", ["r1", "r2"], "REVIEW", "k"), ("d", "f3", "A", ["gone", "r2"], "KEEP", "k"), ("d", "f4", "A", [], "KEEP", "k"),
        ("d", "f5", "A", None, "KEEP", "k"), ("d", "f6", "A", [None], "KEEP", "k"), ("d", "f7", "A", ["r3", "r3"], "KEEP", "k"), ("d", None, "A", ["r1"], "KEEP", "k"),
        (None, "f1", "A", ["r1"], "KEEP", "k"), ("e", "f1", "A", ["r1"], "KEEP", "k"), ("e", "f1", "B", ["gone"], "KEEP", "k"), ("g", "f1", "A", ["r1"], "KEEP", "k"), ("g", "f3", "A", ["r1", "gone"], "KEEP", "k")], DECIDED)
    tokens = spark.createDataFrame([("d", "r1"), ("d", "r1"), ("d", "r2"), ("d", "r3"), ("d", None), (None, "r1"), ("e", "r1"), ("g", "r1")], "document_id string, region_id string")
    return K.resolve_conflicts(decided, tokens)


def test_conflicts_meet_once(spark):
    resolved = resolved_fields(spark)
    assert exchanges(resolved) == 1
    found = sorted((str(r.document_id), str(r.field_path), r.label, r.decision, r.reason) for r in resolved.collect())
    unknown, shared = ("IGNORE", "alignment_region_missing_from_tokens"), ("IGNORE", "region_shared_by_multiple_fields")
    assert found == sorted([
        ("d", "f1", "A", *shared), ("d", "f2", "A", *shared), ("d", "f3", "A", *unknown), ("d", "f4", "A", "KEEP", "k"), ("d", "f5", "A", "KEEP", "k"), ("d", "f6", "A", *unknown),
        ("d", "f7", "A", "KEEP", "k"), ("d", "None", "A", "KEEP", "k"), ("None", "f1", "A", "KEEP", "k"), ("e", "f1", "A", *unknown), ("e", "f1", "B", *unknown), ("g", "f1", "A", "KEEP", "k"), ("g", "f3", "A", *unknown)])


def test_decisions_of_every_field_are_made_once(spark):
    fields = spark.createDataFrame([("d", "f1", "A"), ("d", "new", "B"), ("d", "new", "B"), ("d", None, "C"), (None, "f1", "D")], "document_id string, field_path string, label string")
    every = K.with_unmatched(resolved_fields(spark), fields)
    assert scans(every) == 3
    unmatched = sorted((str(r.document_id), str(r.field_path), r.label) for r in every.where("reason = 'unmatched_no_region'").collect())
    assert unmatched == [("None", "f1", "D"), ("d", "None", "C"), ("d", "new", "B"), ("d", "new", "B")]
    assert every.count() == 13 + 4
