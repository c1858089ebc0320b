"""Weak-label alignment: situations made up from the matching rules, and invariants on whole tables."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docledger.operators import align as L
from docledger.operators import clean as K
from docledger.operators.reports import inspect_labels
from docledger.workload.fixtures import fixture

FIELD = "document_id string, field_path string, label string, gt_value string, normalization_kind string, page_index bigint, invoice_index bigint, item_index bigint, line_number bigint"
REGION = "document_id string, region_id string, text string, x_min double, y_min double, x_max double, y_max double, page_index bigint, detection_confidence double, recognition_confidence double"
CONFIDENCE = {**dict(L.CASCADE), "money_normalized": 0.98}


class Sheet:
    """A document written as printed lines: regions of a line stand side by side."""

    def __init__(self, name, *lines, page=0):
        self.name = name
        self.regions = [
            (name, f"{page}.{row}.{place}", text, 100.0 * place, 30.0 * row, 100.0 * place + 80, 30.0 * row + 12, page, 0.95, 0.97)
            for row, line in enumerate(lines) for place, text in enumerate(line)]
        self.fields = []

    def wants(self, path, label, value, kind="text", *, page=0, item=None):
        self.fields.append((self.name, path, label, value, kind, page, 0, item, None if item is None else item + 1))
        return self

    def __add__(self, other):
        self.regions += other.regions
        return self


RULES = [
    ("BUYER_NAME", "text", "Café Zola", "Café Zola", "exact"),
    ("BUYER_NAME", "text", "Café Zola", "Café   Zola", "whitespace_normalized"),
    ("BUYER_NAME", "text", "Café Zola", "CAFÉ ZOLA", "exact_normalized"),
    ("INVOICE_NUMBER", "identifier", "QX-77/4", "qx 77 4", "identifier_normalized"),
    ("INVOICE_NUMBER", "identifier", "AB123", "AB123" + "#" * 40, "identifier_normalized"),
    ("BUYER_NAME", "text", "ABC Co", "ＡＢＣ Co", "exact_normalized"),
    ("GRAND_TOTAL", "money", "98765", "98,765", "money_normalized"),
    ("QUANTITY", "number", "12.50", "12.5", "number_normalized"),
    ("INVOICE_DATE", "date", "2031-11-04", "4/11/2031", "date_normalized"),
]
INSIDE = [
    ("QUANTITY", "number", "30", "box of 30 tubes", "30"), ("EXPIRY_DATE", "date", "2032-07-01", "use until 01/07/2032 at best", "01/07/2032"),
]


def sheets():
    for k, (label, kind, value, printed, _) in enumerate(RULES):
        yield Sheet(f"rule{k}", ["zzz"], [printed], ["yyy"]).wants("v", label, value, kind)
    yield (Sheet("pages", ["QX-77"]) + Sheet("pages", ["QX-77"], page=3)).wants("n", "INVOICE_NUMBER", "QX-77", "identifier", page=3)
    yield Sheet("three", ["Green", "Valley", "Traders"], ["end"]).wants("s", "SUPPLIER_NAME", "Green Valley Traders")
    yield Sheet("twice", ["QX-77"], ["mid"], ["QX-77"]).wants("n", "INVOICE_NUMBER", "QX-77", "identifier")
    yield Sheet("similar", ["Gren Vally Traders"]).wants("s", "SUPPLIER_NAME", "Green Valley Traders")
    yield Sheet("prefix", ["Số: 4711-B"], ["4712-B"]).wants("n", "INVOICE_NUMBER", "4711-B", "identifier")
    for k, (label, kind, value, inside, alone) in enumerate(INSIDE):
        yield Sheet(f"prose{k}", [inside]).wants("v", label, value, kind, item=0)
        yield Sheet(f"alone{k}", [inside], [alone]).wants("v", label, value, kind, item=0)
    items = Sheet("items", ["Gauze", "8"], ["Plaster", "8"], ["Swab", "8"])
    for item, name in enumerate(("Gauze", "Plaster", "Swab")):
        items.wants(f"{item}.name", "MEDICINE_NAME", name, item=item).wants(f"{item}.count", "QUANTITY", "8", "number", item=item)
    yield items


@pytest.fixture(scope="module")
def matched(spark):
    """All sheets aligned in one go: matches by (document, path), labels by (document, region)."""
    written = list(sheets())
    found = L.align(
        spark.createDataFrame([field for sheet in written for field in sheet.fields], FIELD),
        spark.createDataFrame([region for sheet in written for region in sheet.regions], REGION))
    return {(row.document_id, row.field_path): row for row in found.collect()}, {
        (row.document_id, row.region_id): row.region_label for row in L.region_labels(found).collect()}


def test_each_rule_names_itself(matched):
    rows, labels = matched
    for k, (label, _, _, _, method) in enumerate(RULES):
        row = rows[f"rule{k}", "v"]
        assert row.match_method == method and row.match_confidence == CONFIDENCE[method], RULES[k]
        assert row.region_ids == ["0.1.0"] and labels[f"rule{k}", "0.1.0"] == f"B-{label}"


def test_only_the_fields_own_page_is_searched(matched):
    assert matched[0]["pages", "n"].region_ids == ["3.0.0"]


def test_a_value_over_three_regions(matched):
    rows, labels = matched
    assert rows["three", "s"].match_method == "multi_box_exact" and rows["three", "s"].candidate_count == 1
    assert [labels["three", f"0.0.{k}"][:2] for k in range(3)] == ["B-", "I-", "I-"] and ("three", "0.1.0") not in labels


def test_two_equal_prints_leave_a_field_undecided(matched):
    rows, labels = matched
    assert rows["twice", "n"].ambiguous and rows["twice", "n"].duplicate_candidates
    assert not any(document == "twice" for document, _ in labels)


def test_similar_text_is_never_trained(matched):
    rows, labels = matched
    want = SequenceMatcher(None, "green valley traders", "gren vally traders").ratio()
    assert rows["similar", "s"].match_method == "fuzzy" and abs(rows["similar", "s"].match_confidence - want) < 1e-12
    assert not any(document == "similar" for document, _ in labels)


def test_a_printed_prefix_is_an_anchor(matched):
    row = matched[0]["prefix", "n"]
    assert row.match_method == "anchored_exact_normalized" and row.region_ids == ["0.0.0"]


def test_numbers_and_dates_inside_prose_do_not_count(matched):
    for k in range(len(INSIDE)):
        assert (f"prose{k}", "v") not in matched[0]
        row = matched[0][f"alone{k}", "v"]
        assert row.region_ids == ["0.1.0"] and not row.ambiguous


def test_items_keep_their_own_lines(matched):
    assert [matched[0]["items", f"{item}.count"].region_ids for item in range(3)] == [[f"0.{item}.1"] for item in range(3)]


def test_spans_cross_block_borders(spark):
    words = [f"t{k}" for k in range(83)]
    sheet = Sheet("d", *[words[k:k + 7] for k in range(0, 83, 7)])
    got = {(s.start, s.size): s.text for s in L.spans(spark.createDataFrame(sheet.regions, REGION), max_boxes=5, block=9, band=41.0).collect()}
    assert got == {(k + 1, n): " ".join(words[k:k + n]) for k in range(83) for n in range(1, 6) if k + n <= 83}


def test_no_region_is_trained_twice(spark):
    sf = "/root/testdata/sf0.001"
    matches = L.align(fixture(spark, sf, "fx_fields"), fixture(spark, sf, "fx_regions"))
    assert L.region_labels(matches).groupBy("document_id", "region_id").count().where("count > 1").isEmpty()
    assert matches.groupBy("document_id", "field_path").count().where("count > 1").isEmpty()


ALIGNMENT = "document_id string, field_path string, label string, region_ids array<string>, match_method string, match_confidence double, recognition_confidence double, detection_confidence double, ambiguous boolean, duplicate_candidates boolean, candidate_count bigint, training_eligible boolean"


def decided(spark, **claims):
    rows = [("doc", path, "UNIT", regions, "exact", 1.0, 1.0, 1.0, False, False, 1, True) for path, regions in claims.items()]
    tokens = spark.createDataFrame([("doc", f"t{k}", f"word{k}") for k in range(6)], "document_id string, region_id string, token string")
    return tokens, K.resolve_conflicts(K.classify_alignment(spark.createDataFrame(rows, ALIGNMENT)), tokens)


def test_contested_and_unknown_regions(spark):
    tokens, resolved = decided(spark, sole=["t0"], left=["t1"], right=["t1"], lost=["t2", "zz"], beside=["t2"], none=[])
    reasons = {row.field_path: (row.decision, row.reason) for row in resolved.collect()}
    assert reasons["sole"][0] == "KEEP" and reasons["beside"][0] == "KEEP"
    assert reasons["left"] == reasons["right"] == ("IGNORE", "region_shared_by_multiple_fields")
    assert reasons["lost"] == ("IGNORE", "alignment_region_missing_from_tokens") and reasons["none"][1] == "alignment_has_no_regions"
    cleaned = {row.region_id: (row.clean_label, row.ignore_mask) for row in K.clean_labels(tokens, resolved).collect()}
    assert cleaned["t0"] == ("B-UNIT", False) and cleaned["t1"] == ("O", True) and cleaned["t5"] == ("O", False)


def test_report_and_inspection_of_cleaned_fields(spark):
    _, resolved = decided(spark, sole=["t0"], left=["t1"], right=["t1"])
    fields = resolved.select("document_id", "field_path", "label").union(spark.createDataFrame([("doc", "nowhere", "UNIT")], "a string, b string, c string"))
    every = K.with_unmatched(resolved, fields)
    report = {(row.level, row.name): row for row in K.cleaning_report(every).collect()}
    assert (report["all", "all"].total_fields, report["all", "all"].keep_fields) == (4, 1)
    assert report["reason", "unmatched_no_region"].ignore_fields == 1
    checked = spark.createDataFrame([("doc", []), ("bad", ["pages_not_empty"])], "document_id string, failed_rules array<string>")
    seen = inspect_labels(checked, every).first()
    assert (seen.annotations, seen.invalid_annotations, seen.valid, seen.basis, seen.usable_fields) == (2, 1, False, "cleaned", 1)
    assert inspect_labels(checked.where("size(failed_rules) = 0"), every.drop("decision").withColumn("training_eligible", F.lit(True))).first().valid


def test_cleaning_reads_its_input_twice_at_most(spark):
    _, resolved = decided(spark, sole=["t0"], left=["t1"])
    assert resolved._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3
