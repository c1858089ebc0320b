"""Spans and candidates: pages read in place and full pages give the same rows, and rows move once."""

import random

from pyspark.sql import functions as F

from docledger.operators import align as L

REGIONS = "document_id string, page_index long, region_id string, text string, x_min double, y_min double, x_max double, y_max double"
FIELDS = "document_id string, field_path string, label string, gt_value string, normalization_kind string, page_index long"
CANDIDATES = "document_id string, field_path string, page_index long, start long, size int, confidence double"


def sheets():
    pick = random.Random(11)
    words = ["12.50", "4/11/2031", "Số: 4711-B", "4711-B", "Gren", "Vally", "Green", "Valley", "98,765", " ", "ab", "Café"]
    regions = [(f"d{d}", p, f"r{d}-{p}-{k}", pick.choice(words), 5.0 * (k % 3), 20.0 * (k // 3), 5.0 * (k % 3) + 4, 20.0 * (k // 3) + 10)
               for d in range(2) for p in range(2) for k in range(14)]
    wanted = [("INVOICE_NUMBER", "4711-B", "identifier"), ("SUPPLIER_NAME", "Green Valley", "text"), ("GRAND_TOTAL", "98765", "money"),
              ("INVOICE_DATE", "2031-11-04", "date"), ("QUANTITY", "12.5", "number"), ("BUYER_NAME", "CAFÉ ab", "text")]
    fields = [(f"d{d}", f"f{k}-{p}", *value, p) for d in range(2) for p in (0, 1, 9) for k, value in enumerate(wanted)]
    return fields, regions


def test_full_pages_give_the_same_candidates(spark):
    fields, regions = sheets()
    f, r = spark.createDataFrame(fields, FIELDS), spark.createDataFrame(regions, REGIONS)
    found = []
    for page_pairs in (0, 200, 50_000):  # no page in place, those that few fields ask for, all pages
        rows = L.match_cascade(f, r, max_boxes=4, page_pairs=page_pairs).collect()
        found.append({(c.document_id, c.field_path, c.page_index, c.start, c.size): (
            c.method, round(c.confidence, 12), tuple(c.region_ids), c.center_x, c.center_y, c.mean_height, c.span_width, c.inherently_ambiguous) for c in rows})
    assert found[0] and found[0] == found[1] == found[2]
    assert {m.removeprefix("multi_box_") for m, *_ in found[0].values()} >= {"exact", "money_normalized", "date_normalized", "anchored_exact_normalized"}


def test_long_pages_give_the_same_spans(spark):
    _, regions = sheets()
    r = spark.createDataFrame(regions, REGIONS)
    rows = [sorted(L.spans(r, max_boxes=5, large=large, block=6, band=30.0).collect()) for large in (0, 100)]
    assert rows[0] and rows[0] == rows[1]


def test_regions_of_short_pages_move_once_for_their_spans(spark):
    _, regions = sheets()
    plan = L.spans(spark.createDataFrame(regions, REGIONS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_pruning_equals_comparing_all_candidates(spark):
    pick = random.Random(2)
    rows = {(d, f, p, pick.randrange(1, 9), pick.randrange(1, 6)): pick.choice((0.8, 0.9, 1.0)) for d in "ab" for f in "xy" for p in (0, 1) for _ in range(14)}
    kept = {key for key, sure in rows.items() if not any(
        other[:3] == key[:3] and other[4] < key[4] and other[3] >= key[3] and other[3] + other[4] <= key[3] + key[4] and more >= sure
        for other, more in rows.items())}
    pruned = L.prune_spans(spark.createDataFrame([(*key, sure) for key, sure in rows.items()], CANDIDATES))
    assert {tuple(r)[:5] for r in pruned.collect()} == kept and len(kept) < len(rows)
    assert "Join" not in pruned._jdf.queryExecution().optimizedPlan().toString()
    assert pruned.where(F.col("size") > 12).isEmpty()


def test_only_spans_with_a_print_that_a_field_asks_for_are_parsed(spark):
    fields, regions = sheets()
    placed, pages = L._fields_and_pages(spark.createDataFrame(fields, FIELDS), spark.createDataFrame(regions, REGIONS))
    formed = L.cut_lineage(L._field_keys(placed).withColumn("_prints", L._prints()))
    asked = L.cut_lineage(pages.select("document_id", "page_index", F.lit(12).alias("_longest")))
    found = L._met_in_place(formed, spark.createDataFrame(regions, REGIONS), asked, max_boxes=4, fuzzy=False)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "vnd|d|dong" in plan and "vnd|d|dong" not in plan[plan.index("Join Inner"):]


def test_equal_texts_have_prints_that_their_field_asks_for(spark):
    pick = random.Random(5)
    words = ["Số:", "so", "VND", "d", "%", "12.345", "12345", "-0,50", "0", "1.", "ngày 4", "tháng 11", "năm 2031", "4/11/2031", "2031-11-04", "Straße", "STRASSE", "ΑΣ", "ας", "ﬁn",
             "ἀ12", "12", "İz", "đá", "Đa", "_", "|", "...", "'x'", None, " ", "Tổng", "cộng", "Ngày", "K9"]
    regions = [("d", p, f"{p}-{k}", pick.choice(words), float(k % 4), 20.0 * (k // 4), k % 4 + 0.5, 20.0 * (k // 4) + 9) for p in range(12) for k in range(30)]
    values = ["12345", "12345.0", "0.5", "0", "2031-11-04", "4/11/2031", "strasse", "Straße", "ας", "fin", "12", "iz", "da", "đá", "x", "|", "cộng", "K9", "so 12", None]
    fields = [("d", f"{v}-{label}-{kind}-{p}", label, v, kind, p) for p in range(12) for v in values
              for label, kind in (("GRAND_TOTAL", "money"), ("INVOICE_DATE", "date"), ("INVOICE_NUMBER", "identifier"), ("NOTE", "number"))]
    f, r = spark.createDataFrame(fields, FIELDS), spark.createDataFrame(regions, REGIONS)
    key = ("field_path", "page_index", "start", "size", "method", "region_ids")
    in_place, by_keys = (sorted(map(tuple, L.match_cascade(f, r, max_boxes=4, fuzzy=False, page_pairs=n).select(*key).collect())) for n in (50_000, 0))
    assert in_place == by_keys
    assert {m.removeprefix("multi_box_") for *_, m, _ in in_place} >= {"exact", "money_normalized", "number_normalized", "date_normalized", "identifier_normalized", "anchored_exact_normalized"}
