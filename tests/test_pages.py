"""Pages and spans: rows move once where one task can order a page, longer pages give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from docledger.functions.ordinals import split_groups
from docledger.operators import assemble as A
from docledger.operators import geometry as G

ROWS = "document_id string, page_index bigint, region_id string, label string, text string, x_min double, y_min double, x_max double, y_max double"
LABELS = ("B-QUANTITY", "B-MEDICINE_NAME", "I-LOT_NUMBER", "O")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def scattered(seed, sizes):
    pick = random.Random(seed)
    rows = []
    for page, size in enumerate(sizes):
        for k in range(size):
            x, y, high = float(pick.randrange(0, 60, 5)), float(pick.randrange(0, 4 * size + 1)), float(pick.randrange(2, 30))
            rows.append(("d", page, f"r{k:03d}", pick.choice(LABELS), pick.choice((" ", "7", "ab")), x, y, x + 5, y + high))
    return rows


def lines(rows, ident, reach):
    """Line of every row, by the plain fold over each page."""
    found = {}
    for page in sorted({r[1] for r in rows}):
        line, total, count = -1, 0.0, 0
        for r in sorted((r for r in rows if r[1] == page), key=lambda r: (r[6], r[5], r[ident])):
            centre = (r[6] + r[8]) / 2
            if count and abs(centre - total / count) <= reach(r[8] - r[6]):
                total, count = total + centre, count + 1
            else:
                line, total, count = line + 1, centre, 1
            found[page, r[2]] = line
    return found


@pytest.mark.parametrize("large", [0, 12, 1000])
def test_reading_order_of_short_and_long_pages(spark, large):
    rows = scattered(3, (40, 5, 12, 1, 25))
    at = lines(rows, 2, lambda high: max(1.0, high * 0.5))
    want = {}
    for page in range(5):
        ordered = sorted((r for r in rows if r[1] == page), key=lambda r: (at[page, r[2]], r[5], r[6], r[2]))
        want.update({(page, r[2]): k for k, r in enumerate(ordered, 1)})
    got = G.reading_order(spark.createDataFrame(rows, ROWS).repartition(3), large=large, band=30.0)
    assert {(r.page_index, r.region_id): r.reading_order for r in got.collect()} == want


@pytest.mark.parametrize("large", [0, 12, 1000])
def test_table_rows_of_short_and_long_pages(spark, large):
    rows = [r for r in scattered(5, (40, 5, 12, 1, 25)) if r[3] != "O"]
    want = lines(rows, 2, lambda high: max(2.0, high * 0.7))
    cells = spark.createDataFrame(rows, ROWS).withColumnRenamed("region_id", "entity_id").repartition(3)
    got = G.cluster_table_rows(cells, large=large, band=30.0).collect()
    assert {(r.page_index, r.entity_id): r.row_index for r in got} == want
    assert {r.table_id for r in got} == {f"d-p{page}-medicine" for page in {r[1] for r in rows}}


def test_rows_of_short_pages_move_once_for_their_lines(spark):
    rows = spark.createDataFrame(scattered(7, (9, 9)), ROWS)
    assert exchanges(G.cluster_table_rows(rows.withColumnRenamed("region_id", "entity_id"))) == 1
    assert exchanges(G.reading_order(rows)) == 2  # by page for the lines, and again for the order inside them


def test_items_are_put_together_once(spark):
    rows = [("d", 0, "a", "B-QUANTITY", " ", 1.0, 10.0, 2.0, 20.0), ("d", 0, "b", "B-MEDICINE_NAME", "x", 3.0, 50.0, 4.0, 60.0),
            ("d", 0, "c", "B-MEDICINE_NAME", "y", 2.0, 50.0, 4.0, 60.0), ("d", 0, "e", "B-QUANTITY", "7", 2.0, 51.0, 4.0, 60.0)]
    cells = G.cluster_table_rows(spark.createDataFrame(rows, ROWS).withColumnRenamed("region_id", "entity_id"))
    items = A.reconstruct_items(cells)
    assert "ArrowEvalPython" not in items._jdf.queryExecution().executedPlan().toString()
    got = [(r.line_number, r.medicine_name, None if r.quantity is None else int(r.quantity)) for r in items.orderBy("line_number").collect()]
    assert got == [(1, None, None), (2, "y x", 7)]


def test_groups_are_split_by_size(spark):
    rows = spark.createDataFrame([("a", k) for k in range(5)] + [("b", 0), (None, 1)], "g string, k int")
    usual, long = split_groups(rows, ["g"], 4)
    assert {r.g for r in usual.collect()} == {"b"} and long.count() == 5 and {r.g for r in long.collect()} == {"a"}
    usual, long = split_groups(rows, ["g"])
    assert long is None and usual.agg(F.count("*")).first()[0] == 6
