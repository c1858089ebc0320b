"""Derived inputs and record parsing: long rows stay compilable, long documents linear, each record is parsed once."""

import re

import pytest
from pyspark.sql import functions as F

from docledger.functions.json import parse_record
from docledger.operators.flatten import gt_fields
from docledger.sources.stages import explode_regions, explode_tokens
from docledger.workload.fixtures import fixture
from docledger.workload.q_geometry import annotations

SF = "/root/testdata/sf0.001"


def _longest_method(spark, df):
    """Bytes of the longest generated method; the JVM interprets methods beyond 8000."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark._jvm.PythonSQLUtils.explainString(df.select("*")._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text))


@pytest.mark.parametrize("name", ["fx_ent", "fx_gt", "fx_regions"])
def test_unpivoted_rows_are_compiled(spark, name):
    assert _longest_method(spark, fixture(spark, SF, name)) < 8000


def test_labelled_values_are_compiled_and_parsed_once(spark):
    payload = ('{"invoices":[{"page_number":2,"invoice":{"invoice_number":" A1 ","invoice_date":null},"items":[{"medicine_name":"x","quantity":1.5},null]},'
               '{"items":[]}]}')
    records = spark.createDataFrame([("d", payload), ("n", None), ("bad", payload + "x"), ("s", '{"field":"invoice_number","text":"B2","page":3}')],
                                    "document_id string, payload string")
    found = gt_fields(records)
    rows = {(r.document_id, r.page_index, r.item_index, r.field_path, r.gt_value) for r in found.collect()}
    assert rows == {
        ("d", 1, None, "invoices[0].invoice.invoice_number", "A1"), ("d", 1, 0, "invoices[0].items[0].medicine_name", "x"),
        ("d", 1, 0, "invoices[0].items[0].quantity", "1.5"), ("s", 2, None, "invoice_number", "B2")}
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert "parseJson" in plan and not [line for line in plan.split("\n") if "Filter" in line and "parseJson" in line]
    assert records.select(F.to_json(parse_record(F.lit("[1] 2"))).alias("v")).first().v is None


def test_long_documents_are_cut_without_slices(spark, tmp_path):
    text = " " + " ".join(f"w{k}" for k in range(1000)) + "\n\t"
    spark.createDataFrame([(4, text), (5, text), (6, " \n"), (7, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    nested = annotations(spark, str(tmp_path))
    assert "slice(" not in spark._jvm.PythonSQLUtils.explainString(nested._jdf.queryExecution(), "simple")
    regions, tokens = explode_regions(nested), explode_tokens(nested)
    got = {(r.document_id, r.page_index, r.position): r.text for r in regions.collect()}
    assert {k: v for k, v in got.items() if k[0] == "4"} == {("4", k // 480, k % 480): f"w{k}" for k in range(1000)}
    assert {k: v for k, v in got.items() if k[0] == "5"} == {("5", 0 if k < 100 else k // 480, k): f"w{k}" for k in range(1000)}
    assert len(got) == 2000 and tokens.count() == 1000
    plan = spark._jvm.PythonSQLUtils.explainString(tokens._jdf.queryExecution(), "simple")
    assert not [line for line in plan.split("\n") if "Filter" in line and "transform(" in line]
