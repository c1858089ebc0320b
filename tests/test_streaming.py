"""Streams deliver once and rework only what changed; digests do not depend on tasks."""

import json

import pytest
from pyspark.sql import functions as F

from docledger.operators.identity import manifest_hash
from docledger.streaming import incremental as I


def deliver(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(row) for row in rows))


def test_repeats_are_delivered_once_however_late(spark, tmp_path):
    batches = (
        [{"document_id": "a", "n": 1}, {"document_id": "a", "n": 1}, {"n": 9}], [{"document_id": "b", "n": 2}], [],
        [{"document_id": "a", "n": 1}, {"n": 9}, {"document_id": "c", "n": 3}],
    )
    for number, rows in enumerate(batches):
        deliver(tmp_path / "in", f"f{number}", rows)
        I.ingest_incremental(spark, f"{tmp_path}/in", "document_id string, n bigint", f"{tmp_path}/out", f"{tmp_path}/state", buckets=4).awaitTermination()
    got = I.ingested(spark, f"{tmp_path}/out")
    assert got.columns == ["document_id", "n"]
    assert sorted((row.document_id or "", row.n) for row in got.collect()) == [("", 9), ("a", 1), ("b", 2), ("c", 3)]


def test_only_changed_documents_are_written_again(spark, tmp_path):
    from docledger.workload.q_assemble import entities

    schema = entities(spark, "/root/testdata/sf0.001").schema
    sample = [json.loads(row) for row in entities(spark, "/root/testdata/sf0.001").limit(4000).toJSON().collect()]
    by_document = {}
    for row in sample:
        by_document.setdefault(row["document_id"], []).append(row)
    first, second, *_ = sorted(by_document, key=lambda d: -len(by_document[d]))
    late = by_document[first][-1]
    deliver(tmp_path / "in", "f0", [row for row in by_document[first] + by_document[second] if row is not late])
    run = lambda: I.postprocess_incremental(
        spark, f"{tmp_path}/in", schema, f"{tmp_path}/store", f"{tmp_path}/out", f"{tmp_path}/state", buckets=1).awaitTermination()
    run()
    deliver(tmp_path / "in", "f1", [late])
    run()
    versions = spark.read.parquet(f"{tmp_path}/out/pages").groupBy("_batch").agg(F.collect_set("document_id").alias("ids"))
    assert {row._batch: set(row.ids) for row in versions.collect()} == {0: {first, second}, 1: {first}}
    pages = I.latest(spark, f"{tmp_path}/out")
    assert pages.groupBy("document_id", "page_index").count().where("count > 1").isEmpty()
    whole = I.postprocess(spark.read.schema(schema).json(f"{tmp_path}/in"))
    for name, expected in zip(("pages", "items"), whole, strict=True):
        got = I.latest(spark, f"{tmp_path}/out", name)
        columns = [c for c in expected.columns if c in got.columns]
        assert sorted(got.select(columns).toJSON().collect()) == sorted(expected.select(columns).toJSON().collect())


def test_the_digest_needs_no_order_and_no_task_count(spark):
    rows = spark.range(3000).selectExpr("cast(id % 1000 as string) as path", "if(id % 3 = 0, 'x', null) as sha")
    hot = rows.unionByName(spark.range(2000).selectExpr("'same' as path", "'copy' as sha"))
    got = {manifest_hash(part, ["path", "sha"]).first() for part in (hot.repartition(1), hot.repartition(13), hot.orderBy(F.desc("path")))}
    assert len(got) == 1 and next(iter(got)).files == 5000
    assert manifest_hash(hot.where("path <> '7'"), ["path", "sha"]).first().manifest_hash != next(iter(got)).manifest_hash
    assert manifest_hash(rows.where("false"), ["path", "sha"]).first()[0] == 0


@pytest.mark.parametrize("moved", [1, 2])
def test_a_repeated_row_counts(spark, moved):
    rows = spark.createDataFrame([("a", "1")] * moved + [("b", "2")], "path string, sha string")
    assert (manifest_hash(rows, ["path", "sha"]).first().manifest_hash == manifest_hash(rows.distinct(), ["path", "sha"]).first().manifest_hash) == (moved == 1)
