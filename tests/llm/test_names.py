"""Operators keep the documents' columns whatever they are called, and of whatever type."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docledger.llm.decontaminate import RESULTS, find_contamination
from docledger.llm.quality_rules import COUNTS, METRICS, apply_rules
from docledger.llm.sharding import assign_shards
from docledger.llm.simhash import drop_near_duplicates

HELPERS = (
    "_print", "_key", "_found", "_set", "_n", "_sha", "_words", "_text", "_runs", "_lines", "_stops", "_draws", "_id", "_chosen", "_row", "_windows",
    "root", "print", "a.b", "_own_text", "_own_doc_id", "size", "target", "source_size", "window", "item",
)
PROSE = "the men of the valley went to the river and they had not seen the boats for a week or so when rain began"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(1, PROSE), (2, PROSE), (3, None), (4, "other words are here and that is all")], "doc_id long, text string")
    for name in HELPERS:
        rows = rows.withColumn(name, F.concat(F.lit(f"{name}-"), F.col("doc_id")))
    rows = rows.withColumn("source", F.lit("s")).withColumn("lang", F.lit("en"))
    return rows.withColumn("tags", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("deep", F.array(F.struct(F.create_map(F.lit("k"), F.lit(1)).alias("m"))))


def kept_as_given(got, docs):
    assert got.columns[: len(docs.columns)] == docs.columns
    for row in got.collect():
        assert all(row[name] == f"{name}-{row.doc_id}" for name in HELPERS) and row.tags == {"k": row.doc_id} and row.deep[0].m == {"k": 1}


def test_names_of_helpers_are_free(spark, docs):
    benchmark = spark.createDataFrame([("i", PROSE)], "item_id string, text string")
    kept_as_given(apply_rules(docs), docs)
    kept_as_given(find_contamination(docs, benchmark), docs)
    kept_as_given(assign_shards(docs), docs)
    unique = drop_near_duplicates(docs)
    kept_as_given(unique, docs)
    assert sorted(row.doc_id for row in unique.collect()) == [1, 3, 4]


def test_stages_keep_the_columns(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns


def test_results_replace_columns_of_their_name(spark, docs):
    for name in (*COUNTS, *METRICS, *RESULTS, "kept", "base_failed", "failed_rules", "shard", "grown_shard"):
        docs = docs.withColumn(name, F.lit("mine"))
    benchmark = spark.createDataFrame([("i", PROSE)], "item_id string, text string")
    for got in (apply_rules(docs), find_contamination(docs, benchmark), assign_shards(docs)):
        assert len(got.columns) == len(set(got.columns)) == len(docs.columns)
    text = docs.select("doc_id", F.col("text").alias("n_words"))
    assert {row.n_words for row in apply_rules(text, text="n_words").collect()} == {len(PROSE.split()), 0, 8}


def test_rows_that_repeat_an_id_and_differ_in_a_map(spark):
    rows = spark.createDataFrame([(1, PROSE, {"k": n}) for n in (3, 1, 2)] + [(1, PROSE, None)] * 2, "doc_id long, text string, tags map<string,int>")
    first = [row.tags for row in drop_near_duplicates(rows).collect()]
    assert len(first) == 1 and first == [row.tags for row in drop_near_duplicates(rows.orderBy(F.desc(F.to_json("tags")))).collect()]
