"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.llm import oracles
from docledger.llm.common import table
from docledger.llm.decontaminate import find_contamination
from docledger.llm.extract import extract_text
from docledger.llm.manifest import lowered_where_chosen, manifest, verify
from docledger.llm.mixing import mix_sources
from docledger.llm.pii import find_personal_data
from docledger.llm.quality_model import fit_quality, held_out, score_quality
from docledger.llm.quality_rules import COUNTS, apply_rules
from docledger.llm.sharding import shard_documents
from docledger.llm.simhash import near_duplicates
from docledger.llm.toxicity import fit_toxicity, score_toxicity
from docledger.llm.toxicity import held_out as toxicity_held_out
from docledger.llm.urls import fit_urls, host_of, judge_urls, label_url, path_of
from docledger.llm.warc import archive, audit, damaged_copy, file_count
from docledger.llm.whitening import whiten


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    files = file_count(pages)
    return audit(archive(pages, files), archive(damaged_copy(pages), files))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = fit_urls(pages.select("url", label_url(host_of(F.col("url")), path_of(F.col("url"))).alias("label")))
    return judge_urls(pages, model).select("page_id", "host", "path", "rule", "verdict", "score")


def op7_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, forest)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op10_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return verify(manifest(docs, claims={"text": lowered_where_chosen(F.col("doc_id"), F.col("text"))}))


def op13_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    query.__name__: query
    for query in (
        op1_quality_rules, op2_merkle_fixity, op3_simhash_near_dedup, op4_mix_sources, op5_extract_text, op6_url_filter,
        op7_quality_score, op8_decontaminate, op9_personal_data, op10_rendezvous_shards,
        op11_toxicity, op12_merkle_manifest, op13_whiten_embeddings,
    )
}

ORACLES = {
    "op1_quality_rules": oracles.QUALITY_RULES,
    "op2_merkle_fixity": oracles.MERKLE_FIXITY,
    "op4_mix_sources": oracles.MIX_SOURCES,
    "op8_decontaminate": oracles.DECONTAMINATE,
    "op10_rendezvous_shards": oracles.SHARDS,
    "op12_merkle_manifest": oracles.MERKLE_MANIFEST,
}
