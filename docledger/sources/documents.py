"""Source documents, ground-truth files and report sinks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.functions.json import is_object, parse_record
from docledger.labels import DOCUMENT_SUFFIXES
from docledger.operators.identity import document_id


def _relative(path: Column, root: str) -> Column:
    """Path below ``root``; file paths come back with a scheme."""
    tail = root.rstrip("/") + "/"
    bare = F.regexp_replace(path, r"^[a-z0-9]+:/*", "/")
    return F.url_decode(F.replace(F.substring(bare, F.instr(bare, tail) + F.lit(len(tail)), F.lit(2147483647)), F.lit("+"), F.lit("%2B")))


def discover_documents(spark: SparkSession, root: str, *, suffixes: Sequence[str] = DOCUMENT_SUFFIXES, require: bool = True) -> DataFrame:
    """Recursive scan: id, relative path, media type, content hash and size.

    The hash is computed beside the read, so file contents never reach a shuffle.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kept = files.where(suffix.isin(*suffixes))
    if require and kept.select("path").isEmpty():
        raise FileNotFoundError(f"no documents found under {root}")
    named = kept.select(
        _relative(F.col("path"), root).alias("relative_path"), F.when(suffix == "pdf", "pdf").otherwise("image").alias("media_type"),
        F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    return named.withColumn("document_id", document_id(F.col("relative_path"), F.col("sha256")))


def read_ground_truth_final(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(records keyed by relative path, files whose content is not one JSON object)."""
    files = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(root).select(
        _relative(F.col("_metadata.file_path"), root).alias("gt_path"), F.col("value").alias("payload"), F.sha2("value", 256).alias("gt_sha256"))
    sound = is_object(parse_record(F.trim(F.regexp_replace("payload", r"\s+$", ""))))
    return files.where(sound), files.where(~sound).select("gt_path", F.lit("expected JSON object").alias("reason"))


def write_report_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Header CSV in the given order, or sorted columns."""
    df.select(*(columns or sorted(df.columns))).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def union_reports(reports: Sequence[DataFrame]) -> DataFrame:
    """Rows of all reports over the sorted union of their columns."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)
    return merged.select(*sorted(merged.columns))
