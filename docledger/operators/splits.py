"""Hash splits, locked splits and leakage guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.ordinals import number_rows
from docledger.operators.identity import canonical_json_hash, manifest_hash

FULL_RANGE = 18446744073709551615  # 2^64 - 1


def hash_split(document_id: Column, seed: int, train: float = 0.8, validation: float = 0.1) -> Column:
    """Split name from the first 64 bits of a seeded digest; needs no sort and no count."""
    if train <= 0 or validation < 0 or train + validation >= 1:
        raise ValueError("train needs a share above 0, and train and validation together one below 1")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), document_id), 256)
    value = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")

    def below(ratio: float) -> Column:
        return value < F.lit(str(int(ratio * FULL_RANGE))).cast("decimal(20,0)")

    return F.when(below(train), "train").when(below(train + validation), "validation").otherwise("test")


def locked_split(documents: DataFrame, seed: int) -> DataFrame:
    """Exact 80/10/10 split by digest order: train first, then validation, then test.

    The global rank is a two-level rank over digest prefixes (4096 of them), so no task sorts the
    whole list.
    """
    digested = documents.select("document_id").distinct().withColumn("seed", F.lit(seed)).withColumn(
        "_digest", canonical_json_hash(["document_id", "seed"])).withColumn("_prefix", F.substring("_digest", 1, 3))
    ranked = number_rows(digested, [], "_prefix", [F.col("_digest"), F.col("document_id")], "position")
    total = digested.agg(F.count(F.lit(1)).alias("_n"))
    share = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(0.1), 0).cast("bigint"))
    small = F.col("_n") - 2 * share < 1
    held = F.when(small, F.lit(1)).otherwise(share)
    train_end = F.when(F.col("_n") <= 2, F.least(F.col("_n"), F.lit(1))).otherwise(F.col("_n") - 2 * held)
    validation_end = F.when(F.col("_n") <= 2, train_end).otherwise(F.col("_n") - held)
    return ranked.join(F.broadcast(total)).select(
        "document_id", "position",
        F.when(F.col("position") <= train_end, "train").when(F.col("position") <= validation_end, "validation").otherwise("test").alias("split"))


def split_integrity(assignments: DataFrame, documents: DataFrame) -> DataFrame:
    """Violations: documents in several splits, missing from the split, or unknown to the data."""
    shared = assignments.groupBy("document_id").agg(F.count_distinct("split").alias("_n")).where("_n > 1").select(
        "document_id", F.lit("in_several_splits").alias("violation"))
    known = documents.select("document_id").distinct()
    missing = known.join(assignments, "document_id", "left_anti").select("document_id", F.lit("not_assigned").alias("violation"))
    foreign = assignments.select("document_id").distinct().join(known, "document_id", "left_anti").select("document_id", F.lit("unknown_document").alias("violation"))
    return shared.unionByName(missing).unionByName(foreign)


def partition_annotations(annotations: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train and validation rows, rows that leak test documents, train/validation documents without annotation)."""
    joined = annotations.join(assignments.select("document_id", "split"), "document_id")
    usable = joined.where("split in ('train', 'validation')")
    leaks = joined.where("split = 'test'").select("document_id").distinct()
    missing = assignments.where("split in ('train', 'validation')").join(annotations, "document_id", "left_anti").select("document_id", "split")
    return usable, leaks, missing


def locked_manifest(documents: DataFrame, files: DataFrame, seed: int) -> DataFrame:
    """One row: seed, sizes, data hash, annotation hash, assignment hash and a hash over all of them."""
    from docledger.operators.identity import tree_files

    split = locked_split(documents, seed)
    sizes = split.agg(*[F.count_if(F.col("split") == name).alias(f"{name}_documents") for name in ("train", "validation", "test")])
    data = manifest_hash(documents, ["document_id", "relative_path", "sha256"]).select(F.col("manifest_hash").alias("dataset_manifest_hash"))
    truth = manifest_hash(tree_files(files, "gt_path", ".json", ["splits"]), ["gt_path", "gt_sha256"]).select(F.col("manifest_hash").alias("gt_manifest_hash"))
    assigned = manifest_hash(split, ["document_id", "split"]).select(F.col("manifest_hash").alias("assignment_hash"))
    row = sizes.join(F.broadcast(data)).join(F.broadcast(truth)).join(F.broadcast(assigned)).withColumn("random_seed", F.lit(seed))
    return row.withColumn("split_manifest_hash", canonical_json_hash(row.columns))


def verify_manifest(manifest: DataFrame) -> DataFrame:
    """Manifests whose stored self-hash does not match their content."""
    content = [name for name in manifest.columns if name != "split_manifest_hash"]
    return manifest.where(canonical_json_hash(content) != F.col("split_manifest_hash"))
