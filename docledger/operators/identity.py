"""Document identity, content hashes and drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.text import casefold


def document_id(relative_path: Column, sha256: Column) -> Column:
    """Same bytes under another path are another document; letter case of the path is ignored."""
    return F.sha2(F.concat(casefold(relative_path), F.char(F.lit(0)), sha256), 256)


def canonical_json(columns: Sequence[str]) -> Column:
    """Compact JSON with sorted keys and nulls kept."""
    ordered = F.struct(*[F.col(name) for name in sorted(columns)])
    return F.to_json(ordered, {"ignoreNullFields": "false"})


def canonical_json_hash(columns: Sequence[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


#: Hex digits of a row hash that name its leaf; each level above drops two, so a node has up to 256 children.
LEAF_DIGITS = 8


def manifest_hash(files: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number and hash of a list of files, as a tree of digests of fixed depth.

    Rows are hashed and repeated ones counted. A leaf digests the rows whose hashes share their first
    eight digits, in the order of the hashes; the nodes above digest up to 256 children each, down to
    the root. The depth, not the size of the list or the number of tasks, fixes the result, and the
    three lowest levels share one partitioning. An empty list has the hash of the empty text.
    """
    counted = files.select(canonical_json_hash(columns).alias("_hash")).groupBy("_hash").agg(F.count(F.lit(1)).alias("_files"))
    level = counted.select(
        F.col("_hash").alias("_node"), F.concat_ws(":", "_hash", "_files").alias("_digest"), "_files",
        F.substring("_hash", 1, LEAF_DIGITS - 4).alias("_place"),
    ).repartition("_place")

    def folded(children: DataFrame, digits: int, *together: str) -> DataFrame:
        return children.withColumn("_above", F.substring("_node", 1, digits)).groupBy(*together, "_above").agg(
            F.sum("_files").alias("_files"), F.sha2(F.expr("listagg(_digest, ',') within group (order by _node)"), 256).alias("_digest"),
        ).withColumnRenamed("_above", "_node")

    for digits in (LEAF_DIGITS, LEAF_DIGITS - 2, LEAF_DIGITS - 4):
        level = folded(level, digits, "_place")
    for digits in range(LEAF_DIGITS - 6, 0, -2):
        level = folded(level, digits)
    return level.agg(
        F.coalesce(F.sum("_files"), F.lit(0)).alias("files"),
        F.sha2(F.coalesce(F.expr("listagg(_digest, ',') within group (order by _node)"), F.lit("")), 256).alias("manifest_hash"),
    )


def tree_files(
    files: DataFrame, path: str, suffix: str | None = None, exclude_prefixes: Sequence[str] = ()
) -> DataFrame:
    """Files of a tree with one suffix, without the excluded folders."""
    kept = files
    if suffix is not None:
        kept = kept.where(F.lower(F.col(path)).endswith(suffix.lower()))
    for prefix in exclude_prefixes:
        kept = kept.where((F.col(path) != prefix) & ~F.col(path).startswith(f"{prefix}/"))
    return kept


def detect_drift(locked: DataFrame, current: DataFrame, key: str, hashes: Sequence[str]) -> DataFrame:
    """Every document as added, removed, changed or same, with one flag per hash column."""
    before = locked.select(key, *[F.col(name).alias(f"_locked_{name}") for name in hashes], F.lit(True).alias("_was"))
    after = current.select(key, *[F.col(name).alias(f"_current_{name}") for name in hashes], F.lit(True).alias("_is"))
    joined = before.join(after, key, "full_outer")
    changed = {name: ~F.col(f"_locked_{name}").eqNullSafe(F.col(f"_current_{name}")) for name in hashes}
    both = F.col("_was") & F.col("_is")
    any_change = F.lit(False)
    for condition in changed.values():
        any_change = any_change | condition
    state = (
        F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed")
        .when(any_change, "changed").otherwise("same")
    )
    return joined.select(
        key, state.alias("state"),
        *[(F.coalesce(both, F.lit(False)) & condition).alias(f"{name}_changed") for name, condition in changed.items()],
    )
