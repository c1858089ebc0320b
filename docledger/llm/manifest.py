"""Merkle manifest of a dataset, with an inclusion proof of every row.

The rows of a source are the leaves of one tree, the trees' roots are the leaves of one more. On
every level a window over the runs of sixteen neighbours gives each node its siblings as lag and
lead columns of fixed offset, masked by the node's slot and its run's length; the first node of a
run hashes the run into the parent. Siblings then travel from the root down: a node's path is its
own siblings and its parent's path, joined by run, so that only the rows themselves ever hold a
whole proof and nothing is gathered per source.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.session import cut_lineage

FANOUT = 16
#: What a leaf is the hash of, in this order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def written(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(written(value) for value in values)), 256)


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, pos, n, hash, ...) with ``run``, ``before`` and ``after``: the siblings' hashes on either side, joined.

    ``n`` is the number of nodes of the tree on this level. A window holds one run, so a tree of any
    size spreads over its runs, and the rows leave partitioned by (tree, run).
    """
    slot = F.col("pos") % FANOUT
    length = F.least(F.lit(FANOUT).cast("bigint"), F.col("n") - F.col("run") * FANOUT)
    order = Window.partitionBy("tree", "run").orderBy("pos")
    steps = range(1, FANOUT)
    lags = {f"_lag{k}": F.when(slot >= k, F.lag("hash", k).over(order)) for k in steps}
    leads = {f"_lead{k}": F.when(slot + k < length, F.lead("hash", k).over(order)) for k in steps}
    placed = nodes.withColumn("run", F.expr(f"pos div {FANOUT}")).withColumns({**lags, **leads})
    return placed.withColumns({
        "before": F.concat_ws("", *(f"_lag{k}" for k in reversed(steps))),
        "after": F.concat_ws("", *(f"_lead{k}" for k in steps)),
    }).drop(*lags, *leads)


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: the first node of every run hashes the run. Trees of one node are finished and have none."""
    first = with_siblings(nodes.where("n > 1").select("tree", "pos", "n", "hash")).where(F.col("pos") % FANOUT == 0)
    return first.select(
        "tree", F.col("run").alias("pos"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"),
        F.sha2(F.concat("hash", "after"), 256).alias("hash"),
    )


def grow(leaves: DataFrame) -> list[DataFrame]:
    """All levels of the trees, the leaves first; a level is kept in the shared folder."""
    levels = [leaves]
    while levels[-1].where("n > 1").limit(1).count():
        levels.append(cut_lineage(parents(levels[-1])))
    return levels


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with ``path``: (before, after) of every level from the leaf's own to the root.

    ``tops`` holds, by tree, the path above the tree's single last node and whatever else each of its
    leaves shall carry; it is handed down from parent to child, never joined to all rows by tree.
    """
    carried = [name for name in tops.columns if name not in ("tree", "path")]
    paths = None
    for number, level in reversed(list(enumerate(levels))):
        names = [*level.columns, *carried, "path"]
        found = level.where("n = 1").join(tops, "tree").select(*names)
        if paths is not None:
            above = paths.select("tree", F.col("pos").alias("run"), *carried, F.col("path").alias("_above"))
            own = F.array(F.struct("before", "after"))
            inner = with_siblings(level.where("n > 1")).join(above, ["tree", "run"]).withColumn("path", F.concat(own, F.col("_above")))
            found = inner.select(*names).unionByName(found)
        paths = cut_lineage(found) if number else found
    return paths


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to along ``path``."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_hash(path: Column) -> Column:
    """Hash of all siblings, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def place(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Leaves with ``pos`` (from 0, along ``order``) and ``n`` inside their tree.

    Equal leaves are counted first. The rest is cut into ranges of (tree, order), kept, and numbered
    inside a range; the ranges' counts give the offsets. So neither a large tree nor a repeated row
    is one task's work.
    """
    counted = leaves.groupBy(*leaves.columns).agg(F.count(F.lit(1)).alias("_copies"))
    ranged = cut_lineage(counted.repartitionByRange("tree", *order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("tree", "_range").agg(F.sum("_copies").alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .withColumn("n", F.sum("_size").over(Window.partitionBy("tree"))).drop("_size")
    )
    inside = Window.partitionBy("tree", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("_before", F.coalesce(F.sum("_copies").over(inside), F.lit(0))).join(offsets, ["tree", "_range"])
    first = F.col("_offset") + F.col("_before")
    return ranked.withColumn("pos", F.explode(F.sequence(first, first + F.col("_copies") - 1))).select(*leaves.columns, "pos", "n")


def manifest(
    docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", columns: Sequence[str] = LEAF, claims: dict[str, Column] | None = None,
) -> DataFrame:
    """doc_id, source, leaf, claim, subroot, root, path: one row per row of ``docs``.

    Leaves of a source follow each other by doc_id, null ids first, rows of one id by their hash.
    Sources follow each other null first, then by their UTF-8 bytes. ``claim`` is the leaf of the row
    with the values of ``claims`` in place of its own. An empty table gives no rows; a lone leaf is
    its source's root. Other columns neither matter nor clash.
    """
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col(source)), F.lit("0")).alias("tree"), F.col(doc_id).alias("doc_id"),
        leaf_hash([F.col(name) for name in columns]).alias("hash"),
        leaf_hash([(claims or {}).get(name, F.col(name)) for name in columns]).alias("claim"),
    )
    levels = grow(cut_lineage(place(leaves, ["doc_id", "hash", "claim"])))
    subroots = functools.reduce(DataFrame.unionByName, (level.where("n = 1").select("tree", "hash") for level in levels))
    crown = grow(cut_lineage(place(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "hash"), ["source"])))
    root = crown[-1].where("n = 1").select("tree", F.col("hash").alias("root"), F.expr(f"cast(array() as {PATH})").alias("path"))
    tops = descend(crown, root).select(F.col("source").alias("tree"), F.col("hash").alias("subroot"), "root", "path")
    return descend(levels, cut_lineage(tops)).select(
        "doc_id", F.expr("case when tree <> '0' then substring(tree, 2) end").alias("source"), F.col("hash").alias("leaf"), "claim",
        "subroot", "root", "path",
    )


def lowered_where_chosen(doc_id: Column, text: Column) -> Column:
    """The tampered text: A-Z lower-cased where 5 divides the crc32 of the decimal id, else the text itself."""
    upper, lower = ("".join(map(chr, range(start, start + 26))) for start in (65, 97))
    chosen = F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
    return F.when(chosen, F.translate(text, upper, lower)).otherwise(text)


def verify(proved: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for the rows of :func:`manifest`."""
    folded = proved.withColumn("folded_root", fold(F.col("claim"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
