"""Merkle fixity audit of web archives.

Pages become archive records at fixed offsets of files. Each record is hashed, and every sixteen
neighbouring nodes of a level are hashed into one above, up to a root per file, so a node vouches
for an ordered offset range. Two replicas are compared at their roots; only below branches that
differ are the next level's nodes looked at, down to the records that are changed, missing or extra.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.session import cut_lineage

FANOUT = 16
#: Every tree has at least so many levels above the records, so that small replicas agree in height.
LEAST_HEIGHT = 3
#: Records of one file, on average.
FILE_RECORDS = 256
#: Records of one id and address that one task numbers, on average.
CHUNK_ROWS = 50_000


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The archive record of a page; nulls are written as empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def file_of(page_id: Column, url: Column, files: int) -> Column:
    """The file a record belongs to: a hash of its id and address, the same in every replica."""
    key = F.concat(F.coalesce(page_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(url, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % files


def file_count(pages: DataFrame) -> int:
    return max(1, -(-pages.count() // FILE_RECORDS))


def archive(pages: DataFrame, files: int) -> DataFrame:
    """file, ordinal, offset, length, copies, page_id, url, digest: one row per different record.

    Records of a file lie in the order of id (nulls first), address and digest. Equal records are
    counted, not kept apart, and lie next to each other: ``offset`` is where the first begins,
    ``length`` the bytes of one. A file holds some hundred records whatever the size of the crawl,
    and more only if many different ones share an id and address; those are numbered in chunks of
    the digest, whose offsets come from their counts.
    """
    body = record(F.col("page_id"), F.col("url"), F.col("html"))
    hashed = pages.select(
        file_of(F.col("page_id"), F.col("url"), files).alias("file"), "page_id", "url",
        F.octet_length(body).cast("bigint").alias("length"), F.sha2(body, 256).alias("digest"),
    )
    counted = cut_lineage(hashed.groupBy("file", "page_id", "url", "length", "digest").agg(F.count(F.lit(1)).alias("copies")))
    digits, total = 1, counted.count()
    while total > CHUNK_ROWS * 16**digits and digits < 8:
        digits += 1
    chunk = ["file", "page_id", "url", "_chunk"]
    chunked = counted.withColumn("_chunk", F.substring("digest", 1, digits)).withColumn("_bytes", F.col("length") * F.col("copies"))
    earlier = Window.partitionBy("file").orderBy(*chunk[1:]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunked.groupBy(*chunk).agg(F.count(F.lit(1)).alias("_n"), F.sum("_bytes").alias("_size")).select(
        *(F.col(name).alias(f"_of_{name}") for name in chunk),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rank"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"),
    )
    order = Window.partitionBy(*chunk).orderBy("digest")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = chunked.withColumn("_row", F.row_number().over(order) - 1).withColumn(
        "_before", F.coalesce(F.sum("_bytes").over(before), F.lit(0))
    )
    same = functools.reduce(operator.and_, (F.col(name).eqNullSafe(F.col(f"_of_{name}")) for name in chunk))
    return numbered.join(offsets, same).select(
        "file", (F.col("_rank") + F.col("_row")).cast("bigint").alias("ordinal"), (F.col("_offset") + F.col("_before")).alias("offset"),
        "length", "copies", "page_id", "url", "digest",
    )


def tree(records: DataFrame) -> DataFrame:
    """file, level, node, hash, first_byte, last_byte: level 0 are the records, the top level one root per file."""
    leaf = F.sha2(F.concat("digest", F.lit(":"), F.col("copies").cast("string")), 256)
    level = cut_lineage(records.select(
        "file", F.lit(0).alias("level"), F.col("ordinal").alias("node"), leaf.alias("hash"),
        F.col("offset").alias("first_byte"), (F.col("offset") + F.col("length") * F.col("copies")).alias("last_byte"),
    ))
    widest = (level.agg(F.max("node")).first()[0] or 0) + 1
    whole, height = level, 0
    while height < LEAST_HEIGHT or widest > 1:
        height, widest = height + 1, -(-widest // FANOUT)
        children = F.sort_array(F.collect_list(F.struct("node", "hash")))  # sixteen at most
        level = (
            level.groupBy("file", F.expr(f"node div {FANOUT}").alias("parent"))
            .agg(children.alias("below"), F.min("first_byte").alias("first_byte"), F.max("last_byte").alias("last_byte"))
            .select(
                "file", F.lit(height).alias("level"), F.col("parent").alias("node"),
                F.sha2(F.array_join(F.col("below.hash"), ""), 256).alias("hash"), "first_byte", "last_byte",
            )
        )
        whole = whole.union(level)
    return whole


def mismatches(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """file, level, node, hash, other_hash of every differing node, found from the roots down.

    Trees of unequal height are compared from the lower root on; a side's missing node is null.
    """
    ours, theirs = cut_lineage(ours), cut_lineage(theirs)
    top = min(side.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0] for side in (ours, theirs))
    branches = found = None
    for level in range(top, -1, -1):
        sides = []
        for side, name in ((ours, "hash"), (theirs, "other_hash")):
            nodes = side.where(F.col("level") == level).select("file", "node", F.col("hash").alias(name))
            if branches is not None:
                below = branches.select("file", F.col("node").alias("_parent"))
                nodes = nodes.withColumn("_parent", F.expr(f"node div {FANOUT}")).join(below, ["file", "_parent"], "left_semi").drop("_parent")
            sides.append(nodes)
        differ = sides[0].join(sides[1], ["file", "node"], "full").where(~F.col("hash").eqNullSafe(F.col("other_hash")))
        branches = cut_lineage(differ.select("file", F.lit(level).alias("level"), "node", "hash", "other_hash"))
        found = branches if found is None else found.union(branches)
    return found


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Verdicts on two archives (see :func:`archive`): a row per file, and one per damaged record.

    ``kind`` is ``file`` or ``record``. A file's ``status`` is intact, damaged, missing or extra, with
    both roots in hash and other_hash and its bytes in our archive. A record's status is changed,
    missing (only ours has it, or has it more often) or extra, with both digests and the place in the
    archive that has it, ours first; ``copies`` says how many are concerned. Records are matched by
    id, address and digest below the differing branches only, and every digest whose counts differ
    has a row. Where one digest of an id and address is left on each side, equally often, the two
    are one changed record. Empty archives give no rows.
    """
    ours, theirs = cut_lineage(ours), cut_lineage(theirs)
    our_tree, their_tree = tree(ours), tree(theirs)
    differing = cut_lineage(mismatches(our_tree, their_tree))

    def roots(nodes: DataFrame, name: str) -> DataFrame:
        return nodes.groupBy("file").agg(
            F.max_by("hash", "level").alias(name), F.max("last_byte").alias(f"{name}_bytes")
        )

    status = (
        F.when(F.col("other_hash").isNull(), "missing").when(F.col("hash").isNull(), "extra")
        .when(F.col("damaged"), "damaged").otherwise("intact")
    )
    damaged = differing.select("file").distinct().withColumn("damaged", F.lit(True))
    files = (
        roots(our_tree, "hash").join(roots(their_tree, "other_hash"), "file", "full").join(damaged, "file", "left")
        .select(
            F.lit("file").alias("kind"), "file", status.alias("status"), F.lit(None).cast("bigint").alias("page_id"),
            F.lit(None).cast("string").alias("url"), F.lit(0).cast("bigint").alias("offset"),
            F.coalesce("hash_bytes", "other_hash_bytes").alias("length"), "hash", "other_hash",
            F.lit(None).cast("bigint").alias("copies"),
        )
    )
    leaves = differing.where("level = 0").select("file", F.col("node").alias("ordinal"))
    marked = [
        side.join(leaves, ["file", "ordinal"], "left_semi").select(
            F.lit(number).alias("side"), "file", "page_id", "url", "digest", "copies", "offset", "length"
        )
        for number, side in enumerate((ours, theirs))
    ]
    uneven = cut_lineage(
        marked[0].union(marked[1]).groupBy("file", "page_id", "url", "digest")
        .agg(
            F.sum(F.when(F.col("side") == 0, F.col("copies")).otherwise(-F.col("copies"))).alias("_more"),
            F.min(F.struct("side", "offset", "length")).alias("_at"),
        )
        .where("_more <> 0")
    )
    ours_more, theirs_more = F.when(F.col("_more") > 0, F.col("digest")), F.when(F.col("_more") < 0, F.col("digest"))

    def rows(found: DataFrame, status: Column) -> DataFrame:
        return found.select(
            F.lit("record").alias("kind"), "file", status.alias("status"), "page_id", "url", F.col("_at.offset").alias("offset"),
            F.col("_at.length").alias("length"), "hash", "other_hash", F.abs("_more").alias("copies"),
        )

    changed = (
        uneven.groupBy("file", "page_id", "url")
        .agg(
            F.count(ours_more).alias("_ours"), F.count(theirs_more).alias("_theirs"), F.sum("_more").alias("_left"),
            F.max("_more").alias("_more"), F.min(ours_more).alias("hash"), F.min(theirs_more).alias("other_hash"), F.min("_at").alias("_at"),
        )
        .where("_ours = 1 and _theirs = 1 and _left = 0")
    )
    # joined by digest too, so that many rows of one id and address spread
    paired = changed.select("file", F.explode(F.array("hash", "other_hash")).alias("digest"), "page_id", "url")
    same = functools.reduce(operator.and_, (uneven[name].eqNullSafe(paired[name]) for name in ("file", "page_id", "url", "digest")))
    alone = uneven.join(paired, same, "left_anti").withColumns({"hash": ours_more, "other_hash": theirs_more})
    return files.union(rows(changed, F.lit("changed"))).union(
        rows(alone, F.when(F.col("_more") > 0, "missing").otherwise("extra"))
    )


def damaged_copy(pages: DataFrame) -> DataFrame:
    """A replica with known faults: by a digest of the address some pages have a byte more, some are lost."""
    fault = F.conv(F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 8), 16, 10).cast("bigint")
    longer = F.when(fault % 97 == 0, F.concat(F.coalesce("html", F.lit("")), F.lit("!"))).otherwise(F.col("html"))
    return pages.where(fault % 89 != 0).withColumn("html", longer)
