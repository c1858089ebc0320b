"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard draws a number from the record's key and its own name; the best draw owns the record.
A further shard only takes the records for which it draws best, all others stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.llm.common import keep_columns, own, private, public

#: Rows of one numbering window, on average.
CHUNK_ROWS = 50_000
_DRAW_BITS = 52


def draws(key: Column, weights: tuple[float, ...]) -> Column:
    """(cost, shard) of every shard: minus the logarithm of a uniform draw, over the shard's weight."""
    def cost(shard: Column) -> Column:
        digest = F.md5(F.concat(key, F.lit(":"), shard.cast("string")))
        uniform = (F.conv(F.substring(digest, 1, _DRAW_BITS // 4), 16, 10).cast("double") + 0.5) / float(1 << _DRAW_BITS)
        return -F.log(uniform) / F.element_at(F.array(*(F.lit(float(w)) for w in weights)), shard + 1)

    shards = F.sequence(F.lit(0), F.lit(len(weights) - 1))
    return F.transform(shards, lambda shard: F.struct(cost(shard).alias("cost"), shard.alias("shard")))


def assign_shards(docs: DataFrame, *, shards: int = 40, doc_id: str = "doc_id", weights: tuple[float, ...] | None = None) -> DataFrame:
    """``docs`` with shard and grown_shard (the shard if one more of weight 1 were added).

    Only the id and the shards decide; rows without id share one shard, repeated ids too. Columns
    named like these two are replaced, all others stay, whatever they are called.
    """
    names = keep_columns(docs, {"shard", "grown_shard"})
    all_weights = (*(weights or (1.0,) * shards), 1.0)
    key = F.coalesce(F.col(f"`{own(doc_id)}`").cast("string"), F.lit(""))
    drawn = (
        private(docs).withColumn("_draws", draws(key, all_weights))
        .withColumn("shard", F.array_min(F.slice("_draws", 1, shards))["shard"])
        .withColumn("grown_shard", F.array_min("_draws")["shard"])
    )
    return public(drawn, names, ("shard", "grown_shard"))


def shard_documents(docs: DataFrame, *, shards: int = 40, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Slots count from 0 without gaps, in the order of a hash of id and text. A shard is numbered in
    hash chunks whose offsets come from their counts; rows equal in id and text are counted first
    and spread again, so neither a large shard nor a repeated row is one task's work. Null and empty
    texts have 16 bytes and checksum 0; an empty table gives no rows.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    label = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(value) + 16).cast("bigint").alias("size"),
        F.crc32(value).alias("text_crc32"), F.md5(F.concat(label, F.lit(":"), F.md5(value))).alias("_place"),
    )
    digits, total = 1, docs.count()
    while total > CHUNK_ROWS * shards * 16**digits and digits < 8:
        digits += 1
    counted = rows.groupBy("doc_id", "size", "text_crc32", "_place").agg(F.count(F.lit(1)).alias("_n"))
    placed = assign_shards(counted, shards=shards).withColumn("_chunk", F.substring("_place", 1, digits))
    inside = Window.partitionBy("shard", "_chunk").orderBy("_place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "_chunk").agg(F.sum("_n").alias("_size")).select(
        "shard", "_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    numbered = placed.withColumn("_rank", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(offsets, ["shard", "_chunk"])
    return numbered.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_offset") + F.col("_rank") + F.col("_k")).cast("bigint").alias("slot"), "grown_shard",
    )
