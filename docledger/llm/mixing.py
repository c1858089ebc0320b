"""Mixing sources to target weights with hash-threshold histograms.

Documents get a fixed 36-bit hash. Tokens are summed by source and the hash's top 12 bits; the
running sums of at most 4096 buckets show how far a source's budget reaches. Only the bucket in
which it ends is looked at again, by the next 12 bits, twice. The result is one threshold a source:
documents below it are taken once more. A larger budget only raises the threshold, so mixes nest.
Nothing is sorted but the buckets, and documents are never moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.functions.ordinals import number_rows
from docledger.llm.common import private, public, word_count
from docledger.session import cut_lineage

WEIGHTS = (5, 2, 1)
#: Words of the mix over words of all documents, and the most often a document may be taken.
SHARE = 1.5
MOST = 2
LEVEL_BITS = 12
LEVELS = 3
#: The per-source table is broadcast up to this many bytes and joined by a shuffle beyond.
BROADCAST_BYTES = 8_000_000
_ALL = 1 << (LEVEL_BITS * LEVELS)


def document_hash(doc_id: Column, text: Column) -> Column:
    """36 bits of MD5 over the id and the text, so that rows without id still differ."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, LEVEL_BITS * LEVELS // 4), 16, 10).cast("bigint")


def sized(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    return docs.withColumn("size", word_count(F.col(text))).withColumn("_hash", document_hash(F.col(doc_id), F.col(text)))


def source_targets(
    sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """source, source_size, target from (source, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn and split ``share`` of all
    words; a target stops at ``most`` times its source, and the excess is split again among the
    others until none is above. Only three sums a round reach the driver.
    """
    chunk = F.coalesce(F.concat(F.lit("0"), F.substring(F.hex("source"), 1, 8)), F.lit("1"))
    ranked = number_rows(
        sizes.withColumn("_chunk", chunk), [], "_chunk", [F.col("source").asc_nulls_last()], "_rank"
    )
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights)).cast("int") + 1)
    weighed = cut_lineage(ranked.withColumn("_rank", F.col("_rank") - 1).select("source", "source_size", weight.alias("_weight")))
    level, capped = 0.0, -1
    while True:
        full = F.lit(float(most)) * F.col("source_size") <= F.lit(level) * F.col("_weight")
        row = weighed.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0)), F.count_if(full),
        ).first()
        if row[3] == capped or not row[2]:
            break
        capped = row[3]
        level = (share * row[0] - most * row[1]) / row[2]
    target = F.least(F.lit(float(most)) * F.col("source_size"), F.lit(level) * F.col("_weight"))
    return weighed.select("source", "source_size", target.alias("target"))


def _beside(df: DataFrame, per_source: DataFrame, small: bool) -> DataFrame:
    """``df`` with the columns of its source's row, nulls matched; moved only if the table is large."""
    renamed = per_source.withColumnRenamed("source", "_source")
    return df.join(F.broadcast(renamed) if small else renamed, df["source"].eqNullSafe(renamed["_source"])).drop("_source")


def plan_mix(docs: DataFrame, **shares) -> tuple[DataFrame, bool]:
    """(source, source_size, target, _base, _cut) from sized documents, and whether it is small.

    Each document is taken ``_base`` times and once more if its hash is below ``_cut``.
    """
    sizes = cut_lineage(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    room = sizes.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64), F.lit(0))).first()[0]
    small = room <= BROADCAST_BYTES
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    plan = source_targets(sizes, **shares).withColumn("_base", base)
    plan = plan.withColumn("_budget", F.col("target") - F.col("_base") * F.col("source_size")).withColumn("_cut", F.lit(0).cast("bigint"))
    state = cut_lineage(plan.withColumn("_open", F.lit(True)))
    running = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = docs.select("source", "size", "_hash")
    for level in range(LEVELS):
        low = LEVEL_BITS * (LEVELS - 1 - level)
        bucket = F.shiftright("_hash", low)
        frontier = state.where("_open").select("source", "_cut", "_budget")
        within = _beside(inside, frontier, small).where(F.shiftright("_hash", low + LEVEL_BITS) == F.shiftright("_cut", low + LEVEL_BITS))
        sums = within.groupBy("source", bucket.alias("_bucket")).agg(F.sum("size").alias("_sum"), F.first("_budget").alias("_budget"))
        reach = sums.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("_upto", F.sum("_sum").over(running))
        if level < LEVELS - 1:
            beyond = F.col("_upto") > F.col("_budget")
        else:  # one hash value is taken whole or not at all, whichever comes nearer
            beyond = 2 * F.col("_upto") - F.col("_sum") > 2 * F.col("_budget")
        ends = reach.where(beyond).groupBy("source").agg(F.min_by(F.struct("_bucket", (F.col("_budget") - F.col("_upto") + F.col("_sum")).alias("_left")), "_bucket").alias("_end"))
        met = ends.select(F.col("source").alias("_source"), "_end")
        joined = state.join(met, state["source"].eqNullSafe(met["_source"]), "left").drop("_source")
        found = F.col("_end").isNotNull()
        state = cut_lineage(joined.select(
            "source", "source_size", "target", "_base",
            F.when(found, F.col("_end._left")).otherwise(F.col("_budget")).alias("_budget"),
            F.when(~F.col("_open"), F.col("_cut")).when(found, F.shiftleft("_end._bucket", low))
            .otherwise(F.shiftleft(F.shiftright("_cut", low + LEVEL_BITS) + 1, low + LEVEL_BITS)).alias("_cut"),
            (F.col("_open") & found).alias("_open"),
        ))
    return state.drop("_budget", "_open"), small


def mix(docs: DataFrame, plan: tuple[DataFrame, bool]) -> DataFrame:
    """Sized documents with source_size, target, copies and taken (words, repeats counted)."""
    copies = F.col("_base") + F.when(F.col("_hash") < F.col("_cut"), 1).otherwise(0)
    return (
        _beside(docs, *plan).withColumn("copies", F.least(copies, F.lit(MOST)))
        .withColumn("taken", F.col("size") * F.col("copies")).drop("_hash", "_base", "_cut")
    )


def mix_sources(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every document.

    Null and empty texts have size zero and take none of the budget; a null source is a source of
    its own, null ids are told apart by their texts, rows equal in id and text share their fate. An
    empty table gives an empty mix.
    """
    narrow = cut_lineage(sized(docs, text=text, doc_id=doc_id).select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), "size", "_hash"
    ))
    return mix(narrow, plan_mix(narrow))


def repeat_mixed(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``."""
    own = private(docs).withColumn("source", F.col("_own_source"))
    marked = sized(own, text=f"_own_{text}", doc_id=f"_own_{doc_id}")
    plan = plan_mix(cut_lineage(marked.select("source", "size", "_hash")))
    mixed = mix(marked, plan).where("copies > 0")
    return public(mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs.columns)
