"""SimHash near-duplicates, linked through deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Fingerprints that differ in at most two bits
differ in at most one bit of some segment, so both hold the same segment with one bit left out
(a wildcard): 64 variants index a fingerprint, equal variants are joined and the distance verified.
Only distinct fingerprints are indexed, so copies cost nothing.

A bucket of many different fingerprints would join pair by pair. Its members are indexed once more
by the 65 values at most one bit away from them: two fingerprints share such a value exactly if
they differ in at most two bits, and a value has at most 65 owners, all linked with each other.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docledger.llm.common import own, private, public
from docledger.llm.components import components
from docledger.session import cut_lineage, spread

SHINGLE = 3
SEED = 42
#: Buckets above this many different fingerprints take the second index.
CROWDED = 64


def _simhash(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    digest, seed = xxhash.xxh64_intdigest, SEED
    if len(words) < SHINGLE:
        hashes = [digest(b" ".join(words), seed)]
    else:
        hashes = [digest(shingle, seed) for shingle in map(b" ".join, zip(words, words[1:], words[2:]))]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<i8")[0])


@F.arrow_udf(T.LongType())
def simhash(texts: pa.Array) -> pa.Array:
    """Fingerprint of the 3-word shingles (repeats count) of the A-Z lower-cased text; 0 without words.

    bytes.lower and bytes.split touch ASCII only, as the definition asks.
    """
    return pa.array([_simhash(text.as_py() or b"") for text in texts.cast(pa.binary())], pa.int64())


def _variants(value: Column) -> Column:
    """The 64 one-wildcard variants: segment and wildcard above, the rest of the segment below."""
    out = []
    for segment in range(2):
        half = F.shiftrightunsigned(value, 32 * segment).bitwiseAND(F.lit(0xFFFFFFFF))
        for bit in range(32):
            rest = half.bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << bit)))
            out.append(rest.bitwiseOR(F.lit((segment * 32 + bit) << 32)))
    return F.array(*out)


def _within_one(value: Column) -> Column:
    """The value and the 64 values that differ from it in one bit."""
    return F.array(value, *(value.bitwiseXOR(F.lit((1 << bit) - (1 << 64 if bit == 63 else 0))) for bit in range(64)))


def _members(prints: DataFrame) -> DataFrame:
    """(key, print, size) of the variants that several fingerprints share.

    The engine sizes the 64 variants of a fingerprint like one row: unless told to merge, it would send
    the whole index through the driver while the fingerprints alone are below its limit.
    """
    index = prints.select("print", F.explode(_variants(F.col("print"))).alias("key"))
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return index.hint("merge").join(sizes.hint("merge"), "key").select("key", "print", "size")


def fingerprint_links(prints: DataFrame, *, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links between different fingerprints that keep every component within two bits.

    ``prints`` has one row per distinct ``print``. Small buckets give all their linked pairs, crowded
    ones a star for each shared value; either way two fingerprints within two bits are connected.
    """
    members = cut_lineage(_members(prints))
    few = (
        members.where(F.col("size") <= crowded).groupBy("key").agg(F.collect_list("print").alias("all"))
        .select(F.explode(F.expr(
            "flatten(transform(all, x -> transform(filter(all, y -> y < x and bit_count(x ^ y) <= 2),"
            " y -> struct(x as a, y as b))))"
        )).alias("link")).select("link.a", "link.b")
    )
    many = (
        members.where(F.col("size") > crowded).select("print").distinct()
        .select("print", F.explode(_within_one(F.col("print"))).alias("near"))
        .groupBy("near").agg(F.collect_list("print").alias("all")).where("size(all) > 1")
        .select(F.explode(F.expr("transform(filter(all, x -> x > array_min(all)), x -> struct(x as a, array_min(all) as b))")).alias("link"))
        .select("link.a", "link.b")
    )
    return few.union(many).distinct()


def _rooted(printed: DataFrame) -> DataFrame:
    """(print, root): the smallest fingerprint each distinct one is connected with."""
    # by a hash of the print: dealt by the print itself the exchange would be taken for the distinct's own and coalesced
    prints = spread(printed.select("print").distinct(), F.xxhash64("print"))
    roots = components(fingerprint_links(prints))
    return prints.join(roots, prints["print"] == roots["node"], "left").select("print", F.coalesce("root", "print").alias("root"))


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``.

    ``component_id`` is the smallest doc_id among all documents connected by links of at most two
    differing bits. A null or empty text has the fingerprint zero and is linked like any other; rows
    without doc_id are labelled like all others, and a component of such rows only has a null label.
    Repeated rows are returned as often as given; an empty table gives an empty result.
    """
    printed = cut_lineage(docs.select(F.col(doc_id).alias("doc_id"), simhash(text).alias("print")))
    least = printed.groupBy("print").agg(F.min("doc_id").alias("least"))
    rooted = _rooted(printed).join(least, "print")
    labels = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(labels, "root").select("print", "component_id")
    return printed.join(by_print, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The columns of ``docs``, one row for each component: that of the smallest doc_id.

    Nulls come last; of rows that share doc_id and fingerprint the smallest in column order stays,
    where maps and variants, which have no order, count as their JSON text. Columns may have any name.
    """
    names, mine = docs.columns, private(docs)
    doc_id = own(doc_id)
    marked = mine.withColumn("_print", simhash(own(text)))
    printed = cut_lineage(marked.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col("_print").alias("print")).distinct())
    least = printed.groupBy("print").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id")).alias("least"))
    chosen = (
        _rooted(printed).join(least, "print").groupBy("root")
        .agg(F.min(F.struct("least.late", "least.doc_id", "print")).alias("first"))
        .select(F.col("first.doc_id").alias("_id"), F.col("first.print").alias("_chosen"))
    )
    kept = marked.join(chosen, F.col(f"`{doc_id}`").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_chosen")), "left_semi")
    row = F.struct(*(f"`{name}`" for name in mine.columns))
    unordered = [field.name for field in mine.schema if re.search(r"\b(map|variant)\b", field.dataType.simpleString())]
    if unordered:
        rank = F.struct(*(F.to_json(F.struct(f"`{name}`")) if name in unordered else F.col(f"`{name}`") for name in mine.columns))
        first = F.min_by(row, rank)
    else:
        first = F.min(row)
    return public(kept.groupBy(f"`{doc_id}`", "_print").agg(first.alias("_row")).select("_row.*"), names)
