"""Ordered scans over groups of any size.

A window over a group needs the whole group in one task. The helpers here split each group into
ordered chunks (a coordinate band, a digest prefix), scan inside the chunk, and combine chunks
through their pre-aggregated summaries, so that a group holding a third of all rows still spreads
over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.session import cut_lineage

#: Rows a group may have to be ordered by one task; larger groups are scanned in chunks.
LARGE = 100_000
#: Names of large groups that may be broadcast; each stands for more than ``LARGE`` rows.
FEW = 100_000


def split_groups(df: DataFrame, keys: Sequence[str], large: int = LARGE) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups of at most ``large`` rows, rows of larger groups or None); rows with a null key are left out.

    Only a group that would burden one task needs the two-level scans below; all others are dealt once.
    """
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    names = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > large).drop("_rows"))
    found = names.count()
    if not found:
        return df, None
    named = F.broadcast(names) if found <= FEW else names
    return df.join(named, list(keys), "left_anti"), df.join(named, list(keys), "left_semi")


def number_rows(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[Column], name: str, *,
    counted: DataFrame | None = None,
) -> DataFrame:
    """1-based row number inside ``keys``; ``chunk`` must never decrease along ``order``.

    ``counted`` may name a cheaper frame with the same rows per chunk.
    """
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    sizes = (df if counted is None else counted).groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, chunk, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    return (
        df.withColumn("_row", F.row_number().over(inside))
        .join(offsets, [*keys, chunk])
        .withColumn(name, (F.col("_offset") + F.col("_row")).cast("bigint"))
        .drop("_row", "_offset")
    )


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[Column],
    value: Column,
    name: str,
    *,
    inclusive: bool,
) -> DataFrame:
    """Running maximum of ``value`` inside ``keys`` along (chunk, order); nulls are skipped."""
    last = Window.currentRow if inclusive else -1
    inside = (
        Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    )
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    summary = df.groupBy(*keys, chunk).agg(F.max(value).alias("_top"))
    carried = summary.select(*keys, chunk, F.max("_top").over(before).alias("_carried"))
    scanned = df.withColumn("_inside", F.max(value).over(inside)).join(carried, [*keys, chunk])
    best = F.when(F.col("_inside").isNull(), F.col("_carried")).when(
        F.col("_carried").isNull() | (F.col("_inside") >= F.col("_carried")), F.col("_inside")
    ).otherwise(F.col("_carried"))
    return scanned.withColumn(name, best).drop("_inside", "_carried")
