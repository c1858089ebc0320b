"""Column normalisation jobs and their roll-up."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions import text as T
from docledger.functions import values as V

PARSERS: dict[str, Callable[[Column], Column]] = {
    "date": V.normalize_date,
    "number": V.parse_number,
    "money": V.parse_money,
    "text": T.normalize_text,
    "folded": T.fold_text,
    "identifier": T.normalize_identifier,
    "scalar": T.normalize_scalar,
}


def normalize_columns(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """Add ``<column>_normalized`` for every column named in ``spec`` (column -> parser)."""
    return df.withColumns({f"{name}_normalized": PARSERS[kind](F.col(name)) for name, kind in spec.items()})


def normalization_report(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """Per column: rows, parsed, null and rejected values, in one aggregation pass."""
    parsed = normalize_columns(df, spec)
    counts = parsed.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(f"{name}_normalized").alias(f"{name}_parsed") for name in spec],
        *[F.count_if(F.col(name).isNull()).alias(f"{name}_null") for name in spec],
    )
    per_column = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"), F.lit(kind).alias("parser"), F.col("rows"),
                F.col(f"{name}_parsed").alias("parsed"), F.col(f"{name}_null").alias("missing"),
                (F.col("rows") - F.col(f"{name}_parsed") - F.col(f"{name}_null")).alias("rejected"),
            )
            for name, kind in spec.items()
        ]
    )
    return counts.select(F.inline(per_column))


def describe_products(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns(V.describe_product(F.col(column)))
