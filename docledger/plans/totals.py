"""Flagship plan: printed invoices to checked totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.functions.values import NUMBER_TYPE, parse_money
from docledger.labels import DEFAULT_TOLERANCE


def totals_check(heads: DataFrame, lines: DataFrame, *, tolerance: str = DEFAULT_TOLERANCE) -> DataFrame:
    """Verdicts over printed documents.

    Line amounts are parsed and summed by document before the join (partial sums on the map side),
    so the join carries one row per document and a document with very many lines is not a hot key.
    Amounts that do not fit the decimal type, or whose sum does not, leave their checks unknown.
    """
    sums = lines.groupBy("doc_key").agg(F.try_sum(parse_money(F.col("amount_text"))).alias("_sum"))
    limit = F.lit(tolerance).cast(NUMBER_TYPE)
    typed = heads.select("doc_key", *[parse_money(F.col(f"{name}_text")).alias(name) for name in ("sub", "vat", "total")])
    joined = typed.join(sums, "doc_key", "left")
    gap = F.abs(F.try_subtract(F.try_add("sub", "vat"), F.col("total")))
    gap_items = F.abs(F.try_subtract("_sum", "sub"))

    def verdict(holds):
        return F.when(holds, "equal").when(~holds, "different").otherwise("unknown")

    judged = joined.select(
        verdict(gap <= limit).alias("subtotal_plus_vat"), verdict(gap_items <= limit).alias("sum_of_items"),
        F.coalesce((gap > 0) & (gap <= limit), F.lit(False)).alias("_rounded"), "total")
    return judged.groupBy("subtotal_plus_vat", "sum_of_items").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("_rounded").alias("rounding_differences"),
        F.try_sum("total").cast("double").alias("grand_total"))
