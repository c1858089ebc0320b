"""Fair before/after comparison of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.json import parse_record
from docledger.labels import LOWER_IS_BETTER, PROTOCOL_ATTRIBUTES, STRICT_ATTRIBUTES


def lower_is_better(name: Column, flag: Column | None = None) -> Column:
    """An explicit flag decides, else the name."""
    by_name = F.lower(name).rlike("|".join(LOWER_IS_BETTER))
    return F.coalesce(flag, by_name) if flag is not None else by_name


def numeric_metrics(runs: DataFrame, payload: str, key: str = "run_id") -> DataFrame:
    """(run, metric, value, flag) from a JSON metrics object: bare numbers or records; booleans are no numbers."""
    spark = runs.sparkSession
    root = parse_record(F.col(payload))
    metrics = runs.select(key, F.coalesce(F.try_variant_get(root, "$.metrics", "variant"), root).alias("_m"))
    entries = metrics.lateralJoin(spark.tvf.variant_explode(F.col("_m").outer()).toDF("_pos", "metric", "_v"))
    shape = F.schema_of_variant("_v")
    nested = F.try_variant_get("_v", "$.value", "variant")
    number = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
    value = F.when(shape.rlike(number), F.try_variant_get("_v", "$", "double")).when(
        F.schema_of_variant(nested).rlike(number), F.try_variant_get("_v", "$.value", "double"))
    return entries.select(key, "metric", value.alias("value"), F.try_variant_get("_v", "$.lower_is_better", "boolean").alias("lower_is_better")).where("value is not null")


def _changes(before: Column, after: Column, lower: Column) -> dict[str, Column]:
    better = F.when(lower, after < before).otherwise(after > before)
    return {
        "absolute_change": after - before,
        "relative_change_percent": F.when(before != 0, (after - before) / F.abs(before) * 100),
        "classification": F.when(before.isNull() | after.isNull(), "N/A").when(before == after, "unchanged").when(better, "improved").otherwise("regressed"),
    }


def compare_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Union of metric names with changes on the common ones. The explicit direction flag counts for the classification too."""
    def side(df: DataFrame, name: str) -> DataFrame:
        flag = F.col("lower_is_better") if "lower_is_better" in df.columns else F.lit(None).cast("boolean")
        return df.select("metric", F.col("value").alias(name), flag.alias(f"_{name}_flag"))

    joined = side(before, "before").join(side(after, "after"), "metric", "full_outer")
    lower = lower_is_better(F.col("metric"), F.coalesce("_after_flag", "_before_flag"))
    return joined.withColumn("lower_is_better", lower).withColumns(
        _changes(F.col("before"), F.col("after"), F.col("lower_is_better"))).drop("_before_flag", "_after_flag")


def compare_common(before: DataFrame, after: DataFrame, key: str, metric: str | None = None) -> DataFrame:
    """Changes on common keys: documents under one primary metric, or fields under their accuracy."""
    joined = before.select(key, F.col("value").alias("before")).join(after.select(key, F.col("value").alias("after")), key)
    name = F.lit(metric) if metric is not None else F.concat(F.col(key), F.lit("_accuracy"))
    return joined.withColumns(_changes(F.col("before"), F.col("after"), lower_is_better(name)))


def classification_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("classification").agg(F.count(F.lit(1)).alias("rows"))


def fairness(manifests: DataFrame, *, allow_incomparable: bool = False, attributes: Sequence[str] = PROTOCOL_ATTRIBUTES) -> DataFrame:
    """Protocol attributes of the before and after manifest, null-safe; a strict difference refuses the comparison."""
    sides = manifests.agg(*[
        F.max(F.when(F.col("side") == side, F.col(a))).alias(f"{side}_{a}") for a in attributes for side in ("before", "after")])
    rows = sides.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("attribute"), F.lit(a in STRICT_ATTRIBUTES).alias("strict"), F.col(f"before_{a}").alias("before"), F.col(f"after_{a}").alias("after"))
        for a in attributes])))
    differs = ~F.col("before").eqNullSafe(F.col("after"))
    return rows.withColumn("verdict", F.when(~differs, "equal").when(
        F.col("strict") & F.lit(not allow_incomparable), "refused").otherwise("different"))


def conclusion(compared: DataFrame) -> DataFrame:
    """One row: what the metric changes allow to say."""
    totals = compared.agg(
        F.count("before").alias("_b"), F.count("after").alias("_a"), F.count_if(F.col("classification") == "improved").alias("improved"),
        F.count_if(F.col("classification") == "regressed").alias("regressed"))
    said = (  # fixed values: the sentences are part of the output
        F.when((F.col("_b") == 0) | (F.col("_a") == 0), "insufficient valid test ground truth; no fine-tuning quality conclusion")
        .when((F.col("improved") > 0) & (F.col("regressed") == 0), "fine-tuning improved the measured quality metrics")
        .when(F.col("improved") > 0, "fine-tuning produced mixed quality changes")
        .otherwise("fine-tuning did not improve the measured quality metrics"))
    return totals.select("improved", "regressed", said.alias("conclusion"))
