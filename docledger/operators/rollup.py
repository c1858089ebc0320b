"""Run roll-ups: combinations, benchmark tables, merged stages, timing and outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def combinations(spark: SparkSession, detectors: Sequence[str], recognizers: Sequence[str], layouts: dict[str, bool]) -> DataFrame:
    """Model combinations in stable order; layouts that give no labels are left out. A dozen rows by construction."""
    rows = [(d, r, l) for d in detectors for r in recognizers for l, labelled in layouts.items() if labelled]
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "position int, detector string, recognizer string, layout string")


def benchmark_table(runs: DataFrame, metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """One wide row per run: status and every named metric; pivot names are given, so no extra pass finds them."""
    wide = metrics.groupBy("run_id").pivot("metric", list(names)).agg(F.first("value"))
    return runs.join(wide, "run_id", "left")


def merge_stage_runs(stage_metrics: DataFrame) -> DataFrame:
    """Per (run, metric) the value of the latest stage."""
    return stage_metrics.groupBy("run_id", "metric").agg(
        F.max_by("value", "stage_order").alias("value"), F.max("stage_order").alias("stage_order"), F.count(F.lit(1)).alias("stages"))


def merge_stage_timing(stage_times: DataFrame, summed: Sequence[str], peaked: Sequence[str]) -> DataFrame:
    """Times add up, counts and peaks take the maximum; an end-to-end row replaces both."""
    end = F.col("stage") == "end_to_end"
    columns = []
    for name in [*summed, *peaked]:
        merged = F.sum(name) if name in summed else F.max(name)
        columns.append(F.when(F.max(end), F.max(F.when(end, F.col(name)))).otherwise(merged).alias(name))
    return stage_times.groupBy("run_id").agg(*columns)


def primary_metric(stage_metrics: DataFrame, preferred: str) -> DataFrame:
    """Per run the preferred metric if any stage has it, else the primary of the last stage that names one."""
    return stage_metrics.groupBy("run_id").agg(
        F.when(F.max(F.col("metric") == preferred), F.lit(preferred)).otherwise(
            F.max_by(F.when(F.col("is_primary"), F.col("metric")), F.when(F.col("is_primary"), F.col("stage_order")))).alias("primary_metric"))


#: Bands a factor of e is cut into when values are ranked.
BANDS_PER_E = 256


def _band(value: Column) -> Column:
    """A number that never falls as ``value`` rises: its logarithm in steps, with the sign, 0 for 0."""
    step = F.floor(F.log(F.abs(value)) * BANDS_PER_E).cast("bigint") + 1_000_000
    return F.when(value > 0, step).when(value < 0, -step).otherwise(0)


def medians(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median) by rank selection, exact: the mean of the two middle values.

    Equal values are counted, counts are added up by band of size, and only the one or two bands that
    hold the middle ranks are looked into. So a key with all rows is as many tasks as it has values
    and bands; no list of values is kept. Null values count for nothing.
    """
    banded = values.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counted = banded.withColumn("_band", _band(F.col("_v")))
    bands = Window.partitionBy(key)
    earlier = bands.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.groupBy(key, "_band").agg(F.sum("_n").alias("_size")).withColumns({
        "_before": F.coalesce(F.sum("_size").over(earlier), F.lit(0)), "_total": F.sum("_size").over(bands)})
    low, high = F.expr("(_total - 1) div 2"), F.expr("_total div 2")

    def holds(rank: Column, first: Column, size: Column) -> Column:
        return (first <= rank) & (rank < first + size)

    middle = sums.where(holds(low, F.col("_before"), F.col("_size")) | holds(high, F.col("_before"), F.col("_size"))).drop("_size")
    inside = Window.partitionBy(key, "_band").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.join(middle, [key, "_band"]).withColumn("_first", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    picked = [F.max(F.when(holds(rank, F.col("_first"), F.col("_n")), F.col("_v"))) for rank in (low, high)]
    return ranked.groupBy(key).agg(((picked[0] + picked[1]) / 2).alias("median"))


def timing_stats(times: DataFrame, *, pages: DataFrame | None = None) -> DataFrame:
    """Per run: total, mean and median seconds per document, rates; null with a reason when absent."""
    per_document = times.groupBy("run_id", "document_id").agg(F.sum("seconds").alias("_s"))
    stats = per_document.groupBy("run_id").agg(
        F.sum("_s").alias("total_seconds"), F.avg("_s").alias("mean_seconds"), F.count(F.lit(1)).alias("documents"))
    stats = stats.join(medians(per_document, "run_id", "_s").withColumnRenamed("median", "median_seconds"), "run_id", "left")
    if pages is not None:
        stats = stats.join(pages, "run_id", "left")
    else:
        stats = stats.withColumn("pages", F.lit(None).cast("bigint"))
    return stats.withColumns({
        "seconds_per_page": F.try_divide(F.col("total_seconds"), F.col("pages")),
        "documents_per_second": F.when(F.col("total_seconds") > 0, F.col("documents") / F.col("total_seconds")),
        "pages_per_second": F.when(F.col("total_seconds") > 0, F.col("pages") / F.col("total_seconds")),
        "reason": F.when(F.col("pages").isNull(), "no page counts for this run")})


def stage_seconds(times: DataFrame) -> DataFrame:
    return times.groupBy("run_id", "stage").agg(F.sum("seconds").alias("seconds"), F.count_distinct("document_id").alias("documents"))


def _ordered_reasons() -> object:
    return F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("reason").isNotNull(), F.struct("stage_order", "reason")))), lambda r: r["reason"]), "; ")


def training_rollup(stages: DataFrame) -> DataFrame:
    """Per run: success if any stage succeeded, summed time, stages by status, reasons in stage order."""
    return stages.groupBy("run_id").agg(
        F.when(F.max(F.col("status") == "success"), "success").otherwise("skipped").alias("status"), F.sum("seconds").alias("total_training_seconds"),
        F.count_if(F.col("status") == "success").alias("successful_stages"), F.count_if(F.col("status") != "success").alias("other_stages"),
        _ordered_reasons().alias("reasons"))


def reason_rows(stages: DataFrame, key: str | None = "run_id", position: str = "stage_order") -> DataFrame:
    """(key, reason, first_position, occurrences): the reasons of every run as rows, however many there are."""
    keys = [key] if key else []
    return stages.where("reason is not null").groupBy(*keys, "reason").agg(F.min(position).alias("first_position"), F.count(F.lit(1)).alias("occurrences"))


def experiment_outcome(runs: DataFrame) -> DataFrame:
    """Counts by status, whether everything failed, and distinct reasons in first-seen order.

    Runs are counted by reason first, so the one row is made from as many rows as there are distinct
    reasons. It lists them all; :func:`reason_rows` gives them as rows where they are many.
    """
    statuses = (("success", "successful"), ("skipped", "skipped"), ("failed", "failed"))
    by_reason = runs.groupBy("reason").agg(
        F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col("status") == s).alias(f"_{n}") for s, n in statuses], F.min("position").alias("_at"))
    return by_reason.agg(
        F.coalesce(F.sum("_all"), F.lit(0)).alias("combination_count"),
        *[F.coalesce(F.sum(f"_{n}"), F.lit(0)).alias(f"{n}_count") for _, n in statuses],
        F.expr("listagg(reason, '; ') within group (order by _at, reason)").alias("reasons"),
    ).withColumn("all_failed", (F.col("combination_count") > 0) & (F.col("failed_count") == F.col("combination_count")))


def run_summary(documents: DataFrame) -> DataFrame:
    """Per run: totals, seconds per document, success only when something completed and nothing failed."""
    done, failed = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "failed")
    return documents.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_documents"), done.alias("completed"), failed.alias("failed"), F.sum("seconds").alias("_s")).select(
        "run_id", "total_documents", "completed", "failed", F.try_divide(F.col("_s"), F.col("completed")).alias("seconds_per_document"),
        F.when((F.col("completed") >= 1) & (F.col("failed") == 0), "success").otherwise("failed").alias("status"))
