"""Boxes, reading order, table rows, orientation and the OCR join."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from docledger.functions.ordinals import LARGE, number_rows, running_max, split_groups
from docledger.functions.text import strip
from docledger.labels import ITEM_COLUMNS
from docledger.session import cut_lineage

PAGE = ("document_id", "page_index")
# Orientation trigger, sample size and score weights.
MIN_REGIONS, VERTICAL_TRIGGER, SAMPLE, VERTICAL_RATIO = 8, 0.7, 16, 1.25


def bbox_of(bbox: Column | None = None, corners: Column | None = None, polygon: Column | None = None) -> Column:
    """First usable shape as a box struct: a struct, a four-number list, or a polygon of 3+ points."""
    shapes = []
    if bbox is not None:
        shapes.append(bbox)
    if corners is not None:
        shapes.append(F.when(F.size(corners) == 4, F.struct(
            *[corners[i].alias(n) for i, n in enumerate(("x_min", "y_min", "x_max", "y_max"))])))
    if polygon is not None:
        x, y = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
        shapes.append(F.when(F.size(polygon) >= 3, F.struct(
            F.array_min(x).alias("x_min"), F.array_min(y).alias("y_min"),
            F.array_max(x).alias("x_max"), F.array_max(y).alias("y_max"))))
    return F.coalesce(*shapes)


def failed_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold (null counts as failing), in declared order."""
    return F.filter(
        F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]),
        lambda name: name.isNotNull(),
    )


def region_conformance(regions: DataFrame) -> DataFrame:
    box = F.col("bbox")
    corners = [box[n] for n in ("x_min", "y_min", "x_max", "y_max")]
    non_negative = F.lit(True)
    for corner in corners:
        non_negative = non_negative & (corner >= 0)
    return regions.withColumn("failed_rules", failed_rules({
        "box_has_positive_extent": (box["x_max"] > box["x_min"]) & (box["y_max"] > box["y_min"]) & non_negative,
        "polygon_has_four_points": F.size("polygon") >= 4,
        "polygon_has_three_distinct_points": F.size(F.array_distinct("polygon")) >= 3,
        "confidence_in_unit_range": F.col("confidence").between(0, 1),
    }))


def normalize_bbox(x_min: Column, y_min: Column, x_max: Column, y_max: Column, width: Column, height: Column) -> Column:
    """Integer box in 0..1000, ties rounded to even."""
    def scaled(value: Column, size: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(1000), F.bround(value / size * 1000, 0).cast("int")))

    return F.array(scaled(x_min, width), scaled(y_min, height), scaled(x_max, width), scaled(y_max, height))


def denormalize_bbox(box: Column, width: Column, height: Column) -> Column:
    return F.struct(
        (box[0] * width / 1000).alias("x_min"), (box[1] * height / 1000).alias("y_min"),
        (box[2] * width / 1000).alias("x_max"), (box[3] * height / 1000).alias("y_max"),
    )


def prepare_layout_regions(regions: DataFrame, *, band: float = 200.0) -> DataFrame:
    """Non-blank regions with their ordinal by page, top, left, id inside the document."""
    kept = regions.where(strip(F.col("text")) != "").withColumn(
        "_band", F.struct("page_index", F.floor(F.col("y_min") / band)))
    order = [F.col(n) for n in ("page_index", "y_min", "x_min", "region_id")]
    return number_rows(kept, ["document_id"], "_band", order, "ordinal").drop("_band")


# ---------------------------------------------------------------- sequential line clusters
@F.pandas_udf(ST.LongType())
def _follow_pages(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Line of each row inside its page: the same fold over rows that a window has sorted, ``first`` opening a page."""
    line, total, count = 0, None, 0
    for first, centre, reach in batches:
        lines = []
        for opens, at, within in zip(first.tolist(), centre.tolist(), reach.tolist(), strict=True):
            if opens:
                line, total, count = 0, at, 1
            elif abs(at - total / count) <= within:
                total += at
                count += 1
            else:
                line, total, count = line + 1, at, 1
            lines.append(line)
        yield pd.Series(lines, dtype="int64")


def _page_lines(regions: DataFrame, ident: str, tolerance: Column) -> DataFrame:
    """Add ``_line``, the line inside the page, where one task can order a page: rows are dealt by page once."""
    first = F.row_number().over(Window.partitionBy(*PAGE).orderBy("y_min", "x_min", ident)) == 1
    marked = regions.where("y_min is not null").withColumn("_first", first)
    follow = _follow_pages.asNondeterministic()  # reads the rows in their order, so it must stay where it is
    return marked.withColumn("_line", follow("_first", (F.col("y_min") + F.col("y_max")) / 2, tolerance)).drop("_first")


def _follow_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streaming fold over rows sorted by chain: the state is one running mean, columns pass through."""
    current, line, total, count = None, 0, 0.0, 0
    for batch in batches:
        lines = []
        chains = batch.column("_chain").to_pylist()
        centres, reaches = batch.column("_centre").to_pylist(), batch.column("_reach").to_pylist()
        for chain, centre, reach in zip(chains, centres, reaches, strict=True):
            if chain != current:
                current, line, total, count = chain, 0, centre, 1
            elif abs(centre - total / count) <= reach:
                total += centre
                count += 1
            else:
                line, total, count = line + 1, centre, 1
            lines.append(line)
        yield batch.append_column("_line", pa.array(lines, pa.int64()))


def _chains(regions: DataFrame, ident: str, tolerance: Column, band: float) -> DataFrame:
    """Cut pages into independent chains: adds ``_start`` (first row of the chain) and ``_chain_band``.

    A row whose centre lies beyond every earlier centre of the page by more than its tolerance opens
    a line whatever the running means were. Only the rows between two such rows have to be folded in
    order, so pages of any size spread over tasks and no page is ever collected.
    """
    order = [F.col("y_min"), F.col("x_min"), F.col(ident)]
    base = (
        regions.withColumn("_centre", (F.col("y_min") + F.col("y_max")) / 2)
        .withColumn("_reach", tolerance).withColumn("_band", F.floor(F.col("y_min") / band))
    )
    seen = running_max(base, PAGE, "_band", order, F.col("_centre"), "_seen", inclusive=False)
    opens = F.col("_seen").isNull() | (F.col("_centre") - F.col("_seen") > F.col("_reach"))
    marked = cut_lineage(seen.withColumn("_mark", F.when(opens, F.struct("y_min", "x_min", ident))).drop("_seen"))
    chained = running_max(marked, PAGE, "_band", order, F.col("_mark"), "_start", inclusive=True)
    return chained.drop("_mark", "_band").withColumn("_chain_band", F.floor(F.col("_start")["y_min"] / band))


def _fold_lines(chained: DataFrame, ident: str) -> DataFrame:
    """Add ``_line``, the line inside the chain."""
    keyed = chained.withColumn("_chain", F.concat_ws("/", *PAGE, F.col("_start")[ident]))
    ordered = keyed.repartition(*PAGE, "_start").sortWithinPartitions(*PAGE, "_start", "y_min", "x_min", ident)
    schema = ST.StructType([*keyed.schema.fields, ST.StructField("_line", ST.LongType())])
    return ordered.mapInArrow(_follow_chains, schema).drop("_chain", "_centre", "_reach")


def reading_order(regions: DataFrame, *, line_tolerance: float = 0.5, band: float = 200.0, large: int = LARGE) -> DataFrame:
    """Add ``reading_order``: lines top to bottom by running mean centre, then left to right.

    Pages of more than ``large`` rows are cut into chains, all others are ordered where they are dealt.
    """
    height = F.col("y_max") - F.col("y_min")
    tolerance = F.greatest(F.lit(1.0), height * line_tolerance)
    usual, long = split_groups(regions, PAGE, large)
    inside = Window.partitionBy(*PAGE).orderBy("_line", "x_min", "y_min", "region_id")
    numbered = _page_lines(usual, "region_id", tolerance).withColumn("reading_order", F.row_number().over(inside).cast("bigint"))
    ordered = numbered.select(*regions.columns, "reading_order")
    if long is None:
        return ordered
    chained = _chains(long, "region_id", tolerance, band)
    lines = _fold_lines(chained, "region_id")
    order = [F.col("_start"), F.col("_line"), F.col("x_min"), F.col("y_min"), F.col("region_id")]
    counted = number_rows(lines, PAGE, "_chain_band", order, "reading_order", counted=chained)
    return ordered.unionByName(counted.select(*regions.columns, "reading_order"))


def base_label(label: Column) -> Column:
    """Label without one leading B- and one leading I-."""
    return F.regexp_replace(F.regexp_replace(label, "^B-", ""), "^I-", "")


def label_column(label: Column) -> Column:
    """Table column of an item label; null for every other label."""
    pairs = [item for name, column in ITEM_COLUMNS.items() for item in (F.lit(name), F.lit(column))]
    return F.try_element_at(F.create_map(*pairs), label)


def _long_page_rows(items: DataFrame, tolerance: Column, band: float) -> DataFrame:
    """Table rows of pages too long for one task, numbered over their chains."""
    lines = cut_lineage(_fold_lines(_chains(items, "entity_id", tolerance, band), "entity_id"))
    rows = lines.select(*PAGE, "_chain_band", "_start", "_line").distinct()
    numbered = number_rows(rows, PAGE, "_chain_band", [F.col("_start"), F.col("_line")], "_row_number")
    return lines.join(numbered.drop("_chain_band"), [*PAGE, "_start", "_line"]).withColumn("row_index", F.col("_row_number") - 1)


def cluster_table_rows(entities: DataFrame, *, band: float = 200.0, large: int = LARGE) -> DataFrame:
    """Item entities as table cells: ``row_index`` from vertical centres, ``column_index`` from the label.

    Pages of more than ``large`` cells are cut into chains, all others are clustered where they are dealt.
    """
    items = entities.withColumn("label", base_label(F.col("label"))).withColumn(
        "column_index", label_column(F.col("label"))).where("column_index is not null")
    height = F.col("y_max") - F.col("y_min")
    tolerance = F.greatest(F.lit(2.0), height * 0.7)
    columns = [*items.columns, "row_index"]
    usual, long = split_groups(items, PAGE, large)
    cells = _page_lines(usual, "entity_id", tolerance).withColumnRenamed("_line", "row_index").select(*columns)
    if long is not None:
        cells = cells.unionByName(_long_page_rows(long, tolerance, band).select(*columns))
    return cells.withColumn(
        "table_id", F.concat(F.col("document_id"), F.lit("-p"), F.col("page_index").cast("string"), F.lit("-medicine")))


# ---------------------------------------------------------------- orientation
def is_vertical(width: Column, height: Column) -> Column:
    return height > width * VERTICAL_RATIO


def vertical_fraction(regions: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    width, height = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    return regions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("regions"),
        (F.count_if(is_vertical(width, height)) / F.count(F.lit(1))).alias("vertical_fraction"),
    )


def choose_orientation(initial: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per page the kept rotation (0 when not triggered) and its confidence.

    ``candidates`` holds the recognised regions of each page turned by 90 and by 270 degrees.
    """
    state = vertical_fraction(initial)
    triggered = (F.col("regions") >= MIN_REGIONS) & (F.col("vertical_fraction") >= VERTICAL_TRIGGER)
    turned = candidates.join(state.where(triggered).select(*PAGE), list(PAGE), "left_semi")
    keys = [*PAGE, "rotation"]
    width, height = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    letters = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    quality = F.col("confidence") * (0.2 + 0.8 * F.least(letters / 8, F.lit(1.0)))
    # the longest boxes through a bounded aggregate: partial top lists merge before and after the shuffle
    longest = F.struct((-F.greatest(width, height)).alias("size"), "y_min", "x_min", "region_id", quality.alias("quality"))
    sampled = turned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_regions"), F.count_if(is_vertical(width, height)).alias("_vertical"))
    ranked = turned.select(*keys, longest.alias("_longest")).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_longest"))).where(F.col("_rank") <= SAMPLE)
    means = ranked.groupBy(*keys).agg(F.avg("_longest.quality").alias("_mean"))
    scored = sampled.join(means, keys).select(
        *keys, (F.col("_mean") + 0.05 * (1 - F.col("_vertical") / F.col("_regions"))).alias("score"))
    best = scored.groupBy(*PAGE).agg(
        F.coalesce(F.max(F.when(F.col("rotation") == 90, F.col("score"))), F.lit(0.0)).alias("_s90"),
        F.coalesce(F.max(F.when(F.col("rotation") == 270, F.col("score"))), F.lit(0.0)).alias("_s270"))
    lead = F.abs(F.col("_s90") - F.col("_s270"))
    return state.join(best, list(PAGE), "left").select(
        *PAGE,
        F.when(~triggered, 0).when(F.coalesce(F.col("_s90") >= F.col("_s270"), F.lit(True)), 90).otherwise(270).alias("rotation_degrees"),
        F.when(triggered, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + F.coalesce(lead, F.lit(0.0))))).alias("confidence"),
    )


# ---------------------------------------------------------------- recognised regions
def safe_confidence(value: Column) -> Column:
    """A number in 0..1; anything else is 0."""
    number = value.try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number) & number.between(0, 1), number).otherwise(0.0)


def join_ocr(detections: DataFrame, recognitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions with both confidences, recognitions whose region id was never detected)."""
    keys = [*PAGE, "region_id"]
    spoken = recognitions.where(strip(F.col("text")) != "").select(
        *keys, "text", safe_confidence(F.col("confidence")).alias("recognition_confidence"))
    boxes = detections.withColumnRenamed("confidence", "detection_confidence").drop("text")
    return spoken.join(boxes, keys), spoken.join(boxes, keys, "left_anti")
