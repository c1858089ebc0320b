"""Queries: regions, reading order, table rows, orientation, OCR join, stage annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.operators import geometry as G
from docledger.sources import stages
from docledger.workload.fixtures import fixture, oracle, table
from docledger.workload.registry import query


def _polygon():
    corner = [("x_min", "y_min"), ("x_max", "y_min"), ("x_max", "y_max"), ("x_min", "y_max")]
    return F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corner])


def _box():
    return F.struct("x_min", "y_min", "x_max", "y_max")


@query("geo1_bbox_of", oracle("""
  select document_id, page_index, sum(x_min) as x_min, sum(y_min) as y_min, sum(x_max) as x_max, sum(y_max) as y_max
  from fx_tok group by 1, 2""", "fx_tok"))
def geo1(spark, sf):
    tok = fixture(spark, sf, "fx_tok")
    form = F.col("tok") % 3
    shaped = tok.select(
        "document_id", "page_index",
        F.when(form == 0, _box()).alias("bbox"),
        F.when(form == 1, F.array("x_min", "y_min", "x_max", "y_max")).alias("corners"),
        F.when(form == 2, _polygon()).alias("polygon"),
    ).withColumn("b", G.bbox_of(F.col("bbox"), F.col("corners"), F.col("polygon")))
    return shaped.groupBy("document_id", "page_index").agg(*[F.sum(f"b.{n}").alias(n) for n in ("x_min", "y_min", "x_max", "y_max")])


@query("geo2_region_conformance", oracle("""
  with r as (select document_id, case when tok % 19 = 0 then 'box_has_positive_extent,' else '' end || case when tok % 23 = 0 then 'polygon_has_four_points,' else '' end
    || case when tok % 29 = 0 then 'polygon_has_three_distinct_points,' else '' end || case when tok % 31 = 0 then 'confidence_in_unit_range,' else '' end as failed from fx_tok)
  select document_id, case when failed = '' then '' else substring(failed, 1, length(failed) - 1) end as failed_rules, count(*) as regions from r group by 1, 2""", "fx_tok"))
def geo2(spark, sf):
    tok = fixture(spark, sf, "fx_tok")
    point = F.struct(F.col("x_min").alias("x"), F.col("y_min").alias("y"))
    other = F.struct(F.col("x_max").alias("x"), F.col("y_max").alias("y"))
    regions = tok.select(
        "document_id", _box().alias("whole"), "tok", "confidence", _polygon().alias("square"), "x_min", "y_min", "x_max", "y_max",
    ).select(
        "document_id",
        F.when(F.col("tok") % 19 == 0, F.struct("x_min", "y_min", F.col("x_min").alias("x_max"), "y_max")).otherwise(F.col("whole")).alias("bbox"),
        F.when((F.col("tok") % 23 == 0) & (F.col("tok") % 29 == 0), F.array(point, other, point))
        .when(F.col("tok") % 23 == 0, F.slice("square", 1, 3))
        .when(F.col("tok") % 29 == 0, F.array(point, other, point, other)).otherwise(F.col("square")).alias("polygon"),
        F.when(F.col("tok") % 31 == 0, 1.5).otherwise(F.col("confidence")).alias("confidence"),
    )
    checked = G.region_conformance(regions)
    return checked.groupBy("document_id", F.array_join("failed_rules", ",").alias("failed_rules")).agg(F.count(F.lit(1)).alias("regions"))


@query("geo3_normalize_bbox", oracle("""
  with s as (select document_id, tok, least(1000, greatest(0, cast(round_even(x_min / 800 * 1000, 0) as bigint))) as a, least(1000, greatest(0, cast(round_even(y_min / 850 * 1000, 0) as bigint))) as b,
    least(1000, greatest(0, cast(round_even(x_max / 800 * 1000, 0) as bigint))) as c, least(1000, greatest(0, cast(round_even(y_max / 850 * 1000, 0) as bigint))) as d from fx_tok)
  select document_id, cast(sum(a * (tok % 7)) as bigint) as a, cast(sum(b * (tok % 7)) as bigint) as b, cast(sum(c * (tok % 7)) as bigint) as c, cast(sum(d * (tok % 7)) as bigint) as d from s group by 1""", "fx_tok"))
def geo3(spark, sf):
    box = G.normalize_bbox(*[F.col(n) for n in ("x_min", "y_min", "x_max", "y_max")], F.lit(800), F.lit(850))
    scaled = fixture(spark, sf, "fx_tok").select("document_id", "tok", box.alias("box"))
    return scaled.groupBy("document_id").agg(
        *[F.sum(F.col("box")[i].cast("bigint") * (F.col("tok") % 7)).alias(n) for i, n in enumerate("abcd")])


@query("geo4_prepare_layout_regions", oracle("""
  with r as (select document_id, tok, row_number() over (partition by document_id order by page_index, y_min, x_min, region_id) as ordinal from fx_tok where tok % 9 <> 0)
  select document_id, count(*) as regions, cast(sum(ordinal * (tok + 1)) as bigint) as check_sum from r group by 1""", "fx_tok"))
def geo4(spark, sf):
    tok = fixture(spark, sf, "fx_tok").withColumn("text", F.when(F.expr("tok % 9 = 0"), "  ").otherwise(F.col("text")))
    return G.prepare_layout_regions(tok).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("regions"), F.sum(F.col("ordinal") * (F.col("tok") + 1)).alias("check_sum"))


_FOLD = """
  grouped as (select document_id, page_index, list(struct_pack(k := tok, x := x_min, y := y_min, i := {ident}, txt := text, c := (y_min + y_max) / 2,
      t := {reach}) order by y_min, x_min, {ident}) as rs from {source} group by 1, 2),
  folded as (select document_id, page_index, list_reduce(rs, lambda a, r: case
      when a.n > 0 and abs(r.c - a.s / a.n) <= r.t then {{'s': a.s + r.c, 'n': a.n + 1, 'line': a.line, 'lines': list_append(a.lines, a.line)}}
      else {{'s': r.c, 'n': cast(1 as bigint), 'line': a.line + 1, 'lines': list_append(a.lines, a.line + 1)}} end,
      {{'s': cast(0 as double), 'n': cast(0 as bigint), 'line': cast(-1 as bigint), 'lines': cast([] as bigint[])}}) as f, rs from grouped),
  lined as (select document_id, page_index, unnest(rs) as r, unnest(f.lines) as line from folded)
"""


@query("geo5_reading_order", oracle(f"""
  with {_FOLD.format(ident="region_id", reach="greatest(1.0, (y_max - y_min) * 0.5)", source="fx_tok")},
  o as (select document_id, page_index, r.k as tok, row_number() over (partition by document_id, page_index order by line, r.x, r.y, r.i) as ordinal from lined)
  select document_id, page_index, count(*) as regions, cast(sum(ordinal * (tok + 1)) as bigint) as check_sum from o group by 1, 2""", "fx_tok"))
def geo5(spark, sf):
    return G.reading_order(fixture(spark, sf, "fx_tok")).groupBy("document_id", "page_index").agg(
        F.count(F.lit(1)).alias("regions"), F.sum(F.col("reading_order") * (F.col("tok") + 1)).alias("check_sum"))


def entities(spark, sf):
    ent = fixture(spark, sf, "fx_ent")
    return ent.withColumn("entity_id", F.concat_ws("-", "label", F.col("y_min").cast("int").cast("string"), F.col("x_min").cast("int").cast("string")))


ITEM_CASE = "case regexp_replace(label, '^[BI]-', '') " + " ".join(
    f"when '{name}' then {column}" for name, column in G.ITEM_COLUMNS.items()) + " end"
CELLS = f"""
  cand as (select *, {ITEM_CASE} as tok, label || '-' || cast(cast(y_min as int) as string) || '-' || cast(cast(x_min as int) as string) as entity_id from fx_ent where {ITEM_CASE} is not null),
  {_FOLD.format(ident="entity_id", reach="greatest(2.0, (y_max - y_min) * 0.7)", source="cand")}"""


@query("geo6_cluster_table_rows", oracle(f"""
  with {CELLS} select document_id, page_index, line as row_index, r.k as column_index, count(*) as cells from lined group by 1, 2, 3, 4""", "fx_ent"))
def geo6(spark, sf):
    cells = G.cluster_table_rows(entities(spark, sf))
    return cells.groupBy("document_id", "page_index", "row_index", F.col("column_index").cast("bigint").alias("column_index")).agg(
        F.count(F.lit(1)).alias("cells"))


_TURNED = "x_min, y_min, case when tok % 4 <> 0 then x_min + 9 else x_max end as x_max, case when tok % 4 <> 0 then y_min + 10 + 5 * length(text) else y_max end as y_max"


def _turned(spark, sf):
    tok = fixture(spark, sf, "fx_tok")
    return tok.withColumn("x_max", F.expr("case when tok % 4 <> 0 then x_min + 9 else x_max end")).withColumn(
        "y_max", F.expr("case when tok % 4 <> 0 then y_min + 10 + 5 * length(text) else y_max end"))


@query("geo8_vertical_fraction", oracle(f"""
  with t as (select document_id, page_index, {_TURNED} from fx_tok)
  select document_id, page_index, count(*) as regions, sum(case when y_max - y_min > (x_max - x_min) * 1.25 then 1 else 0 end) / count(*) as vertical_fraction from t group by 1, 2""", "fx_tok"))
def geo8(spark, sf):
    return G.vertical_fraction(_turned(spark, sf))


@query("geo9_choose_orientation", oracle(f"""
  with t as (select document_id, page_index, {_TURNED} from fx_tok),
  st as (select document_id, page_index, count(*) as n, sum(case when y_max - y_min > (x_max - x_min) * 1.25 then 1 else 0 end) / count(*) as vf from t group by 1, 2),
  c as (select document_id, page_index, rot, region_id, x_min, y_min, x_max, y_max,
      case when rot = 90 then text else substring(text, 1, 3) end as text, case when rot = 90 then confidence else 0.99 - confidence / 2 end as confidence
    from (select *, unnest([90, 270]) as rot from fx_tok) f join st using (document_id, page_index) where n >= 8 and vf >= 0.7),
  k as (select *, row_number() over (partition by document_id, page_index, rot order by -greatest(x_max - x_min, y_max - y_min), y_min, x_min, region_id) as rk from c),
  s as (select document_id, page_index, rot, avg(case when rk <= 16 then confidence * (0.2 + 0.8 * least(length(regexp_replace(text, '[^\\pL\\pN]', '', 'g')) / 8, 1.0)) end)
      + 0.05 * (1 - sum(case when y_max - y_min > (x_max - x_min) * 1.25 then 1 else 0 end) / count(*)) as score from k group by 1, 2, 3),
  p as (select document_id, page_index, max(case when rot = 90 then score end) as a, max(case when rot = 270 then score end) as b from s group by 1, 2)
  select document_id, page_index, case when n < 8 or vf < 0.7 then 0 when a >= b then 90 else 270 end as rotation_degrees,
    case when n >= 8 and vf >= 0.7 then round(least(1.0, greatest(0.0, 0.5 + abs(a - b))), 9) end as confidence
  from st left join p using (document_id, page_index)""", "fx_tok"))
def geo9(spark, sf):
    tok = fixture(spark, sf, "fx_tok")
    turned = tok.withColumn("rotation", F.explode(F.array(F.lit(90), F.lit(270))))
    first = F.col("rotation") == 90
    turned = turned.withColumn("text", F.when(first, F.col("text")).otherwise(F.substring("text", 1, 3))).withColumn(
        "confidence", F.when(first, F.col("confidence")).otherwise(0.99 - F.col("confidence") / 2))
    chosen = G.choose_orientation(_turned(spark, sf), turned)
    return chosen.withColumn("confidence", F.round("confidence", 9))


@query("geo10_join_ocr", oracle("""
  with d as (select * from fx_tok where tok % 37 <> 0), r as (select document_id, page_index, region_id, tok,
      case tok % 5 when 0 then 'nan' when 1 then '1.7' when 2 then 'high' else cast(tok % 100 as string) end as c from fx_tok where tok % 9 <> 0)
  select r.document_id, case when d.tok is null then 'unknown_region' else 'joined' end as outcome, count(*) as regions,
    cast(sum(case when r.tok % 5 in (0, 1, 2) then 0 when r.tok % 100 <= 1 then r.tok % 100 else 0 end) as double) as recognition_confidence, round(sum(d.confidence), 6) as detection_confidence
  from r left join d using (document_id, page_index, region_id) group by 1, 2""", "fx_tok"))
def geo10(spark, sf):
    tok = fixture(spark, sf, "fx_tok")
    recognised = tok.select(
        "document_id", "page_index", "region_id", F.when(F.expr("tok % 9 = 0"), " ").otherwise(F.col("text")).alias("text"),
        F.expr("case tok % 5 when 0 then 'nan' when 1 then '1.7' when 2 then 'high' else cast(tok % 100 as string) end").alias("confidence"))
    joined, unknown = G.join_ocr(tok.where("tok % 37 <> 0"), recognised)
    summary = [F.count(F.lit(1)).alias("regions"), F.sum("recognition_confidence").alias("recognition_confidence")]
    return joined.groupBy("document_id", F.lit("joined").alias("outcome")).agg(*summary, F.round(F.sum("detection_confidence"), 6).alias("detection_confidence")).unionByName(
        unknown.groupBy("document_id", F.lit("unknown_region").alias("outcome")).agg(*summary).withColumn("detection_confidence", F.lit(None).cast("double")))


# ---------------------------------------------------------------- stage annotations
def annotations(spark, sf):
    """Whole documents as nested annotation records, built inside the row (no grouping)."""
    docs = table(spark, sf, "documents")
    # a page's words are cut out of the text by one pattern: slices of the whole list would read all of it once per page
    words = docs.where(F.col("text").rlike("[^ \\n\\t\\r]")).select(
        F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id").alias("doc_key"),
        F.expr(r"filter(split(text, '[ \\n\\t\\r]+'), x -> x <> '')").alias("words"),
        F.expr(r"""transform(regexp_extract_all(text, '(?:[^ \\n\\t\\r]++(?:[ \\n\\t\\r]++|\\z)){1,480}+', 0),
            t -> filter(split(t, '[ \\n\\t\\r]+'), x -> x <> ''))""").alias("paged"))
    return words.select(
        "document_id", "doc_key",
        F.expr("""case when doc_key % 4 <> 1 then transform(paged, (ws, p) -> named_struct('page_index', cast(p as bigint),
            'regions', transform(ws, (w, i) -> named_struct('region_id', concat('r', i), 'text', w)),
            'tokens', ws,
            'boxes', transform(ws, (w, i) -> array(i % 900, 10, i % 900 + 50, 22)),
            'labels', transform(ws, (w, i) -> if(i % 5 = 0, 'B-UNIT', 'O')),
            'ignore_mask', if(p % 2 = 0, transform(ws, (w, i) -> i % 6 = 0), null))) end""").alias("pages"),
        F.expr("""case when doc_key % 4 = 1 then transform(words, (w, i) -> named_struct('region_id', concat('r', i), 'text', w,
            'page_index', if(i < 100, cast(null as bigint), cast(i div 480 as bigint)))) end""").alias("regions"),
    )


@query("src5_explode_stage_gt", oracle("""
  with t as (select *, tok % 480 as i, case when doc_key % 4 = 1 and tok < 100 then 0 else page_index end as p from fx_tok)
  select 'recognition' as stage, document_id, p as page_index, count(*) as row_count, cast(sum(length(text) * (case when doc_key % 4 = 1 then tok else i end + 1)) as bigint) as check_sum from t group by 1, 2, 3
  union all select 'layout', document_id, page_index, count(*), cast(sum(case when i % 5 = 0 then 100 else 0 end + case when page_index % 2 = 0 and i % 6 = 0 then 1 else 0 end + i % 900) as bigint) from t where doc_key % 4 <> 1 group by 1, 2, 3""", "fx_tok"))
def src5(spark, sf):
    nested = annotations(spark, sf)
    regions = stages.explode_regions(nested).groupBy(F.lit("recognition").alias("stage"), "document_id", "page_index").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.length("text") * (F.col("position") + 1)).alias("check_sum"))
    tokens = stages.explode_tokens(nested).groupBy(F.lit("layout").alias("stage"), "document_id", "page_index").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.when(F.col("label") == "B-UNIT", 100).otherwise(0) + F.col("ignored").cast("int") + F.col("box")[0]).cast("bigint").alias("check_sum"))
    return regions.unionByName(tokens)
