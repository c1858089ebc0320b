"""Queries: flattening and quality metrics."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from docledger.operators import detection as D
from docledger.operators import fields as Q
from docledger.operators import flatten as L
from docledger.operators import metrics as M
from docledger.operators import transcription as R
from docledger.plans import evaluation
from docledger.workload.fixtures import fixture, oracle
from docledger.workload.registry import query

# ---------------------------------------------------------------- flattening
_NESTED = """select document_id, doc_key, case
    when doc_key % 10 = 3 then '{"field":"' || case when doc_key % 20 = 3 then 'invoice_number' else 'unknown' end || '","text":" ' || document_id || ' ","page":' || cast(doc_key % 3 as string) || '}'
    when doc_key % 10 = 7 then '{"invoice":{"invoice_number":"' || document_id || '"},"items":[]}'
    else '{"document_type":"VAT_INVOICE_BATCH","invoice_count":2,"invoices":[{"page_number":' || case when doc_key % 4 = 0 then '"x"' else '2' end || ',"invoice":{"invoice_number":"' || document_id || '","invoice_serial":"' || serial || '","invoice_date":null,"payment_method":"  "},'
      || '"buyer":{"buyer_organization":"' || buyer || '"},"workflow_fields":{"status":{"value":"' || serial || '","source":"invoice"},"invoice_type":{"value":"retail","source":"workflow_default"}},'
      || '"items":[{"line_number":7,"medicine_name":" ' || payment || ' ","quantity":' || cast(doc_key % 100 as string) || '.5,"is_promotion":true},{"medicine_name":"y' || serial || '","tags":["a","b",[1,2]],"line_number":"q"}],"validation":{"item_count":2}},'
      || '{"invoice":{"invoice_number":' || cast(doc_key as string) || '},"items":[]}],"_review":{"by":["me"],"_x":1}}' end as payload from fx_print"""


def _nested(spark, sf):
    fixture(spark, sf, "fx_print").createOrReplaceTempView("fx_print")
    return spark.sql(_NESTED)


_TREE = f"""n as ({_NESTED}), tree as (select document_id, replace(replace(substring(t.fullkey, 3), '"', ''), '$', '') as path, t.type, t.atom from n, json_tree(n.payload) t where t.type not in ('OBJECT', 'ARRAY')),
  flat as (select document_id, path, case type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'bool' when 'NULL' then 'null' else 'number' end as kind,
     case when type = 'VARCHAR' then json_extract_string(atom, '$') when type = 'NULL' then null else cast(atom as string) end as text from tree)"""
_BUSINESS = """kind <> 'null' and (kind <> 'string' or trim(text) <> '') and path not in ('document_type', 'invoice_count') and path not like '%.page_number'
   and path not like '%.validation.%' and (path not like '%.workflow_fields.%' or path like '%.value')"""


@query("fl1_flatten_json", oracle(f"with {_TREE} select document_id, path, kind, text from flat", "fx_print"))
def fl1(spark, sf):
    return L.flatten_json(_nested(spark, sf), "payload", ["document_id"])


@query("fl2_canonical_view", oracle(f"with {_TREE} select path, kind, count(*) as documents, count(distinct text) as texts from flat where not regexp_matches('.' || path, '\\._') group by 1, 2", "fx_print"))
def fl2(spark, sf):
    flat = L.flatten_json(_nested(spark, sf), "payload", ["document_id"], canonical=True)
    return flat.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("text").alias("texts"))


@query("fl3_business_fields", oracle(f"with {_TREE} select document_id, path, kind || ':' || text as token from flat where not regexp_matches('.' || path, '\\._') and {_BUSINESS}", "fx_print"))
def fl3(spark, sf):
    flat = L.business_fields(L.flatten_json(_nested(spark, sf), "payload", ["document_id"], canonical=True))
    return flat.select("document_id", "path", L.value_token(F.col("kind"), F.col("text")).alias("token"))


@query("fl5_gt_fields", oracle("""
  with k as (select document_id, doc_key, serial, buyer, payment, doc_key % 10 as form, case when doc_key % 4 = 0 then 0 else 1 end as pg, 'invoices[0].' as b from fx_print),
  f as (select *, form not in (3, 7) as whole from k)
  select document_id, 0 as invoice_index, null as item_index, null as line_number, greatest(doc_key % 3 - 1, 0) as page_index, 'invoice_number' as field_path, 'INVOICE_NUMBER' as label, 'identifier' as normalization_kind, document_id as gt_value from f where form = 3 and doc_key % 20 = 3
  union all select document_id, 0, null, null, 0, 'invoices[0].invoice.invoice_number', 'INVOICE_NUMBER', 'identifier', document_id from f where form = 7
  union all select document_id, 0, null, null, pg, b || 'invoice.invoice_number', 'INVOICE_NUMBER', 'identifier', document_id from f where whole
  union all select document_id, 0, null, null, pg, b || 'invoice.invoice_serial', 'INVOICE_SERIAL', 'identifier', serial from f where whole
  union all select document_id, 0, null, null, pg, b || 'buyer.buyer_organization', 'BUYER_ORGANIZATION', 'text', buyer from f where whole
  union all select document_id, 0, null, null, pg, b || 'workflow_fields.status.value', 'STATUS', 'text', serial from f where whole
  union all select document_id, 0, 0, 7, pg, b || 'items[0].line_number', 'LINE_NUMBER', 'number', '7' from f where whole
  union all select document_id, 0, 0, 7, pg, b || 'items[0].medicine_name', 'MEDICINE_NAME', 'text', payment from f where whole
  union all select document_id, 0, 0, 7, pg, b || 'items[0].quantity', 'QUANTITY', 'number', cast(doc_key % 100 as string) || '.5' from f where whole
  union all select document_id, 0, 1, 2, pg, b || 'items[1].medicine_name', 'MEDICINE_NAME', 'text', 'y' || serial from f where whole
  union all select document_id, 0, 1, 2, pg, b || 'items[1].line_number', 'LINE_NUMBER', 'number', 'q' from f where whole
  union all select document_id, 1, null, null, 1, 'invoices[1].invoice.invoice_number', 'INVOICE_NUMBER', 'identifier', cast(doc_key as string) from f where whole""".replace("null", "-1"), "fx_print"))
def fl5(spark, sf):
    return L.gt_fields(_nested(spark, sf)).na.fill(-1, ["item_index", "line_number"])


# ---------------------------------------------------------------- detection
_IOU = """pairs as (select p.document_id, p.page_index, p.box_index as pi, g.box_index as gi,
      greatest(0.0, least(p.x_max, g.x_max) - greatest(p.x_min, g.x_min)) * greatest(0.0, least(p.y_max, g.y_max) - greatest(p.y_min, g.y_min)) as inter,
      (p.x_max - p.x_min) * (p.y_max - p.y_min) + (g.x_max - g.x_min) * (g.y_max - g.y_min) as areas
    from fx_box_pred p join fx_box_gt g on p.document_id = g.document_id and p.page_index = g.page_index and p.x_min < g.x_max and g.x_min < p.x_max and p.y_min < g.y_max and g.y_min < p.y_max),
  scored as (select *, inter / (areas - inter) as iou from pairs where inter / (areas - inter) >= 0.5),
  greedy as (select document_id, page_index, list_reduce(list(struct_pack(pi := pi, gi := gi, iou := iou) order by iou desc, pi desc, gi desc),
      lambda a, r: case when list_contains(a.ps, r.pi) or list_contains(a.gs, r.gi) then a else {'ps': list_append(a.ps, r.pi), 'gs': list_append(a.gs, r.gi), 's': a.s + r.iou} end,
      {'ps': cast([] as bigint[]), 'gs': cast([] as bigint[]), 's': cast(0 as double)}) as m from scored group by 1, 2),
  np as (select document_id, page_index, count(*) as n from fx_box_pred group by 1, 2), ng as (select document_id, page_index, count(*) as n from fx_box_gt group by 1, 2),
  pg as (select ng.document_id, ng.page_index, coalesce(len(m.ps), 0) as tp, coalesce(np.n, 0) - coalesce(len(m.ps), 0) as fp, ng.n - coalesce(len(m.ps), 0) as fn, coalesce(m.s, 0) as s
    from ng left join np using (document_id, page_index) left join greedy using (document_id, page_index)),
  m as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0 end as r, case when tp > 0 then s / tp else 0 end as iou from pg),
  f as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1 from m)"""


def _pages(spark, sf):
    return D.page_metrics(fixture(spark, sf, "fx_box_pred"), fixture(spark, sf, "fx_box_gt"))


@query("m1_match_boxes", oracle(f"with {_IOU} select document_id, page_index, tp as true_positives, fp as false_positives, fn as false_negatives, round(iou, 9) as mean_iou, round(f1, 9) as f1 from f", "fx_box_pred", "fx_box_gt"))
def m1(spark, sf):
    return _pages(spark, sf).select("document_id", "page_index", "true_positives", "false_positives", "false_negatives",
                                    F.round("mean_iou", 9).alias("mean_iou"), F.round("f1", 9).alias("f1"))


@query("m2_detection_macro", oracle(f"with {_IOU} select count(*) as pages, round(avg(iou), 9) as detection_iou, round(avg(p), 9) as detection_precision, round(avg(r), 9) as detection_recall, round(avg(f1), 9) as detection_f1 from f", "fx_box_pred", "fx_box_gt"))
def m2(spark, sf):
    macro = D.detection_macro(_pages(spark, sf))
    return macro.select("pages", *[F.round(c, 9).alias(c) for c in macro.columns if c != "pages"])


@query("m3_detection_micro", oracle(f"""with {_IOU}, t as (select count(*) as pages, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, avg(iou) filter (tp > 0) as iou from f)
  select pages, tp as true_positives, fp as false_positives, fn as false_negatives, round(iou, 9) as mean_iou, round(tp / (tp + fp), 12) as precision, round(tp / (tp + fn), 12) as recall, round(2 * tp / (2 * tp + fp + fn), 12) as f1 from t""", "fx_box_pred", "fx_box_gt"))
def m3(spark, sf):
    micro = D.detection_micro(_pages(spark, sf))
    return micro.select("pages", "true_positives", "false_positives", "false_negatives", F.round("mean_iou", 9).alias("mean_iou"),
                        *[F.round(c, 12).alias(c) for c in ("precision", "recall", "f1")])


# ---------------------------------------------------------------- transcription
_PAIRS = "pairs as (select region_id, region_key, coalesce(predicted, '') as p, expected as e from fx_txt)"


@query("m4_char_edits", oracle(f"with {_PAIRS} select region_id, levenshtein(p, e) as edits from pairs", "fx_txt"))
def m4(spark, sf):
    pairs = fixture(spark, sf, "fx_txt")
    return pairs.select("region_id", R.char_edits(F.coalesce("predicted", F.lit("")), F.col("expected")).alias("edits"))


# word distance by the same trick in SQL: one letter per distinct word of the pair
_WORDS = f"""{_PAIRS}, w as (select *, case when trim(p) = '' then [] else string_split(trim(p), ' ') end as pw, string_split(trim(e), ' ') as ew from pairs),
  vocab as (select *, list_distinct(list_concat(pw, ew)) as v from w),
  coded as (select region_id, p, e, len(ew) as words, levenshtein(array_to_string(list_transform(pw, lambda x: chr(96 + cast(list_position(v, x) as int))), ''), array_to_string(list_transform(ew, lambda x: chr(96 + cast(list_position(v, x) as int))), '')) as we from vocab)"""


@query("m5_word_edits", oracle(f"with {_WORDS} select region_id, we as edits from coded", "fx_txt"))
def m5(spark, sf):
    pairs = fixture(spark, sf, "fx_txt")
    return pairs.select("region_id", R.word_edits(F.coalesce("predicted", F.lit("")), F.col("expected")).alias("edits"))


@query("m6_transcription_metrics", oracle(f"""with {_WORDS}, t as (select count(*) as pairs, cast(sum(levenshtein(p, e)) as bigint) as ce, cast(sum(length(e)) as bigint) as c, cast(sum(we) as bigint) as we, cast(sum(words) as bigint) as w,
    count(*) filter (p = e) as x, count(*) filter (regexp_matches(e, '^[0-9.,+/% -]+$')) as n, count(*) filter (p = e and regexp_matches(e, '^[0-9.,+/% -]+$')) as nx from coded)
  select pairs, ce as char_errors, c as expected_chars, we as word_errors, w as expected_words, x as exact, n as numeric_pairs, nx as numeric_exact, ce / c as cer, we / w as wer, x / pairs as exact_match, nx / n as numeric_accuracy from t""", "fx_txt"))
def m6(spark, sf):
    return R.transcription_metrics(fixture(spark, sf, "fx_txt").withColumn("predicted", F.coalesce("predicted", F.lit(""))))


@query("m7_pair_transcriptions", oracle("""
  with b as (select *, 'd' || cast(region_key % 50 as string) as document_id, case when region_key % 4 = 0 then 'other' || region_id else region_id end as pid from fx_txt),
  e as (select *, row_number() over (partition by document_id order by region_key) as n from b),
  p as (select *, row_number() over (partition by document_id order by region_key) as n from b where predicted is not null)
  select e.document_id, e.region_id, e.expected, coalesce(a.predicted, c.predicted, '') as predicted from e left join p a on a.document_id = e.document_id and a.pid = e.region_id
    left join p c on c.document_id = e.document_id and c.n = e.n""", "fx_txt"))
def m7(spark, sf):
    base = fixture(spark, sf, "fx_txt").withColumn("document_id", F.concat(F.lit("d"), (F.col("region_key") % 50).cast("string")))
    expected = base.select("document_id", "region_id", F.col("expected").alias("text"), "region_key")
    predicted = base.where("predicted is not null").select(
        "document_id", F.when(F.col("region_key") % 4 == 0, F.concat(F.lit("other"), "region_id")).otherwise(F.col("region_id")).alias("region_id"),
        F.col("predicted").alias("text"), "region_key")
    return R.pair_transcriptions(predicted, expected, "region_key")


# ---------------------------------------------------------------- entities and tokens
_SETS = """p as (select distinct document_id, page_index, label, regexp_replace(trim(text), '\\s+', ' ', 'g') as text from fx_ent where length(document_id) > 0 and not (label = 'B-QUANTITY' and text like '%7')),
  g as (select distinct document_id, page_index, case when label = 'B-STATUS' then 'B-INVOICE_TYPE' else label end as label, trim(text) as text from fx_ent where label <> 'O'),
  j as (select coalesce(p.document_id, g.document_id) as document_id, p.label is not null as ip, g.label is not null as ig from p full outer join g using (document_id, page_index, label, text)),
  {group} c as (select {key} count(*) filter (ip and ig) as tp, count(*) filter (ip and not ig) as fp, count(*) filter (ig and not ip) as fn from j {by})
  select {key} tp as true_positives, fp as false_positives, fn as false_negatives, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall,
    case when tp > 0 then 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) else 0 end as f1 from c"""


def _entity_sides(spark, sf):
    ent = fixture(spark, sf, "fx_ent")
    predicted = ent.where("not (label = 'B-QUANTITY' and text like '%7')")
    expected = ent.withColumn("label", F.when(F.col("label") == "B-STATUS", "B-INVOICE_TYPE").otherwise(F.col("label")))
    return predicted, expected


@query("m8_entity_set_metrics", oracle("with " + _SETS.format(group="", key="", by=""), "fx_ent"))
def m8(spark, sf):
    return Q.entity_set_metrics(*_entity_sides(spark, sf))


@query("m8_entity_document_metrics", oracle("with " + _SETS.format(group="", key="document_id,", by="group by document_id"), "fx_ent"))
def m8d(spark, sf):
    return Q.entity_set_metrics(*_entity_sides(spark, sf), per_document=True)


@query("m23_token_metrics", oracle("""with t as (select case when tok % 6 = 0 then -100 when tok % 5 = 0 then 1 + tok % 4 else 0 end as e, case when tok % 13 = 0 then 2 when tok % 5 = 0 then 1 + tok % 4 when tok % 31 = 0 then 3 else 0 end as p from fx_tok),
   c as (select count(*) as n, count(*) filter (p = e) as ok, count(*) filter (p = e and e <> 0) as tp, count(*) filter (p <> e and p <> 0) as fp, count(*) filter (p <> e and e <> 0) as fn from t where e <> -100)
   select n as tokens, ok as correct, tp as true_positives, fp as false_positives, fn as false_negatives, tp / (tp + fp) as precision, tp / (tp + fn) as recall,
     2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) as f1, ok / n as token_accuracy from c""", "fx_tok"))
def m23(spark, sf):
    tok = fixture(spark, sf, "fx_tok").select(
        F.expr("case when tok % 6 = 0 then -100 when tok % 5 = 0 then 1 + tok % 4 else 0 end").alias("expected_id"),
        F.expr("case when tok % 13 = 0 then 2 when tok % 5 = 0 then 1 + tok % 4 when tok % 31 = 0 then 3 else 0 end").alias("predicted_id"))
    return Q.token_metrics(tok)


# ---------------------------------------------------------------- fields
def _norm(t: str) -> str:
    return f"regexp_replace(trim(lower({t})), '\\s+', ' ', 'g')"


_FIELD = f"""both_sides as (select coalesce(g.document_id, p.document_id) as document_id, coalesce(g.path, p.path) as path, g.kind as gk, g.text as gt, p.kind as pk, p.text as pt
     from fx_gt g full outer join fx_pred p on g.document_id = p.document_id and g.path = p.path),
  flags as (select *, coalesce({_BUSINESS.replace('kind', 'gk').replace('text', 'gt')}, false) as bg, coalesce({_BUSINESS.replace('kind', 'pk').replace('text', 'pt')}, false) as bp,
     case when gk is null then false when coalesce(pk, 'null') <> gk then false when gk = 'null' then true when gk = 'number' then cast(pt as double) = cast(gt as double) else pt = gt end as same,
     case when gk is null then false when coalesce(pk, 'null') <> gk then false when gk = 'null' then true when gk = 'number' then cast(pt as double) = cast(gt as double) else {_norm('pt')} = {_norm('gt')} end as nsame from both_sides),
  dc as (select document_id, count(*) filter (bg and bp and gk = pk and gt = pt) as tp, count(*) filter (bg and bp and gk = pk and (gt = pt or (gk = 'string' and {_norm('pt')} = {_norm('gt')}))) as ntp,
     count(*) filter (bp) as np, count(*) filter (bg) as ng, cast(sum(case when bg then levenshtein(case when bp then pt else '' end, gt) when bp then length(pt) else 0 end) as bigint) as ce,
     cast(sum(case when bg then length(gt) else 0 end) as bigint) as c, count(gk) as paths, count(*) filter (same) as ex, count(*) filter (nsame) as nex, count(pk) as ppaths,
     bool_and(pk is not null and gk is not null and same) as whole from flags group by 1)"""


def _paired(spark, sf):
    return Q.paired_fields(fixture(spark, sf, "fx_pred"), fixture(spark, sf, "fx_gt"))


@query("m9_field_counts", oracle(f"with {_FIELD} select document_id, tp as true_positives, ntp as normalized_true_positives, np as predicted_fields, ng as expected_fields from dc", "fx_pred"))
def m9(spark, sf):
    return Q.document_counts(_paired(spark, sf)).select("document_id", "true_positives", "normalized_true_positives", "predicted_fields", "expected_fields")


@query("m10_field_char_errors", oracle(f"with {_FIELD} select document_id, ce as character_errors, c as expected_characters from dc", "fx_pred"))
def m10(spark, sf):
    return Q.document_counts(_paired(spark, sf)).select("document_id", "character_errors", "expected_characters")


@query("m12_field_accuracy", oracle(f"with {_FIELD} select document_id, case when paths > 0 then ex / paths else 1 end as field_exact_match, case when paths > 0 then nex / paths else 1 end as normalized_field_accuracy from dc", "fx_pred"))
def m12(spark, sf):
    return Q.document_metrics(Q.document_counts(_paired(spark, sf))).select("document_id", "field_exact_match", "normalized_field_accuracy")


@query("m15_document_exact_match", oracle(f"with {_FIELD} select document_id, case when whole then 1.0 else 0.0 end as document_exact_match from dc", "fx_pred"))
def m15(spark, sf):
    return Q.document_metrics(Q.document_counts(_paired(spark, sf))).select("document_id", "document_exact_match")


@query("m17_per_field_accuracy", oracle(f"with {_FIELD} select path, count(*) filter (nsame) as correct, count(*) as total, count(*) filter (nsame) / count(*) as accuracy from flags where gk is not null group by 1", "fx_pred"))
def m17(spark, sf):
    return Q.per_field_accuracy(_paired(spark, sf))


# ---------------------------------------------------------------- item rows
ITEM_COLUMNS = ["medicine_name", "lot_number", "quantity", "line_amount"]
_ROW = "lower(medicine_name) || '|' || lower(lot_number) || '|' || quantity || '|' || line_amount"
_ROWS = f"""rp as (select document_id, {_ROW} as k, count(*) as n from fx_items_pred group by 1, 2), re as (select document_id, {_ROW} as k, count(*) as n from fx_items_gt group by 1, 2),
   rj as (select coalesce(rp.document_id, re.document_id) as document_id, coalesce(rp.n, 0) as p, coalesce(re.n, 0) as e from rp full outer join re using (document_id, k)),
   rd as (select document_id, cast(sum(least(p, e)) as bigint) as m, cast(sum(p) as bigint) as p, cast(sum(e) as bigint) as e from rj group by 1)"""
_PR = "case when p > 0 then m / p when e = 0 then 1 else 0 end", "case when e > 0 then m / e when p = 0 then 1 else 0 end"


@query("m13_item_row_metrics", oracle(f"with {_ROWS}, x as (select *, {_PR[0]} as pr, {_PR[1]} as rc from rd) select document_id, m as matching_rows, p as predicted_rows, e as expected_rows, pr as item_row_precision, rc as item_row_recall, case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0 end as item_row_f1 from x", "fx_items_pred"))
def m13(spark, sf):
    return Q.item_row_metrics(fixture(spark, sf, "fx_items_pred"), fixture(spark, sf, "fx_items_gt"), ITEM_COLUMNS)


_ASSIGN = """sc as (select g.document_id, g.item_index as e, p.item_index as p, cast(lower(g.medicine_name) = lower(p.medicine_name) as int) + cast(lower(g.lot_number) = lower(p.lot_number) as int)
      + cast(g.quantity = p.quantity as int) + cast(g.line_amount = p.line_amount as int) as s from fx_items_gt g left join fx_items_pred p on g.document_id = p.document_id),
  sl as (select document_id, e, list(struct_pack(p := p, s := s) order by s desc, p) filter (p is not null) as ps from sc group by 1, 2),
  fold as (select document_id, list_reduce(list(struct_pack(e := e, ps := ps) order by e), lambda a, r: case
      when len(list_filter(coalesce(r.ps, []), lambda x: not list_contains(a.used, x.p))) = 0 then {'used': a.used, 'got': a.got, 'n': a.n + 1}
      else {'used': list_append(a.used, list_filter(r.ps, lambda x: not list_contains(a.used, x.p))[1].p), 'got': a.got + list_filter(r.ps, lambda x: not list_contains(a.used, x.p))[1].s, 'n': a.n + 1} end,
      {'used': cast([] as bigint[]), 'got': cast(0 as bigint), 'n': cast(0 as bigint)}) as f from sl group by 1),
  acc as (select document_id, f.got as correct_fields, f.n * 4 as total_fields, f.got / (f.n * 4) as item_field_accuracy from fold)"""


@query("m14_item_field_accuracy", oracle(f"with {_ASSIGN} select * from acc", "fx_items_pred"))
def m14(spark, sf):
    return Q.item_field_accuracy(fixture(spark, sf, "fx_items_pred"), fixture(spark, sf, "fx_items_gt"), ITEM_COLUMNS)


# ---------------------------------------------------------------- corpus
def _final(spark, sf):
    return M.final_documents(fixture(spark, sf, "fx_pred"), fixture(spark, sf, "fx_gt"), fixture(spark, sf, "fx_items_pred"), fixture(spark, sf, "fx_items_gt"), ITEM_COLUMNS)


_FINAL = f"""{_FIELD}, {_ROWS}, {_ASSIGN}, rr as (select *, {_PR[0]} as pr, {_PR[1]} as rc from rd),
  fd as (select dc.*, coalesce(pr, 1) as pr, coalesce(rc, 1) as rc, case when rr.document_id is null then 1 when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0 end as rf,
     coalesce(item_field_accuracy, case when rr.document_id is null then 1 else 0 end) as ia from dc left join rr using (document_id) left join acc using (document_id)),
  tot as (select sum(tp) as tp, sum(ntp) as ntp, sum(np) as np, sum(ng) as ng, sum(ce) as ce, sum(c) as c, count(*) filter (paths > 0) as docs, count(*) filter (paths > 0 and ppaths = 0) as missing, count(*) filter (paths > 0 and ppaths > 0) as ev from fd {{only}}),
  b as (select * from fd where paths > 0 and ppaths > 0),
  met as (select 'final_field_level_precision' as metric, tp / np as value, tp as numerator, np as denominator, docs as evaluated, 0 as skipped, 0 as lower from tot
    union all select 'final_field_level_recall', tp / ng, tp, ng, docs, 0, 0 from tot union all select 'final_field_level_f1', 2 * (tp / np) * (tp / ng) / (tp / np + tp / ng), 2 * tp, np + ng, docs, 0, 0 from tot
    union all select 'final_normalized_field_level_precision', ntp / np, ntp, np, docs, 0, 0 from tot union all select 'final_normalized_field_level_recall', ntp / ng, ntp, ng, docs, 0, 0 from tot
    union all select 'final_normalized_field_level_f1', 2 * (ntp / np) * (ntp / ng) / (ntp / np + ntp / ng), 2 * ntp, np + ng, docs, 0, 0 from tot union all select 'final_character_error_rate', ce / c, ce, c, docs, 0, 1 from tot
    {"".join(f" union all select 'final_{n}', avg({e}), sum({e}), count(*), count(*), (select missing from tot), 0 from b" for n, e in (('field_exact_match', 'ex / paths'), ('normalized_field_accuracy', 'nex / paths'), ('item_row_precision', 'pr'), ('item_row_recall', 'rc'), ('item_row_f1', 'rf'), ('item_field_accuracy', 'ia'), ('document_exact_match', 'case when whole then 1.0 else 0.0 end')))})"""


@query("m16_corpus_metrics", oracle(f"with {_FINAL.replace('{only}', '')} select metric, round(value, 9) as value, round(cast(numerator as double), 5) as numerator, cast(denominator as double) as denominator, evaluated, skipped, lower as lower_is_better from met", "fx_pred", "fx_items_pred"))
def m16(spark, sf):
    return M.corpus_metrics(_final(spark, sf)).select("metric", F.round("value", 9).alias("value"), F.round("numerator", 5).alias("numerator"),
                                                      "denominator", "evaluated", "skipped", F.col("lower_is_better").cast("int").alias("lower_is_better"))


@query("m18_validation_rates", oracle("""
  with h as (select abs(sub_cents + vat_cents - total_cents) <= 100 as a, case when n_lines > 0 then doc_key % 6 <> 0 end as b, case when buyer is null then 1 else 0 end + case when total_cents is null then 1 else 0 end as u, doc_key % 23 <> 0 as ok from fx_head),
  t as (select count(*) as n, count(a) + count(b) as checks, count(*) filter (a) + count(*) filter (b) as held, cast(sum(u) as bigint) as u, count(*) filter (ok) as ok from h)
  select 'validation_success_rate' as metric, held / checks as value, checks as evaluated from t union all select 'unresolved_required_field_count', u, n from t union all select 'schema_validation_success_rate', ok / n, n from t""", "fx_head"))
def m18(spark, sf):
    pages = fixture(spark, sf, "fx_head").selectExpr(
        "abs(sub_cents + vat_cents - total_cents) <= 100 as total_check", "case when n_lines > 0 then doc_key % 6 <> 0 end as item_check",
        "case when buyer is null then 1 else 0 end + case when total_cents is null then 1 else 0 end as unresolved", "doc_key % 23 <> 0 as conforms")
    return M.validation_rates(pages).select("metric", "value", "evaluated")


@query("m19_macro_average", oracle("""
  select 'sub' as metric, round(avg(sub_cents / 100), 6) as value, count(sub_cents) as evaluated from fx_head union all select 'vat', round(avg(vat_cents / 100), 6), count(vat_cents) from fx_head
  union all select 'total', round(avg(total_cents / 100), 6), count(total_cents) from fx_head""", "fx_head"))
def m19(spark, sf):
    rows = fixture(spark, sf, "fx_head").selectExpr("sub_cents / 100 as sub", "vat_cents / 100 as vat", "total_cents / 100 as total")
    return M.macro_average(rows, ["sub", "vat", "total"]).withColumn("value", F.round("value", 6))


def _as_documents(spark, sf):
    """Source rows and annotation files of the printed documents themselves."""
    heads = fixture(spark, sf, "fx_print")
    docs = heads.select("document_id", F.concat(F.lit("scan/"), "serial", F.lit("/"), "document_id", F.lit(".pdf")).alias("relative_path"))
    files = heads.where("doc_key % 12 <> 5").select(
        F.concat(F.when(F.expr("doc_key % 6 = 0"), F.lit("moved/")).otherwise(F.concat(F.lit("scan/"), "serial", F.lit("/"))), "document_id", F.lit(".json")).alias("gt_path"),
        F.sha2("document_id", 256).alias("gt_sha256"))
    return docs, files


_WITHIN = _FINAL.replace('{only}', '').replace("from fx_gt g full outer join fx_pred p", "from (select * from fx_gt where doc_key % 12 <> 5) g full outer join (select * from fx_pred where doc_key % 12 <> 5 and document_id not like 'EXTRA%') p")


@query("m22_evaluate_predictions", oracle(f"""with {_WITHIN}, k as (select *, case when np > 0 then tp / np when ng = 0 then 1 else 0 end as fp_, case when ng > 0 then tp / ng when np = 0 then 1 else 0 end as fr_ from b)
  {" union all ".join(f"select '{n}' as metric, round(avg({e}), 9) as value, count(*) as evaluated from k" for n, e in (('field_exact_match', 'ex / paths'), ('normalized_field_accuracy', 'nex / paths'), ('item_row_precision', 'pr'), ('item_row_recall', 'rc'), ('item_row_f1', 'rf'), ('item_field_accuracy', 'ia'), ('document_exact_match', 'case when whole then 1.0 else 0.0 end'), ('field_level_precision', 'fp_'), ('field_level_recall', 'fr_'), ('field_level_f1', 'case when fp_ + fr_ > 0 then 2 * fp_ * fr_ / (fp_ + fr_) else 0 end'), ('character_error_rate', 'case when c > 0 then ce / c else 0 end')))}
  union all select 'target_documents', docs, docs from tot union all select 'missing_predictions', missing, docs from tot""", "fx_pred", "fx_items_pred"))
def m22(spark, sf):
    docs, files = _as_documents(spark, sf)
    result = evaluation.evaluate_predictions(docs, files, "", fixture(spark, sf, "fx_pred"), fixture(spark, sf, "fx_gt"),
                                             fixture(spark, sf, "fx_items_pred"), fixture(spark, sf, "fx_items_gt"), ITEM_COLUMNS)
    return result.withColumn("value", F.round("value", 9))


def _renamed(sql: str, suffix: str, *names: str) -> str:
    for name in names:
        sql = re.sub(rf"(?<![.\w]){name}(?= as \()|(?<=from ){name}\b|(?<=join ){name}\b", f"{name}_{suffix}", sql)
    return sql


_RUN_IOU = _renamed(_IOU, "box", "pairs", "m", "f")
_RUN_SETS = _renamed(_SETS.format(group="", key="", by=""), "ent", "j", "c").rsplit("  select  tp", 1)[0].replace(
    "p as (select distinct", "p_ent as (select distinct").replace("g as (select distinct", "g_ent as (select distinct").replace(
    "from p full outer join g", "from p_ent p full outer join g_ent g")


@query("m24_evaluate_run", oracle(f"""with {_RUN_IOU},
    {_WORDS}, tt as (select sum(levenshtein(p, e)) / sum(length(e)) as cer, sum(we) / sum(words) as wer, count(*) filter (p = e) / count(*) as x, count(*) filter (p = e and regexp_matches(e, '^[0-9.,+/% -]+$')) / count(*) filter (regexp_matches(e, '^[0-9.,+/% -]+$')) as nx from coded),
    {_RUN_SETS},
    ee as (select tp / (tp + fp) as p, tp / (tp + fn) as r from c_ent), {_FINAL.replace('{only}', "where paths > 0")}
  select 'detection' as stage, 'detection_iou' as metric, round(avg(iou), 9) as value from f_box union all select 'detection', 'detection_precision', round(avg(p), 9) from f_box union all select 'detection', 'detection_recall', round(avg(r), 9) from f_box union all select 'detection', 'detection_f1', round(avg(f1), 9) from f_box
  union all select 'recognition', 'recognition_cer', round(cer, 9) from tt union all select 'recognition', 'recognition_wer', round(wer, 9) from tt union all select 'recognition', 'recognition_exact_match', round(x, 9) from tt union all select 'recognition', 'recognition_numeric_accuracy', round(nx, 9) from tt
  union all select 'layout', 'entity_precision', round(p, 9) from ee union all select 'layout', 'entity_recall', round(r, 9) from ee union all select 'layout', 'entity_f1', round(2 * p * r / (p + r), 9) from ee union all select 'layout', 'field_exact_match', round(2 * p * r / (p + r), 9) from ee
  union all select 'final', metric, round(value, 9) from met""", "fx_box_pred", "fx_box_gt", "fx_txt", "fx_ent", "fx_pred", "fx_items_pred"))
def m24(spark, sf):
    run = evaluation.evaluate_run(
        boxes=(fixture(spark, sf, "fx_box_pred"), fixture(spark, sf, "fx_box_gt")),
        transcriptions=fixture(spark, sf, "fx_txt").withColumn("predicted", F.coalesce("predicted", F.lit(""))),
        entities=_entity_sides(spark, sf), final=_final(spark, sf))
    return run.select("stage", "metric", F.round("value", 9).alias("value"))
