"""Queries: weak-label alignment, reports and cleaning."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from docledger.operators import align as L
from docledger.operators import clean as K
from docledger.operators import reports as P
from docledger.workload.fixtures import fixture, oracle
from docledger.workload.q_index import _DOCS, _checked
from docledger.workload.q_normalize import _N4, _PARSE
from docledger.workload.registry import query

_SPANS = """runs as (select document_id, page_index, list(struct_pack(i := region_id, t := trim(text), x0 := x_min, y0 := y_min, x1 := x_max, y1 := y_max) order by y_min, x_min, region_id) as rs from fx_regions group by 1, 2),
  starts as (select *, unnest(range(1, len(rs) + 1)) as start from runs), sized as (select *, unnest(range(1, least(12, len(rs) - start + 1) + 1)) as size from starts),
  spans as (select document_id, page_index, start, size, array_to_string(list_filter(list_transform(rs[start:start + size - 1], lambda r: r.t), lambda t: t <> ''), ' ') as text,
     list_sum(list_transform(rs[start:start + size - 1], lambda r: (r.y0 + r.y1) / 2)) / size as cy, list_sum(list_transform(rs[start:start + size - 1], lambda r: (r.x0 + r.x1) / 2)) / size as cx from sized)"""


def _stepwise(sql: str) -> str:
    """The same text with every named step kept as a table, so that no step is planned into the next."""
    return re.sub(r"(?<=[\s,])(\w+) as \((?=\s*select)", r"\1 as materialized (", sql)


def _stepwise_oracle(body: str, *names: str) -> str:
    return _stepwise(oracle(body, *names))


def _regions(spark, sf):
    return fixture(spark, sf, "fx_regions")


def _fields(spark, sf):
    return fixture(spark, sf, "fx_fields")


@query("al1_spans", oracle(f"""with {_SPANS} select document_id, page_index, size, count(*) as spans, cast(sum(length(text) * start) as bigint) as check_sum, round(sum(cx), 4) as center_x, round(sum(cy), 4) as center_y from spans where text <> '' group by 1, 2, 3""", "fx_regions"))
def al1(spark, sf):
    return L.spans(_regions(spark, sf)).groupBy("document_id", "page_index", F.col("size").cast("bigint").alias("size")).agg(
        F.count(F.lit(1)).alias("spans"), F.sum(F.length("text") * F.col("start")).alias("check_sum"),
        F.round(F.sum("center_x"), 4).alias("center_x"), F.round(F.sum("center_y"), 4).alias("center_y"))


_PAGE = "case when doc_key % 6 = 5 then page_index + 40 else page_index end"


@query("al2_gate_pages", oracle(f"""with pages as (select distinct document_id, page_index from fx_regions), f as (select document_id, field_path, {_PAGE} as p from fx_fields)
   select f.document_id, field_path, page_index as match_page from f join pages on f.document_id = pages.document_id and (pages.page_index = f.p or f.p not in (select q.page_index from pages q where q.document_id = f.document_id))""".replace(
    "or f.p not in (select q.page_index from pages q where q.document_id = f.document_id)", "or f.p >= 40"), "fx_fields", "fx_regions"))
def al2(spark, sf):
    fields = _fields(spark, sf).withColumn("page_index", F.expr(_PAGE))
    return L.gate_pages(fields, _regions(spark, sf)).select("document_id", "field_path", "match_page")


def _form(text: str) -> str:
    return _N4.format(c=text)


_ISO = "case when regexp_matches({t}, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') then substring({t}, 7, 4) || '-' || substring({t}, 4, 2) || '-' || substring({t}, 1, 2) when regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then {t} end"
_NUMERIC = "case when regexp_full_match({t}, '[+-]?\\s*[0-9]+([.\\s][0-9]+)*\\s*(%|vnd|d|dong)?') then trim(regexp_replace({t}, '\\s*(%|vnd|d|dong)\\s*$', '')) end"
_REST = ", ".join(
    f"case {' '.join(f'''when fold like '{p} %' then nullif(trim(substring(fold, {len(p) + 2})), '')''' for p in L.VALUE_PREFIXES[label])} end as rest_{label.lower()}"
    for label in ("INVOICE_NUMBER", "SUBTOTAL", "GRAND_TOTAL"))
_LABELS = ("invoice_number", "subtotal", "grand_total")
_CANDIDATES = f"""{_SPANS},
  s1 as (select *, {_form('text')} as norm, trim(regexp_replace(text, '\\s+', ' ', 'g')) as ws from spans where text <> ''), s2 as (select *, replace(strip_accents(norm), 'đ', 'd') as fold from s1), s3 as (select *, {_REST}, {_NUMERIC.format(t='fold')} as num_text from s2),
  s4 as (select *, regexp_replace(norm, '[^0-9a-zA-ZÀ-ỹ]+', '', 'g') as ident, {_ISO.format(t='fold')} as day, {", ".join(f"{_NUMERIC.format(t='rest_' + n)} as numtext_{n}" for n in _LABELS)} from s3),
  f1 as (select *, {_form('gt_value')} as norm, trim(regexp_replace(gt_value, '\\s+', ' ', 'g')) as ws from fx_fields), f2 as (select *, replace(strip_accents(norm), 'đ', 'd') as fold, regexp_replace(norm, '[^0-9a-zA-ZÀ-ỹ]+', '', 'g') as ident,
      case when normalization_kind = 'date' then {_ISO.format(t='gt_value')} end as day from f1),
  src as (select distinct text from (select num_text as text from s4 union all select numtext_invoice_number from s4 union all select numtext_subtotal from s4 union all select numtext_grand_total from s4 union all select gt_value from fx_fields where normalization_kind in ('number', 'money'))
      where text is not null), {_PARSE},
  nums as (select text, number from parsed where number is not null),
  s5 as (select s4.*, a.number as num, {", ".join(f"b_{n}.number as num_{n}" for n in _LABELS)} from s4 left join nums a on a.text = num_text {" ".join(f"left join nums b_{n} on b_{n}.text = numtext_{n}" for n in _LABELS)}),
  f3 as (select f2.*, case when normalization_kind in ('number', 'money') then nums.number end as num from f2 left join nums on nums.text = f2.gt_value),
  met as (select f.document_id, f.field_path, f.normalization_kind as kind, s.page_index, s.start, s.size, s.cx, s.cy, f.norm as g, s.norm as o,
      case when s.text = f.gt_value then 0 when s.ws = f.ws then 1
        when f.fold = case f.label when 'INVOICE_NUMBER' then rest_invoice_number when 'SUBTOTAL' then rest_subtotal when 'GRAND_TOTAL' then rest_grand_total end then 2
        when s.norm <> '' and s.norm = f.norm then 3 when f.normalization_kind = 'identifier' and s.ident <> '' and s.ident = f.ident then 4
        when f.num = coalesce(s.num, case f.label when 'INVOICE_NUMBER' then num_invoice_number when 'SUBTOTAL' then num_subtotal when 'GRAND_TOTAL' then num_grand_total end) then 5
        when f.day = s.day then 6
        when length(f.norm) >= 3 and (contains(s.norm, f.norm) or contains(f.norm, s.norm)) and least(length(f.norm), length(s.norm)) / greatest(length(f.norm), length(s.norm)) >= 0.55 then 7 end as rank
    from f3 f join s5 s on f.document_id = s.document_id and f.page_index = s.page_index),
  cand as (select document_id, field_path, page_index, start, size, cx, cy, rank >= 7 as weak, case when size > 1 then 'multi_box_' else '' end || case rank when 0 then 'exact' when 1 then 'whitespace_normalized' when 2 then 'anchored_exact_normalized'
        when 3 then 'exact_normalized' when 4 then 'identifier_normalized' when 5 then case kind when 'money' then 'money_normalized' else 'number_normalized' end when 6 then 'date_normalized' else 'value_substring' end as method,
      case rank when 0 then 1.0 when 1 then 0.995 when 2 then 0.985 when 3 then 0.99 when 7 then least(0.89, 0.72 + 0.15 * (least(length(g), length(o)) / greatest(length(g), length(o)))) else 0.98 end as confidence from met where rank is not null),
  kept as (select * from cand c where not exists (select 1 from cand k where k.document_id = c.document_id and k.field_path = c.field_path and k.page_index = c.page_index and k.start >= c.start and k.start + k.size <= c.start + c.size and k.size < c.size and k.confidence >= c.confidence)),
  ranked as (select *, row_number() over (partition by document_id, field_path order by confidence desc, size, page_index, cy, cx, start) as position, count(*) over (partition by document_id, field_path) as candidate_count
     from (select *, bool_or(not weak) over (partition by document_id, field_path) as strong from kept) where not strong or not weak)"""
_CAND_OUT = "document_id, field_path, page_index, cast(start as bigint) as start, cast(size as bigint) as size, method, round(confidence, 9) as confidence"


def _shown(candidates, *more):
    return candidates.select("document_id", "field_path", "page_index", F.col("start").cast("bigint").alias("start"), F.col("size").cast("bigint").alias("size"), "method",
                             F.round("confidence", 9).alias("confidence"), *more)


def _candidates(spark, sf, fuzzy=False):
    return L.match_cascade(_fields(spark, sf), _regions(spark, sf), fuzzy=fuzzy)


@query("al3_match_cascade", oracle(f"with {_CANDIDATES} select {_CAND_OUT} from cand", "fx_fields", "fx_regions"))
def al3(spark, sf):
    return _shown(_candidates(spark, sf))


# matching blocks of a pair: the longest common piece, first in g, then in o, and the same on either side of it
_FUZZY = f"""{_CANDIDATES},
  unsure as (select * from met where rank is null and least(length(g), length(o)) >= {L.MIN_FUZZY} and 2 * least(length(g), length(o)) >= {L.FUZZY_RATIO} * (length(g) + length(o))
     and levenshtein(g, o) <= {1 - L.FUZZY_RATIO} * (length(g) + length(o)) + 1e-9),
  blocks as (
    select distinct g, o, g as a, o as b, 0 as taken from unsure
    union all
    select g, o, p.a, p.b, p.taken from (
      select g, o, unnest([{{'a': substring(a, 1, m.i - 1), 'b': substring(b, 1, m.j - 1), 'taken': 0}}, {{'a': substring(a, m.i + m.l), 'b': substring(b, m.j + m.l), 'taken': 0}}, {{'a': '', 'b': '', 'taken': m.l}}]) as p
      from (select g, o, a, b, flatten(list_transform(range(least(length(a), length(b)), 0, -1), lambda l: list_filter(list_transform(range(1, length(a) - l + 2), lambda i:
          {{'l': l, 'i': i, 'j': strpos(b, substring(a, i, l))}}), lambda x: x.j > 0)))[1] as m from blocks where a <> '' and b <> '') where m is not null)),
  alike as (select g, o, 2 * sum(taken) / (length(g) + length(o)) as ratio from blocks group by g, o)"""


@query("al4_fuzzy_match", oracle(f"""with recursive {_FUZZY} select document_id, field_path, page_index, cast(start as bigint) as start, cast(size as bigint) as size,
   case when size > 1 then 'multi_box_' else '' end || 'fuzzy' as method, round(ratio, 9) as confidence from unsure join alike using (g, o) where ratio >= {L.FUZZY_RATIO}""", "fx_fields", "fx_regions"))
def al4(spark, sf):
    return _shown(_candidates(spark, sf, fuzzy=True).where(F.col("method").endswith("fuzzy")))


@query("al5_prune_spans", oracle(f"with {_CANDIDATES} select {_CAND_OUT} from kept", "fx_fields", "fx_regions"))
def al5(spark, sf):
    return _shown(L.prune_spans(_candidates(spark, sf)))


@query("al6_rank_candidates", oracle(f"with {_CANDIDATES} select {_CAND_OUT}, position, candidate_count from ranked", "fx_fields", "fx_regions"))
def al6(spark, sf):
    ranked = L.rank_candidates(L.prune_spans(_candidates(spark, sf)))
    return _shown(ranked, F.col("position").cast("bigint").alias("position"), "candidate_count")


@query("al8_assign")
def al8(spark, sf):
    matches = L.align(_fields(spark, sf), _regions(spark, sf))
    return matches.select("document_id", "field_path", F.array_join("region_ids", ",").alias("region_ids"), "match_method",
                          F.round("match_confidence", 9).alias("match_confidence"), "ambiguous", "candidate_count")


# ---------------------------------------------------------------- results of given matches
def _aligned(spark, sf):
    return fixture(spark, sf, "fx_align")


@query("al11_region_labels", oracle("""with u as (select document_id, label, unnest(region_ids) as region_id, unnest(range(len(region_ids))) as i from fx_align where not ambiguous)
   select document_id, region_id, case when i = 0 then 'B-' else 'I-' end || label as region_label from u""", "fx_align"))
def al11(spark, sf):
    return L.region_labels(_aligned(spark, sf))


@query("al12_alignment_rows", _stepwise_oracle("""with u as (select document_id, field_path, unnest(region_ids) as region_id, unnest(range(len(region_ids))) as i from (select document_id, field_path, [region_id] as region_ids from m1)),
   m1 as (select f.document_id, f.field_path, r.region_id from fx_fields f join fx_regions r on r.document_id = f.document_id and r.ord = f.ord)
   select m1.document_id, m1.field_path, nullif(trim(r.text), '') as ocr_text, r.detection_confidence, r.recognition_confidence, f.gt_value, r.page_index + 1 as page from m1 join fx_regions r on r.region_id = m1.region_id join fx_fields f on f.document_id = m1.document_id and f.field_path = m1.field_path""".replace(
    "with u as (select document_id, field_path, unnest(region_ids) as region_id, unnest(range(len(region_ids))) as i from (select document_id, field_path, [region_id] as region_ids from m1)),\n   m1", "with m1"), "fx_fields", "fx_regions"))
def al12(spark, sf):
    fields, regions = _fields(spark, sf), _regions(spark, sf)
    matches = fields.select("document_id", "field_path", "label", "ord").join(
        regions.select("document_id", "ord", "region_id", "page_index"), ["document_id", "ord"]).select(
        "document_id", "field_path", "label", "page_index", F.array("region_id").alias("region_ids"), F.lit(False).alias("ambiguous"))
    rows = L.alignment_rows(matches, fields, regions)
    return rows.select("document_id", "field_path", "ocr_text", "detection_confidence", "recognition_confidence", "gt_value", "page")


@query("al13_layout_pages", oracle("""with t as (select document_id, page_index, region_id, text, y_min, x_min, case when ord % 3 = 0 then 'B-UNIT' else 'O' end as label, least(1000, greatest(0, cast(round_even(x_max / 700 * 1000, 0) as bigint))) as b from fx_regions)
   select document_id, page_index, string_agg(text, '|' order by y_min, x_min, region_id) as tokens, string_agg(label, '|' order by y_min, x_min, region_id) as labels, string_agg(cast(b as string), '|' order by y_min, x_min, region_id) as right_edges from t group by 1, 2""", "fx_regions"))
def al13(spark, sf):
    regions = _regions(spark, sf)
    labels = regions.where("ord % 3 = 0").select("document_id", "region_id", F.lit("B-UNIT").alias("region_label"))
    sizes = regions.select("document_id", "page_index").distinct().withColumn("width", F.lit(700)).withColumn("height", F.lit(1000))
    pages = L.layout_pages(regions, labels, sizes)
    return pages.select("document_id", "page_index", F.array_join("tokens", "|").alias("tokens"), F.array_join("labels", "|").alias("labels"),
                        F.array_join(F.transform("boxes", lambda b: b[2].cast("string")), "|").alias("right_edges"))


# ---------------------------------------------------------------- reports
_REPORT = """rep as (select f.document_id, f.field_path, f.label, f.gt_value, case when a.match_method is null then 'unmatched' else 'matched' end as status, coalesce(a.ocr_text, '') as ocr_text, f.page_index + 1 as page,
    coalesce(a.match_method, 'unmatched') as match_method, coalesce(a.match_confidence, 0) as match_confidence, coalesce(a.ambiguous, false) as ambiguous, coalesce(a.duplicate_candidates, false) as dup, coalesce(a.candidate_count, 0) as candidate_count,
    coalesce(a.training_eligible, false) as ok, levenshtein(a.ocr_text, f.gt_value) as errors, case when a.match_method is not null then length(f.gt_value) end as chars from fx_fields f left join fx_align a on a.document_id = f.document_id and a.field_path = f.field_path)"""
_TOTALS = """count(*) as total_gt_fields, count(*) filter (status = 'matched') as matched_fields, count(*) filter (ok) as training_eligible_fields, count(*) filter (ambiguous) as ambiguous_matches, count(*) filter (match_method in ('exact', 'multi_box_exact')) as exact_matches,
    count(*) filter (match_method like '%normalized%') as normalized_matches, count(*) filter (dup) as duplicate_candidate_matches, cast(coalesce(sum(errors), 0) as bigint) as matched_character_errors, cast(coalesce(sum(chars), 0) as bigint) as matched_expected_characters,
    cast(coalesce(sum(errors) filter (ok), 0) as bigint) as training_eligible_character_errors, cast(coalesce(sum(chars) filter (ok), 0) as bigint) as training_eligible_expected_characters"""
_RATES = """total_gt_fields - matched_fields as unmatched_fields, matched_fields / total_gt_fields * 100 as coverage_percent, training_eligible_fields / total_gt_fields * 100 as training_coverage_percent,
    coalesce(matched_character_errors / nullif(matched_expected_characters, 0), 0) as matched_field_character_error_rate, coalesce(training_eligible_character_errors / nullif(training_eligible_expected_characters, 0), 0) as training_eligible_field_character_error_rate"""


def _report(spark, sf):
    return P.alignment_report(_fields(spark, sf), _aligned(spark, sf))


@query("rp1_alignment_report", _stepwise_oracle(f"with {_REPORT} select document_id, field_path, status, ocr_text, page, match_method, match_confidence, candidate_count, cast(ok as int) as training_eligible, coalesce(errors, -1) as character_errors, coalesce(chars, -1) as expected_characters, coalesce(errors / nullif(chars, 0), -1) as character_error_rate from rep", "fx_fields", "fx_align"))
def rp1(spark, sf):
    return _report(spark, sf).select("document_id", "field_path", "status", "ocr_text", "page", "match_method", "match_confidence", "candidate_count",
                                     F.col("training_eligible").cast("int").alias("training_eligible"), *[F.coalesce(F.col(c), F.lit(-1)).alias(c) for c in ("character_errors", "expected_characters", "character_error_rate")])


@query("rp2_report_summary", oracle(f"with {_REPORT}, t as (select {_TOTALS} from rep) select *, {_RATES} from t", "fx_fields", "fx_align"))
def rp2(spark, sf):
    return P.report_summary(_report(spark, sf))


@query("rp5_coverage", oracle(f"""with {_REPORT}, t as (select 'label' as level, label as name, {_TOTALS} from rep group by label union all select 'document', document_id, {_TOTALS} from rep group by document_id union all select 'all', 'all', {_TOTALS} from rep) select *, {_RATES} from t""", "fx_fields", "fx_align"))
def rp5(spark, sf):
    return P.coverage(_report(spark, sf))


# ---------------------------------------------------------------- cleaning
_CLEAN = """cls as (select *, case when len(region_ids) = 0 then 'IGNORE' when len(list_distinct(region_ids)) < len(region_ids) then 'IGNORE' when ambiguous or not training_eligible or duplicate_candidates or candidate_count > 1 or len(region_ids) > 1
       or regexp_replace(match_method, '^multi_box_', '') not in ('exact', 'whitespace_normalized', 'exact_normalized', 'money_normalized') or match_confidence < 0.98 or recognition_confidence < 0.8 or detection_confidence < 0.8 then 'REVIEW' else 'KEEP' end as d0,
     case when len(list_distinct(region_ids)) < len(region_ids) then 'alignment_repeats_region' when ambiguous then 'ambiguous_match' when not training_eligible then 'source_not_training_eligible' when duplicate_candidates or candidate_count > 1 then 'duplicate_candidates'
       when len(region_ids) > 1 then 'multi_box_match' when regexp_replace(match_method, '^multi_box_', '') not in ('exact', 'whitespace_normalized', 'exact_normalized', 'money_normalized') then 'method_requires_review:' || match_method
       when match_confidence < 0.98 then 'low_match_confidence' when recognition_confidence < 0.8 then 'low_recognition_confidence' when detection_confidence < 0.8 then 'low_detection_confidence' else 'safe_exact_or_typed_normalized_match' end as r0 from fx_align),
  uses as (select document_id, field_path, label, d0, unnest(region_ids) as region_id, unnest(range(len(region_ids))) as i from cls), mis as (select distinct u.document_id, u.field_path from uses u anti join fx_align_tokens t on t.document_id = u.document_id and t.region_id = u.region_id),
  ku as (select u.* from uses u anti join mis m on m.document_id = u.document_id and m.field_path = u.field_path), con as (select document_id, region_id from ku group by 1, 2 having count(distinct field_path) > 1),
  sh as (select distinct k.document_id, k.field_path from ku k semi join con c on c.document_id = k.document_id and c.region_id = k.region_id),
  dec as (select c.*, case when m.field_path is not null or s.field_path is not null then 'IGNORE' else d0 end as decision, case when m.field_path is not null then 'alignment_region_missing_from_tokens' when s.field_path is not null then 'region_shared_by_multiple_fields' else r0 end as reason
    from cls c left join mis m using (document_id, field_path) left join sh s using (document_id, field_path)),
  du as (select document_id, label, decision, unnest(region_ids) as region_id, unnest(range(len(region_ids))) as i from dec),
  reg as (select document_id, region_id, max(case when decision = 'KEEP' then case when i = 0 then 'B-' else 'I-' end || label end) as l, bool_or(decision <> 'KEEP') as m from du group by 1, 2),
  tok as (select t.*, coalesce(l, 'O') as clean_label, cast(coalesce(m, false) as int) as ignore_mask from fx_align_tokens t left join reg using (document_id, region_id)),
  every as (select document_id, field_path, label, decision, reason from dec union all select document_id, field_path, label, 'IGNORE', 'unmatched_no_region' from fx_fields f anti join fx_align a on a.document_id = f.document_id and a.field_path = f.field_path)"""


def _tokens(spark, sf):
    return fixture(spark, sf, "fx_align_tokens")


def _resolved(spark, sf):
    return K.resolve_conflicts(K.classify_alignment(_aligned(spark, sf)), _tokens(spark, sf))


@query("cl1_classify_alignment", oracle(f"with {_CLEAN} select document_id, field_path, d0 as decision, r0 as reason from cls", "fx_align", "fx_align_tokens"))
def cl1(spark, sf):
    return K.classify_alignment(_aligned(spark, sf)).select("document_id", "field_path", "decision", "reason")


@query("cl2_resolve_conflicts", _stepwise_oracle(f"with {_CLEAN} select document_id, field_path, decision, reason from dec", "fx_align", "fx_align_tokens"))
def cl2(spark, sf):
    return _resolved(spark, sf).select("document_id", "field_path", "decision", "reason")


@query("cl3_clean_labels", oracle(f"with {_CLEAN} select document_id, region_id, token, clean_label, ignore_mask from tok", "fx_align", "fx_align_tokens"))
def cl3(spark, sf):
    return K.clean_labels(_tokens(spark, sf), _resolved(spark, sf)).select("document_id", "region_id", "token", "clean_label", F.col("ignore_mask").cast("int").alias("ignore_mask"))


@query("cl4_region_integrity", oracle("select document_id, token as region_id, count(*) as tokens from fx_align_tokens group by 1, 2 having count(*) > 1", "fx_align_tokens"))
def cl4(spark, sf):
    return K.region_integrity(_tokens(spark, sf).withColumn("region_id", F.col("token")))


@query("cl5_review_queue", _stepwise_oracle(f"with {_CLEAN} select document_id, field_path, reason, match_method from dec where decision = 'REVIEW'", "fx_align", "fx_align_tokens"))
def cl5(spark, sf):
    return K.review_queue(_resolved(spark, sf)).select("document_id", "field_path", "reason", "match_method")


@query("cl6_cleaning_report", oracle(f"""with {_CLEAN}, t as (select 'label' as level, label as name, decision from every union all select 'reason', reason, decision from every union all select 'all', 'all', decision from every)
   select level, name, count(*) as total_fields, count(*) filter (decision = 'KEEP') as keep_fields, count(*) filter (decision = 'REVIEW') as review_fields, count(*) filter (decision = 'IGNORE') as ignore_fields,
     count(*) filter (decision = 'KEEP') / count(*) * 100 as clean_training_coverage_percent from t group by 1, 2""", "fx_align", "fx_align_tokens"))
def cl6(spark, sf):
    return K.cleaning_report(K.with_unmatched(_resolved(spark, sf), _fields(spark, sf)))


@query("cl6_token_counts", oracle(f"with {_CLEAN} select count(*) as tokens, count(*) filter (ignore_mask = 1) as ignored_tokens, count(*) filter (ignore_mask = 0) as supervised_tokens from tok", "fx_align", "fx_align_tokens"))
def cl6t(spark, sf):
    return K.token_counts(K.clean_labels(_tokens(spark, sf), _resolved(spark, sf)))


@query("rp6_inspect_labels", oracle(f"""with {_DOCS}, {_CLEAN}, a as (select count(*) as annotations, count(*) filter (failed <> '') as invalid_annotations from v),
   f as (select 'cleaned' as basis, count(*) as total_fields, count(*) filter (decision = 'KEEP') as usable_fields from every union all
     select 'alignment', count(*), count(*) filter (training_eligible) from fx_fields left join fx_align using (document_id, field_path))
   select annotations, invalid_annotations, total_fields, usable_fields, cast(annotations > 0 and invalid_annotations = 0 as int) as valid, basis, usable_fields / total_fields * 100 as usable_percent from a, f""",
    "fx_tok", "fx_align", "fx_align_tokens", "fx_fields"))
def rp6(spark, sf):
    checked = _checked(spark, sf)
    cleaned = P.inspect_labels(checked, K.with_unmatched(_resolved(spark, sf), _fields(spark, sf)))
    return cleaned.unionByName(P.inspect_labels(checked, _report(spark, sf))).withColumn("valid", F.col("valid").cast("int"))
