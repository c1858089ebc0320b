"""Queries: annotation index, splits, structural checks, resume and quarantine."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.operators import checks, index, splits
from docledger.operators.identity import document_id
from docledger.sources import stages
from docledger.workload.fixtures import fixture, oracle, table
from docledger.workload.q_geometry import annotations
from docledger.workload.registry import query

_INDEX = """
  docs as (select *, sha256(lower(relative_path) || chr(0) || sha256) as document_id, replace(relative_path, '.PDF', '.json') as prediction_path from fx_source),
  under as (select *, substring(gt_path, 8) as rel, regexp_replace(gt_path, '.*/', '') as name from fx_files where gt_path like 'batch7/%'),
  solo as (select name, any_value(gt_path) as gt_path, any_value(gt_sha256) as gt_sha256 from under group by name having count(*) = 1),
  ix as (select d.*, coalesce(u.gt_path, s.gt_path) as gt_path, coalesce(u.gt_sha256, s.gt_sha256) as gt_sha256,
      case when u.gt_path is not null then 'path' when s.gt_path is not null then 'basename' else 'none' end as matched_by
    from docs d left join under u on u.rel = d.prediction_path left join solo s on u.rel is null and s.name = regexp_replace(d.prediction_path, '.*/', ''))"""


def _documents(spark, sf):
    return fixture(spark, sf, "fx_source").withColumn("document_id", document_id(F.col("relative_path"), F.col("sha256")))


def _index(spark, sf):
    return index.index_ground_truth(_documents(spark, sf), fixture(spark, sf, "fx_files"), "batch7")


@query("src8_pending_documents", oracle("""
  select relative_path, replace(relative_path, '.PDF', '.json') as prediction_path from fx_source where doc_key % 3 <> 0 or doc_key % 2 <> 0""", "fx_source"))
def src8(spark, sf):
    docs = fixture(spark, sf, "fx_source")
    done = docs.where("doc_key % 3 = 0").select("doc_key", F.when(F.col("doc_key") % 2 == 0, "success").otherwise("failed").alias("status"))
    pending = stages.pending_documents(docs, done, "doc_key")
    return pending.select("relative_path", stages.prediction_key(F.col("relative_path")).alias("prediction_path"))


@query("src9_quarantine", oracle("""
  select 'good' as outcome, cast(null as string) as message, count(*) as documents from fx_source where n_chars > 200 and n_chars < 60000 and doc_key % 21 <> 0
  union all select 'error', m, count(*) from (select case when n_chars <= 200 or n_chars >= 60000 then case when doc_key % 21 = 0 then 'text_length; hash_present' else 'text_length' end else 'hash_present' end as m
    from fx_source where not (n_chars > 200 and n_chars < 60000 and doc_key % 21 <> 0)) group by m""", "fx_source"))
def src9(spark, sf):
    docs = _documents(spark, sf).withColumn("sha256", F.when(F.expr("doc_key % 21 <> 0"), F.col("sha256")))
    docs = docs.withColumn("document_id", F.col("doc_key").cast("string"))
    good, errors = stages.quarantine(docs, {
        "text_length": (F.col("n_chars") > 200) & (F.col("n_chars") < 60000), "hash_present": F.col("sha256").isNotNull()}, "ingest")
    return good.groupBy(F.lit("good").alias("outcome"), F.lit(None).cast("string").alias("message")).agg(F.count(F.lit(1)).alias("documents")).unionByName(
        errors.groupBy(F.lit("error").alias("outcome"), "message").agg(F.count(F.lit(1)).alias("documents")))


@query("ix1_index_ground_truth", oracle(f"with {_INDEX} select document_id, relative_path, prediction_path, gt_path, gt_sha256, matched_by from ix", "fx_files"))
def ix1(spark, sf):
    return _index(spark, sf).select("document_id", "relative_path", "prediction_path", "gt_path", "gt_sha256", "matched_by")


@query("ix2_choose_prefix", oracle(f"""
  with {_INDEX}, plain as (select replace(relative_path, '.PDF', '.json') as p from fx_source),
  names as (select regexp_replace(gt_path, '.*/', '') as name, count(*) as n from fx_files group by 1),
  s as (select 'batch7' as prefix, 1 as candidate, count(*) filter (matched_by = 'path') as direct_matches, count(*) filter (matched_by <> 'none') as total_matches from ix
    union all select '', 0, count(*) filter (p in (select gt_path from fx_files)), count(*) filter (p in (select gt_path from fx_files) or coalesce(n, 0) = 1) from plain left join names on name = regexp_replace(p, '.*/', ''))
  select prefix, candidate, direct_matches, total_matches, cast(candidate = 1 as int) as chosen from s""", "fx_files"))
def ix2(spark, sf):
    scored = index.score_prefixes(_documents(spark, sf), fixture(spark, sf, "fx_files"), ["", "batch7"])
    return scored.withColumn("chosen", F.col("chosen").cast("int"))


@query("ix3_excluded_and_unmatched", oracle(f"""
  with {_INDEX} select 'excluded' as kind, gt_path as path from under where gt_path not in (select gt_path from ix where gt_path is not null)
  union all select 'unmatched', relative_path from ix where gt_path is null""", "fx_files"))
def ix3(spark, sf):
    ix = _index(spark, sf)
    return index.excluded_files(ix, fixture(spark, sf, "fx_files"), "batch7").select(F.lit("excluded").alias("kind"), F.col("gt_path").alias("path")).union(
        index.unmatched_sources(ix).select(F.lit("unmatched"), "relative_path"))


@query("ix4_index_integrity", oracle(f"""
  with {_INDEX} select 'document_id' as column_name, document_id as value, count(*) as "rows" from ix where gt_path is not null group by 2 having count(*) > 1
  union all select 'prediction_path', prediction_path, count(*) from ix where gt_path is not null group by 2 having count(*) > 1""", "fx_files"))
def ix4(spark, sf):
    return index.index_integrity(_index(spark, sf))


@query("ix5_changed_since_index", oracle(f"""
  with {_INDEX}, later as (select gt_path, case when ascii(right(gt_sha256, 1)) % 2 = 0 then sha256(gt_sha256) else gt_sha256 end as h from (select distinct * from fx_files) where left(gt_sha256, 1) <> '0')
  select document_id, ix.gt_path, case when h is null then 'missing' else 'changed' end as change from ix left join later on ix.gt_path = later.gt_path
  where ix.gt_path is not null and (h is null or h <> ix.gt_sha256)""", "fx_files"))
def ix5(spark, sf):
    files = fixture(spark, sf, "fx_files").distinct().where("left(gt_sha256, 1) <> '0'").withColumn(
        "gt_sha256", F.expr("case when ascii(right(gt_sha256, 1)) % 2 = 0 then sha2(gt_sha256, 256) else gt_sha256 end"))
    return index.changed_since_index(_index(spark, sf), files)


@query("ix6_restrict_to_targets", oracle(f"""
  with {_INDEX}, target as (select document_id from ix where gt_path is not null union select 'gone:' || document_id from ix where matched_by = 'basename')
  select 'kept' as kind, document_id from docs semi join target using (document_id)
  union all select 'absent', document_id from target anti join docs using (document_id)""", "fx_source", "fx_files"))
def ix6(spark, sf):
    ix = _index(spark, sf)
    targets = ix.where("gt_path is not null").select("document_id").union(
        ix.where("matched_by = 'basename'").select(F.concat(F.lit("gone:"), "document_id"))).distinct()
    kept, absent = index.restrict_to_targets(_documents(spark, sf), targets)
    return kept.select(F.lit("kept").alias("kind"), "document_id").union(absent.select(F.lit("absent"), "document_id"))


@query("sp1_hash_split", """
  with h as (select doc_id, cast('0x' || substring(sha256('42:' || cast(doc_id as string)), 1, 16) as ubigint) as v from documents)
  select doc_id, case when v < 14757395258967641292 then 'train' when v < 16602069666338596453 then 'validation' else 'test' end as split from h""")
def sp1(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", splits.hash_split(F.col("doc_id").cast("string"), 42).alias("split"))


def _text_ids(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"))


_SPLIT = """ranked as (select document_id, row_number() over (order by sha256('{"document_id":"' || document_id || '","seed":42}')) as position, count(*) over () as n
    from (select distinct cast(doc_id as string) as document_id from documents)),
  held as (select *, greatest(1, cast(round_even(n * 0.1, 0) as bigint)) as h from ranked),
  split as (select document_id, position, case when position <= n - 2 * h then 'train' when position <= n - h then 'validation' else 'test' end as split from held)"""


@query("sp2_locked_split", f"with {_SPLIT} select * from split")
def sp2(spark, sf):
    return splits.locked_split(_text_ids(spark, sf), 42)


@query("sp3_split_integrity", f"""with {_SPLIT}, a as (select document_id, split from split where cast(document_id as bigint) % 15 <> 0
    union all select document_id, 'test' from split where cast(document_id as bigint) % 35 = 1 and split <> 'test' union all select 'ghost' || document_id, 'train' from split where cast(document_id as bigint) % 90 = 0)
  select document_id, 'in_several_splits' as violation from a group by 1 having count(distinct split) > 1
  union all select document_id, 'not_assigned' from split where cast(document_id as bigint) % 15 = 0 union all select document_id, 'unknown_document' from a where document_id like 'ghost%'""")
def sp3(spark, sf):
    ids = _text_ids(spark, sf)
    key = F.col("document_id").cast("bigint")
    split = splits.locked_split(ids, 42).select("document_id", "split")
    damaged = split.where(key % 15 != 0).union(split.where((key % 35 == 1) & (F.col("split") != "test")).select("document_id", F.lit("test"))).union(
        split.where(key % 90 == 0).select(F.concat(F.lit("ghost"), "document_id"), F.lit("train")))
    return splits.split_integrity(damaged, ids)


@query("sp4_partition_annotations", f"""with {_SPLIT}, l as (select cast(doc_id as string) as document_id, quality from labels)
  select 'usable' as outcome, split, count(*) as "rows" from l join split using (document_id) where split <> 'test' group by 2
  union all select 'leak', 'test', count(distinct document_id) from l join split using (document_id) where split = 'test'
  union all select 'missing', split, count(*) from split where split <> 'test' and document_id not in (select document_id from l) group by 2""")
def sp4(spark, sf):
    split = splits.locked_split(_text_ids(spark, sf), 42)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").cast("string").alias("document_id"), "quality")
    usable, leaks, missing = splits.partition_annotations(labels, split)
    rows = F.count(F.lit(1)).alias("rows")
    return usable.groupBy(F.lit("usable").alias("outcome"), "split").agg(rows).unionByName(
        leaks.agg(rows).select(F.lit("leak").alias("outcome"), F.lit("test").alias("split"), "rows")).unionByName(
        missing.groupBy(F.lit("missing").alias("outcome"), "split").agg(rows))


@query("sp5_locked_manifest")
def sp5(spark, sf):
    return splits.locked_manifest(_documents(spark, sf), fixture(spark, sf, "fx_files"), 42)


def _damaged(spark, sf):
    key = F.col("doc_key")
    nested = annotations(spark, sf)
    damaged = nested.withColumn("pages", F.when(key % 16 == 0, F.slice("pages", 1, 0)).when(
        key % 18 == 2, F.transform("pages", lambda p: p.withField("boxes", F.slice(p["boxes"], 1, F.size(p["boxes"]) - 1)))).when(
        key % 22 == 4, F.transform("pages", lambda p: p.withField("boxes", F.transform(p["boxes"], lambda b: F.array(F.lit(1001), b[1], b[2], b[3]))))).when(
        key % 26 == 6, F.transform("pages", lambda p: p.withField("ignore_mask", F.array(F.lit(True))))).otherwise(F.col("pages"))).withColumn(
        "regions", F.when(key % 20 == 1, F.transform("regions", lambda r: r.withField("text", F.lit(None).cast("string")))).otherwise(F.col("regions")))
    # behind a generator: filters on the nested columns would otherwise build them a second time
    return damaged.select(F.inline(F.array(F.struct("document_id", "doc_key", "pages", "regions"))))


_DOCS = """ d as (select doc_key as k, count(*) as n from fx_tok group by 1),
  lay as (select k, n, case when k % 16 = 0 then 'pages_not_empty' when k % 18 = 2 then 'token_box_label_lengths' when k % 22 = 4 then 'boxes_are_four_integers_in_range'
     when k % 26 = 6 then case when n = 1 then '' else 'mask_matches_tokens' end else '' end as failed from d where k % 4 <> 1),
  det as (select k, case when k % 16 = 0 then 'pages_not_empty' else '' end as failed from d where k % 4 <> 1),
  rec as (select k, case when k % 20 = 1 then 'regions_have_text' else '' end as failed from d where k % 4 = 1),
  v as (select 'layout' as stage, k, failed from lay union all select 'detection', k, failed from det union all select 'recognition', k, failed from rec)"""


def _checked(spark, sf):
    nested = _damaged(spark, sf)
    paged, loose = nested.where("pages is not null"), nested.where("regions is not null")
    return checks.validate_annotations(paged, "layout").unionByName(checks.validate_annotations(paged, "detection")).unionByName(
        checks.validate_annotations(loose, "recognition"))


@query("v1_validate_ground_truth", oracle(f"with {_DOCS} select stage, failed as failed_rules, count(*) as annotations from v group by 1, 2", "fx_tok"))
def v1(spark, sf):
    return _checked(spark, sf).groupBy("stage", F.array_join("failed_rules", ",").alias("failed_rules")).agg(F.count(F.lit(1)).alias("annotations"))


@query("v2_require_annotations", oracle(f"""with {_DOCS} select stage, count(*) as annotations, count(*) filter (failed = '') as valid, cast(count(*) = count(*) filter (failed = '') as int) as usable,
   case when count(*) > count(*) filter (failed = '') then 'invalid annotations' end as reason from v group by 1""", "fx_tok"))
def v2(spark, sf):
    return checks.validation_summary(_checked(spark, sf)).withColumn("usable", F.col("usable").cast("int"))


@query("m21_stage_availability", oracle("""select * from (values ('detection', 0, 'pending', null), ('recognition', 1, 'pending', null), ('layout', 2, 'pending', null), ('final', 3, 'N/A', 'GT/final annotations are missing'))
   t(stage, stage_order, status, reason) where (select count(*) from fx_tok) > 0""", "fx_tok"))
def m21(spark, sf):
    return checks.stage_availability(checks.validation_summary(_checked(spark, sf)))
