"""Queries: run comparison, roll-ups, training data, probe and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.labels import PROTOCOL_ATTRIBUTES, bio_ids
from docledger.operators import compare as C
from docledger.operators import rollup as U
from docledger.operators import scoring as S
from docledger.operators import training as T
from docledger.operators.splits import hash_split
from docledger.workload.fixtures import fixture, oracle, table
from docledger.workload.q_geometry import annotations
from docledger.workload.registry import query

_CLASS = """case when b is null or a is null then 'N/A' when a = b then 'unchanged' when (case when lower_better then a < b else a > b end) then 'improved' else 'regressed' end as classification,
   a - b as absolute_change, case when b <> 0 then (a - b) / abs(b) * 100 end as relative_change_percent"""
_METRICS = f"""j as (select coalesce(x.metric, y.metric) as metric, x.value as b, y.value as a from fx_run_before x full outer join fx_run_after y on x.metric = y.metric),
   k as (select *, case when metric = 'character_error_rate' then true else regexp_matches(metric, 'cer|wer|latency|time|runtime|memory|ram|unresolved|failed') end as lower_better from j),
   cmp as (select metric, b as before, a as after, cast(lower_better as int) as lower_is_better, {_CLASS} from k)"""


def _sides(spark, sf):
    flag = F.when(F.col("metric") == "character_error_rate", F.lit(True))
    return [fixture(spark, sf, f"fx_run_{s}").withColumn("lower_is_better", flag) for s in ("before", "after")]


@query("cp1_numeric_metrics", oracle("""
  select event_type || '_' || cast(user_id % 10 as string) as run_id, 'plain' as metric, cast(sum(cast(round(value * 100) as bigint)) as bigint) / 100 as value, cast(null as string) as flag from events group by 1
  union all select event_type || '_' || cast(user_id % 10 as string), 'recorded', count(*) / 2, 'true' from events group by 1"""))
def cp1(spark, sf):
    events = table(spark, sf, "events")
    payload = F.concat(
        F.lit('{"metrics":{"plain":'), (F.sum(F.round(F.col("value") * 100).cast("bigint")) / 100).cast("string"), F.lit(',"ok":true,"text":"7","recorded":{"value":'),
        (F.count(F.lit(1)) / 2).cast("string"), F.lit(',"lower_is_better":true},"absent":{"value":null}}}'))
    runs = events.groupBy(F.concat_ws("_", "event_type", (F.col("user_id") % 10).cast("string")).alias("run_id")).agg(payload.alias("payload"))
    return C.numeric_metrics(runs, "payload").select("run_id", "metric", "value", F.col("lower_is_better").cast("string").alias("flag"))


@query("cp3_compare_metrics", oracle(f"with {_METRICS} select * from cmp", "fx_run_before", "fx_run_after"))
def cp3(spark, sf):
    return C.compare_metrics(*_sides(spark, sf)).withColumn("lower_is_better", F.col("lower_is_better").cast("int"))


_DOCS = f"""dj as (select x.document_id, x.value as b, y.value as a, true as lower_better from fx_docs_before x join fx_docs_after y on x.document_id = y.document_id), dcmp as (select document_id, b as before, a as after, {_CLASS} from dj)"""


def _documents(spark, sf):
    return C.compare_common(fixture(spark, sf, "fx_docs_before"), fixture(spark, sf, "fx_docs_after"), "document_id", "document_runtime")


@query("cp4_compare_documents", oracle(f"with {_DOCS} select * from dcmp", "fx_docs_before", "fx_docs_after"))
def cp4(spark, sf):
    return _documents(spark, sf)


@query("cp4_document_counts", oracle(f'with {_DOCS} select classification, count(*) as "rows" from dcmp group by 1', "fx_docs_before", "fx_docs_after"))
def cp4c(spark, sf):
    return C.classification_counts(_documents(spark, sf))


@query("cp5_compare_fields", oracle(f"with dj as (select x.field, x.value as b, y.value as a, false as lower_better from fx_fields_before x join fx_fields_after y on x.field = y.field) select field, b as before, a as after, {_CLASS} from dj", "fx_fields_before", "fx_fields_after"))
def cp5(spark, sf):
    return C.compare_common(fixture(spark, sf, "fx_fields_before"), fixture(spark, sf, "fx_fields_after"), "field")


@query("cp6_compare_timings", oracle(f"""with t as (select 'u' || cast(user_id % 20 as string) || case when user_id % 2 = 0 then '_time' else '_count' end as metric, cast(sum(cast(round(value * 100) as bigint)) filter (ts < timestamp '2024-01-16 00:00:00') as bigint) / 100 as b, cast(sum(cast(round(value * 100) as bigint)) filter (ts >= timestamp '2024-01-16 00:00:00') as bigint) / 100 as a from events group by 1),
  k as (select *, metric like '%_time' as lower_better from t) select metric, b as before, a as after, cast(lower_better as int) as lower_is_better, {_CLASS} from k"""))
def cp6(spark, sf):
    events = table(spark, sf, "events").withColumn("metric", F.expr("'u' || cast(user_id % 20 as string) || case when user_id % 2 = 0 then '_time' else '_count' end"))
    value = (F.sum(F.round(F.col("value") * 100).cast("bigint")) / 100).alias("value")
    early = F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp")
    compared = C.compare_metrics(events.where(early).groupBy("metric").agg(value), events.where(~early).groupBy("metric").agg(value))
    return compared.withColumn("lower_is_better", F.col("lower_is_better").cast("int"))


@query("cp7_fairness", oracle(f"""with s as (select case when ts < timestamp '2024-01-16 00:00:00' then 'before' else 'after' end as side, cast(count(distinct user_id) as string) as users, cast(count(distinct event_type) as string) as kinds from events group by 1),
  b as (select * from s where side = 'before'), a as (select * from s where side = 'after'), n as (select unnest([{", ".join(f"'{x}'" for x in PROTOCOL_ATTRIBUTES)}]) as attribute),
  r as (select attribute, attribute in ('split_manifest_hash', 'test_document_ids', 'schema_version') as strict,
     case attribute when 'split_manifest_hash' then 'before' when 'test_document_ids' then b.users when 'schema_version' then b.kinds when 'batch_size' then null when 'device' then 'cpu' end as before,
     case attribute when 'split_manifest_hash' then 'after' when 'test_document_ids' then a.users when 'schema_version' then a.kinds when 'batch_size' then a.kinds when 'device' then 'cpu' end as after from n, a, b)
  select attribute, cast(strict as int) as strict, before, after, case when before is not distinct from after then 'equal' when strict then 'refused' else 'different' end as verdict from r"""))
def cp7(spark, sf):
    side = F.when(F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp"), "before").otherwise("after")
    seen = table(spark, sf, "events").groupBy(side.alias("side")).agg(
        F.count_distinct("user_id").cast("string").alias("users"), F.count_distinct("event_type").cast("string").alias("kinds"))
    none = F.lit(None).cast("string")
    given = {"split_manifest_hash": F.col("side"), "test_document_ids": F.col("users"), "schema_version": F.col("kinds"),
             "batch_size": F.when(F.col("side") == "after", F.col("kinds")), "device": F.lit("cpu")}
    return C.fairness(seen.select("side", *[given.get(a, none).alias(a) for a in PROTOCOL_ATTRIBUTES])).withColumn("strict", F.col("strict").cast("int"))


@query("cp8_conclusion", oracle(f"""with {_METRICS}, t as (select count(*) filter (classification = 'improved') as improved, count(*) filter (classification = 'regressed') as regressed from cmp)
  select *, case when improved > 0 and regressed = 0 then 'fine-tuning improved the measured quality metrics' when improved > 0 then 'fine-tuning produced mixed quality changes' else 'fine-tuning did not improve the measured quality metrics' end as conclusion from t""", "fx_run_before", "fx_run_after"))
def cp8(spark, sf):
    return C.conclusion(C.compare_metrics(*_sides(spark, sf)))


# ---------------------------------------------------------------- roll-ups
_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("ru2_benchmark_table", oracle(f"""with r as (select run_id, count(*) as events, max(status) as status from fx_times group by 1)
  select run_id, events, status, {", ".join(f"cast(sum(millis) filter (stage = '{t}') as bigint) as {t}" for t in _TYPES)} from fx_times join r using (run_id, status) right join (select run_id as rid from r) on rid = run_id group by all""".replace("""select run_id, events, status, """, """select r.run_id, any_value(r.events) as events, any_value(r.status) as status, """).replace("from fx_times join r using (run_id, status) right join (select run_id as rid from r) on rid = run_id group by all", "from r join fx_times t on t.run_id = r.run_id group by 1"), "fx_times"))
def ru2(spark, sf):
    times = fixture(spark, sf, "fx_times")
    runs = times.groupBy("run_id").agg(F.count(F.lit(1)).alias("events"), F.max("status").alias("status"))
    metrics = times.groupBy("run_id", F.col("stage").alias("metric")).agg(F.sum("millis").alias("value"))
    return U.benchmark_table(runs, metrics, _TYPES)


@query("ru3_merge_stage_runs", oracle("""with m as (select run_id, stage as metric, stage_order, cast(sum(millis) as bigint) as value from fx_times group by 1, 2, 3)
  select run_id, metric, arg_max(value, stage_order) as value, max(stage_order) as stage_order, count(*) as stages from m group by 1, 2""", "fx_times"))
def ru3(spark, sf):
    times = fixture(spark, sf, "fx_times")
    return U.merge_stage_runs(times.groupBy("run_id", F.col("stage").alias("metric"), "stage_order").agg(F.sum("millis").alias("value")))


@query("ru3_merge_stage_timing", oracle("""with s as (select run_id, case when stage = 'signup' and run_id in ('run1', 'run2') then 'end_to_end' else stage end as stage, cast(sum(millis) as bigint) as wall, count(distinct document_id) as processed from fx_times group by 1, 2)
  select run_id, cast(case when max(case when stage = 'end_to_end' then 1 else 0 end) = 1 then max(wall) filter (stage = 'end_to_end') else sum(wall) end as bigint) as wall,
    case when max(case when stage = 'end_to_end' then 1 else 0 end) = 1 then max(processed) filter (stage = 'end_to_end') else max(processed) end as processed from s group by 1""", "fx_times"))
def ru3t(spark, sf):
    stage = F.when((F.col("stage") == "signup") & F.col("run_id").isin("run1", "run2"), "end_to_end").otherwise(F.col("stage"))
    per_stage = fixture(spark, sf, "fx_times").groupBy("run_id", stage.alias("stage")).agg(F.sum("millis").alias("wall"), F.count_distinct("document_id").alias("processed"))
    return U.merge_stage_timing(per_stage, ["wall"], ["processed"])


@query("ru3_primary_metric", oracle("""select run_id, case when max(case when stage = 'signup' and run_id <> 'run3' then 1 else 0 end) = 1 then 'signup' else arg_max(stage, stage_order * 1000000000 + event_id) filter (event_id % 3 = 0) end as primary_metric from (select * replace (case when run_id = 'run3' and stage = 'signup' then 'signup_late' else stage end as stage) from fx_times) group by 1""", "fx_times"))
def ru3p(spark, sf):
    metric = F.when((F.col("run_id") == "run3") & (F.col("stage") == "signup"), "signup_late").otherwise(F.col("stage"))
    times = fixture(spark, sf, "fx_times").select(
        "run_id", metric.alias("metric"), (F.col("event_id") % 3 == 0).alias("is_primary"), (F.col("stage_order") * 1000000000 + F.col("event_id")).alias("stage_order"))
    return U.primary_metric(times, "signup")


@query("ru4_timing_stats", oracle("""with d as (select run_id, document_id, cast(sum(millis) as bigint) as s from fx_times group by 1, 2), p as (select run_id, count(*) as pages from fx_times where run_id <> 'run5' group by 1)
  select run_id, cast(sum(s) as bigint) as total_seconds, round(avg(s), 6) as mean_seconds, round(median(s), 6) as median_seconds, count(*) as documents, max(coalesce(pages, -1)) as pages, round(sum(s) / max(pages), 9) as seconds_per_page,
    round(count(*) / sum(s), 9) as documents_per_second, round(max(pages) / sum(s), 9) as pages_per_second, case when max(pages) is null then 'no page counts for this run' end as reason from d left join p using (run_id) group by 1""", "fx_times"))
def ru4(spark, sf):
    times = fixture(spark, sf, "fx_times").withColumn("seconds", F.col("millis"))
    pages = times.where("run_id <> 'run5'").groupBy("run_id").agg(F.count(F.lit(1)).alias("pages"))
    stats = U.timing_stats(times, pages=pages)
    return stats.withColumns({**{c: F.round(c, 6) for c in ("mean_seconds", "median_seconds")}, **{c: F.round(c, 9) for c in ("seconds_per_page", "documents_per_second", "pages_per_second")}}).na.fill(-1, ["pages"])


@query("ru4_stage_seconds", oracle("select run_id, stage, cast(sum(millis) as bigint) as seconds, count(distinct document_id) as documents from fx_times group by 1, 2", "fx_times"))
def ru4s(spark, sf):
    return U.stage_seconds(fixture(spark, sf, "fx_times").withColumn("seconds", F.col("millis")))


_REASON = "case when status <> 'success' then stage || ' ' || status end"


@query("ru5_training_rollup", oracle(f"""with r as (select distinct run_id, stage_order, {_REASON} as reason from fx_times where status <> 'success'), l as (select run_id, string_agg(reason, '; ' order by stage_order, reason) as reasons from r group by 1)
  select t.run_id, case when max(case when status = 'success' then 1 else 0 end) = 1 then 'success' else 'skipped' end as status, cast(sum(millis) as bigint) as total_training_seconds, count(*) filter (status = 'success') as successful_stages,
    count(*) filter (status <> 'success') as other_stages, coalesce(any_value(reasons), '') as reasons from fx_times t left join l on l.run_id = t.run_id group by 1""", "fx_times"))
def ru5(spark, sf):
    return U.training_rollup(fixture(spark, sf, "fx_times").withColumn("seconds", F.col("millis")).withColumn("reason", F.expr(_REASON)))


@query("ru5_reason_rows", oracle(f"""with r as (select run_id, stage_order, {_REASON} as reason from fx_times where status <> 'success')
  select run_id, reason, min(stage_order) as first_position, count(*) as occurrences from r where reason is not null group by 1, 2""", "fx_times"))
def ru5_rows(spark, sf):
    return U.reason_rows(fixture(spark, sf, "fx_times").where("status <> 'success'").withColumn("reason", F.expr(_REASON)))


@query("ru6_experiment_outcome", oracle(f"""with f as (select {_REASON} as reason, min(event_id) as first_at from fx_times where status <> 'success' group by 1)
  select count(*) as combination_count, count(*) filter (status = 'success') as successful_count, count(*) filter (status = 'skipped') as skipped_count, count(*) filter (status = 'failed') as failed_count,
   (select string_agg(reason, '; ' order by first_at, reason) from f) as reasons, 0 as all_failed from fx_times""", "fx_times"))
def ru6(spark, sf):
    runs = fixture(spark, sf, "fx_times").withColumn("reason", F.expr(_REASON)).withColumn("position", F.col("event_id"))
    return U.experiment_outcome(runs).withColumn("all_failed", F.col("all_failed").cast("int"))


@query("ru7_run_summary", oracle("""select run_id, count(*) as total_documents, count(*) filter (status = 'success') as completed, count(*) filter (status = 'failed') as failed, round(sum(millis) / count(*) filter (status = 'success'), 6) as seconds_per_document,
   case when count(*) filter (status = 'success') >= 1 and count(*) filter (status = 'failed') = 0 then 'success' else 'failed' end as status from (select * replace (case when run_id = 'run4' and status = 'failed' then 'success' else status end as status) from fx_times) group by 1""", "fx_times"))
def ru7(spark, sf):
    mended = F.when((F.col("run_id") == "run4") & (F.col("status") == "failed"), "success").otherwise(F.col("status"))
    times = fixture(spark, sf, "fx_times").withColumn("status", mended).withColumn("seconds", F.col("millis"))
    return U.run_summary(times).withColumn("seconds_per_document", F.round("seconds_per_document", 6))


# ---------------------------------------------------------------- training data
@query("tr2_token_dataset", oracle(f"""with t as (select document_id, page_index, tok % 480 as i from fx_tok where doc_key % 4 <> 1)
   select document_id, page_index, count(*) as tokens, count(*) filter (page_index % 2 = 0 and i % 6 = 0) as ignored, cast(sum(case when page_index % 2 = 0 and i % 6 = 0 then 0 when i % 5 = 0 then {bio_ids()['B-UNIT']} else 0 end) as bigint) as id_sum from t group by 1, 2""", "fx_tok"))
def tr2(spark, sf):
    pages = annotations(spark, sf).select("document_id", F.explode("pages").alias("p")).select("document_id", "p.page_index", "p.tokens", "p.boxes", "p.labels", "p.ignore_mask")
    data = T.token_dataset(pages)
    return data.select("document_id", "page_index", F.size("label_ids").cast("bigint").alias("tokens"),
                       F.size(F.filter("label_ids", lambda i: i == -100)).cast("bigint").alias("ignored"),
                       F.aggregate(F.filter("label_ids", lambda i: i != -100), F.lit(0), lambda a, b: a + b).cast("bigint").alias("id_sum"))


@query("tr3_align_subtokens", oracle("""with t as (select document_id, page_index, tok % 480 as i, 1 + (length(text) - 1) // 4 as pieces from fx_tok)
   select document_id, page_index, cast(2 + sum(pieces) as bigint) as subtokens, cast(2 + sum(pieces) - count(*) as bigint) as ignored, cast(sum(i % 7) as bigint) as first_sum, cast(sum((i % 7) * pieces) as bigint) as all_sum from t group by 1, 2""", "fx_tok"))
def tr3(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("cast(doc_id as string) as document_id", r"filter(split(text, '[ \\n\\t\\r]+'), x -> x <> '') as words")
    pages = docs.where("size(words) > 0").selectExpr("document_id", "posexplode(transform(sequence(0, cast(ceil(size(words) / 480) as int) - 1), p -> slice(words, p * 480 + 1, 480))) as (page_index, words)")
    encoded = pages.selectExpr(
        "document_id", "cast(page_index as bigint) as page_index",
        "concat(array(cast(null as int)), flatten(transform(words, (w, i) -> array_repeat(i, cast(1 + (length(w) - 1) div 4 as int)))), array(cast(null as int))) as word_ids",
        "transform(words, (w, i) -> i % 7) as word_labels")
    first = T.align_subtokens(F.col("word_ids"), F.col("word_labels"))
    every = T.align_subtokens(F.col("word_ids"), F.col("word_labels"), label_all=True)

    def total(labels):
        return F.aggregate(F.filter(labels, lambda i: i != -100), F.lit(0), lambda a, b: a + b).cast("bigint")

    return encoded.select("document_id", "page_index", F.size(first).cast("bigint").alias("subtokens"),
                          F.size(F.filter(first, lambda i: i == -100)).cast("bigint").alias("ignored"), total(first).alias("first_sum"), total(every).alias("all_sum"))


def _features(spark, sf):
    emb = table(spark, sf, "embeddings")
    return emb.withColumn("split", hash_split(F.col("vec_id").cast("string"), 42))


@query("tr4_linear_probe")
def tr4(spark, sf):
    return T.linear_probe(_features(spark, sf))[1]


@query("tr5_best_checkpoint", oracle("""with c as (select run_id, event_id as epoch, millis as v, case when event_id % 7 = 0 then 'test' else 'validation' end as s from fx_times),
   b as (select run_id, epoch, v, row_number() over (partition by run_id order by v desc, epoch) as r from c where s = 'validation')
   select 'best' as outcome, run_id, epoch, v as metric_value from b where r = 1 union all select 'refused', run_id, max(epoch), count(*) from c where s = 'test' group by 2""", "fx_times"))
def tr5(spark, sf):
    candidates = fixture(spark, sf, "fx_times").select("run_id", F.col("event_id").alias("epoch"), F.col("millis").alias("metric_value"), F.expr("case when event_id % 7 = 0 then 'test' else 'validation' end").alias("evaluated_split"))
    best, refused = T.best_checkpoint(candidates)
    return best.select(F.lit("best").alias("outcome"), "run_id", "epoch", "metric_value").unionByName(
        refused.groupBy(F.lit("refused").alias("outcome"), "run_id").agg(F.max("epoch").alias("epoch"), F.count(F.lit(1)).alias("metric_value")))


# ---------------------------------------------------------------- scoring
def _norm_model():
    """A model loaded once per task: logits from three directions of the embedding."""
    def predict(batch):
        import numpy as np

        vectors = np.stack(batch["embedding"].to_numpy()).astype(float)
        batch = batch.drop(columns=["embedding"])
        batch["logits"] = list(vectors[:, :3])
        return batch

    return predict


@query("sc1_score_table", """with e as (select *, case when embedding[1] >= embedding[2] and embedding[1] >= embedding[3] then 'O' when embedding[2] >= embedding[3] then 'B-UNIT' else 'I-UNIT' end as l,
     row_number() over (partition by vec_id // 3 order by vec_id) as r from embeddings)
   select 'doc' || cast(vec_id // 3 as string) as document_id, 0 as page_index, cast(vec_id // 3 as string) as region_id, vec_id as subtoken, l as label, 'probe' as model_name, 'r1' as model_revision from e where r = 1 and l <> 'O'""")
def sc1(spark, sf):
    rows = table(spark, sf, "embeddings").selectExpr(
        "concat('doc', cast(vec_id div 3 as string)) as document_id", "0 as page_index", "cast(vec_id div 3 as string) as region_id", "vec_id as subtoken", "embedding")
    scored = S.score_table(rows, _norm_model, "document_id string, page_index int, region_id string, subtoken bigint, logits array<double>", model_name="probe", model_revision="r1")
    return S.label_entities(scored, ["O", "B-UNIT", "I-UNIT"]).drop("confidence")


@query("sc1_probe_labels")
def sc1_probe(spark, sf):
    """Entities labelled by the head that the probe fits to the same table; classes past the first are entity labels."""
    weights, bias = T.probe_head(T.linear_probe(_features(spark, sf))[0])
    rows = table(spark, sf, "embeddings").selectExpr(
        "concat('doc', cast(vec_id div 3 as string)) as document_id", "0 as page_index", "cast(vec_id div 3 as string) as region_id", "vec_id as subtoken", "embedding")
    scored = S.score_table(
        rows, S.linear_head(spark, weights, bias), "document_id string, page_index int, region_id string, subtoken bigint, logits array<double>",
        model_name="probe", model_revision="fitted")
    return S.label_entities(scored, ["O", *(f"CLASS_{k}" for k in range(1, len(bias)))])
