"""Queries: normalised columns, identity and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.functions import text as T
from docledger.functions import values as V
from docledger.operators import identity, normalize
from docledger.workload.fixtures import Dialect, fixture, oracle, table
from docledger.workload.registry import query

_NUM = r"regexp_replace(text, '[^0-9,.+-]', '', 'g')"
_PARSE = f"""
 a as (select *, {_NUM} as kept from src),
 b as (select *, case when kept like '-%' then '-' else '' end as sign,
        case when kept like '-%' or kept like '+%' then substring(kept, 2) else kept end as body from a),
 c as (select *, length(body) - length(replace(body, '.', '')) as dots, length(body) - length(replace(body, ',', '')) as commas,
        string_split(replace(body, ',', '.'), '.') as groups from b),
 d as (select *, case
        when body like '%+%' or body like '%-%' then null
        when dots > 0 and commas > 0 then
          case when instr(reverse(body), '.') < instr(reverse(body), ',') then replace(body, ',', '')
               else replace(replace(body, '.', ''), ',', '.') end
        when dots + commas > 1 then case when len(list_filter(groups[2:], lambda g: length(g) <> 3)) = 0 then array_to_string(groups, '') end
        when dots + commas = 1 and length(groups[2]) = 3 and groups[1] <> '' then groups[1] || groups[2]
        else replace(body, ',', '.') end as plain from c),
 parsed as (select *, case when regexp_matches(plain, '^([0-9]+\\.?[0-9]*|\\.[0-9]+)$') then
        cast(sign || case when plain like '.%' then '0' else '' end || plain || case when plain like '%.' then '0' else '' end as decimal(28, 6)) end as number from d)
"""


def _dates(spark, sf):
    lines = fixture(spark, sf, "fx_print")
    parts = [F.substring("date_iso", 1, 4), F.substring("date_iso", 6, 2), F.substring("date_iso", 9, 2)]
    year, month, day = parts
    form = F.col("doc_key") % 7
    return lines.select(
        "doc_key",
        F.when(form == 0, F.concat(F.lit("ngày "), day, F.lit(" tháng "), month, F.lit(" năm "), year))
        .when(form == 1, F.concat(F.lit("31/02/"), year))
        .when(form == 2, F.concat_ws("/", day, month, F.substring(year, 3, 2)))
        .when(form == 3, F.concat(F.lit("printed on "), F.concat_ws(".", day, month, year), F.lit(" here")))
        .otherwise(F.col("date_text")).alias("text"),
    )


_DATES = """ src as (select doc_key, substring(date_iso, 1, 4) as y, substring(date_iso, 6, 2) as m, substring(date_iso, 9, 2) as d, date_text, date_iso from fx_print),
 typed as (select doc_key, case when doc_key % 7 in (1, 2) then null else date_iso end as date_iso from src)"""


@query("n1_normalize_date", oracle(
    f"with {_DATES} select doc_key, date_iso as normalized from typed", "fx_print"))
def n1(spark, sf):
    return _dates(spark, sf).select("doc_key", V.normalize_date(F.col("text")).alias("normalized"))


_NUMBERS = """select doc_key, case doc_key % 11 when 0 then replace(replace(replace(sub_text, '.', '#'), ',', '.'), '#', ',')
  when 1 then replace(sub_text, '.', ' ') when 2 then '-' || vat_text when 3 then 'not a number' when 4 then '0.' || lpad(cast(doc_key % 1000 as string), 3, '0')
  when 5 then cast(doc_key as string) || '.' when 6 then '1.23.4' when 7 then '+' || sub_text || ' VND' when 8 then '5-3'
  when 9 then cast(doc_key % 100 as string) || ',5%' else total_text end as text from fx_print"""


def _numbers(spark, sf):
    return spark.sql(_NUMBERS.replace("fx_print", "{lines}"), lines=fixture(spark, sf, "fx_print"))


@query("n2_parse_number", oracle(
    f"with src as ({_NUMBERS}), {_PARSE} select doc_key, cast(number as double) as number, "
    "cast(case when number >= 0 then number end as double) as money from parsed", "fx_print"))
def n2(spark, sf):
    return _numbers(spark, sf).select(
        "doc_key", V.parse_number(F.col("text")).cast("double").alias("number"),
        V.parse_money(F.col("text")).cast("double").alias("money"),
    )


_N4 = r"trim(regexp_replace(replace(lower({c}), 'ß', 'ss'), '[\s:;|,_]+', ' ', 'g'), ' .-''""')"
_PUNCT = "replace(translate({c}, ' “”„’‘–—−：，．／', ' \"\"\"''''---:,./'), '…', '...')"
_N4_TEXT = _N4.format(c=_PUNCT.format(c="text"))


@query("n4_normalize_text", f"select doc_id, sha256({_N4_TEXT}) as digest from documents")
def n4(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("digest"))


@query("n5_fold_text", f"select doc_id, sha256(replace(strip_accents({_N4_TEXT}), 'đ', 'd')) as digest from documents")
def n5(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.sha2(T.fold_text(F.col("text")), 256).alias("digest"))


@query("n6_normalize_identifier",
       f"select doc_id, sha256(regexp_replace({_N4_TEXT}, '[^0-9a-zA-ZÀ-ỹ]+', '', 'g')) as digest from documents")
def n6(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.sha2(T.normalize_identifier(F.col("text")), 256).alias("digest"))


_PRODUCT = """select p_partkey, case p_partkey % 5 when 0 then p_name || ' ' || cast(p_size as string) || 'mg - NSX: ' || p_brand || '; lot'
   when 1 then p_name || ', ' || cast(p_size as string) || ',5 ml / 10 ml, Manufacturer: ' || p_brand
   when 2 then p_name || ' xuất xứ: ' || p_type || ' | nhà sản xuất: ' || p_brand
   when 3 then '  ' || p_name || ' -' else '  ' end as description from part"""


@query("n8_describe_product", """
 select p_partkey, case when p_partkey % 5 < 4 then p_name end as medicine_name,
   case p_partkey % 5 when 0 then cast(p_size as string) || 'mg' when 1 then cast(p_size as string) || ',5 ml / 10 ml' end as strength,
   case when p_partkey % 5 in (1, 2) then p_brand end as manufacturer,
   case p_partkey % 5 when 0 then p_brand when 2 then p_type end as country_of_manufacture from part""")
def n8(spark, sf):
    part = table(spark, sf, "part")
    described = spark.sql(_PRODUCT.replace("from part", "from {part}"), part=part)
    return normalize.describe_products(described, "description").drop("description")


@query("n_normalization_report", oracle(f"""
  with src as ({_NUMBERS}), {_PARSE}, {_DATES.replace(' src as', ' dsrc as').replace('from src', 'from dsrc')}
  select 'number_text' as column_name, 'number' as parser, count(*) as "rows", count(number) as parsed,
    count(*) - count(text) as missing, count(text) - count(number) as rejected from parsed
  union all select 'date_text', 'date', count(*), count(date_iso), 0, count(*) - count(date_iso) from typed""", "fx_print"))
def report(spark, sf):
    both = _numbers(spark, sf).withColumnRenamed("text", "number_text").join(
        _dates(spark, sf).withColumnRenamed("text", "date_text"), "doc_key")
    return normalize.normalization_report(both, {"number_text": "number", "date_text": "date"})


# ---------------------------------------------------------------- identity
@query("id1_document_id", oracle(
    "select relative_path, sha256(lower(relative_path) || chr(0) || sha256) as document_id from fx_source", "fx_source"))
def id1(spark, sf):
    src = fixture(spark, sf, "fx_source")
    return src.select("relative_path", identity.document_id(F.col("relative_path"), F.col("sha256")).alias("document_id"))


_ROW_JSON = """'{"document_id":"' || sha256(lower(relative_path) || chr(0) || sha256) || '","relative_path":"' || relative_path || '","sha256":"' || sha256 || '"}'"""


def _identified(spark, sf):
    src = fixture(spark, sf, "fx_source")
    return src.withColumn("document_id", identity.document_id(F.col("relative_path"), F.col("sha256")))


@query("id2_canonical_json_hash", oracle(f"select doc_key, sha256({_ROW_JSON}) as digest from fx_source", "fx_source"))
def id2(spark, sf):
    return _identified(spark, sf).select(
        "doc_key", identity.canonical_json_hash(["sha256", "relative_path", "document_id"]).alias("digest"))


def _manifest_sql(rows: str, table: str, where: str = "true") -> str:
    levels = "".join(
        f", l{digits} as (select substring(b, 1, {digits}) as b, sum(n) as n, sha256(string_agg(d, ',' order by b)) as d from {below} group by 1)"
        for digits, below in ((8, "c"), (6, "l8"), (4, "l6"), (2, "l4")))
    return f"""with r as (select sha256({rows}) as h from {table} where {where}), c as (select h as b, count(*) as n, h || ':' || count(*) as d from r group by h){levels}
      select cast(coalesce(sum(n), 0) as bigint) as files, sha256(coalesce(string_agg(d, ',' order by b), '')) as manifest_hash from l2"""


@query("id3_dataset_manifest_hash", oracle(_manifest_sql(_ROW_JSON, "fx_source"), "fx_source"))
def id3(spark, sf):
    return identity.manifest_hash(_identified(spark, sf), ["document_id", "relative_path", "sha256"])


_GT_JSON = """'{"gt_path":"' || gt_path || '","gt_sha256":"' || gt_sha256 || '"}'"""


@query("id4_tree_manifest_hash", oracle(
    _manifest_sql(_GT_JSON, "fx_files", "gt_path like '%.json' and gt_path not like 'splits/%'"), "fx_files"))
def id4(spark, sf):
    files = identity.tree_files(fixture(spark, sf, "fx_files"), "gt_path", ".json", ["splits"])
    return identity.manifest_hash(files, ["gt_path", "gt_sha256"])


_CURRENT = """select doc_key, case when doc_key % 9 = 0 then {h} else sha256 end as data_hash,
  case when doc_key % 14 = 0 then 'new' else 'old' end as gt_hash from {t} where doc_key % 8 <> 1"""


@query("id5_detect_drift", oracle("""
  select doc_key, case when doc_key % 8 = 1 then 'removed' when doc_key % 9 = 0 or doc_key % 14 = 0 then 'changed' else 'same' end as state,
    cast(doc_key % 8 <> 1 and doc_key % 9 = 0 as int) as data_hash_changed, cast(doc_key % 8 <> 1 and doc_key % 14 = 0 as int) as gt_hash_changed from fx_source
  union all select doc_key + 1000000000, 'added', 0, 0 from fx_source where doc_key % 33 = 0""", "fx_source"))
def id5(spark, sf):
    src = fixture(spark, sf, "fx_source")
    locked = src.select("doc_key", F.col("sha256").alias("data_hash"), F.lit("old").alias("gt_hash"))
    current = src.where("doc_key % 8 <> 1").select(
        "doc_key", F.when(F.expr("doc_key % 9 = 0"), F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("data_hash"),
        F.when(F.expr("doc_key % 14 = 0"), "new").otherwise("old").alias("gt_hash"),
    ).union(src.where("doc_key % 33 = 0").select(F.col("doc_key") + 1000000000, "sha256", F.lit("old")))
    drift = identity.detect_drift(locked, current, "doc_key", ["data_hash", "gt_hash"])
    return drift.select("doc_key", "state", F.col("data_hash_changed").cast("int").alias("data_hash_changed"),
                        F.col("gt_hash_changed").cast("int").alias("gt_hash_changed"))
