"""SQL for the queries that SQL can express, in the dialect of the checking engine."""

from __future__ import annotations

from docledger.llm.decontaminate import WINDOW
from docledger.llm.manifest import LEAF
from docledger.llm.mixing import MOST, SHARE, WEIGHTS
from docledger.llm.quality_rules import RULES, STOP_WORDS
from docledger.llm.warc import FANOUT, FILE_RECORDS

_SPACE = r"[\x20\x09-\x0D]"
_WORDS = rf"list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _failed() -> str:
    parts = []
    for rule in RULES:
        bounds = [f"{rule.metric} < {rule.low}"] * (rule.low is not None) + [f"{rule.metric} > {rule.high}"] * (rule.high is not None)
        parts.append(f"(n_words >= {rule.from_words} and ({' or '.join(bounds)}))")
    return " or ".join(parts)


QUALITY_RULES = rf"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, {_WORDS} as w from documents),
windows as (
  select rid, i, array_to_string(w[i:i + 4], ' ') as win
  from (select rid, w, unnest(range(1, len(w) - 3)) as i from docs)
),
twice as (select rid, win from windows group by rid, win having count(*) > 1),
covered as (
  select rid, count(distinct p) as n from (
    select rid, unnest(range(i, i + 5)) as p from windows join twice using (rid, win)
  ) group by rid
),
counted as (
  select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l,
    len(list_filter(w, lambda x: x in ({", ".join(f"'{word}'" for word in STOP_WORDS)}))) as stops,
    coalesce(n, 0)::bigint as n_repeat_words
  from docs left join covered using (rid)
),
measured as (
  select *, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
    n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    case when n_words > 0 then word_chars / n_words else 0 end as mean_word_chars,
    case when n_words > 0 then n_symbols / n_words else 0 end as symbol_ratio,
    case when len(l) > 0 then (len(l) - len(list_distinct(l))) / len(l) else 0 end as dup_line_ratio,
    case when n_words > 0 then stops / n_words else 0 end as stop_ratio
  from counted
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not ({_failed()}) as kept
from measured
"""

MIX_SOURCES = rf"""
with sized as (
  select doc_id, source, len({_WORDS})::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 9))::bigint as h
  from documents
),
sizes as (
  select source, sum(size)::bigint as s,
    ([{", ".join(map(str, WEIGHTS))}])[((row_number() over (order by source nulls last)) - 1) % {len(WEIGHTS)} + 1] as w
  from sized group by source
),
ranked as (
  select *, row_number() over (order by {MOST}.0 * s / w, source) as k,
    ({SHARE} * sum(s) over () - {MOST} * coalesce(sum(s) over (order by {MOST}.0 * s / w, source rows between unbounded preceding and 1 preceding), 0))
      / sum(w) over (order by {MOST}.0 * s / w, source rows between current row and unbounded following) as level
  from sizes
),
chosen as (select coalesce(arg_min(level, k) filter ({MOST}.0 * s > level * w), 0) as level from ranked),
targets as (select source, s, least({MOST}.0 * s, (level * w))::double as target from sizes, chosen),
budgets as (
  select *, case when s > 0 then floor(target / s)::bigint else 0 end as base,
    target - case when s > 0 then floor(target / s)::bigint else 0 end * s as budget
  from targets
),
reach as (
  select doc_id, size, s, target, base, budget, sum(size) over (partition by sized.source order by h) as upto,
    sum(size) over (partition by sized.source, h) as own
  from sized join budgets on sized.source is not distinct from budgets.source
)
select doc_id, size, s as source_size, target,
  (size * least({MOST}, base + case when 2 * upto - own <= 2 * budget then 1 else 0 end))::bigint as taken
from reach
"""

DECONTAMINATE = rf"""
with tokens as (
  select row_number() over () as rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
),
windows as (
  select distinct item_id, least(len(w), {WINDOW}) as n, array_to_string(w[i:i + {WINDOW - 1}], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) as i from items where len(w) > 0)
),
places as (
  select rid, n, i, array_to_string(w[i:i + n - 1], ' ') as win
  from (
    select rid, n, w, unnest(range(1, len(w) - n + 2)) as i from tokens, (select distinct n from windows) where len(w) >= n
  )
),
found as (select rid, i, n, item_id from places join windows using (n, win)),
hits as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from found) group by rid),
seen as (
  select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct rid, item_id::varchar as item_id from found where item_id is not null) group by rid
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from tokens left join hits using (rid) left join seen using (rid)
"""

_LABEL = "coalesce(page_id::varchar, '')"
_RECORD = rf"""'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || {_LABEL}
  || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html'
  || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, '')))::varchar || chr(13) || chr(10) || chr(13) || chr(10)
  || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"""


def _side(name: str, pages: str) -> str:
    """Records and three levels, enough for files of up to FANOUT ** 3 records (they hold FILE_RECORDS on average)."""
    levels = "".join(f"""
{name}{k} as (select file, node // {FANOUT} as node, sha256(string_agg(hash, '' order by node)) as hash from {name}{k - 1} group by file, node // {FANOUT}),""" for k in (1, 2, 3))
    return rf"""
{name}_hashed as (
  select ('0x' || substr(md5({_LABEL} || '|' || coalesce(url, '')), 1, 8))::bigint % n as file, page_id, url,
    octet_length(encode({_RECORD})) as length, sha256({_RECORD}) as digest
  from {pages}, files
),
{name}_counted as (select file, page_id, url, length, digest, count(*) as copies from {name}_hashed group by all),
{name} as (
  select *, row_number() over (partition by file order by page_id nulls first, url nulls first, digest) - 1 as node,
    coalesce(sum(length * copies) over (partition by file order by page_id nulls first, url nulls first, digest rows between unbounded preceding and 1 preceding), 0) as place
  from {name}_counted
),
{name}0 as (select file, node, sha256(digest || ':' || copies::varchar) as hash from {name}),{levels}
{name}_bytes as (select file, max(place + length * copies) as bytes from {name} group by file)"""


MERKLE_FIXITY = rf"""
with files as (select greatest(1, ceil(count(*) / {FILE_RECORDS}.0)::bigint) as n from pages),
other as (
  select page_id, url, case when fault % 97 = 0 then coalesce(html, '') || '!' else html end as html
  from (select *, ('0x' || substr(md5(coalesce(url, '')), 1, 8))::bigint as fault from pages) where fault % 89 <> 0
),
{_side("a", "pages")},
{_side("b", "other")},
roots as (
  select file, a3.hash as hash, b3.hash as other_hash, coalesce(a_bytes.bytes, b_bytes.bytes) as bytes
  from a3 full join b3 using (file) left join a_bytes using (file) left join b_bytes using (file)
),
pairs as (
  select coalesce(a.file, b.file) as file, coalesce(a.page_id, b.page_id) as page_id, coalesce(a.url, b.url) as url,
    a.digest as ours, b.digest as theirs, coalesce(a.place, b.place) as place, coalesce(a.length, b.length) as length,
    coalesce(a.copies, b.copies) as copies
  from a full join b on a.file = b.file and a.page_id is not distinct from b.page_id and a.url is not distinct from b.url
)
select 'file' as kind, file, case when other_hash is null then 'missing' when hash is null then 'extra' when hash <> other_hash then 'damaged' else 'intact' end as status,
  null::bigint as page_id, null::varchar as url, 0::bigint as "offset", bytes::bigint as length, hash, other_hash, null::bigint as copies
from roots
union all
select 'record', file, case when theirs is null then 'missing' when ours is null then 'extra' else 'changed' end, page_id, url,
  place::bigint, length::bigint, ours, theirs, copies::bigint
from pairs where ours is distinct from theirs
"""

_POLYNOMIAL = 0xEDB88320
SHARDS = rf"""
with crc as (
  select list(c order by i) as t from (
    select i, list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, {_POLYNOMIAL}) else c >> 1 end) as c
    from range(256) r(i)
  )
),
docs as (
  select row_number() over () as rid, doc_id, coalesce(doc_id::varchar, '') as label, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as hx
  from documents
),
summed as (
  select rid, doc_id, label, length(hx) // 2 + 16 as size, md5(label || ':' || md5(text)) as place,
    xor(list_reduce([4294967295::bigint] || list_transform(regexp_extract_all(hx, '..'), lambda h: ('0x' || h)::bigint),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::bigint) as text_crc32
  from docs, crc
),
drawn as (
  select rid, s, -ln((('0x' || substr(md5(label || ':' || s::varchar), 1, 13))::bigint::double + 0.5) / 4503599627370496.0) as cost
  from docs, range(41) r(s)
),
owned as (select rid, arg_min(s, cost) filter (s < 40) as shard, arg_min(s, cost) as grown from drawn group by rid)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard::int as shard,
  row_number() over (partition by shard order by place, doc_id) - 1 as slot, grown::int as grown_shard
from summed join owned using (rid)
"""


def _written(name: str) -> str:
    return f"coalesce(octet_length(encode({name}::varchar))::varchar || ':' || {name}::varchar, '-')"


def _climb(name: str, leaves: str, levels: int) -> str:
    """(tree, pos, n, hash) tables name0..nameK; a tree's levels end with its single node."""
    return f"{name}0 as ({leaves})" + "".join(f""",
{name}{k} as (
  select tree, pos // {FANOUT} as pos, (any_value(n) + {FANOUT - 1}) // {FANOUT} as n, sha256(string_agg(hash, '' order by pos)) as hash
  from {name}{k - 1} where n > 1 group by tree, pos // {FANOUT}
)""" for k in range(1, levels + 1))


def _siblings(name: str, levels: int) -> str:
    """Per node of each level its siblings on either side; the last node of a tree has none."""
    return " union all ".join(f"""
  select {k} as level, tree, pos, n, coalesce(string_agg(hash, '') over (w rows between unbounded preceding and 1 preceding), '') as before,
    coalesce(string_agg(hash, '') over (w rows between 1 following and unbounded following), '') as after
  from {name}{k} where n > 1 window w as (partition by tree, pos // {FANOUT} order by pos)""" for k in range(levels + 1))


def _fold(name: str, source: str, prefix: str, levels: int) -> str:
    """Joins the siblings of ``prefix`` level by level to ``source``, which has (tree, pos, node, proof)."""
    steps = ""
    for k in range(levels + 1):
        steps += f""",
{name}{k} as (
  select a.* exclude (node, proof), case when s.n is null then node else sha256(before || node || after) end as node,
    proof || coalesce(before || after, '') as proof
  from {source if k == 0 else f"{name}{k - 1}"} a left join {prefix}_siblings s
    on s.level = {k} and s.tree = a.tree and s.pos = a.pos // {FANOUT**k}
)"""
    return steps


_LEVELS, _CROWN = 5, 3
MERKLE_MANIFEST = rf"""
with crc as (
  select list(c order by i) as t from (
    select i, list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, {_POLYNOMIAL}) else c >> 1 end) as c
    from range(256) r(i)
  )
),
summed as (
  select *, xor(list_reduce([4294967295::bigint] || list_transform(regexp_extract_all(hex(encode(doc_id::varchar)), '..'), lambda h: ('0x' || h)::bigint),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::bigint) as crc
  from documents, crc
),
claims as (
  select * exclude (text), text, case when coalesce(crc % 5 = 0, false) then translate(text, '{_UPPER}', '{_LOWER}') else text end as other from summed
),
hashed as (
  select doc_id, coalesce('1' || source, '0') as tree, sha256({" || ".join(map(_written, LEAF))}) as leaf,
    sha256({" || ".join(_written("other" if name == "text" else name) for name in LEAF)}) as claim
  from claims
),
placed as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf, claim) - 1 as pos, count(*) over (partition by tree) as n from hashed
),
{_climb("a", "select tree, pos, n, leaf as hash from placed", _LEVELS)},
subroots as ({" union all ".join(f"select tree, hash from a{k} where n = 1" for k in range(_LEVELS + 1))}),
{_climb("b", "select '' as tree, row_number() over (order by tree) - 1 as pos, count(*) over () as n, hash, tree as source from subroots", _CROWN)},
tops as ({" union all ".join(f"select hash as root from b{k} where n = 1" for k in range(_CROWN + 1))}),
a_siblings as ({_siblings("a", _LEVELS)}),
b_siblings as ({_siblings("b", _CROWN)}),
start as (select doc_id, leaf, tree, pos, claim as node, '' as proof from placed){_fold("f", "start", "a", _LEVELS)},
crowned as (
  select doc_id, leaf, b0.hash as subroot, '' as tree, b0.pos, node, proof from f{_LEVELS} join b0 on b0.source = f{_LEVELS}.tree
){_fold("g", "crowned", "b", _CROWN)}
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, node as folded_root, node = root as verified from g{_CROWN}, tops
"""
