"""DuckDB twins of the queries that SQL can express."""

ORACLES = {}

ORACLES["op6_chat_format"] = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
  sum(length('<turn ') + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) + 2
      + length(replace(replace(text, '\', '\b'), '<', '\l')) + length('</turn>') + 1)::bigint as formatted_chars
from rows group by conv_id
"""

ORACLES["op8_warc_store"] = r"""
with own as (select page_id, encode(coalesce(html, '')) as payload from pages),
digested as (select page_id, octet_length(payload)::bigint as payload_bytes, sha1(payload) as h,
    first_value(page_id) over (partition by sha256(payload) order by page_id nulls last) as first_id from own),
groups as (select *, list_transform([1, 11, 21, 31], lambda i: ('0x' || substr(h, i::int, 10))::bigint) as g from digested)
select page_id, payload_bytes,
  list_aggregate(list_transform(range(32),
    lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((g[(i // 8 + 1)::int] >> (35 - 5 * (i % 8))::bigint) & 31) + 1)::int, 1)),
    'string_agg', '') as payload_digest,
  case when page_id is distinct from first_id then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first_id then first_id end as refers_to
from groups
"""

ORACLES["op4_source_mix"] = r"""
with recursive sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5(concat(coalesce(doc_id::varchar, 'null'), ':mix-1:', md5(coalesce(text, '')))) as hash from documents),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
sources as (
  select source, source_size, 3.0::double * source_size as cap,
    (array[5.0, 2.0, 1.0])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight from totals),
fill as (
  select 0 as step, 0.0::double as level
  union all
  select step + 1, (select (sum(source_size) - sum(case when weight * level > cap then cap else 0 end))::double
                           / sum(case when weight * level > cap then 0 else weight end) from sources)
  from fill where step < (select count(*) from sources)),
targets as (
  select source, source_size, least(cap, weight * (select max_by(level, step) from fill)) as target from sources),
goals as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from targets),
placed as (
  select s.*, g.source_size, g.target, g.whole, round(g.target)::bigint - g.whole * g.source_size as rest,
    sum(s.size) over (partition by s.source order by s.hash, s.size
                      rows between unbounded preceding and current row)::bigint as upto
  from sized s join goals g on s.source is not distinct from g.source)
select doc_id, size, source_size, target,
  (whole * size + case when upto <= rest or (upto - size <= rest and 2 * (rest - (upto - size)) >= size) then size else 0 end)::bigint as taken
from placed
"""

ORACLES["op5_jaccard_join"] = r"""
with recursive split as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i:i + 3], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from split where len(w) > 0)),
sizes as (select doc_id, count(*)::bigint as n from shingles group by doc_id),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * c >= 85 * (x.n + y.n - c)),
both_ways as (select a, b from links union select b, a from links),
reach as (
  select doc_id as a, doc_id as b from split
  union
  select r.a, l.b from reach r join both_ways l on r.b = l.a)
select s.doc_id, coalesce(n, 0) as n_shingles, (select min(b) from reach r where r.a = s.doc_id) as component_id
from split s left join sizes z on z.doc_id = s.doc_id
"""

ORACLES["op12_lexical_search"] = r"""
with found as (
  select row_number() over () as r, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents),
counted as (select r, doc_id, term, count(*)::bigint as tf from found group by all),
sizes as (select r, sum(tf)::bigint as n from counted group by r),
corpus as (select count(*)::bigint as total_docs, sum(n)::bigint as total_terms from sizes),
weights as (
  select term, floor(1000 * ln((2.0::double * total_docs + 2) / (2.0::double * count(*) + 1)))::bigint as w
  from counted, corpus group by term, total_docs),
items as (
  select distinct item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
scored as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * total_docs) // total_terms))))::bigint as score
  from items join counted using (term) join sizes using (r) join weights using (term), corpus
  group by item_id, r, doc_id)
select item_id, rank::int as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
where rank <= 50
"""
