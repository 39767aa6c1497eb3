"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP6 = r"""
with t as (select row_number() over () r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
p as (select r, w, unnest(range(1, greatest(len(w) - 33, 1))) i from t),
s as (select r, i, array_to_string(w[i : i + 34], ' ') s from p),
again as (select s from s group by s having count(*) > 1),
gone as (select distinct r, unnest(range(i, i + 35)) k from s semi join again using (s)),
words as (select r, unnest(w) x, unnest(range(1, len(w) + 1)) k from t),
kept as (select r, string_agg(x, ' ' order by k) said from words anti join gone using (r, k) group by r),
n as (select r, count(*) n from gone group by r)
select doc_id, len(w)::bigint n_words, coalesce(n.n, 0) n_removed, sha256(coalesce(said, '')) kept_sha256
from t left join n using (r) left join kept using (r)
"""

_SCORE = "-ln((('0x' || substr(md5(k || '/' || s), 1, 13))::bigint + 0.5) / 4503599627370496.0)"
OP5 = rf"""
with recursive bits as (select i, i::bigint c, 0 n from range(256) t(i) union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n + 1 from bits where n < 8),
crc as (select list(c order by i) t from bits where n = 8),
d as (select row_number() over () r, doc_id, coalesce(doc_id::varchar, 'null') k, coalesce(text, '') text from documents),
b as (select r, doc_id, k, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint) bytes, t from d, crc),
c as (select r, doc_id, k, (len(bytes) + 1)::bigint size,
  xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)::bigint text_crc32 from b),
w as (select r, s, {_SCORE} score from d, range(17) g(s)),
p as (select r, arg_min(s, (score, s)) filter (s < 16) shard, arg_min(s, (score, s)) grown from w group by r)
select doc_id, size, text_crc32, 'key' law, shard::int shard,
  row_number() over (partition by shard order by substr(md5(k || '/' || text_crc32), 1, 2), doc_id nulls first, text_crc32, size) - 1 slot, grown::int grown_shard
from c join p using (r)
"""

OP9 = r"""
with a as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
b as (select *, length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) n from a)
select conv_id, count(*) n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) loss_sha256,
  (3 + sum(n + case role when 'system' then 11 when 'user' then 13 else 12 end))::bigint formatted_chars,
  regexp_full_match(string_agg(role[1], '' order by turn, role, text), 's?(ua)*u?') in_order,
  regexp_full_match(string_agg(role[1], '' order by turn, role, text), 's?(ua)+') accepted
from b group by conv_id
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10 = rf"""
with t as (select row_number() over () r, doc_id, {_WORDS} w from documents),
v as (select item_id::varchar item, {_WORDS} w from benchmark),
vs as (select item, w, least(len(w), 10) z from v where len(w) > 0),
vp as (select item, w, z, unnest(range(1, len(w) - z + 2)) i from vs),
vw as (select distinct item, z, array_to_string(w[i : i + z - 1], ' ') s from vp),
sizes as (select distinct z from vs),
p as (select r, w, z, unnest(range(1, greatest(len(w) - z + 2, 1))) i from t, sizes),
d as (select r, z, i, array_to_string(w[i : i + z - 1], ' ') s from p),
h as (select r, z, i, item from d join vw using (z, s)),
k as (select r, count(distinct k) n from (select r, unnest(range(i, i + z)) k from h) group by r),
m as (select r, count(*) n, string_agg(item, ',' order by item) said from (select distinct r, item from h) group by r)
select doc_id, len(w)::bigint n_words, coalesce(k.n, 0) n_hit, coalesce(m.n, 0) n_items, sha256(coalesce(said, '')) items_sha256, coalesce(k.n, 0) > 0 contaminated
from t left join k using (r) left join m using (r)
"""
