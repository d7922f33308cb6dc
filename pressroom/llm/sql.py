"""The results of the queries in SQL for DuckDB, written from their definitions."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Words of the window join; windows of 10 words, or a whole item of fewer.
OP1 = rf"""
with dw as (select doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (select item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (
  select distinct item_id, least(len(w), 10) as l, array_to_string(w[s + 1:s + least(len(w), 10)], ' ') as g
  from (select item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) as s from iw where len(w) > 0)
),
dg as (
  select doc_id, p, l, array_to_string(w[p + 1:p + l], ' ') as g
  from (select doc_id, w, l, unnest(range(0, greatest(len(w) - l + 1, 0))) as p
        from dw, (select distinct l from win))
),
hit as (select doc_id, p, dg.l, item_id from dg join win on dg.l = win.l and dg.g = win.g),
cover as (select doc_id, count(distinct q) as n from (select doc_id, unnest(range(p, p + l)) as q from hit) group by 1),
found as (
  select doc_id, count(distinct item_id) as n, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids
  from hit group by 1
)
select doc_id, len(w)::bigint as n_words, coalesce(cover.n, 0)::bigint as n_hit, coalesce(found.n, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(cover.n, 0) > 0 as contaminated
from dw left join cover using (doc_id) left join found using (doc_id)
"""

OP2 = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as points,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as whole
  from documents
)
select doc_id,
  first_value(doc_id) over (partition by whole order by points desc, doc_id) as keep_id,
  count(*) over (partition by whole)::bigint as group_size,
  doc_id = first_value(doc_id) over (partition by whole order by points desc, doc_id) as kept,
  sha256(whole) as text_sha256
from t
"""


def _u(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13))::bigint / 4503599627370496.0"


# The same blocks, draws and permutations as the query: every random number is an md5.
OP6 = rf"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5(concat_ws(':', 'mix', coalesce(doc_id::varchar, '~'))) as h
  from documents
),
named as (
  select source, source_size, row_number() over (order by source is null, source) - 1 as sid
  from (select source, sum(size)::bigint as source_size from sized group by 1)
),
weighed as (
  select *, [5, 2, 1][(sid % 3 + 1)::int]::double as w, 3 * source_size as cap, sum(source_size) over ()::bigint as total from named
),
ordered as (
  select *, coalesce(sum(cap) over (order by cap / w, sid rows between unbounded preceding and 1 preceding), 0)::double as lower,
    sum(w) over (order by cap / w, sid rows between current row and unbounded following) as open
  from weighed
),
flagged as (select *, cap * open <= (total - lower) * w as isfull from ordered),
sources as (
  select sid, source, source_size, total, ceil(source_size / 32)::bigint as blocks,
    case when isfull then cap::double
      else w * ((total - sum(case when isfull then cap else 0 end) over ())::double
                / sum(case when isfull then 0.0 else w end) over ()) end as target
  from flagged
),
offs as (
  select s.doc_id, n.sid, s.size,
    coalesce(sum(s.size) over (partition by n.sid order by s.h, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0)::bigint as off
  from sized s join sources n on s.source is not distinct from n.source
),
live as (select *, round(total / 32.0)::bigint as slots from sources where source_size > 0),
kinds as (
  select *, per - sum(fixed) over (partition by first) as draws,
    case when sum(rest) over (partition by first order by sid rows between unbounded preceding and unbounded following) > 0
      then sum(rest) over (partition by first order by sid rows between unbounded preceding and current row)
        / sum(rest) over (partition by first order by sid rows between unbounded preceding and unbounded following) else 0.0 end as hi
  from (
    select *, floor(mean)::bigint as fixed, mean - floor(mean) as rest
    from (
      select sid, target, total, k.shards, k.first, k.per, k.per * target / total as mean
      from (select *, unnest([{{'shards': slots // 1024, 'first': 0, 'per': 1024}},
                              {{'shards': 1, 'first': slots // 1024, 'per': slots % 1024}}]) as k from live)
      where k.shards > 0 and k.per > 0
    )
  )
),
spans as (select *, coalesce(lag(hi) over (partition by first order by sid), 0.0) as lo from kinds),
tosses as (
  select first, shard, {_u("'mix'", "shard", "toss")} as u
  from (select first, shard, unnest(range(1, draws::bigint + 1)) as toss
        from (select first, draws, unnest(range(first, first + shards)) as shard
              from (select distinct first, shards, draws from spans)))
),
draws as (
  select sid, shard, sum(n)::bigint as n
  from (
    select sid, unnest(range(first, first + shards)) as shard, fixed as n from spans where fixed > 0
    union all
    select s.sid, t.shard, 1 from tosses t join spans s on t.first = s.first and t.u >= s.lo and t.u < s.hi
  ) group by 1, 2
),
slots as (
  select sid, blocks, unnest(range(fr, fr + n)) as k
  from (select d.sid, s.blocks, d.n,
          coalesce(sum(d.n) over (partition by d.sid order by shard rows between unbounded preceding and 1 preceding), 0)::bigint as fr
        from draws d join sources s using (sid))
),
times as (
  select sid, ((k % blocks)::hugeint * case when blocks % 2147483659 <> 0 then 2147483659 else 2147483693 end
      + floor({_u("'mix'", "'shift'", "sid", "k // blocks")} * blocks)::bigint) % blocks as block, count(*) as times
  from slots where k // blocks < 3 group by 1, 2
),
lies as (
  select doc_id, sid, off, size, case when size > 0 then unnest(range(off // 32, (off + size - 1) // 32 + 1)) end as block
  from offs where size > 0
),
taken as (
  select sid, off, sum((least(off + size, (l.block + 1) * 32) - greatest(off, l.block * 32)) * times)::bigint as taken
  from lies l join times t using (sid, block) group by 1, 2
)
select doc_id, o.size, source_size, target, case when o.size > 0 then coalesce(taken, 0) else 0 end::bigint as taken
from offs o join sources using (sid) left join taken using (sid, off)
"""

# All pairs that share a shingle, counted in full; then the smallest id that can be reached.
OP7 = rf"""
with recursive w as materialized (
  select doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') as w from documents
),
g as materialized (
  select distinct doc_id, array_to_string(w[p + 1:p + 3], ' ') as g
  from (select doc_id, w, unnest(range(0, greatest(len(w) - 2, 1))) as p from w where len(w) > 0)
),
n as materialized (select doc_id, count(*) as n from g group by 1),
pairs as materialized (
  select i, j from (select a.doc_id as i, b.doc_id as j, count(*) as o from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2)
  join n x on x.doc_id = i join n y on y.doc_id = j
  where 100 * o >= 85 * (x.n + y.n - o)
),
links as materialized (select i, j from pairs union all select j, i from pairs),
reach(doc_id, r) as (
  select doc_id, doc_id from documents
  union
  select reach.doc_id, links.j from reach join links on links.i = reach.r
)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept
from (select doc_id, min(r) as component_id from reach group by 1) left join n using (doc_id)
"""

# Every order walked step by step; the share of a filter is what it removes, summed over all orders.
OP11 = r"""
with w as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws
  from documents
),
flagged as (
  select part, coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic,
    case when len(ws) < 200 then 'A' else '' end
    || case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 'B' else '' end
    || case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) then 'C' else '' end
    || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end
    || case when doc_id > min(doc_id) over (partition by text) then 'E' else '' end as fails
  from w left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1) using (doc_id)
),
counted as (
  select part, fails, count(*) as n, count(*) filter (good) as g, count(*) filter (toxic) as t from flagged group by 1, 2
),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
),
steps as (
  select filter_order, step, filter_order[step] as f, filter_order[1:step - 1] as before
  from orders, (select unnest(range(1, 6))::int as step)
),
walked as (
  select part, filter_order, step, f,
    sum(n) filter (length(translate(fails, before || f, '')) = length(fails)) as kept,
    sum(n) filter (contains(fails, f) and length(translate(fails, before, '')) = length(fails)) as removed,
    sum(n) filter (contains(fails, f) and length(translate(fails, before, '')) < length(fails)) as redundant,
    sum(n) filter (fails = f) as unique_fails,
    sum(g) filter (contains(fails, f) and length(translate(fails, before, '')) = length(fails)) as good_lost,
    sum(t) filter (contains(fails, f) and length(translate(fails, before, '')) = length(fails)) as toxic_lost
  from counted, steps group by 1, 2, 3, 4
)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
  coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  (sum(coalesce(removed, 0)) over (partition by part, f))::bigint as shapley
from walked
"""

OP12 = """
with l as (
  select doc_id, generate_subscripts(ls, 1) as place, unnest(ls) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)
),
k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from l
),
shared as (
  select key, max(doc_id) as last from k where length(key) >= 40 group by 1 having count(distinct doc_id) >= 5
),
marked as (select k.*, last is not null and doc_id <> last as gone from k left join shared using (key))
select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256
from marked group by 1
"""

# All rows scored with every anchor.
OP13 = """
with e as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [floor(256 * x::double) for x in embedding] as v
  from embeddings
  where label is not null and embedding is not null
    and len([x for x in embedding if x is not null and isfinite(x)]) = len(embedding)
),
scored as materialized (
  select a.vec_id as anchor_id, b.vec_id as vec_id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
),
pos as (
  select anchor_id, vec_id as positive_id, score as positive_score
  from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id,
  (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank,
  vec_id as negative_id, positive_score, score as negative_score
from pos join scored using (anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 3
"""
