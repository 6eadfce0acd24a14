"""DuckDB SQL for the text queries that SQL can express.

The others depend on trained models, tokenizers, tag streams or signatures;
their tests hold them against brute force, round trips and held-out labels.
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
with d as (select doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws from documents),
b as (select coalesce(cast(item_id as varchar), '') as item_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws from benchmark),
bw as (
  select distinct item_id, unnest(case when len(ws) >= 10 then list_transform(range(1, len(ws) - 8), lambda i: ws[i:i + 9]) when len(ws) > 0 then [ws] else [] end) as win from b
),
sizes as (select distinct len(win) as size from bw),
dw as (
  select doc_id, size, unnest(range(1, len(ws) - size + 2)) as pos, ws from d, sizes where len(ws) >= size
),
m as (select distinct doc_id, pos, size, item_id from dw join bw on bw.win = dw.ws[dw.pos:dw.pos + dw.size - 1]),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(pos, pos + size)) as p from m) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id from m) group by doc_id),
places as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as p from d),
numbered as (select row_number() over () as id, item_id, win from bw),
wt as (select id, item_id, len(win) as size, unnest(win) as w, generate_subscripts(win, 1) as k from numbered),
freq as (select w, count(*) as c from places group by w),
rare as (select id, any_value(item_id) as item_id, any_value(size) as size, arg_min(k, c) as k, arg_min(wt.w, c) as w from wt join freq on freq.w = wt.w group by id having count(distinct k) = any_value(size)),
cand as (select distinct doc_id, id, item_id, size, p - k + off as s from rare join places on places.w = rare.w, (select unnest(range(-2, 3)) as off)),
near as (
  select cand.doc_id, cand.id, cand.item_id, s from cand join wt on wt.id = cand.id
  join places on places.doc_id = cand.doc_id and places.w = wt.w and places.p between s + wt.k - case when wt.k = 1 then 0 else 2 end and s + wt.k + case when wt.k = 1 then 0 else 2 end
  group by cand.doc_id, cand.id, cand.item_id, s having count(distinct wt.k) = any_value(cand.size)
),
ni as (select doc_id, count(distinct item_id) as n_near_items from near group by doc_id)
select d.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near_items, 0) as n_near_items
from d left join h on h.doc_id = d.doc_id left join i on i.doc_id = d.doc_id left join ni on ni.doc_id = d.doc_id
"""

JACCARD = rf"""
with recursive w as (select doc_id, list_filter(string_split_regex(coalesce({_LOWER}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (
  select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as sh from w
),
e as (select doc_id, len(sh) as n, unnest(sh) as g from s),
links as (
  select a.doc_id as x, b.doc_id as y from e a join e b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
),
r(doc_id, root) as (select doc_id, doc_id from s union select links.x, r.root from r join links on links.y = r.doc_id)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, min(root) as component_id from s join r on r.doc_id = s.doc_id group by s.doc_id, sh
"""
