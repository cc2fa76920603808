"""DuckDB SQL for the queries that SQL can express, in each query's columns."""

from __future__ import annotations

#: Words of op7 and op9, and of op5; SQL strings hold the white space as characters of a class.
_SPACED = r"[^\x20\x09-\x0D]+"
_NORMAL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = f"""
with items as (select item_id::varchar as item, regexp_extract_all({_LOWER.format("text")}, '{_NORMAL}') as ws from benchmark where text is not null),
starts as (select item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as i from items where len(ws) > 0),
windows as (select distinct item, least(len(ws), 10) as n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') as w from starts),
docs as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_NORMAL}') as ws from documents),
lengths as (select distinct n from windows),
places as (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from docs, lengths where len(ws) >= n),
found as (select doc_id, i, places.n, item from places join windows on places.n = windows.n and windows.w = array_to_string(ws[i : i + places.n - 1], ' ')),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from found)) group by 1),
own as (select doc_id, count(distinct item) as n_items, sha256(string_agg(distinct item, ',' order by item)) as items_sha256 from found group by 1)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (doc_id) left join own using (doc_id)
"""

PASSAGES = f"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') as ws from documents),
places as (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from docs where len(ws) >= 13),
windows as (select doc_id, i, md5(array_to_string(ws[i : i + 12], ' ')) as w from places),
earliest as (select w, min(doc_id) as first from windows group by 1),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from windows join earliest using (w) where first < doc_id),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from docs where len(ws) > 0),
left_ as (select words.doc_id, string_agg(word, ' ' order by words.p) as kept from words left join gone on gone.doc_id = words.doc_id and gone.p = words.p where gone.p is null group by 1),
removed as (select doc_id, count(*) as n from gone group by 1)
select docs.doc_id, len(ws)::bigint as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from docs left join removed using (doc_id) left join left_ using (doc_id)
"""

NEAR_DUPLICATES = f"""
with recursive rows_ as (select doc_id, case when regexp_matches(text, '[^\\x20\\x09-\\x0D]') then sha256(text)[1:32] end as h, text from documents),
texts as (select h, min(doc_id) as text_id, any_value(text) as text from rows_ where h is not null group by 1),
ws as (select h, regexp_extract_all(text, '{_SPACED}') as ws from texts),
grams as (select distinct h, case when len(ws) < 5 then array_to_string(ws, ' ') else array_to_string(ws[i : i + 4], ' ') end as g from (select h, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from ws)),
sizes as (select h, count(*) as n from grams group by 1),
common as (select a.h as a, b.h as b, count(*) as c from grams a join grams b on a.g = b.g and a.h < b.h group by 1, 2),
links as (select a, b from common join sizes x on x.h = a join sizes y on y.h = b where 5 * c >= 4 * (x.n + y.n - c)),
both_ as (select a, b from links union all select b, a from links),
walk as (select a as x, a as y from both_ union select walk.x, both_.b from walk join both_ on both_.a = walk.y),
class as (select x as h, min({{'id': text_id, 'h': texts.h}}) as first from walk join texts on texts.h = walk.y group by 1),
n_links as (select a as h, count(*) as n from both_ group by 1)
select rows_.doc_id, coalesce(texts.text_id, rows_.doc_id) as text_id, coalesce(class.first.id, texts.text_id, rows_.doc_id) as class_id, coalesce(n_links.n, 0) as n_links, coalesce(class.first.h, rows_.h) as class_key
from rows_ left join texts on texts.h = rows_.h left join class on class.h = rows_.h left join n_links on n_links.h = rows_.h
"""

AUDIT = f"""
with docs as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
firsts as (select text, min(doc_id) as m from docs group by 1),
known as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
ws as (select doc_id, part, text, regexp_extract_all(text, '{_SPACED}') as ws, length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as capitals from docs),
facts as (select part, (len(ws) < 50)::int + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::int + 4 * (100 * capitals > 5 * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(doc_id > m, false)::int as mask, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
 from ws join firsts using (text) left join known using (doc_id)),
cells as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from facts group by 1, 2),
f as (select unnest([0, 1, 2, 3, 4]) as f),
orders as (select [a.f, b.f, c.f, d.f, e.f] as o from f a, f b, f c, f d, f e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps as (select o, k as step, o[k] as f, coalesce(list_sum(list_transform(o[1 : k - 1], lambda x: 1 << x)), 0)::int as before from orders, range(1, 6) t(k)),
sums as (select part, o, step, f, sum(case when mask & before = 0 and mask & (1 << f) = 0 then n else 0 end) as kept, sum(case when mask & before = 0 and mask & (1 << f) <> 0 then n else 0 end) as removed,
 sum(case when mask & before <> 0 and mask & (1 << f) <> 0 then n else 0 end) as redundant, sum(case when mask = 1 << f then n else 0 end) as unique_fails,
 sum(case when mask & before = 0 and mask & (1 << f) <> 0 then good else 0 end) as good_lost, sum(case when mask & before = 0 and mask & (1 << f) <> 0 then toxic else 0 end) as toxic_lost from cells, steps group by all)
select part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x + 1, 1)), '') as filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
 good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley from sums
"""


def _nearest(book: str) -> str:
    return f"select vec_id, x.part, arg_min(e.entry, d * 64 + e.entry) as entry, min(d) as d, any_value(x.v) as v from (select x.*, e.entry, list_sum(list_transform(list_zip(x.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from x join {book} e on e.part = x.part) x join {book} e on e.part = x.part and e.entry = x.entry group by 1, 2"


def _moved(book: str, found: str) -> str:
    return f"""select part, entry, coalesce(m.v, b.v) as v from {book} b left join (select part, entry, list(v order by k) as v from (select part, entry, k, floor(sum(v)::double / count(*))::bigint as v from (select part, entry, unnest(v) as v, generate_subscripts(v, 1) as k from {found}) group by 1, 2, 3) group by 1, 2) m using (part, entry)"""


#: The squared distances and sums of the given tables are far below 2^53, so that doubles hold them.
CODES = f"""
with own as (select vec_id, label, list_transform(embedding, lambda y: floor(256 * y)::bigint) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda y: y is not null and isfinite(y))) = len(embedding)),
x as materialized (select vec_id, p as part, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] as v from own, range(16) t(p)),
b0 as materialized (select part, (row_number() over (partition by part order by vec_id) - 1)::bigint as entry, v from x qualify entry < 64),
a1 as materialized ({_nearest("b0")}), b1 as materialized ({_moved("b0", "a1")}), a2 as materialized ({_nearest("b1")}), b2 as materialized ({_moved("b1", "a2")}), a3 as materialized ({_nearest("b2")}),
coded as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from a3 group by 1),
sums as (select label, sum(error)::bigint as label_error from coded join own using (vec_id) group by 1),
digest as (select sha256(string_agg(w::varchar, ',' order by part, entry, k)) as h from (select part, entry, unnest(v) as w, generate_subscripts(v, 1) as k from b2))
select vec_id, code, error, label_error, h as codebooks_sha256 from coded join own using (vec_id) join sums on sums.label is not distinct from own.label, digest
"""

COMPONENTS = f"""
with recursive own as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACED}') as ws from documents),
texts as (select ws, min(doc_id) as t from own where len(ws) > 0 group by 1),
grams as (select distinct t, array_to_string(ws[i : i + least(len(ws), 5) - 1], ' ') as g from (select t, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from texts)),
sizes as (select t, count(*) as n from grams group by 1),
common as (select a.t as a, b.t as b, count(*) as c from grams a join grams b on a.g = b.g and a.t < b.t group by 1, 2),
links as (select a, b from common join sizes x on x.t = a join sizes y on y.t = b where 100 * c >= 85 * (x.n + y.n - c)),
both_ as (select a, b from links union all select b, a from links),
walk as (select t as x, t as y from texts union select walk.x, both_.b from walk join both_ on both_.a = walk.y),
least_ as (select x as t, min(y) as m from walk group by 1)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(m, doc_id) as component_id, doc_id = coalesce(m, doc_id) as kept
from own left join texts using (ws) left join sizes using (t) left join least_ using (t)
"""
