"""SQL that says the same as the queries whose methods are exact, for small tables: it compares all pairs that share anything."""

from __future__ import annotations

from .urls import RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Links between classes of equal shingle sets; components by reachability.
NEAR = rf"""with recursive t as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
 s as (select rid, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from t),
 d as (select distinct rid, g from s), k as (select rid, md5(string_agg(g, chr(10) order by g)) as k, count(*) as n from d group by rid),
 c as (select k, any_value(n) as n, min(rid) as rep, min(doc_id) as first, count(*) as copies from k join t using (rid) group by k),
 p as (select a.rid as a, b.rid as b, count(*) as met from d a join c x on x.rep = a.rid join d b on a.g = b.g and a.rid <> b.rid join c y on y.rep = b.rid group by 1, 2),
 e as (select x.k as a, y.k as b, y.copies, y.first from p join c x on x.rep = p.a join c y on y.rep = p.b where met >= 0.8 * (x.n + y.n - met)),
 r as (select k as a, k as b from c union select r.a, e.b from r join e on e.a = r.b),
 o as (select r.a as k, min(c.first) as class_id from r join c on c.k = r.b group by 1), l as (select a as k, sum(copies) as n from e group by 1)
 select t.doc_id, coalesce(o.class_id, t.doc_id) as class_id, (case when c.k is null then 0 else c.copies - 1 + coalesce(l.n, 0) end)::bigint as n_links from t left join k on k.rid = t.rid left join c on c.k = k.k left join o on o.k = k.k left join l on l.k = k.k"""

REPEATS = rf"""with t as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents), x as (select rid, unnest(w) as word, generate_subscripts(w, 1) as pos from t),
 v as (select rid, doc_id, pos, array_to_string(w[pos:pos + 49], ' ') as s from (select rid, doc_id, w, unnest(range(1, len(w) - 48)) as pos from t where len(w) >= 50)),
 m as (select s, min(doc_id) as least from v group by s having min(doc_id) <> max(doc_id)), g as (select distinct rid, unnest(range(v.pos, v.pos + 50)) as pos from v join m using (s) where v.doc_id > m.least),
 k as (select x.rid, count(g.rid) as gone, string_agg(case when g.rid is null then x.word end, ' ' order by x.pos) as kept from x left join g on g.rid = x.rid and g.pos = x.pos group by x.rid)
 select doc_id, len(w) as n_words, coalesce(gone, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from t left join k using (rid)"""

_REST = "coalesce(case when instr({0}, '://') > 0 then substr({0}, instr({0}, '://') + 3) end, '')"
_LOW = "translate(regexp_extract({0}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TAIL = "(case when regexp_matches({0}, '^[A-Za-z][A-Za-z0-9+.-]*://') then regexp_replace({0}, '^[A-Za-z][A-Za-z0-9+.-]*://', '') end)"
_PATH = "regexp_extract({0}, '^[^/?#]*([^?#]*)', 1)"
#: A path's steps without `.`, and `..` with the step before it, once each of up to eight (enough for the tests).
_STEPS = "('/' || array_to_string(list_filter(string_split({0}, '/'), lambda x: x not in ('', '.')), '//') || '/')"
for _ in range(8):
    _STEPS = f"regexp_replace(regexp_replace({_STEPS}, '^(/\\.\\./)+', '/'), '/([^/.][^/]*|\\.[^/.][^/]*)//\\.\\./', '/')"
_NODE = f"(case when {_LOW} <> '' then {_LOW} || '/' || trim(replace({_STEPS.format(_PATH)}, '//', '/'), '/') || '/' || regexp_extract(regexp_extract({{0}}, '^[^/?#]*([^#]*)', 1), '\\?.*$') end)"
_TAGS = r"list_filter(regexp_extract_all(html, '(?is)<{0}\b[^>]*>'), lambda x: regexp_matches(x, '(?is)\b{1}\s*=\s*[\"'']?{2}\b') and regexp_matches(x, '(?is)\b{3}\s*=\s*[\"'']?[^\"''\s>]'))"
_LINK = r"list_transform({0}, lambda x: regexp_extract(x, '(?is)\b{1}\s*=\s*[\"'']?([^\"''\s>]+)', 1))"
_FITS = [(what, rule, rule.split("/", 1)) for what, rule in sorted(RULES, key=lambda r: -len(r[1]))]
_CASE = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}') then '{{{k}}}'" for k, (_, _, (h, p)) in enumerate(_FITS))
_LEADS = rf"""case when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') then {_TAIL.format("t")} when starts_with(t, '//') then substr(t, 3) when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') or starts_with(t, '#') then null
 when starts_with(t, '/') then site || t when starts_with(t, '?') then site || way || t else site || case when contains(way, '/') then regexp_extract(way, '^.*/') else '/' end || t end"""
URLS = f"""with recursive a as (select page_id, {_REST.format("url")} as rest, {_TAIL.format("url")} as own, list_concat({_LINK.format(_TAGS.format("link", "rel", "canonical", "href"), "href")}, {_LINK.format(_TAGS.format("meta", "http-equiv", "refresh", "url"), "url")}) as links from pages),
 b as (select page_id, {_LOW.format("rest")} as host, {_PATH.format("rest")} as path, {_NODE.format("own")} as node, regexp_extract(own, '^[^/?#]*') as site, {_PATH.format("own")} as way, links from a),
 p as (select *, case {_CASE.format(*[rule for _, rule, _ in _FITS])} end as rule, case {_CASE.format(*[what for what, _, _ in _FITS])} end as said from b),
 l as (select node, site, way, unnest(links) as t from p where node is not null), m as (select node as x, {_LEADS} as r from l), e as (select x, {_NODE.format("r")} as y from m),
 f as (select x, y from e where y is not null union select y, x from e where y is not null),
 n as (select node from p where node is not null union select x from f), w as (select node as x, node as y from n union select w.x, f.y from w join f on f.x = w.y), o as (select x as node, min(y) as root from w group by 1),
 h as (select root from p join o using (node) where said is not null group by root having bool_or(said = 'block') and not bool_or(said = 'allow'))
 select page_id, host, path, rule, coalesce(said, case when h.root is not null then 'block' end, 'allow') as verdict from p left join o on o.node = p.node left join h on h.root = o.root"""
