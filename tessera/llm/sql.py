"""DuckDB SQL for the queries that SQL can express over whole tables."""

from . import line_dedup, secret_scan
from .queries import LISTED_LABELS, URL_RULES

_TRIM = r"regexp_replace(l, '^[ \t\r]+|[ \t\r]+$', '', 'g')"

OP2 = f"""
with d as (select row_number() over () as r, doc_id, source, text from documents),
l as (select r, doc_id, source, i, l, {_TRIM} as k from (
  select r, doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) as i, unnest(string_split(text, chr(10))) as l from d)),
bad as (select k from l where length(k) >= {line_dedup.MIN_CHARS} and source is not null group by k having count(distinct source) >= {line_dedup.MIN_SITES}),
o as (select r, coalesce(string_agg(l, chr(10) order by i) filter (where not gone), '') as kept, sum(gone::int)::bigint as n
  from (select l.*, k in (select k from bad) as gone from l) group by r)
select doc_id, source, case when n > 0 then kept else text end as text, coalesce(n, 0)::bigint as n_removed from d left join o using (r)
"""


def _op6() -> str:
    spelled = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    parts = []
    for rank, (kind, pattern, group, least) in enumerate((*secret_scan.BASE, *secret_scan.ADDED)):
        pattern = secret_scan.SCANNED.get(kind, pattern).replace("(?i:password|passwd|secret|token|api_?key)", spelled).replace("'", "''")
        parts.append(f"""select doc_id, source, '{kind}' as kind, {rank} as rank, {least} as least, string_split_regex(text, '{pattern}') as gaps,
  regexp_extract_all(text, '{pattern}', 0) as whole, regexp_extract_all(text, '{pattern}', {group}) as secrets from documents where text is not null""")
    base = ", ".join(f"'{k[0]}'" for k in secret_scan.BASE)
    return f"""
with f as ({" union all ".join(parts)}),
m as (select doc_id, source, kind, rank, least, i, secrets[i] as secret, whole, gaps from (select *, unnest(range(1, len(whole) + 1)) as i from f)),
p as (select distinct doc_id, source, kind, rank, secret, (list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[:i-1], lambda x: length(x))), 0))::bigint as s, length(whole[i]) as n from m
  where length(secret) >= least and (kind in ({base}) or (regexp_matches(secret, '[a-z]') and regexp_matches(secret, '[A-Z]') and regexp_matches(secret, '[0-9]')))),
c as (select secret, count(distinct source) as owners from p group by secret),
v as (select p.*, case when owners >= {secret_scan.COPIED_OWNERS} then 'example'
  when len(list_distinct(string_split(secret, ''))) >= 8 and not regexp_matches(secret, '{_RUNS}|(?i)example|changeme|placeholder|your[_-]') then 'live' else 'weak' end as verdict
  from p join c using (secret)),
k as (select *, concat_ws(':', kind, s::varchar, (s + n)::varchar) as t from v where kind in ({base}) or verdict = 'live'),
g as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg(t, ',' order by s, rank) filter (kind in ({base})) as base, string_agg(t, ',' order by s, rank) as spans,
  count(*) filter (verdict = 'live') as n_live, count(*) filter (verdict = 'example') as n_example, count(*) filter (verdict = 'weak') as n_weak from k group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example, coalesce(n_weak, 0) as n_weak
from documents d left join g using (doc_id)
"""


#: RE2 has no back references: a run of four of any character of a secret.
_RUNS = "|".join(f"[{c}]{{4}}" for c in "+/_.=-") + "|" + "|".join(f"{c}{{4}}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _op7() -> str:
    rules = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in URL_RULES)
    labels = ", ".join(f"'{x}'" for x in LISTED_LABELS)
    return f"""
with p as (select row_number() over () as r, page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UP}', '{_LOW}'), '') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
q as (select *, list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '(?i)^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))) as kept from p),
c as (select *, case when host = '' then '' else regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\\.', '') || regexp_replace(path, '/+$', '')
  || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as canonical_url from q),
listed as (select distinct canonical_url from c where list_has_any(string_split(host, '.'), [{labels}]) and canonical_url <> ''),
rules(rh, rp, v) as (values {rules}),
best as (select r, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(v, length(rh || rp)) as v from c join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by r)
select page_id, host, path, rule, coalesce(v, case when canonical_url in (select canonical_url from listed) then 'block' else 'allow' end) as verdict,
  canonical_url, canonical_url in (select canonical_url from listed) as listed from c left join best using (r)
"""


_NORMAL = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"

OP8 = rf"""
with recursive m as (select row_number() over () as r, conv_id, turn, role, text, string_split_regex(text, '\r?\n') as ls from conversations),
c as (select *, regexp_replace(array_to_string(list_filter(ls, lambda x: not regexp_matches(x, '^[ \t]*>') and not regexp_matches(x, '^On .{{1,200}} wrote:[ \t]*$')), chr(10)), '^\s+|\s+$', '', 'g') as clean_text from m),
l as (select r, conv_id, turn, i, regexp_extract(x, '^(?:[ \t]*>)+[ \t]?', 0) as mark, regexp_replace(x, '^(?:[ \t]*>)+[ \t]?', '') as line
  from (select r, conv_id, turn, generate_subscripts(ls, 1) as i, unnest(ls) as x from m)),
q as (select *, length(regexp_replace(mark, '[^>]', '', 'g')) as level from l where mark <> ''),
n as (select *, i - row_number() over (partition by r, level order by i) as run from q),
s as (select r, conv_id, turn, level, run, string_agg(line, chr(10) order by i) as whole, list(line) as lines from n group by all),
a as (select r, conv_id, turn, level, run, 0 as how, {_NORMAL.format('whole')} as t from s union select r, conv_id, turn, level, run, 1, {_NORMAL.format('x')} from (select *, unnest(lines) as x from s)),
o as (select conv_id, {_NORMAL.format('x')} as t, min(turn) as origin from (
  select conv_id, turn, unnest(list_concat([clean_text], list_concat(string_split_regex(clean_text, '\n\s*\n'), string_split(clean_text, chr(10))))) as x from c) group by all),
k as (select r, conv_id, turn, level, run, arg_min(origin, how * 1000000000 + origin) as origin from a join o using (conv_id, t) where t <> '' and origin < turn group by all),
p as (select r, any_value(conv_id) as conv_id, any_value(turn) as turn, count(*) as n_linked, arg_min(origin, level * 1000000000 - origin) as parent_turn from k group by r),
e as (select conv_id, turn, min(parent_turn) as up from p group by all),
w as (select conv_id, turn, up, 1 as depth from e union all select w.conv_id, w.turn, e.up, depth + 1 from w join e on e.conv_id = w.conv_id and e.turn = w.up),
z as (select conv_id, turn, min(up) as root, max(depth) as depth from w group by all)
select c.conv_id, c.turn, c.role, c.clean_text, coalesce((select count(*) from s where s.r = c.r), 0)::bigint as n_quotes, coalesce(n_linked, 0)::bigint as n_linked,
  parent_turn, coalesce(root, c.turn) as thread_root, coalesce(depth, 0)::bigint as depth
from c left join p using (r) left join z on z.conv_id = c.conv_id and z.turn = c.turn and p.r is not null
"""

OP9 = """
with recursive w as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
x as (select r, doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) end as s from w),
c as (select min(r) as c, s from (select r, list_sort(s) as s from x where len(s) > 0) group by s),
m as (select x.r, x.doc_id, len(x.s)::bigint as n, c.c from x left join c on list_sort(x.s) = c.s),
u as (select c, len(s) as n, unnest(s) as t from c),
p as (select a.c as a, b.c as b from u a join u b on a.t = b.t and a.c < b.c and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  group by a.c, b.c, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e as (select a, b from p union all select b, a from p),
g(a, b) as (select c, c from c union select g.a, e.b from g join e on g.b = e.a),
k as (select m.c, min(doc_id) as own from m where c is not null group by m.c),
z as (select g.a as c, min(k.own) as component_id from g join k on k.c = g.b group by g.a)
select m.doc_id, m.n as n_shingles, coalesce(z.component_id, m.doc_id) as component_id from m left join z using (c)
"""

SQL = {"op2_line_dedup": OP2, "op6_secret_scan": _op6(), "op7_url_filter": _op7(), "op8_quotation_linking": OP8, "op9_ngram_join": OP9}
