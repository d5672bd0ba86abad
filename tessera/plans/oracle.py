"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from collections.abc import Sequence


def _norm(n: str) -> str:
    shift = f"greatest(length(bin(({n}) - 24)) - 4, 0)"
    return f"(case when {n} < 24 then {n} else 24 + (((({n}) - 24) >> {shift}) << {shift}) end)"


def _words(c: str, low: bool = True) -> str:
    return f"list_filter(string_split_regex({f'lower({c})' if low else c}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


#: Texts as words, with the corpus numbers of BM25.
TOKENS = f"t as (select *, {_words('text')} as w from documents), s as (select count(w) as n, avg(len(w)) as a from t)"


def _tf(word: str, w: str = "w") -> str:
    return f"len(list_filter({w}, lambda x: x = '{word}'))"


def _df(word: str, table: str = "t", w: str = "w") -> str:
    return f"(select count(*) from {table} where list_contains({w}, '{word}'))"


def _idf(df: str, n: str = "(select n from s)") -> str:
    return f"ln(1 + ({n} - {df} + 0.5) / ({df} + 0.5))"


def _bm25(tf: str, weight: str, length: str = "len(w)", average: str = "(select a from s)") -> str:
    return f"({weight} - {weight} / (1 + {tf} / (1.2 * (0.25 + 0.75 * {_norm(length)} / {average}))))"


def _term(word: str) -> str:
    return f"(case when list_contains(w, '{word}') then {_bm25(_tf(word), _idf(_df(word)))} else 0 end)"


def _phrase(words: Sequence[str]) -> str:
    places = " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
    return f"len(list_filter(range(1, len(w) + 1), lambda i: {places}))"


PLACES = "(select *, (c_custkey * 37 % 1700)::double / 10 - 85 as lat, (c_custkey * 101 % 3600)::double / 10 - 180 as lon from customer)"
GRID = lambda c, span: f"least(floor(({c} + {span}) * (4294967296.0 / {2 * span})), 4294967295)"
HAVERSINE = "2 * 6371008.7714 * asin(least(sqrt(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2)), 1))"
SPAN = "(select p_partkey, p_size::bigint as lo, p_size + p_partkey % 7 as hi from part)"
RING = [[-50, -50], [60, -40], [70, 50], [-40, 60]], [[-10, -10], [10, -10], [10, 10], [-10, 10]]
EDGES = ", ".join(f"({a[0]}.0, {a[1]}.0, {b[0]}.0, {b[1]}.0)" for r in RING for a, b in zip(r, [*r[1:], r[0]]) if a[1] != b[1])
VECTOR = "q as (select embedding as v from embeddings where vec_id = 0)"
COSINE = "list_cosine_similarity(embedding::double[], (select v::double[] from q))"
HEAD = f"h as (select *, {_words('text')} as w, {_words('string_split(text, chr(10))[1]')} as g from documents)"


SQL: dict[str, str] = {
    "match_all_topk": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20",
    "filter_range_sort_topk": """select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_quantity >= 10 and l_quantity < 20
        and l_shipdate >= timestamp '1995-03-01' and l_shipdate < timestamp '1995-06-01' and l_discount >= 0.05
        order by l_extendedprice desc, l_orderkey, l_partkey, l_suppkey, l_linenumber limit 50""",
    "match_none": "select o_orderkey from orders where false",
    "any_of_bool": "select o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_totalprice > 100000 and o_orderstatus <> 'F'",
    "min_match_bool": """with m as (select p_partkey, (p_size >= 20)::int + (starts_with(p_type, 'S'))::int + (p_retailprice < 1000)::int as n from part)
        select p_partkey, n::double as _score_ from m where n >= 2""",
    "exists_missing": "select c_custkey from customer where c_acctbal < 100",
    "pagination": "select o_orderkey from orders order by o_orderdate desc, o_orderkey limit 15 offset 40",
    "expression_sort": "select l_orderkey, l_linenumber from lineitem order by l_extendedprice * (1 - l_discount) * 2 desc, l_orderkey, l_linenumber, l_partkey limit 25",
    "prefix_terms": f"select p_partkey from part where len(list_filter({_words('p_name')}, lambda x: starts_with(x, 'al'))) > 0",
    "wildcard_terms": "select p_partkey from part where regexp_full_match(p_type, '.*A..*')",
    "regex_terms": "select p_partkey from part where regexp_full_match(p_brand, 'Brand#[1-3][24]')",
    "string_range": "select c_custkey from customer where c_mktsegment >= 'B' and c_mktsegment < 'F'",
    "ip_cidr": "select c_custkey from customer where (c_custkey % 65536) // 256 < 4",
    "range_relations": f"""select p_partkey, 'intersects' as relation from {SPAN} where lo <= 22 and hi >= 20 union all
        select p_partkey, 'contains' from {SPAN} where lo <= 20 and hi >= 22 union all select p_partkey, 'within' from {SPAN} where lo >= 20 and hi <= 22""",
    "selective_filters": "select o_orderstatus as status, count(*) as count from orders where o_totalprice > 150000 group by 1 order by 2 desc, 1 limit 5",
    "match_bm25_topk": f"with {TOKENS} select doc_id, round({' + '.join(map(_term, ('the', 'of', 'tion')))}, 6) as score from t where list_has_any(w, ['the', 'of', 'tion']) order by {' + '.join(map(_term, ('the', 'of', 'tion')))} desc, doc_id limit 20",
    "match_and": f"with {TOKENS} select doc_id, round({' + '.join(map(_term, ('de', 'la', 'que')))}, 6) as score from t where list_has_all(w, ['de', 'la', 'que'])",
    "phrase_exact": f"with {TOKENS}, f as (select *, {_phrase(['of', 'the'])} as f from t) select doc_id, round({_bm25('f', f'({_idf(_df('of'))} + {_idf(_df('the'))})')}, 6) as score from f where f > 0",
    "dis_max": f"""with {TOKENS}, m as (select doc_id, case when list_contains(w, 'the') then {_term('the')} end as a, case when list_contains(w, 'and') then {_term('and')} * 1.5 end as b, case when lang = 'fr' then 0.25 end as c from t),
        x as (select doc_id, greatest(a, b, c) as top, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) as total from m where coalesce(a, b, c) is not null)
        select doc_id, round(top + (total - top) * 0.3, 6) as score from x order by top + (total - top) * 0.3 desc, doc_id limit 40""",
    "rescore_min_score": f"with {TOKENS} select doc_id, round(ln(1 + n_chars) * 2, 6) as score from t where list_contains(w, 'the') and ln(1 + n_chars) * 2 >= 14",
    "fuzzy_vocab": f"""with {TOKENS}, v as (select t, count(*) as df, levenshtein(t, 'their') as d from (select unnest(list_distinct(w)) as t from t) where starts_with(t, 't') and length(t) between 4 and 6 group by t having levenshtein(t, 'their') <= 1 order by d, df desc, t limit 50)
        select doc_id from t where list_has_any(w, (select list(t) from v))""",
    "case_insensitive": f"select doc_id from documents where list_contains({_words('text')}, 'the')",
    "multi_match_combined": f"""with {HEAD}, n as (select count(*) as n, 2 * avg(len(g)) + avg(len(w)) as a from h),
        d as (select unnest(['the', 'of']) as t, unnest([greatest({_df('the', 'h')}, {_df('the', 'h', 'g')}), greatest({_df('of', 'h')}, {_df('of', 'h', 'g')})]) as df),
        m as (select doc_id, 2 * len(g) + len(w) as l, {' , '.join(f"2 * {_tf(x, 'g')} + {_tf(x)} as f{i}, (select {_idf('df', '(select n from n)')} from d where t = '{x}') as i{i}" for i, x in enumerate(('the', 'of')))} from h),
        x as (select doc_id, {' + '.join(f"case when f{i} > 0 then {_bm25(f'f{i}', f'i{i}', 'l', '(select a from n)')} else 0 end" for i in (0, 1))} as score from m where f0 + f1 > 0)
        select doc_id, round(score, 6) as score from x order by x.score desc, doc_id limit 25""",
    "multi_match_per_field": f"""with {HEAD}, n as (select count(*) as n, avg(len(g)) as ag, avg(len(w)) as aw from h),
        m as (select doc_id, case when list_contains(g, 'the') then 3 * {_bm25(_tf('the', 'g'), _idf(_df('the', 'h', 'g'), '(select n from n)'), 'len(g)', '(select ag from n)')} end as a,
          case when list_contains(w, 'the') then {_bm25(_tf('the'), _idf(_df('the', 'h'), '(select n from n)'), 'len(w)', '(select aw from n)')} end as b from h),
        x as (select doc_id, greatest(a, b) * 0.9 + (coalesce(a, 0) + coalesce(b, 0)) * 0.1 as score from m where coalesce(a, b) is not null)
        select doc_id, round(score, 6) as score from x order by x.score desc, doc_id limit 25""",
    "text_facet": f"select term, count(*) as count from (select unnest(list_distinct({_words('text')})) as term from documents where lang = 'en') where starts_with(term, 'th') and term <> 'that' group by term order by count desc, term limit 25",
    "field_facet": "select o_orderpriority as priority, count(*) as count from orders group by 1 order by 2 desc, 1 limit 3",
    "field_facet_numeric": "select p_size as size, count(*) as count from part group by 1 having count(*) >= 2 order by 2 desc, 1 limit 10 offset 2",
    "field_facet_metric_sort": "select l_returnflag as flag, count(*) as count, round(avg(l_extendedprice), 4) as price, min(l_quantity) as least from lineitem group by 1",
    "field_facet_nested": """with c as (select l_returnflag as flag, l_linenumber as line, count(*) as count from lineitem group by 1, 2)
        select flag, line, count from c qualify row_number() over (partition by flag order by count desc, line) <= 3""",
    "top_docs_per_bucket": """select o_orderpriority as priority, o_orderkey, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey)::int as rank from orders
        qualify rank <= 3""",
    "range_facet_fixed": "select g * 10000 as price, count(l_orderkey) as count from range(12) r(g) left join lineitem on floor(l_extendedprice / 10000) = g group by g",
    "range_facet_data": "select g as size, count(p_partkey) as count from range((select min(p_size) // 7 * 7 from part), (select max(p_size) + 1 from part), 7) r(g) left join part on p_size // 7 * 7 = g group by g",
    "date_hist_month": """select epoch_ms(g)::bigint as month, count(o_orderkey) as count from range((select date_trunc('month', min(o_orderdate))::timestamp from orders), (select max(o_orderdate) + interval 1 microsecond from orders), interval 1 month) r(g)
        left join orders on date_trunc('month', o_orderdate) = g group by g""",
    "query_facet_overlap": "select tier, count(l_orderkey) as count, round(avg(l_extendedprice), 4) as price from (values ('small'), ('cheap'), ('none'), ('returned')) b(tier) left join lineitem on (tier = 'small' and l_quantity < 10) or (tier = 'cheap' and l_extendedprice < 20000) or (tier = 'none' and l_quantity > 1000) or (tier = 'returned' and l_returnflag = 'R') group by tier",
    "multi_select_any": """select 'status' as facet, o_orderstatus as val, count(*) as count from orders where o_orderpriority in ('1-URGENT', '5-LOW') group by 2
        union all select 'priority', o_orderpriority, count(*) from orders where o_orderstatus = 'F' group by 2""",
    "multi_select_all": """select 'status' as facet, o_orderstatus as val, count(*) as count from orders where o_orderstatus = 'F' group by 2
        union all select 'priority', o_orderpriority, count(*) from orders where o_orderstatus = 'F' group by 2""",
    "count_distinct_bucket": "select l_returnflag as flag, count(distinct (l_partkey, l_suppkey)) as count from lineitem group by 1",
    "domain_override": "select o_orderpriority as priority, count(*) as count from orders where o_orderstatus = 'O' and o_totalprice > 50000 group by 1",
    "metrics": """select sum(l_linenumber)::bigint as n, round(avg(l_extendedprice), 4) as price, min(l_quantity) as least, max(l_tax) as most, count(distinct l_partkey) as parts, round(quantile_cont(l_extendedprice, 0.95), 4) as p95,
        round(100.0 * count(*) filter (l_quantity <= 25) / count(*), 4) as rank, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) as weighted, round(avg(case when l_quantity > 25 then l_extendedprice else 0 end), 4) as big from lineitem""",
    "collapse_head": "select o_orderkey, o_custkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1 order by o_totalprice desc, o_orderkey limit 30",
    "collapse_head_sort": """with r as (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as b, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as h, count(*) over (partition by o_custkey) as members from orders),
        g as (select o_custkey, o_totalprice as p, o_orderkey as k from r where b = 1 order by p desc, k limit 30)
        select o_orderkey, o_custkey, members from r join g using (o_custkey) where h = 1""",
    "collapse_metric_sort": """with g as (select o_custkey, max(o_totalprice) as total, max(o_totalprice) - min(o_totalprice) as spread, min(o_orderkey) as o_orderkey from orders group by 1)
        select o_orderkey, o_custkey, round(total, 4) as total, round(spread, 4) as spread from g order by g.total desc, o_orderkey limit 20""",
    "diversify_cap": "with r as (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as n from orders) select o_orderkey, o_orderpriority from r where n <= 4 order by o_totalprice desc, o_orderkey limit 15",
    "fusion_rrf": f"""with {TOKENS}, a as (select doc_id, 2.0 / (60 + row_number() over (order by {_term('the')} desc, doc_id)) as p from t where list_contains(w, 'the') order by {_term('the')} desc, doc_id limit 50),
        b as (select doc_id, 1.0 / (60 + row_number() over (order by n_chars desc nulls last, doc_id)) as p from t order by n_chars desc nulls last, doc_id limit 50), u as (select * from a union all select * from b), g as (select doc_id, sum(p) as x from u group by 1)
        select doc_id, round(x::double, 8) as score from g order by x desc, doc_id limit 30""",
    "fusion_linear": f"""with {TOKENS}, a as (select doc_id, {_term('the')} as p from t where list_contains(w, 'the') order by p desc, doc_id limit 60),
        b as (select doc_id, coalesce(n_chars, 0)::double as p from t order by p desc, doc_id limit 60),
        u as (select doc_id, 0.3 * (p - min(p) over ()) / (max(p) over () - min(p) over ()) as p from a union all select doc_id, 0.7 * (p - min(p) over ()) / (max(p) over () - min(p) over ()) from b), g as (select doc_id, sum(p) as x from u group by 1)
        select doc_id, round(x, 6) as score from g order by x desc, doc_id limit 40""",
    "knn_cosine": f"with {VECTOR} select vec_id, label, round({COSINE}, 5) as score from embeddings order by {COSINE} desc, vec_id limit 12",
    "knn_l2": f"with {VECTOR} select vec_id, label, round(1 / (1 + power(list_distance(embedding::double[], (select v::double[] from q)), 2)), 5) as score from embeddings order by list_distance(embedding::double[], (select v::double[] from q)), vec_id limit 12",
    "knn_filtered": f"with {VECTOR} select vec_id, label, round({COSINE}, 5) as score from embeddings where label < 3 order by {COSINE} desc, vec_id limit 8",
    "knn_similarity": f"with {VECTOR} select vec_id, label, round({COSINE}, 5) as score from embeddings where {COSINE} >= 0.2 order by {COSINE} desc, vec_id limit 20",
    "knn_groups": f"with {VECTOR} select vec_id, label, round({COSINE}, 5) as score from embeddings qualify row_number() over (partition by label order by {COSINE} desc, vec_id) = 1 order by {COSINE} desc, vec_id limit 5",
    "nested_any_same_child": "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R' and l_quantity >= 45)",
    "nested_not": "select o_orderkey from orders where o_orderstatus = 'F' and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')",
    "nested_children_count": "select l_orderkey as o_orderkey, round(sum(l_quantity), 4) as score from lineitem join orders on o_orderkey = l_orderkey where l_returnflag = 'N' group by 1 having count(*) between 2 and 3",
    "child_reducer_sort": "select o_orderkey from orders left join (select l_orderkey, max(l_extendedprice) as m from lineitem group by 1) on l_orderkey = o_orderkey order by m desc nulls last, o_orderkey limit 25",
    "domain_children": "select l_returnflag as flag, count(*) as count from lineitem join orders on o_orderkey = l_orderkey where o_totalprice > 200000 and l_quantity > 10 group by 1",
    "row_children": """with p as (select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 10),
        r as (select o_orderkey, l_partkey, l_extendedprice, row_number() over (partition by o_orderkey order by l_extendedprice desc, l_linenumber, l_partkey) as n from p join lineitem on l_orderkey = o_orderkey where l_quantity > 5)
        select o_orderkey, l_partkey, l_extendedprice from r where n <= 2""",
    "geo_box": f"select c_custkey from {PLACES} where {GRID('lat', 90)} between {GRID('-20', 90)} and {GRID('40', 90)} and ({GRID('lon', 180)} >= {GRID('170', 180)} or {GRID('lon', 180)} <= {GRID('-150', 180)})",
    "geo_distance": f"with p as (select c_custkey, {HAVERSINE.format(lat1='lat', lon1='lon', lat2='50.0', lon2='10.0')} as m from {PLACES}) select c_custkey, round(m / 1000, 3) as km from p where m <= 2500000",
    "geo_polygon": f"select c_custkey from {PLACES} where (select count(*) from (values {EDGES}) e(a, b, c, d) where ((b > lat) <> (d > lat)) and lon < (c - a) * (lat - b) / (d - b) + a) % 2 = 1",
    "value_math": """select p_partkey, p_size * 2 - p_partkey % 7 as a, round(p_retailprice / p_size, 6) as b, round(floor(p_retailprice / 7 + 0.5) + floor(p_retailprice) + round_even(p_size / 4.0, 0), 6) as c,
        greatest(least(p_size, 30), 10)::bigint + greatest(p_size, 25) + least(p_size, 5) as e, round(case when p_size > 20 and p_retailprice < 1200 then sqrt(p_retailprice) else ln(1 + p_size) end, 6) as f,
        -1 as g, (p_size + 1)::bigint * (p_size + 1) as h, round(sqrt(p_size * p_size + 9) + atan2(p_size, 2) + cbrt(p_size), 6) as i from part""",
    "value_bits": "select o_orderkey, (o_orderkey & 255) | (o_custkey << 3) as a, xor(o_orderkey, o_custkey) as b, (~o_orderkey) >> 2 as c, (o_orderkey >> 3) + 64 as e from orders",
    "value_dates": """select event_id, year(ts) as y, month(ts) as m, isodow(ts) as dow, dayofyear(ts) as doy, weekofyear(ts) as w, quarter(ts) as q, hour(ts + interval 330 minute) as h, minute(ts) as mi, epoch_us(ts) // 1000 as ms, epoch_us(ts) // 1000 % 86400000 as mod from events""",
    "value_decay": """select p_partkey, round(exp(ln(0.4) * power(greatest(abs(p_size - 25) - 2, 0), 2) / 100), 6) as g, round(exp(ln(0.5) * abs(p_size - 25) / 10.0), 6) as e, round(greatest(0, (600 - abs(p_retailprice - 1000)) / 600), 6) as l from part""",
    "value_geo": f"""select c_custkey, (8::bigint << 58) | (least(greatest(floor((lon + 180) / 360 * 256), 0), 255)::bigint << 29) | least(greatest(floor((1 - ln(tan(radians(least(greatest(lat, -85.05112878), 85.05112878))) + 1 / cos(radians(least(greatest(lat, -85.05112878), 85.05112878)))) / pi()) / 2 * 256), 0), 255)::bigint as tile,
        (lat <= 40 and lat >= -20 and lon between -20 and 60)::bigint as box, round({HAVERSINE.format(lat1='lat', lon1='lon', lat2='0.0', lon2='0.0')} / 1000, 4) as arc,
        round((degrees(atan2(sin(radians(20 - lon)) * cos(radians(10)), cos(radians(lat)) * sin(radians(10)) - sin(radians(lat)) * cos(radians(10)) * cos(radians(20 - lon)))) + 360) % 360, 4) as bearing from {PLACES}""",
    "upsert_delete": """select o_orderkey, o_totalprice, o_orderstatus from orders where o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0
        union all select o_orderkey, o_totalprice + 1, 'X' from orders where o_orderkey % 5 = 0""",
    "ingest_latest": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "ingest_errors": "select c_custkey as id, 'balance is not double' as error from customer where c_custkey % 11 = 0",
    "field_map": "select n_nationkey as id, n_name as name from nation",
    "change_log": "select user_id as id, event_id as seq, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1 and event_type <> 'purchase'",
}
