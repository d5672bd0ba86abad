"""Registered queries of the search engine over the driver's tables, each through the engine's own requests."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..functions.values import Names
from ..operators.collection import Collection
from ..operators.search import search
from ..sources.store import checked, latest, mapped, upserted
from ..streaming.ingest import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Roles of the tables' columns that names don't tell.
DOCUMENTS = {"text": {"type": "text", "analyzer": "whitespace_lower"}}
PARTS = {"p_name": {"type": "text", "analyzer": "whitespace_lower", "variants": {"s": "string"}, "value": "s"}}
VECTORS = {"embedding": {"type": "vector", "metric": "cosine"}}
#: The query vector of the kNN queries: the first row's.
FIRST = 0


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collection(spark: SparkSession, sf_dir: str, name: str, key: str | None, schema: Mapping[str, Any] | None = None, **extra: Any) -> Collection:
    """Without a unique key, a whole row is its own."""
    df = table(spark, sf_dir, name)
    df = df.withColumns({n: F.expr(e) for n, e in extra.items()}) if extra else df
    return Collection(df if key else df.withColumn("id", F.struct(*df.columns)), schema, key or "id")


def _frame(c: Collection, request: Mapping[str, Any], op: str) -> DataFrame:
    return search(c, {"limit": 0, "count_limit": 0, **request}).ops[op].frame


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def orders(s: SparkSession, d: str) -> Collection:
    return collection(s, d, "orders", "o_orderkey")


def lineitem(s: SparkSession, d: str) -> Collection:
    return collection(s, d, "lineitem", None)


def part(s: SparkSession, d: str) -> Collection:
    return collection(s, d, "part", "p_partkey", PARTS)


def documents(s: SparkSession, d: str) -> Collection:
    return collection(s, d, "documents", "doc_id", DOCUMENTS)


def baskets(s: SparkSession, d: str) -> Collection:
    """Orders with their lines as nested items."""
    items = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_extendedprice"))).alias("items"))
    joined = table(s, d, "orders").join(items, F.col("o_orderkey") == F.col("k"), "left").drop("k")
    return Collection(joined, {"items": "nested"}, "o_orderkey")


def places(s: SparkSession, d: str) -> Collection:
    """Customers at points made from their keys."""
    return collection(s, d, "customer", "c_custkey", None, at="named_struct('lat', double(c_custkey * 37 % 1700) / 10 - 85, 'lon', double(c_custkey * 101 % 3600) / 10 - 180)")


# Scans, filters, sorts


@query
def match_all_topk(s, d):
    return search(orders(s, d), {"query": "*:*", "sort": "o_totalprice desc", "limit": 20, "fields": ["o_orderkey", "o_totalprice"]}).docs


@query
def filter_range_sort_topk(s, d):
    return search(lineitem(s, d), {"query": "*:*", "filter": ["l_quantity:[10 TO 20} AND l_shipdate:[1995-03 TO 1995-05]", "l_discount:>=0.05"], "sort": ["l_extendedprice desc", "l_orderkey asc"], "limit": 50, "fields": ["l_orderkey", "l_linenumber", "l_extendedprice"]}).docs


@query
def match_none(s, d):
    return search(orders(s, d), {"query": {"none": {}}, "fields": ["o_orderkey"]}).docs


@query
def any_of_bool(s, d):
    q = {"boolean": {"required": [{"any_of": {"field": "o_orderpriority", "vals": ["1-URGENT", "2-HIGH"]}}], "filter": ["o_totalprice:>100000"], "prohibited": [{"match": {"o_orderstatus": "F"}}]}}
    return search(orders(s, d), {"query": q, "limit": -1, "sort": "o_orderkey", "fields": ["o_orderkey", "o_orderpriority"]}).docs


@query
def min_match_bool(s, d):
    c = collection(s, d, "part", "p_partkey")
    q = {"boolean": {"optional": [{"range": {"field": "p_size", "gte": 20}}, {"prefix": {"field": "p_type", "prefix": "S"}}, {"range": {"field": "p_retailprice", "lt": 1000}}], "min_match": 2}}
    return search(c, {"query": q, "limit": -1, "get_scores": True, "sort": "p_partkey", "fields": ["p_partkey"]}).docs


@query
def exists_missing(s, d):
    c = collection(s, d, "customer", "c_custkey", None, balance="if(c_acctbal < 0, null, c_acctbal)")
    return search(c, {"query": "NOT balance:* OR balance:<100", "limit": -1, "sort": "c_custkey", "fields": ["c_custkey"]}).docs


@query
def pagination(s, d):
    return search(orders(s, d), {"sort": ["o_orderdate desc", "o_orderkey"], "offset": 40, "limit": 15, "fields": ["o_orderkey"]}).docs


@query
def expression_sort(s, d):
    return search(lineitem(s, d), {"sort": [{"expr": "l_extendedprice * (1 - l_discount) * $k", "vars": {"k": 2}, "dir": "desc"}, "l_orderkey", "l_linenumber", "l_partkey"], "limit": 25, "fields": ["l_orderkey", "l_linenumber"]}).docs


@query
def prefix_terms(s, d):
    return search(part(s, d), {"query": "p_name:al*", "limit": -1, "fields": ["p_partkey"]}).docs


@query
def wildcard_terms(s, d):
    return search(collection(s, d, "part", "p_partkey"), {"query": {"wildcard": {"field": "p_type", "pattern": "*A?*"}}, "limit": -1, "fields": ["p_partkey"]}).docs


@query
def regex_terms(s, d):
    return search(collection(s, d, "part", "p_partkey"), {"query": r"p_brand:/Brand#[1-3][24]/", "limit": -1, "fields": ["p_partkey"]}).docs


@query
def string_range(s, d):
    return search(collection(s, d, "customer", "c_custkey"), {"query": "c_mktsegment:[B TO F}", "limit": -1, "fields": ["c_custkey"]}).docs


@query
def ip_cidr(s, d):
    c = collection(s, d, "customer", "c_custkey", {"addr": "ip"}, addr="unhex(concat('00000000000000000000ffff0a', lpad(hex(c_custkey % 65536), 4, '0'), '07'))")
    return search(c, {"query": {"match": {"field": "addr", "val": "10.0.0.0/14"}}, "limit": -1, "fields": ["c_custkey"]}).docs


@query
def range_relations(s, d):
    c = collection(s, d, "part", "p_partkey", {"span": "long_range"}, span="named_struct('lo', bigint(p_size), 'hi', bigint(p_size + p_partkey % 7))")
    made = None
    for relation in ("intersects", "contains", "within"):
        got = search(c, {"query": {"range": {"field": "span", "gte": 20, "lte": 22, "relation": relation}}, "limit": -1, "fields": ["p_partkey"]}).docs.withColumn("relation", F.lit(relation))
        made = got if made is None else made.unionByName(got)
    return made


@query
def selective_filters(s, d):
    request = {"filter": ["o_totalprice:>150000", {"query": {"match": {"o_orderstatus": "O"}}, "except_ops": ["status"]}], "ops": {"status": {"field_facet": {"field": "o_orderstatus"}}}}
    return _frame(orders(s, d), request, "status")


# Text


@query
def match_bm25_topk(s, d):
    out = search(documents(s, d), {"query": {"match": {"text": "the of tion"}}, "limit": 20, "get_scores": True, "fields": ["doc_id"]}).docs
    return _rounded(out.withColumnRenamed("_score_", "score"), "score", digits=6)


@query
def match_and(s, d):
    out = search(documents(s, d), {"query": {"match": {"field": "text", "val": "de la que", "operator": "and"}}, "limit": -1, "get_scores": True, "sort": "doc_id", "fields": ["doc_id"]}).docs
    return _rounded(out.withColumnRenamed("_score_", "score"), "score", digits=6)


@query
def phrase_exact(s, d):
    out = search(documents(s, d), {"query": 'text:"of the"', "limit": -1, "get_scores": True, "fields": ["doc_id"]}).docs
    return _rounded(out.withColumnRenamed("_score_", "score"), "score", digits=6)


@query
def phrase_slop(s, d):
    out = search(documents(s, d), {"query": 'text:"the of"~2', "limit": 30, "get_scores": True, "fields": ["doc_id"]}).docs
    return _rounded(out.withColumnRenamed("_score_", "score"), "score", digits=6)


@query
def dis_max(s, d):
    q = {"dis_max": {"queries": [{"match": {"text": "the"}}, {"boost": {"query": {"match": {"text": "and"}}, "boost": 1.5}}, {"constant_score": {"query": {"match": {"lang": "fr"}}, "score": 0.25}}], "tie": 0.3}}
    out = search(documents(s, d), {"query": q, "limit": 40, "sort": ["score desc", "doc_id"], "get_scores": True, "fields": ["doc_id"]}).docs
    return _rounded(out.withColumnRenamed("_score_", "score"), "score", digits=6)


@query
def rescore_min_score(s, d):
    q = {"rescore": {"query": {"match": {"text": "the"}}, "expr": "log1p(n_chars) * $w", "vars": {"w": 2.0}, "min_score": 14}}
    out = search(documents(s, d), {"query": q, "limit": -1, "sort": "doc_id", "get_scores": True, "fields": ["doc_id"]}).docs
    return _rounded(out.withColumnRenamed("_score_", "score"), "score", digits=6)


@query
def fuzzy_vocab(s, d):
    return search(documents(s, d), {"query": {"fuzzy": {"field": "text", "term": "their", "max_edits": 1}}, "limit": -1, "fields": ["doc_id"]}).docs


@query
def case_insensitive(s, d):
    c = collection(s, d, "documents", "doc_id", {"text": {"type": "text", "analyzer": "whitespace"}})
    return search(c, {"query": {"match": {"field": "text", "val": "THE", "case_insensitive": True}}, "limit": -1, "fields": ["doc_id"]}).docs


@query
def multi_match_combined(s, d):
    c = collection(s, d, "documents", "doc_id", {**DOCUMENTS, "head": {"type": "text", "analyzer": "whitespace_lower"}}, head="substring_index(text, '\\n', 1)")
    out = search(c, {"query": {"multi_match": {"text": "the of", "fields": ["head^2", "text"]}}, "limit": 25, "get_scores": True, "fields": ["doc_id"]}).docs
    return _rounded(out.withColumnRenamed("_score_", "score"), "score", digits=6)


@query
def multi_match_per_field(s, d):
    c = collection(s, d, "documents", "doc_id", {**DOCUMENTS, "head": {"type": "text", "analyzer": "whitespace_lower"}}, head="substring_index(text, '\\n', 1)")
    out = search(c, {"query": {"multi_match": {"text": "the", "fields": ["head^3", "text"], "mode": "per_field", "tie": 0.1}}, "limit": 25, "get_scores": True, "fields": ["doc_id"]}).docs
    return _rounded(out.withColumnRenamed("_score_", "score"), "score", digits=6)


@query
def simple_query(s, d):
    out = search(documents(s, d), {"query": {"simple_query": {"q": 'the "of the" | that -que and*', "fields": ["text"]}}, "limit": 50, "get_scores": True, "fields": ["doc_id"]}).docs
    return _rounded(out.withColumnRenamed("_score_", "score"), "score", digits=6)


@query
def html_tokens(s, d):
    c = collection(s, d, "pages", "page_id", {"html": {"type": "text", "analyzer": "html"}})
    return _frame(c, {"ops": {"term": {"field_facet": {"field": "html", "limit": 50}}}}, "term")


@query
def text_facet(s, d):
    return _frame(documents(s, d), {"query": "lang:en", "ops": {"term": {"field_facet": {"field": "text", "limit": 25, "term_filter": {"prefix": "th", "exclude": ["that"]}}}}}, "term")


@query
def english_analysis(s, d):
    c = collection(s, d, "documents", "doc_id", {"text": {"type": "text", "analyzer": "english"}})
    return search(c, {"query": 'text:thing AND NOT text:"of the"', "limit": -1, "fields": ["doc_id"]}).docs


# Facets and metrics


@query
def field_facet(s, d):
    return _frame(orders(s, d), {"ops": {"priority": {"field_facet": {"field": "o_orderpriority", "limit": 3}}}}, "priority")


@query
def field_facet_numeric(s, d):
    return _frame(part(s, d), {"ops": {"size": {"field_facet": {"field": "p_size", "limit": 10, "mincount": 2, "offset": 2}}}}, "size")


@query
def field_facet_metric_sort(s, d):
    out = _frame(lineitem(s, d), {"ops": {"flag": {"field_facet": {"field": "l_returnflag", "limit": 5, "ops": {"price": "avg(l_extendedprice)", "least": "min(l_quantity)"}, "sort": ["price desc"]}}}}, "flag")
    return _rounded(out, "price")


@query
def field_facet_nested(s, d):
    c = lineitem(s, d)
    return search(c, {"limit": 0, "count_limit": 0, "ops": {"flag": {"field_facet": {"field": "l_returnflag", "ops": {"line": {"field_facet": {"field": "l_linenumber", "limit": 3}}}}}}}).ops["flag"].inner["line"].frame


@query
def top_docs_per_bucket(s, d):
    c = orders(s, d)
    return search(c, {"limit": 0, "count_limit": 0, "ops": {"priority": {"field_facet": {"field": "o_orderpriority", "limit": 5, "ops": {"best": {"top_docs": {"sort": "o_totalprice desc", "limit": 3, "fields": ["o_orderkey"]}}}}}}}).ops["priority"].inner["best"].withColumnRenamed("_rank_", "rank")


@query
def range_facet_fixed(s, d):
    return _frame(lineitem(s, d), {"ops": {"price": {"range_facet": {"field": "l_extendedprice", "start": 0, "end": 120000, "gap": 10000}}}}, "price")


@query
def range_facet_data(s, d):
    return _frame(part(s, d), {"ops": {"size": {"range_facet": {"field": "p_size", "bounds": "data", "gap": 7}}}}, "size")


@query
def date_hist_month(s, d):
    return _frame(orders(s, d), {"ops": {"month": {"range_facet": {"field": "o_orderdate", "bounds": "data", "calendar_gap": {"n": 1, "unit": "month"}}}}}, "month")


@query
def date_hist_zone(s, d):
    return _frame(collection(s, d, "events", "event_id"), {"time_zone": "America/New_York", "ops": {"day": {"range_facet": {"field": "ts", "bounds": "data", "calendar_gap": {"n": 1, "unit": "day"}}}}}, "day")


@query
def query_facet_overlap(s, d):
    out = _frame(lineitem(s, d), {"ops": {"tier": {"query_facet": {"buckets": {"small": "l_quantity:<10", "cheap": "l_extendedprice:<20000", "none": "l_quantity:>1000", "returned": "l_returnflag:R"}, "ops": {"price": "avg(l_extendedprice)"}}}}}, "tier")
    return _rounded(out, "price")


@query
def multi_select_any(s, d):
    request = {"ops": {"status": {"field_facet": {"field": "o_orderstatus", "selected": ["F"], "limit": 10}}, "priority": {"field_facet": {"field": "o_orderpriority", "selected": ["1-URGENT", "5-LOW"], "limit": 10}}}}
    got = search(orders(s, d), {**request, "limit": 0, "count_limit": 0}).ops
    return got["status"].frame.select(F.lit("status").alias("facet"), F.col("status").alias("val"), "count").unionByName(got["priority"].frame.select(F.lit("priority").alias("facet"), F.col("priority").alias("val"), "count"))


@query
def multi_select_all(s, d):
    request = {"ops": {"status": {"field_facet": {"field": "o_orderstatus", "selected": "F", "selection_mode": "all", "limit": 10}}, "priority": {"field_facet": {"field": "o_orderpriority", "limit": 10}}}}
    got = search(orders(s, d), {**request, "limit": 0, "count_limit": 0}).ops
    return got["status"].frame.select(F.lit("status").alias("facet"), F.col("status").alias("val"), "count").unionByName(got["priority"].frame.select(F.lit("priority").alias("facet"), F.col("priority").alias("val"), "count"))


@query
def count_distinct_bucket(s, d):
    return _frame(lineitem(s, d), {"ops": {"flag": {"field_facet": {"field": "l_returnflag", "count_distinct": {"field": ["l_partkey", "l_suppkey"], "missing": "drop"}}}}}, "flag")


@query
def domain_override(s, d):
    request = {"query": "o_orderstatus:F", "filter": ["o_totalprice:>50000"], "ops": {"priority": {"field_facet": {"field": "o_orderpriority", "limit": 10}, "domain": {"query": {"match": {"o_orderstatus": "O"}}, "apply_parent_filters": True}}}}
    return _frame(orders(s, d), request, "priority")


@query
def metrics(s, d):
    ops = {"n": "sum(l_linenumber)", "price": "avg(l_extendedprice)", "least": "min(l_quantity)", "most": "max(l_tax)", "parts": "cardinality(l_partkey)", "p95": "percentile(l_extendedprice, 95)", "rank": "percentile_rank(l_quantity, 25)", "weighted": "sum(l_extendedprice * l_quantity) / sum(l_quantity)", "big": "avg(l_quantity > 25 ? l_extendedprice : 0)"}
    got = search(lineitem(s, d), {"limit": 0, "count_limit": 0, "ops": ops}).ops["n"].frame
    return _rounded(got, "price", "p95", "rank", "weighted", "big")


# Collapse, diversify, fusion


@query
def collapse_head(s, d):
    return search(orders(s, d), {"collapse": "o_custkey", "sort": "o_totalprice desc", "limit": 30, "fields": ["o_orderkey", "o_custkey", "o_totalprice"]}).docs.drop("_group_")


@query
def collapse_head_sort(s, d):
    got = search(orders(s, d), {"collapse": {"field": "o_custkey", "head_sort": ["o_orderdate asc", "o_orderkey asc"], "get_count": True}, "sort": "o_totalprice desc", "limit": 30, "fields": ["o_orderkey", "o_custkey"]}).docs
    return got.drop("_group_").withColumnRenamed("_count_", "members")


@query
def collapse_metric_sort(s, d):
    got = search(orders(s, d), {"collapse": {"field": "o_custkey", "sort": ["total desc"], "ops": {"total": "max(o_totalprice)", "spread": "max(o_totalprice) - min(o_totalprice)"}}, "sort": "o_orderkey", "limit": 20, "fields": ["o_orderkey", "o_custkey"]}).docs
    return _rounded(got.drop("_group_"), "total", "spread")


@query
def diversify_cap(s, d):
    return search(orders(s, d), {"diversify": {"field": "o_orderpriority", "max_per_key": 4}, "sort": "o_totalprice desc", "limit": 15, "fields": ["o_orderkey", "o_orderpriority"]}).docs


@query
def fusion_rrf(s, d):
    sources = {"text": {"query": {"match": {"text": "the"}}, "limit": 50}, "long": {"sort": "n_chars desc", "limit": 50}}
    got = search(documents(s, d), {"ops": {"h": {"fusion": {"rrf": {"k": 60}, "weights": {"text": 2}, "sources": sources, "limit": 30, "fields": ["doc_id"]}}}}).ops["h"].docs
    return _rounded(got.withColumnRenamed("_score_", "score"), "score", digits=8)


@query
def fusion_linear(s, d):
    sources = {"text": {"query": {"match": {"text": "the"}}, "limit": 60}, "size": {"query": {"rescore": {"query": {"all": True}, "expr": "n_chars"}}, "limit": 60}}
    got = search(documents(s, d), {"ops": {"h": {"fusion": {"linear": {"normalization": "min_max"}, "weights": {"text": 0.3, "size": 0.7}, "sources": sources, "limit": 40, "fields": ["doc_id"]}}}}).ops["h"].docs
    return _rounded(got.withColumnRenamed("_score_", "score"), "score", digits=6)


# Vectors


def _vector(s: SparkSession, d: str) -> list[float]:
    """The stated query vector: one row."""
    return list(table(s, d, "embeddings").where(F.col("vec_id") == FIRST).first()["embedding"])


def _near(s: SparkSession, d: str, metric: str, spec: Mapping[str, Any], request: Mapping[str, Any] | None = None) -> DataFrame:
    c = collection(s, d, "embeddings", "vec_id", {"embedding": {"type": "vector", "metric": metric}})
    got = search(c, {"query": {"knn": {"field": "embedding", "query": _vector(s, d), **spec}}, "limit": 20, "get_scores": True, "fields": ["vec_id", "label"], **(request or {})}).docs
    return _rounded(got.withColumnRenamed("_score_", "score"), "score", digits=5)


@query
def knn_cosine(s, d):
    return _near(s, d, "cosine", {"k": 12})


@query
def knn_l2(s, d):
    return _near(s, d, "l2", {"k": 12})


@query
def knn_filtered(s, d):
    return _near(s, d, "cosine", {"k": 8}, {"filter": ["label:<3"]})


@query
def knn_similarity(s, d):
    return _near(s, d, "cosine", {"k": 20, "similarity": 0.2})


@query
def knn_groups(s, d):
    return _near(s, d, "cosine", {"k": 5, "unit": "groups"}, {"collapse": "label", "limit": 5}).drop("_group_")


# Nested


@query
def nested_any_same_child(s, d):
    return search(baskets(s, d), {"query": "items:(l_returnflag:R AND l_quantity:>=45)", "limit": -1, "fields": ["o_orderkey"]}).docs


@query
def nested_not(s, d):
    return search(baskets(s, d), {"query": "o_orderstatus:F AND NOT items.l_returnflag:R", "limit": -1, "fields": ["o_orderkey"]}).docs


@query
def nested_children_count(s, d):
    q = {"to_parent": {"path": "items", "score": "sum", "min_children": 2, "max_children": 3, "query": {"rescore": {"query": {"match": {"field": "l_returnflag", "val": "N"}}, "expr": "l_quantity"}}}}
    got = search(baskets(s, d), {"query": q, "limit": -1, "get_scores": True, "fields": ["o_orderkey"]}).docs
    return _rounded(got.withColumnRenamed("_score_", "score"), "score")


@query
def child_reducer_sort(s, d):
    return search(baskets(s, d), {"sort": [{"expr": "max(items.l_extendedprice)", "dir": "desc"}], "limit": 25, "fields": ["o_orderkey"]}).docs


@query
def domain_children(s, d):
    return _frame(baskets(s, d), {"query": "o_totalprice:>200000", "ops": {"flag": {"domain": {"to": "items", "filter": ["l_quantity:>10"]}, "field_facet": {"field": "l_returnflag"}}}}, "flag")


@query
def row_children(s, d):
    got = search(baskets(s, d), {"sort": "o_totalprice desc", "limit": 10, "fields": ["o_orderkey"], "row_ops": {"best": {"domain": {"to": "items", "filter": ["l_quantity:>5"]}, "top_docs": {"sort": "l_extendedprice desc", "limit": 2, "fields": ["l_partkey", "l_extendedprice"]}}}})
    return got.row_ops["best"].withColumnRenamed("_owner_", "o_orderkey")


# Geo


@query
def geo_box(s, d):
    return search(places(s, d), {"query": {"geo_box": {"field": "at", "top": 40, "left": 170, "bottom": -20, "right": -150}}, "limit": -1, "fields": ["c_custkey"]}).docs


@query
def geo_distance(s, d):
    got = search(places(s, d), {"query": {"geo_distance": {"field": "at", "center": [10.0, 50.0], "distance": "2500km"}}, "limit": -1, "fields": ["c_custkey", "at"]}).docs
    far = values.value("geo_distance(at, 50, 10)", Names(F.col))
    return got.select("c_custkey", F.round(far / 1000, 3).alias("km"))


@query
def geo_polygon(s, d):
    ring, hole = [[-50, -50], [60, -40], [70, 50], [-40, 60]], [[-10, -10], [10, -10], [10, 10], [-10, 10]]
    return search(places(s, d), {"query": {"geo_polygon": {"field": "at", "polygon": [ring, hole]}}, "limit": -1, "fields": ["c_custkey"]}).docs


# Value expressions


def _valued(df: DataFrame, key: str, **expressions: str) -> DataFrame:
    c = Collection(df, None, key)
    from ..operators.collection import Scope

    names = Scope(c.view()).expressions(F.lit(1.0))
    return c.view().base.select(key, *(values.value(e, names).alias(n) for n, e in expressions.items()))


@query
def value_math(s, d):
    got = _valued(table(s, d, "part"), "p_partkey", a="p_size * 2 - p_partkey % 7", b="p_retailprice / p_size", c="round(p_retailprice / 7) + floor(p_retailprice) + rint(p_size / 4.0)", e="clamp(p_size, 10, 30) + max(p_size, 25) + min(p_size, 5)", f="p_size > 20 && p_retailprice < 1200 ? sqrt(p_retailprice) : log1p(p_size)", g="def(p_size % (p_size - p_size), -1)", h="let(x, p_size + 1, x * x)", i="hypot(p_size, 3) + atan2(p_size, 2) + cbrt(p_size)")
    return _rounded(got, "b", "c", "f", "i", digits=6)


@query
def value_bits(s, d):
    return _valued(table(s, d, "orders"), "o_orderkey", a="(o_orderkey & 0xFF) | (o_custkey << 3)", b="o_orderkey ^ o_custkey", c="~o_orderkey >> 2", e="ushr(o_orderkey, 3) + shl(1, 70)")


@query
def value_dates(s, d):
    return _valued(table(s, d, "events"), "event_id", y="ts.year", m="month(ts)", dow="day_of_week(ts)", doy="day_of_year(ts)", w="week_of_year(ts)", q="quarter(ts)", h="hour(ts, 330)", mi="ts.minute", ms="epoch_millis(ts)", mod="millis_of_day(ts)")


@query
def value_decay(s, d):
    got = _valued(table(s, d, "part"), "p_partkey", g="gauss_decay(p_size, 25, 10, 2, 0.4)", e="exp_decay(p_size, 25, 10)", l="linear_decay(p_retailprice, 1000, 300)")
    return _rounded(got, "g", "e", "l", digits=6)


@query
def value_geo(s, d):
    got = _valued(places(s, d).df.drop("_docid_"), "c_custkey", tile="geotile(at, 8)", box="geo_in_box(at, 40, -20, -20, 60)", arc="haversin(at.lat, at.lon, 0, 0)", bearing="geo_bearing(at, 10, 20)")
    return _rounded(got, "arc", "bearing", digits=4)


@query
def value_hash(s, d):
    return _valued(table(s, d, "orders"), "o_orderkey", x="xxhash64(o_orderkey)", m="murmur64(o_custkey)", b="hash_bucket(o_orderkey, 16)", c="hash_combine(o_orderkey, o_custkey)")


# Ingest


@query
def upsert_delete(s, d):
    old = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = old.where("o_orderkey % 5 = 0").select(F.col("o_orderkey"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("X").alias("o_orderstatus"))
    gone = old.where("o_orderkey % 7 = 0").select("o_orderkey")
    return upserted(old, new, "o_orderkey", gone)


@query
def ingest_latest(s, d):
    return latest(table(s, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ("ts", "event_id")).select("user_id", "event_id", "event_type")


@query
def ingest_errors(s, d):
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 11 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("balance"))
    return checked(rows, {"balance": "double"})[1].select("id", "error")


@query
def field_map(s, d):
    return mapped(table(s, d, "nation"), {"n_name": "name", "n_nationkey": "id"}, True)


@query
def change_log(s, d):
    log = table(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type", (F.col("event_type") == "purchase").alias("gone"))
    return changes(log, "id", "seq", "gone")
