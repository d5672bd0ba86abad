"""The engine's requests over small collections, held against plain Python."""

import math

import pytest

from tessera.functions import analysis, dates, values
from tessera.operators import parse
from tessera.operators.collection import Collection
from tessera.plans.errors import RequestError
from tessera.plans.schema import Schema

ROWS = [("b1", "Dune", 1965, 9.99, "sf", "Herbert"), ("b2", "Dune Messiah", 1969, 8.99, "sf", "Herbert"), ("b3", "Children of Dune", 1976, 7.5, "classic", None), ("b4", "Neuromancer", 1984, 6.0, "sf", "Gibson"), ("b5", None, None, None, None, "Gibson")]


@pytest.fixture(scope="module")
def books(spark):
    return Collection(spark.createDataFrame(ROWS, "id string, title_un string, year_i long, price_f double, category_s string, author_s string"))


def ids(result):
    return [d["id"] for d in result.to_dict()["docs"]]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("title_un:dune", "b1 b2 b3"),
        ('title_un:"children of dune"', "b3"),
        ('title_un:"dune children"~4', "b3"),
        ("title_un:mess*", "b2"),
        ("title_un:(dune AND messiah)", "b2"),
        ("title_un:dune AND NOT author_s:Herbert", "b3"),
        ("+title_un:dune -title_un:messiah", "b1 b3"),
        ("year_i:[1965 TO 1976}", "b1 b2"),
        ("year_i:>=1976", "b3 b4"),
        ("author_s:=(Gibson, Nobody)", "b4 b5"),
        ("NOT title_un:*", "b5"),
        ("title_un:dnue~2", "b1 b2 b3"),
        ("title_un:/n.*r/", "b4"),
        ("title_un:d?ne", "b1 b2 b3"),
        ("fuzzy(neuromancr, field=title_un, max_edits=1)", "b4"),
        ("*:*", "b1 b2 b3 b4 b5"),
        ({"boolean": {"optional": ["year_i:<1970", "price_f:<9", "author_s:Herbert"], "min_match": 3}}, "b2"),
        ({"simple_query": {"q": 'dune | "neuromancer" -messiah', "fields": ["title_un"]}}, "b1 b2 b3 b4"),
        ({"simple_query": {"q": "dune -messiah", "fields": ["title_un"]}}, "b1 b3"),
        ({"simple_query": {"q": ')(" |', "fields": ["title_un"]}}, ""),
        ({"multi_match": {"text": "dune herbert", "fields": ["title_*"], "mode": "per_field"}}, "b1 b2 b3"),
        ({"rescore": {"query": "title_un:dune", "expr": "year_i", "min_score": 1969}}, "b2 b3"),
    ],
)
def test_matches(books, query, want):
    assert ids(books.search({"query": query, "sort": "id", "limit": -1})) == want.split()


def test_bm25_by_hand(books):
    got = {d["id"]: d["_score_"] for d in books.search({"query": "title_un:dune", "get_scores": True}).to_dict()["docs"]}
    idf, average = math.log1p((4 - 3 + 0.5) / 3.5), (1 + 2 + 3 + 1) / 4
    for key, n in (("b1", 1), ("b2", 2), ("b3", 3)):
        assert got[key] == pytest.approx(idf - idf / (1 + 1 / (1.2 * (0.25 + 0.75 * n / average))))


def test_scores_of_filters(books):
    q = {"boolean": {"required": ["category_s:sf"], "optional": ["author_s:Herbert", {"constant_score": {"query": "year_i:1965", "score": 3}}]}}
    got = {d["id"]: d["_score_"] for d in books.search({"query": q, "get_scores": True}).to_dict()["docs"]}
    assert got == {"b1": 4.0, "b2": 1.0, "b4": 0.0}
    assert [d["_score_"] for d in books.search({"query": "category_s:sf", "get_scores": True}).to_dict()["docs"]] == [1.0] * 3


def test_facets_nested_with_metrics(books):
    spec = {"field_facet": {"field": "category_s", "missing": True, "ops": {"price": "avg(price_f)", "who": {"field_facet": {"field": "author_s", "limit": 1}}, "best": {"top_docs": {"sort": "year_i desc", "limit": 1}}}}}
    got = books.search({"limit": 0, "ops": {"cats": spec, "n": "sum(year_i)"}}).to_dict()["ops"]
    assert got["n"] == 1965 + 1969 + 1976 + 1984 and got["cats"]["missing"] == 1
    assert [(b["val"], b["count"], b["who"]["buckets"]) for b in got["cats"]["buckets"]] == [("sf", 3, [{"val": "Herbert", "count": 2}]), ("classic", 1, [])]
    assert got["cats"]["buckets"][0]["best"][0]["id"] == "b4" and got["cats"]["buckets"][0]["price"] == pytest.approx((9.99 + 8.99 + 6) / 3)


def test_range_and_query_facets(books):
    ops = {"y": {"range_facet": {"field": "year_i", "start": 1960, "end": 2000, "gap": 10}}, "d": {"range_facet": {"field": "year_i", "bounds": "data", "gap": 7}}, "q": {"query_facet": {"buckets": {"old": "year_i:<1970", "none": "year_i:<0", "cheap": "price_f:<9"}}}}
    got = books.search({"limit": 0, "ops": ops}).to_dict()["ops"]
    assert [(b["val"], b["count"]) for b in got["y"]["buckets"]] == [(1960, 2), (1970, 1), (1980, 1), (1990, 0)]
    assert [(b["val"], b["count"]) for b in got["d"]["buckets"]] == [(1960, 1), (1967, 1), (1974, 1), (1981, 1)]
    assert [(b["val"], b["count"]) for b in got["q"]["buckets"]] == [("old", 2), ("none", 0), ("cheap", 3)]


def test_selection_spares_its_own_facet(books):
    ops = {"c": {"field_facet": {"field": "category_s", "selected": ["sf"]}}, "a": {"field_facet": {"field": "author_s"}}}
    got = books.search({"ops": ops, "sort": "id"}).to_dict()
    assert [d["id"] for d in got["docs"]] == ["b1", "b2", "b4"]
    assert [b["val"] for b in got["ops"]["c"]["buckets"]] == ["sf", "classic"]
    assert got["ops"]["a"]["buckets"] == [{"val": "Herbert", "count": 2}, {"val": "Gibson", "count": 1}]


def test_collapse_and_diversify(books):
    got = books.search({"collapse": {"field": "author_s", "get_count": True}, "sort": "price_f asc"}).to_dict()
    assert [(d["id"], d["_count_"]) for d in got["docs"]] == [("b4", 2), ("b3", 1), ("b2", 2)] and got["found"] == 3
    assert ids(books.search({"collapse": {"field": "author_s", "missing": "drop", "head_sort": ["year_i asc"]}, "sort": "price_f asc"})) == ["b4", "b1"]
    assert ids(books.search({"diversify": {"field": "author_s", "max_per_key": 1}, "sort": "price_f asc"})) == ["b4", "b3", "b2"]


def test_fusion_and_counts(books):
    fusion = {"fusion": {"rrf": {}, "sources": {"a": {"query": "title_un:dune", "limit": 2}, "b": {"sort": "price_f asc", "limit": 2}}, "fields": ["id"]}}
    got = books.search({"ops": {"h": fusion}}).to_dict()["ops"]["h"]["docs"]
    assert {d["id"]: round(d["_score_"], 9) for d in got} == {"b1": round(1 / 61, 9), "b4": round(1 / 61, 9), "b2": round(1 / 62, 9), "b3": round(1 / 62, 9)}
    assert books.search({"count_limit": 2}).to_dict()["found_gte"] is True


def test_nested(spark):
    rows = [("a", [("red", "S", [("steel",)]), ("blue", "L", [])]), ("b", [("red", "L", [])]), ("c", []), ("d", None)]
    c = Collection(spark.createDataFrame(rows, "id string, items array<struct<color:string,size:string,parts:array<struct<material:string>>>>"))
    assert ids(c.search({"query": "items:(color:red AND size:L)"})) == ["b"]
    assert ids(c.search({"query": "items.color:red AND items.size:L", "sort": "id"})) == ["a", "b"]
    assert ids(c.search({"query": "NOT items.color:red", "sort": "id"})) == ["c", "d"]
    assert ids(c.search({"query": "items.parts.material:steel"})) == ["a"]
    facet = {"colors": {"domain": {"to": "items"}, "field_facet": {"field": "color"}}}
    assert c.search({"limit": 0, "ops": facet}).to_dict()["ops"]["colors"]["buckets"] == [{"val": "red", "count": 2}, {"val": "blue", "count": 1}]
    assert ids(c.search({"query": {"to_parent": {"path": "items", "min_children": 2, "query": {"all": True}}}})) == ["a"]


def test_values_and_missing(books):
    names = values.Names(lambda n: __import__("pyspark").sql.functions.col(n), {"k": 3})
    one = lambda text: books.df.where("id = 'b1'").select(values.value(text, names).alias("v")).first()["v"]
    cases = {"1 + 2 * 3": 7, "7 % 4": 3, "-7 % 3": -1, "1 / 0": None, "round(-2.5)": -2.0, "rint(2.5)": 2.0, "1 < 2 && 0": 0, "0 && (1 / 0)": 0, "(1/0) || 1": None, "2 > 1 ? 5 : 6": 5, "let(x, 4, x * x)": 16, "bit_and(12, 10)": 8, "1 << 65": 2, "year_i * $k": 5895, "day_of_week(0)": 4, "max(1, 2)": 2, "def(1/0, 9)": 9, "xxhash64(0)": 3803688792395291579, "0xFF ^ 1": 254}
    for text, want in cases.items():
        assert one(text) == want, text
    for bad in ("1 +", "nope(1)", "1 < 2 < 3", "$zz", "a b"):
        with pytest.raises((RequestError, Exception)):
            values.value(bad, names)


def test_analysis():
    assert analysis.html_strip("H<sub>2</sub>O<p>a &lt;b&amp;gt;</p><!-- x") == "H2O\na <b&gt;\n"
    assert [t for t, _ in analysis.terms("standard", "Ｆｏｏ can't 3.14 naïve_x 日本")] == ["foo", "can't", "3.14", "naïve_x", "日", "本"]
    assert [t for t, _ in analysis.terms("english", "The dog's running Cafés stories")] == ["the", "dog", "run", "cafe", "story"]
    assert analysis.terms(["whitespace", "lowercase", ["stop", ["the"]]], "see The dog") == [("see", 0), ("dog", 2)]


def test_dates():
    june = dates.window("2024-06", 0)
    assert (june[1] + 1 - june[0]) == 30 * 86_400_000
    assert dates.window("NOW/DAY-1DAY", 1_700_000_000_000) == dates.window("now-1d/d", 1_700_000_000_000)[:1] * 2
    assert len(dates.fences(dates.window("2024-03-09", 0, "America/New_York")[0], dates.window("2024-03-12", 0, "America/New_York")[0], 1, "day", "America/New_York")) == 4
    with pytest.raises(RequestError):
        dates.window("2024-13", 0)


def test_parse_errors_and_schema(books):
    for bad in ("title:", "a:[1 TO", 'a:"x', "(a:b", "loose words", "a:$x"):
        with pytest.raises(RequestError):
            parse.expression(bad)
    with pytest.raises(RequestError):
        books.search({"query": {"match": {"field": "title_un", "val": "x", "oops": 1}}})
    schema = Schema({"summary": {"type": "text", "analyzer": "standard", "variants": {"s": "string"}, "value": "s"}})
    assert schema.fields["summary"].variants["s"].source == "summary"
    assert schema.set({"x": "int"}).fields["x"].type == "int" and "summary" not in schema.set({"x": "int"}, True).fields


def test_geo_and_vectors(spark):
    rows = [(1, (40.7, -74.0), [1.0, 0.0]), (2, (51.5, -0.1), [0.6, 0.8]), (3, (-33.9, 151.2), [0.0, 1.0]), (4, None, None)]
    c = Collection(spark.createDataFrame(rows, "id long, at struct<lat:double,lon:double>, v array<double>"), {"v": {"type": "vector", "metric": "cosine"}})
    assert ids(c.search({"query": {"geo_distance": {"field": "at", "center": [0, 51], "distance": "100km"}}})) == [2]
    assert ids(c.search({"query": {"geo_box": {"field": "at", "top": 60, "left": 150, "bottom": -40, "right": -70}}, "sort": "id"})) == [1, 3]
    near = c.search({"query": {"knn": {"field": "v", "query": [1, 0], "k": 2}}, "get_scores": True}).to_dict()["docs"]
    assert [d["id"] for d in near] == [1, 2] and near[1]["_score_"] == pytest.approx(0.6)
    assert ids(c.search({"query": {"knn": {"field": "v", "query": [1, 0], "k": 1}}, "filter": ["id:>1"]})) == [2]


def test_output_forms(books, spark):
    from tessera.operators import output
    from tessera.operators.search import register as register_op

    output.register("shout", lambda df: df.withColumn("year_i", df["year_i"] + 1))
    page = {"query": "title_un:dune", "sort": "id", "fields": ["id", "year_i", "author_s"]}
    assert books.search(page, decorators=["shout"], int64_str=True).to_dict()["docs"][0] == {"id": "b1", "year_i": "1966", "author_s": "Herbert"}
    assert books.search(page, document_format="column").to_dict()["docs"]["author_s"] == ["Herbert", "Herbert", None]
    assert books.search(page, document_format="adaptive").to_dict()["docs"]["docs"] == [{"author_s": "Herbert"}, {"author_s": "Herbert"}, {}]
    dated = Collection(spark.sql("select 1L id, timestamp'2024-01-02 03:04:05' at_dt"))
    assert dated.search({}, date_iso=True).to_dict()["docs"][0]["at_dt"] == "2024-01-02T03:04:05.000Z"
    assert dated.search({}, date_ms=True).to_dict()["docs"][0]["at_dt"] == 1704164645000
    echoed = output.canonical({"query": "title_un:dune", "limit": 3})
    assert echoed["ops"]["q"]["top_docs"]["query"] == {"match": {"field": "title_un", "val": "dune"}}
    register_op("size", lambda own, rows, spec: rows.groupBy().count())
    assert books.search({"limit": 0, "ops": {"n": {"size": {}}}}).ops["n"].first()["count"] == 5


def test_vector_lists_keep_recall(spark):
    import random

    from tessera.operators import knn
    from tessera.plans.schema import Field

    rng = random.Random(1)
    rows = [(i, [rng.gauss(c, 1) for _ in range(8)]) for i in range(400) for c in [rng.choice([-4, 0, 4])]]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    made, centres = knn.lists(df, "v", 6)
    hit = 0
    for q in range(0, 400, 40):
        exact = [r["id"] for r in knn.nearest(df, "id", Field("v", "vector"), rows[q][1], 5).collect()]
        some = [r["id"] for r in knn.nearest(knn.probed(made, centres, rows[q][1], 2), "id", Field("v", "vector"), rows[q][1], 5).collect()]
        hit += len(set(exact) & set(some))
    assert hit >= 0.9 * 50
