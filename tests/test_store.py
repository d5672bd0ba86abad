"""Versions, upserts, errors, NDJSON and streams."""

import json

import pytest

from tessera.plans.errors import RequestError
from tessera.sources.store import Catalog, Store, exported, mapped, ndjson
from tessera.streaming.ingest import changes, histogram, into, stream


def test_versions_and_upserts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "c"))
    df = lambda *rows: spark.createDataFrame(rows, "id string, n string")
    assert store.update(df(("a", "1"), ("b", "2"), ("a", "3")))["version"] == 1
    first = store.read()
    out = store.update(df(("b", "9"), ("c", "x"), (None, "1")), ["a"], types={"n": "int"})
    assert out["version"] == 2 and {e["message"] for e in out["errors"]} == {"n is not int", "id is missing"}
    assert sorted(map(tuple, first.collect())) == [("a", "3"), ("b", "2")]
    assert [r["id"] for r in store.read().select("id").collect()] == ["b"]
    with pytest.raises(RequestError):
        store.update(df(("d", "x")), types={"n": "int"}, all_or_none=True)
    with pytest.raises(RequestError):
        store.read(at_least=9)
    assert store.vacuum() == ["v=1"] and store.read(2).count() == 1


def test_catalog(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    catalog.create("a", {"x": "int"})
    catalog.create("b")
    with pytest.raises(RequestError):
        catalog.create("a")
    catalog.swap("a", "b")
    assert catalog.get("b").manifest()["schema"] == {"x": "int"}
    catalog.rename("a", "z")
    catalog.drop("b")
    assert catalog.list() == ["z"]


def test_ndjson_stream_and_export(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ['{"_header_": {}}', '{"id": "a", "n": 1}', "{}", '{"id": "b", "n": 2}', '{"_update_": {"delete_ids": ["q"]}}', '{"_end_": true}']
    (tmp_path / "in" / "1.json").write_text("\n".join(lines))
    docs, gone = ndjson(spark, str(tmp_path / "in"), "id string, n int")
    assert sorted(map(tuple, docs.collect())) == [("a", 1), ("b", 2)] and [r["id"] for r in gone.collect()] == ["q"]
    store = Store(spark, str(tmp_path / "s"))
    (tmp_path / "in" / "2.json").write_text('{"id": "a", "n": 5}')
    into(store, stream(spark, str(tmp_path / "in"), "id string, n int"), str(tmp_path / "ck")).awaitTermination()
    assert {r["id"]: r["n"] for r in store.read().where("id is not null").collect()} == {"a": 5, "b": 2}
    exported(store.read().where("id = 'a'"), str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()["value"]) == {"id": "a", "n": 5}


def test_field_map_and_changes(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert mapped(df, {"a": "x", "b": "x"}, True).first().asDict() == {"x": 2}
    log = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False)], "id int, seq int, gone boolean")
    assert [r["id"] for r in changes(log, "id", "seq", "gone").collect()] == [2]
    assert histogram(spark.readStream.format("rate").load(), "timestamp", "1 minute", "1 minute").isStreaming


def test_coercion(spark):
    from datetime import datetime

    from tessera.sources.coerce import coerced, geohash

    rows = [("a", "7", "2024-02", "10.0.0.1", "40.5,-74", ["b", "a", "b"], "true", [3.0, 4.0]), ("b", "7.5", "2024-02", None, None, [], None, None), ("c", "8", "soon", None, None, None, None, None), ("d", None, None, None, "POINT(1 2)", None, None, [float("nan"), 1.0]), (None, "1", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, n_i string, at_dt string, from_ip string, where_p string, tag_ss array<string>, ok_b string, e_v array<double>")
    schema = {"e_v": {"type": "vector", "metric": "cosine", "dims": 2}}
    good, bad = coerced(df, schema)
    row = good.first()
    assert (row["n_i"], row["at_dt"], row["where_p"]["lat"], row["tag_ss"], row["ok_b"]) == (7, datetime(2024, 2, 1), 40.5, ["a", "b"], True)
    assert [round(x, 6) for x in row["e_v"]] == [0.6, 0.8] and good.count() == 1
    assert {r["id"]: r["error"] for r in bad.collect()} == {"b": "n_i is not int", "c": "at_dt is not date", "d": "e_v is not vector", None: "id is missing"}
    assert coerced(df, schema, ignore_malformed=True)[0].count() == 4
    assert [round(x, 2) for x in geohash("ezs42")] == [42.6, -5.6]
