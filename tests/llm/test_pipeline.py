"""The pipeline's stages against brute force, each on its own input; queries are registered and their SQL agrees."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tessera.llm import queries, sql

from .test_operators import joined

TABLES = ("documents", "pages", "benchmark", "conversations")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(pipeline.STAGES):
        before = docs.collect()
        docs = stage(spark, docs, sf_dir).cache()
        after = docs.collect()
        assert after, name
        if i < 4:
            assert docs.columns == list(pipeline.COLUMNS)
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
        if i == 0:
            assert len(after) > 0.98 * len(before)
        if i == 2:
            groups = joined([(r["doc_id"], r["text"]) for r in before], 5, 80)
            assert sorted(r["doc_id"] for r in after) == sorted({c for _, _, c in groups})
        if i == 3:
            items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            clean = lambda r: not any(x in " ".join(r["text"].lower().split()) for x in items)
            assert all(map(clean, after)) and {r["doc_id"] for r in before if clean(r)} == {r["doc_id"] for r in after}
        if i == 4:
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}


def test_near_copies_are_dropped_by_row(spark, sf_dir):
    text = lambda g, more="": " ".join(f"g{g}w{i}" for i in range(60)) + more
    data = [
        (1, text(1), "en", "a", 1), (5, text(1, " tail"), "en", "a", 1), (5, text(2), "en", "a", 1),  # id 5: a near copy and a text of its own
        (None, text(3), "en", "a", 1), (None, text(3, " tail"), "en", "a", 1), (None, text(4), "en", "a", 1), (9, text(4), "en", "b", 1),
        (7, text(5), "en", "a", 1), (7, text(5), "fr", "b", 1), (7, text(5), "en", "a", 1), (8, None, "en", "a", 1), (8, None, "en", "a", 1),
    ]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"] and r["text"].split()[0]) for r in pipeline.near_copies(spark, docs, sf_dir).collect()]
    assert sorted(got, key=repr) == sorted([(1, "g1w0"), (5, "g2w0"), (None, "g3w0"), (9, "g4w0"), (7, "g5w0"), (8, None)], key=repr)


def test_stages_of_odd_rows(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _line string, item_ids int, score int"
    some = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    odd = [(900, None, None, None, None), (901, "", "en", "a", 0), (None, "12 34", None, "b", 5), (902, "word " * 20_000, "en", None, 100_000)]
    data = [(*x, "x", 1, 2) for x in [*some, *odd, some[0], some[0], odd[0]]]
    for name, stage in pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(data, schema), sf_dir)
        ids = [r["doc_id"] for r in out.collect()]
        assert set(ids) <= {x[0] for x in data} and len(ids) > 30, name
        if name != "packing":
            assert out.columns == list(pipeline.COLUMNS)
        if name in ("line dedup", "n-gram Jaccard join", "benchmark decontamination"):
            assert {900, 901, None} <= set(ids), name
        if name == "n-gram Jaccard join":
            assert ids.count(some[0][0]) <= 1 and ids.count(900) == 1
        assert stage(spark, spark.createDataFrame([], schema), sf_dir).count() == 0


def test_registered():
    names = entry.queries()
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(sql.SQL) <= set(entry.oracle_sql()) & set(names)


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{os.path.join(sf_dir, t)}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.sql(sql.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, got.select(*sorted(got.columns)).collect())) == sorted(map(key, want.select(", ".join(sorted(got.columns))).fetchall()))
