"""Every engine query with SQL gives that SQL's rows."""

import os

import duckdb
import pytest

from tessera.plans import oracle, queries


def test_every_oracle_has_a_query():
    assert set(oracle.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    got, want = queries.QUERIES[name](spark, sf_dir), con.sql(oracle.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda r: tuple("~" if v is None else round(float(v), 6) if isinstance(v, (int, float)) else str(v) for v in r)
    assert sorted(map(plain, got.select(*columns).collect()), key=repr) == sorted(map(plain, want.select(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
