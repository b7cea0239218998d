"""Every query against its reference SQL, as the driver compares them."""

import os

import duckdb
import pytest

from guardframe.plans import registry

TABLES = ["documents", "conversations"]


def plain(x):
    return round(x, 9) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", [n for n in sorted(registry.QUERIES) if n in registry.ORACLES and (not os.environ.get("ONLY") or os.environ["ONLY"] in n)])
def test_oracle(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(columns).collect()]
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == columns
    want = [tuple(plain(v) for v in r) for r in rel.select(", ".join(columns)).fetchall()]
    key = lambda r: tuple(str(v) for v in r)
    assert len(got) == len(want) and got
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a == b
