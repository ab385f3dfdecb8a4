"""Every registered query of the library against its SQL twin, on whole tables."""

import os

import duckdb
import pytest

from pulseloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def normal(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    return f"{value:.9g}" if isinstance(value, (int, float)) or hasattr(value, "as_integer_ratio") else str(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = sorted(tuple(normal(v) for _, v in sorted(r.asDict().items())) for r in got.collect())
    if name not in catalog.ORACLES:
        assert rows
        return
    want = duck.sql(catalog.ORACLES[name])
    columns = want.columns
    assert sorted(got.columns) == sorted(columns)
    assert rows == sorted(tuple(normal(v) for _, v in sorted(zip(columns, r, strict=True))) for r in want.fetchall())
