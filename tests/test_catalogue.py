"""Each query of the catalogue against its SQL in DuckDB, as the driver compares them."""

import math

import duckdb
import pytest

from gridframe.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(table):
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v)
    return sorted(tuple(map(plain, r.values())) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = frame.select(*columns).toArrow()
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    want = want.project(", ".join(f'"{c}"' for c in columns)).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    assert rows(got) == rows(want)
    assert [str(t).replace("large_", "") for t in got.schema.types] == [str(t).replace("large_", "") for t in want.schema.types]
