"""Every query against its DuckDB SQL on the smallest tables; queries without SQL must run."""

import math
import os

import pytest

from presswire import queries as own

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=repr)
    if name in own.ORACLE:
        cursor = duck.execute(own.ORACLE[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
