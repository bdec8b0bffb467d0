import math

import duckdb
import pytest

from wardline.plans import registry

D = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{D}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6f}"
    return str(x)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, db, name):
    df = registry.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    rel = db.sql(registry.SQL[name])
    assert sorted(rel.columns) == columns
    expected = sorted(tuple(map(plain, r)) for r in rel.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert len(got) == len(expected) and got == expected
