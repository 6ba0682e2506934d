"""Every query with an SQL counterpart gives the same rows as DuckDB; the generated pool is checked in test_sources."""

import decimal
import math
import os

import duckdb
import pytest

from gleanfold.plans import indexes, queries, streams  # noqa: F401  they fill the registry
from gleanfold.plans import registry as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    r = duck.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() == 20 and set(E.oracle_sql()) <= set(E.queries())
