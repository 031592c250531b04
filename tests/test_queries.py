"""Every query of the catalog against its SQL."""

import math
from collections import Counter

import duckdb
import pytest

from graphquarry import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in catalog.SQL:
        r = duck.execute(catalog.SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert rows == Counter(tuple(plain(x[i]) for i in at) for x in r.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["c_custkey", "total"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
