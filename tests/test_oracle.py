"""Each registered query of the library against DuckDB's answer to its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from logweave.plans import registry

DATA = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    got = duck.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == columns
    wanted = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in got.fetchall())
    assert rows == wanted
    kinds = {x[0]: str(x[1]) for x in got.description}
    assert {c: TYPES.get(t, t) for c, t in df.dtypes if t in TYPES} == {c: kinds[c] for c, t in df.dtypes if t in TYPES}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
