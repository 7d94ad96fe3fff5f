from __future__ import annotations

import os

import duckdb
import pytest

from graphloom.plans import registry


@pytest.fixture(scope="module")
def db(tiny):
    con = duckdb.connect()
    for name in os.listdir(tiny):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{tiny}/{name}'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_against_sql(spark, db, tiny, name):
    df = registry.QUERIES[name](spark, tiny)
    cols = sorted(df.columns)
    got = plain(df.select(*cols).collect())
    if name in registry.ORACLES:
        cur = db.execute(registry.ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        order = [names.index(c) for c in cols]
        assert got == plain([tuple(r[i] for i in order) for r in cur.fetchall()])
    else:
        assert got or name == "extract_rules"
