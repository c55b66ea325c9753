"""Every query with SQL gives the rows of that SQL in DuckDB on the smallest tables."""

import datetime

import duckdb
import numpy as np
import pytest

from docloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(norm(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    try:
        return float(f"{float(v):.9g}") if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[k]) for k in cols) for r in df.collect()), key=repr)
    cur = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(k) for k in cols]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=repr)
