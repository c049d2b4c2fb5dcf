"""Every query of the core runs on the smallest tables, and agrees with its SQL."""

import glob
import importlib

import duckdb
import pytest

from scholion.plans import MODULES

MODULE = {q: m for m in (importlib.import_module(f"scholion.plans.{n}") for n in MODULES) for q in m.QUERIES}


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return str(v).replace("+00:00", "")
    return tuple(norm(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {p.rpartition('/')[2][:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(MODULE))
def test_query(spark, sf, con, name):
    df = MODULE[name].QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select([f"`{c}`" for c in cols]).collect()), key=repr)
    sql = MODULE[name].SQL.get(name)
    if sql:
        res = con.sql(sql)
        names = list(res.columns)
        assert sorted(names) == cols
        assert got == sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(MODULE) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).columns == ["query_id", "key", "score", "rank"]
