"""Every registered query of the language against its SQL, on the smallest tables."""

import os

import numpy as np
import pandas as pd
import pytest

from lodestone.queries import HEADLINE, ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, (float, np.floating)) and np.isnan(x)):
        return None
    if isinstance(x, (np.integer, bool)):
        return int(x)
    if isinstance(x, (float, np.floating)):
        return int(x) if float(x).is_integer() else float(x)
    return x


def rows(df):
    return sorted(repr([plain(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in ORACLE:
        want = duck.sql(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_headline_queries_are_registered():
    assert set(HEADLINE) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
def test_plans(spark):
    """Filters and columns reach the scan; semi- and anti-joins are joins; top-n is not a sort."""
    from lodestone.queries import session

    s = session(spark, SF)
    plan = s.analyze("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000.0 AND o_orderdate < TIMESTAMP '1996-01-01'")
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "LessThan(o_orderdate" in plan and "o_orderpriority" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "LeftAnti" in s.analyze("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
    assert "LeftSemi" in s.analyze("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
    assert "Python" not in s.analyze("SELECT l_returnflag, SUM(l_quantity) AS q FROM lineitem WHERE BEGINS(l_shipdate || '', '1996') GROUP BY l_returnflag")
