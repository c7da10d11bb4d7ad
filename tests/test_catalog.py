"""Every registered query gives the rows of its SQL, over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from graphloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, values):
    """Columns and rows, both in order, nulls and numbers as text."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(str(v[k]) for k in order) for v in values)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_agrees_with_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF), con.sql(catalog.ORACLE_SQL[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_requests_leave_no_order_out(spark, con):
    told = {r["callee"] for r in catalog.QUERIES["agent_edge_status"](spark, SF).collect()}
    assert {f"order_{k}" for (k,) in con.sql("select o_orderkey from orders join customer on c_custkey = o_custkey").fetchall()} <= told


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_core_stands_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['graphloom.llm'] = None; import __spark_entry__ as e; assert 'impact_part' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    from tests.conftest import ROOT

    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0
