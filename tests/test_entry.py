"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings events conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


def plain_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def cell(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_agrees_with_sql(spark, con, name):
    got = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(cols)
    assert plain_rows(got.columns, [tuple(r) for r in got.collect()]) == plain_rows(cols, want.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"))
def test_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "logdice" in out.columns


def test_windows_plan_no_exchange_of_tokens(spark, tmp_path):
    from korpuscle.operators import collocation
    from korpuscle.operators.corpus import Corpus

    c = Corpus.from_documents(spark.read.parquet(f"{DATA}/documents.parquet"), meta=["lang"])
    plan = collocation.mark_windows(c, collocation.node_condition("the"), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_COL" in plan
