"""Twins at the smallest size, and plan shapes."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import norm, rank
from faultline.plans import scoring_queries as SQ

D = "/root/testdata/sf0.001"
FAST = (
    "contract_long_events", "window_quality", "window_late_classes", "service_window_view", "trailing_features", "threshold_sweep",
    "residual_control", "detector_signals", "order_match",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_twin(spark, con, name):
    df = entry.queries()[name](spark, D)
    cols = sorted(df.columns, key=rank)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda i: rank(names[i]))
    assert sorted(names, key=rank) == cols
    assert got == sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["window_quality", "detector_signals", "threshold_sweep", "signal_snapshots"])
def test_no_cartesian_and_no_python(spark, name):
    plan = _plan(entry.queries()[name](spark, D))
    assert "CartesianProduct" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_sweep_reads_scores_once_per_role(spark):
    """One pass for the sweep; the grid and the slice limits are scalar subqueries or small joins."""
    plan = _plan(SQ.threshold_sweep(spark, D))
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["contamination_sweep", "decision_scores"])
def test_forest_is_walked_once(spark, name):
    """What is built on the scores reads them as fixed: no Python is left in the plan."""
    assert "Python" not in _plan(entry.queries()[name](spark, D))
