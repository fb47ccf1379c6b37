"""Ordinals, blocks and quantiles against plain Python, with hot keys."""

import datetime as dt
import hashlib
import random

import numpy as np
import pytest

from faultline.functions.ordinals import with_ordinal
from faultline.functions.quantiles import long_quantiles
from faultline.operators.correlation import SNAP, snapshots
from faultline.operators.detector import detector_signals
from faultline.operators.profiling import burst_runs
from pyspark.sql import functions as F

T0 = dt.datetime(2026, 1, 1)


def arrival(rows):
    return sorted(rows, key=lambda r: (r[1], hashlib.md5(r[0].encode()).hexdigest()))


def frame(spark, n=400, seed=3):
    rng = random.Random(seed)
    # A third of all rows share one instant.
    rows = [(f"e{i}", T0 + dt.timedelta(seconds=0 if i % 3 == 0 else rng.randrange(60)), rng.choice(["payments-api", "orders-api"]),
             "node-1", round(rng.random(), 6), rng.random() * 10, rng.random() * 10) for i in range(n)]
    df = spark.createDataFrame(rows, "event_id string, generated_at timestamp, service_name string, source_node string, anomaly_score double, queue_length double, latency_ms double")
    return rows, df.withColumns({"scored_at": F.col("generated_at"), "cpu_pct": F.col("latency_ms"), "http_5xx_rate": F.col("queue_length")})


@pytest.mark.parametrize("slices", [2, 16])
def test_ordinals(spark, slices):
    rows, df = frame(spark)
    got = {r.event_id: (r.ordinal, r.ordinal_count) for r in with_ordinal(df, ["service_name"], F.unix_micros("generated_at"), F.col("event_id"), slices=slices).collect()}
    for svc in ("payments-api", "orders-api"):
        mine = arrival([r for r in rows if r[2] == svc])
        assert all(got[r[0]] == (i, len(mine)) for i, r in enumerate(mine))


@pytest.mark.parametrize("block", [40, 100_000])
def test_signals_do_not_depend_on_blocks(spark, block):
    rows, df = frame(spark)
    got = {r.event_id: r for r in detector_signals(df, thresholds={"payments-api": 0.4, "orders-api": 0.5}, block=block).collect()}
    assert len(got) == len(rows)
    for svc, t in (("payments-api", 0.4), ("orders-api", 0.5)):
        flags = []
        for r in arrival([r for r in rows if r[2] == svc]):
            flags = (flags + [r[4] >= t])[-32:]
            g = got[r[0]]
            assert g.anomaly_flag == (len(flags) >= 3 and all(flags[-3:]))
            assert g.window_size == len(flags) and g.service_candidate_rate == pytest.approx(sum(flags) / len(flags))


@pytest.mark.parametrize("block", [16, 100_000])
def test_snapshots_do_not_depend_on_blocks(spark, block):
    rows, df = frame(spark)
    sig = detector_signals(df, thresholds={"payments-api": 0.4, "orders-api": 0.5})
    got = {r.event_id: r for r in snapshots(sig, block=block).collect()}
    last = {}
    for r in arrival(rows):
        last[r[2]] = r[0]
        assert {s: (getattr(got[r[0]], c) or {"event_id": None})["event_id"] for s, c in SNAP.items() if s in last} == last


@pytest.mark.parametrize("block", [8, 100_000])
def test_burst_runs_do_not_depend_on_blocks(spark, block):
    rows, df = frame(spark)
    got = {r.service_name: r for r in burst_runs(df, fields=("queue_length", "latency_ms"), min_hits=1, block=block).collect()}
    for svc in ("payments-api", "orders-api"):
        mine = arrival([r for r in rows if r[2] == svc])
        q, lat = (np.quantile([r[i] for r in mine], 0.95) for i in (5, 6))
        runs, cur = [], 0
        for r in mine:
            if r[5] >= q or r[6] >= lat:
                cur += 1
            elif cur:
                runs.append(cur)
                cur = 0
        runs += [cur] if cur else []
        assert (got[svc].burst_runs, got[svc].max_burst_run, got[svc].burst_samples) == (len(runs), max(runs), sum(runs))


@pytest.mark.parametrize("n", [1, 7, 30_000])
def test_quantiles(spark, n):
    rng = np.random.default_rng(n)
    data = {"a": np.round(rng.normal(size=n), 3), "b": np.where(rng.random(n) < 0.4, 1.5, rng.random(n))}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, value double")
    probs = {"p0": 0.0, "p05": 0.05, "p50": 0.5, "p97": 0.97, "p98": 0.98, "p100": 1.0}
    lin = {r.k: r for r in long_quantiles(df, ["k"], probs).collect()}
    near = {r.k: r for r in long_quantiles(df, ["k"], probs, mode="nearest").collect()}
    for k, vs in data.items():
        s = np.sort(vs)
        for name, p in probs.items():
            assert lin[k][name] == pytest.approx(np.quantile(vs, p), abs=1e-9)
            assert near[k][name] == s[int(np.floor((n - 1) * p + 0.5))]


def test_rank_shuffles_each_value_once(spark):
    """The id, the order key and the hash of the id travel once, the hash as bytes."""
    _, df = frame(spark)
    out = with_ordinal(df.select("service_name", "generated_at", "event_id"), ["service_name"], F.unix_micros("generated_at"), F.col("event_id"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_id#" not in plan.replace("event_id#", "") and "unhex(" in plan
