"""Windows: literal cases, and the pane form against a literal scan."""

import datetime as dt
import random

import pytest

from faultline.operators import windows as W
from faultline.operators.contracts import long_event_errors
from faultline.operators.features import build_features, trailing_features

T0 = dt.datetime(2026, 1, 1, 20, 0, 0)
SCHEMA = "event_id string, ts timestamp, sequence_number long, service_name string, metric_name string, metric_value double, scenario_tag string, chaos_suitability string"


def events(spark, rows):
    return spark.createDataFrame(
        [(f"e{i}", T0 + dt.timedelta(seconds=s), q, svc, m, float(v), "S4_INTERSERVICE_CHAIN", None) for i, (s, q, svc, m, v) in enumerate(rows)],
        SCHEMA,
    )


def test_late_classes(spark):
    ev = events(spark, [(0, 1, "payments-api", "latency_p95", 200), (125, 2, "redis", "redis_latency", 9), (140, 3, "redis", "redis_queue_depth", 30)])
    first = W.build_windows(ev, W.WindowingPolicy()).where("window_index = 0").first()
    assert (first.strict_event_count, first.late_events_within_tolerance, first.late_discarded_count) == (1, 1, 1)
    assert first.window_id == "temporal_window_0000"


def test_sequence_regression(spark):
    ev = events(spark, [(0, 10, "payments-api", "latency_p95", 1), (10, 9, "payments-api", "latency_p95", 1), (15, 11, "payments-api", "latency_p95", 1),
                        (5, 20, "redis", "redis_latency", 1), (20, 21, "redis", "redis_latency", 1)])
    row = W.build_windows(ev, W.WindowingPolicy()).where("window_index = 0").first()
    assert row.ordering_broken and row.ordering_violation_services == ["payments-api"] and not row.accepted_for_training


@pytest.mark.parametrize("length,stride,tol", [(120, 60, 10), (120, 30, 10), (50, 30, 45)])
def test_panes_equal_literal_scan(spark, length, stride, tol):
    rng = random.Random(length + stride)
    rows = [(rng.uniform(0, 900), rng.randrange(60), rng.choice(["payments-api", "redis"]), rng.choice(["latency_p95", "error_rate"]), rng.random()) for _ in range(150)]
    # Repeats of one instant, in and out of sequence order.
    rows += [(300.0, q, "redis", "latency_p95", 1.0) for q in (5, 6, 6)]
    ev = events(spark, rows)
    policy = W.WindowingPolicy(length, stride, tol)
    got = {r.window_index: r for r in W.build_windows(ev, policy).collect()}
    us = lambda s: int(round(s * 1e6))
    stamped = [(int((r.ts - T0).total_seconds() * 1e6 + 0.5), r.sequence_number, r.service_name, r.metric_name, r.metric_value) for r in ev.collect()]
    t0, t1 = min(s[0] for s in stamped), max(s[0] for s in stamped)
    want = {}
    k = 0
    while t0 + k * us(stride) <= t1:
        a = t0 + k * us(stride)
        strict = [s for s in stamped if a <= s[0] < a + us(length)]
        late = [s for s in stamped if a + us(length) <= s[0] < a + us(length) + us(tol)]
        gone = [s for s in stamped if a + us(length) + us(tol) <= s[0] < a + us(length) + us(stride)]
        if strict or late:
            bad = set()
            for svc in ("payments-api", "redis"):
                seqs = [s[1] for s in sorted(strict + late) if s[2] == svc]
                if any(y <= x for x, y in zip(seqs, seqs[1:])):
                    bad.add(svc)
            want[k] = (len(strict), len(late), len(gone), sorted(bad))
        k += 1
    assert {k: (r.strict_event_count, r.late_events_within_tolerance, r.late_discarded_count, r.ordering_violation_services) for k, r in got.items()} == want


def test_eligibility_split(spark):
    w = spark.createDataFrame([("w1", 0.91, True), ("w2", 0.84, True), ("w3", 0.90, False)], "window_id string, window_data_quality_score double, accepted_for_training boolean")
    assert [r.window_id for r in W.quality_split(w).where("eligible").collect()] == ["w1"]


def test_moving_average(spark):
    ev = events(spark, [(i, i, "payments-api", "error_rate", v) for i, v in enumerate((1, 2, 3))])
    row = trailing_features(ev, W.WindowingPolicy()).where("window_index = 0").first()
    assert row.degradation_intensity_payments == pytest.approx(1.81)


def test_trailing_ranks_are_cut_before_the_shuffle(spark, monkeypatch):
    """With few kept places, plain panes and panes of huge values both give the full average."""
    from faultline.operators import features as FT

    rng = random.Random(3)
    rows = [(i * 0.05, i, s, "error_rate", rng.random() * (1e40 if s == "orders-api" and i == 2 else 1)) for i in range(1_100) for s in ("payments-api", "orders-api")]
    ev = events(spark, rows)
    policy = W.WindowingPolicy()
    monkeypatch.setattr(FT, "NEWEST", 10_000)
    want = sorted(map(tuple, trailing_features(ev, policy).collect()))
    monkeypatch.setattr(FT, "NEWEST", 300)
    got = trailing_features(ev, policy)
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan
    assert FT._plain_limit(FT.EMA_ALPHA) < 1e40
    empty = trailing_features(ev.limit(0), policy, span=W.time_span(ev))
    assert empty.count() == 0


def test_recovery_memory_counts_from_last_clean(spark):
    rows = [(60 * i, i, "payments-api", "error_rate", 0.5 if i in (2, 3) else 0.01) for i in range(7)]
    policy = W.WindowingPolicy(length_s=60, stride_s=60, tolerance_s=0)
    ev = events(spark, rows)
    f = build_features(ev, W.build_windows(ev, policy), policy)
    assert [r.recovery_memory for r in f.orderBy("window_index").collect()] == [0, 0, 1, 2, 0, 0, 0]


def test_bad_service_is_reported(spark):
    cols = ["schema_version", "event_id", "timestamp", "sequence_number", "service_name", "metric_name", "metric_value", "unit", "source",
            "is_training_only_field", "metadata", "chaos_suitability"]
    row = ["common_telemetry_event_v0_1", "e1", "2026-01-01T00:00:00Z", "1", "unknown-service", "latency_p95", "1.5", "ms", "runtime", "false", "{}", None]
    gone = list(row)
    gone[1] = None
    df = spark.createDataFrame([row, gone], ", ".join(f"{c} string" for c in cols))
    got = [r.errors for r in long_event_errors(df).collect()]
    assert got == [["invalid service_name"], ["missing required field: event_id"]]
