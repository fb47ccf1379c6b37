"""Rows never meet in the task of their service, scenario or metric."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import fixtures as X
from faultline.functions.ordinals import slices_for, with_ordinal
from faultline.functions.quantiles import column_quantiles
from faultline.operators import evaluation as EV
from faultline.operators import labels as LB
from faultline.operators.correlation import snapshots
from faultline.operators.detector import detector_signals, signals_after
from faultline.plans.file_queries import quarantined_envelopes
from faultline.plans.signal_queries import decision_features
from faultline.streaming import bus

SMALL = "/root/testdata/sf0.001"
T0 = dt.datetime(2026, 1, 1)


@pytest.fixture
def rows(spark):
    data = [(f"e{i}", T0 + dt.timedelta(hours=i), ("payments-api", "orders-api", None)[i % 3], ("normal", "anomalous")[i % 5 == 0], i / 100, *(float(i * k % 17) for k in range(1, 7)))
            for i in range(60)]
    names = "event_id string, generated_at timestamp, service_name string, scenario_tag string, anomaly_score double, " + ", ".join(f"{c} double" for c in LB.STRESS_WEIGHTS)
    return spark.createDataFrame(data, names)


@pytest.fixture
def no_size_checks(spark):
    """Plans as on tables whose size says nothing."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_burst_limits_travel_to_the_rows(rows, no_size_checks):
    assert "SortMergeJoin" not in plan_of(EV.burst_proxy(rows))
    assert EV.burst_proxy(rows).count() == 60


def test_brackets_travel_to_the_rows(rows, no_size_checks):
    q = column_quantiles(rows, ["service_name"], ["queue_length", "latency_ms"], {"p": 0.5})
    assert "SortMergeJoin" not in plan_of(q)
    assert q.count() == 3


def test_sweep_sorts_no_rows(rows, no_size_checks):
    flagged = rows.withColumns({"burst_proxy": F.col("latency_ms") > 5, "drift_slice": F.lit("late")})
    s = EV.threshold_sweep(flagged)
    assert "SortAggregate" not in plan_of(s)
    by_hand = [r.anomaly_score >= 0.58 for r in rows.collect()]
    assert s.where("threshold = 0.58").first().flag_rate_overall == sum(by_hand) / 60


def test_stress_statistics_travel_to_the_rows(rows, no_size_checks):
    assert "SortMergeJoin" not in plan_of(LB.stress_score(rows))
    assert LB.stress_score(rows).count() == 60


def test_envelopes_are_parsed_once(spark):
    lines = ['{"payload": "{\\"event_id\\": \\"a\\"}"}', '{"payload": " [1]"}', '{"x": 1}', '{"payload": "{\\"event_id\\": "}', "junk"]
    raw = spark.createDataFrame([(x,) for x in lines], "value string")
    good, bad = bus.decode_envelopes(raw, T.StructType().add("event_id", "string"))
    for df in (good, bad):
        assert plan_of(df).count("get_json_object(") == 1
    assert [r.event_id for r in good.collect()] == ["a"]
    assert sorted((r.value, r.reason) for r in bad.collect()) == sorted(
        (x, "missing payload" if x in (lines[2], lines[4]) else "payload is not an object") for x in lines[1:])


def test_nothing_kept_is_a_row(spark, monkeypatch):
    none = X.wide_events(spark, SMALL).where("status_code = -1")
    monkeypatch.setattr(X, "wide_events", lambda *_: none)
    assert [tuple(r) for r in quarantined_envelopes(spark, SMALL).collect()] == [("kept", 0)]


def test_decision_features_work_out_no_decisions(spark):
    assert "row_number" not in plan_of(decision_features(spark, SMALL))

def test_ordinals_deal_rows_out_once(rows, no_size_checks):
    """The sizes join by the columns the ranks are dealt by; behind a join the size estimate does not set the slices."""
    plan = plan_of(with_ordinal(rows, ["service_name"], F.unix_micros("generated_at"), F.col("event_id"), slices=4))
    assert "hashpartitioning(coalesce(" not in plan
    wide = rows.crossJoin(rows.selectExpr("event_id as other")).crossJoin(rows.selectExpr("event_id as third")).where("other = 'e1' and third = 'e2'")
    assert slices_for(wide) >= 64
    got = with_ordinal(wide, ["service_name"], F.unix_micros("generated_at"), F.col("event_id"))
    for svc in ("payments-api", "orders-api", None):
        mine = got.where(F.col("service_name").eqNullSafe(F.lit(svc))).orderBy("generated_at").collect()
        assert [(r.ordinal, r.ordinal_count) for r in mine] == [(i, 20) for i in range(20)]


def test_snapshots_deal_rows_out_once(rows, no_size_checks):
    sig = rows.withColumns({"source_node": F.lit("n"), "anomaly_flag": F.lit(False), "candidate_flag": F.lit(False), "iforest_label": F.lit("normal"), "scored_at": F.col("generated_at")})
    s = snapshots(sig)
    assert "hashpartitioning(source_node" not in plan_of(s) and "hashpartitioning(coalesce(" not in plan_of(s)
    assert s.count() == 40


def test_signals_deal_rows_out_once(rows, no_size_checks):
    """Trailing flags come from a table of the groups before: no second shuffle of the rows by service and block."""
    plan = plan_of(detector_signals(rows.withColumn("scored_at", F.col("generated_at"))))
    assert "hashpartitioning(service_name" not in plan and "Expand" not in plan and "Generate" not in plan
    plan = plan_of(snapshots(rows.withColumns({"source_node": F.lit("n"), **{c: F.lit(False) for c in ("anomaly_flag", "candidate_flag")}, "iforest_label": F.lit("normal"), "scored_at": F.col("generated_at")})))
    assert "_blk" not in plan and plan.count("REPARTITION_BY_COL") <= 2  # for the last signals and for the rows, one exchange where both read the same


def test_signals_with_unknown_scores_and_ids(spark):
    """Rows without an id at a hot instant keep their place; unknown scores take one and count as no flag."""
    data = [(None if i % 5 == 0 else f"e{i}", T0 if i < 300 else T0 + dt.timedelta(seconds=i), "payments-api", None if i % 7 == 0 else (i % 3) / 2, i) for i in range(360)]
    df = spark.createDataFrame(data, "event_id string, generated_at timestamp, service_name string, anomaly_score double, n int").withColumn("scored_at", F.col("generated_at"))
    got = signals_after(df, None, thresholds={"payments-api": 0.5}).orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == list(range(360)) and {r.ordinal_count for r in got} == {360}
    assert sorted(r.n for r in got) == list(range(360)) and all(r.n >= 300 for r in got[300:])
    flags = [r.candidate_flag for r in got]
    for i, r in enumerate(got):
        last = [f for f in flags[max(0, i - 31) : i + 1] if f is not None]
        assert r.service_candidate_rate == (sum(last) / len(last) if last else None)
        three = [f for f in flags[max(0, i - 2) : i + 1] if f is not None]
        assert bool(r.anomaly_flag) == (i >= 2 and sum(three) == 3)


def test_stored_tables_are_compressed_columns(spark):
    from faultline.session import dropped, stored

    df = spark.sql("select id, if(id % 3 = 0, null, struct(id as a, cast(id as string) as b)) as s, id % 2 = 0 as f from range(50)")
    kept = stored(df)
    assert kept.dtypes == df.dtypes and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    assert all(f.endswith(".zstd.parquet") for f in kept.inputFiles())
    dropped(kept)
