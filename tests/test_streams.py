"""Streams against their batch forms, restart, quarantine, late and repeated rows."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from faultline import fixtures as X
from faultline.operators import correlation as CO
from faultline.operators import detector as DT
from faultline.operators import incidents as N
from faultline.operators import windows as W
from faultline.operators.contracts import enriched_event_errors
from faultline.sources import readers, writers
from faultline.streaming import bus
from faultline.streaming.detector import stream_signals, stream_snapshots
from faultline.streaming.windows import stream_windows

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "event_id string, generated_at timestamp, scored_at timestamp, source_node string, service_name string, anomaly_score double, queue_length double"


def scored(spark, n=120):
    rng = random.Random(5)
    rows = [(f"e{i:03d}", T0 + dt.timedelta(seconds=i), T0 + dt.timedelta(seconds=i + 1), f"node-{i % 2}",
             rng.choice(["payments-api", "orders-api", "checkout-api"]), rng.random(), rng.random() * 60) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_stream_equals_batch_across_restart(spark, tmp_path):
    df = scored(spark)
    src, log, state = (str(tmp_path / x) for x in ("src", "log", "state"))
    limits = {"payments-api": 0.3, "orders-api": 0.4, "checkout-api": 0.5}
    for lo, hi in ((0, 50), (50, 90), (90, 120)):
        part = df.where(f"cast(substring(event_id, 2) as int) >= {lo} and cast(substring(event_id, 2) as int) < {hi}").coalesce(1)
        part.write.mode("append").parquet(src)
        # Each pass is a new query that resumes from the checkpoint.
        stream = spark.readStream.schema(df.schema).parquet(src)
        bus.append_log(stream_signals(stream, thresholds=limits), log, state).awaitTermination()
    cols = ["event_id", "anomaly_flag", "candidate_flag", "window_size", "window_fill", "reason_codes", "iforest_label"]
    got = sorted(map(str, spark.read.parquet(log).select(*cols).collect()))
    batch = DT.detector_signals(df, thresholds=limits)
    assert got == sorted(map(str, batch.select(*cols).collect()))
    snaps = str(tmp_path / "snaps")
    sig = spark.readStream.schema(spark.read.parquet(log).schema).parquet(log)
    bus.append_log(stream_snapshots(sig), snaps, str(tmp_path / "s2")).awaitTermination()
    pick = lambda d: sorted((r.event_id, *[(getattr(r, c) or {"event_id": ""})["event_id"] for c in CO.SNAP.values()]) for r in d.collect())
    assert pick(spark.read.parquet(snaps)) == pick(CO.snapshots(batch))


def test_envelopes_and_quarantine(spark, tmp_path):
    topic, out, state = (str(tmp_path / x) for x in ("topic", "out", "state"))
    good = {"event_id": "e1", "service_name": "redis"}
    lines = [json.dumps({"payload": json.dumps(good)}), json.dumps({"other": 1}), json.dumps({"payload": "[1, 2]"}), json.dumps({"payload": "nonsense"})]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(topic)
    events, bad = bus.decode_envelopes(spark.read.text(topic), readers.DECISION)
    assert [r.event_id for r in events.collect()] == ["e1"]
    assert sorted(r.reason for r in bad.collect()) == ["missing payload", "payload is not an object", "payload is not an object"]
    stream, _ = bus.decode_envelopes(bus.read_topic_files(spark, topic), readers.DECISION)
    bus.publish(stream, "copy", out, state).awaitTermination()
    again, _ = bus.decode_envelopes(spark.read.text(out), readers.DECISION)
    assert [r.service_name for r in again.collect()] == ["redis"]


def test_streamed_windows_equal_batch(spark, tmp_path):
    schema = "event_id string, ts timestamp, sequence_number long, service_name string, metric_name string, metric_value double, scenario_tag string, chaos_suitability string"
    rng = random.Random(2)
    rows = [(f"e{i}", T0 + dt.timedelta(seconds=i * 3), i, *rng.choice([("payments-api", "latency_p95"), ("redis", "redis_latency"), ("orders-api", "error_rate")]), rng.random(), "S4", None) for i in range(200)]
    df = spark.createDataFrame(rows, schema)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    # One file is delivered twice; a last far row pushes the watermark on.
    far = spark.createDataFrame([("far", T0 + dt.timedelta(hours=5), 999, "redis", "redis_latency", 1.0, "S4", None)], schema)
    for part in (df.where("sequence_number < 100"), df.where("sequence_number < 100"), df.where("sequence_number >= 100"), far, far.selectExpr("'far2' as event_id", "ts + interval 5 hours as ts", *[c for c in df.columns if c not in ("event_id", "ts")])):
        part.coalesce(1).write.mode("append").parquet(src)
        policy = W.WindowingPolicy(min_events=1)
        stream = spark.readStream.schema(df.schema).parquet(src)
        bus.append_log(stream_windows(stream, policy, anchor=T0, delay="10 minutes"), out, str(tmp_path / "state")).awaitTermination()
    cols = ["window_index", "strict_event_count", "late_events_within_tolerance", "late_discarded_count", "window_data_quality_score", "redis__redis_latency"]
    got = {r.window_index: r for r in spark.read.parquet(out).select(*cols).collect()}
    # Windows whose reach ends before the far row see the same events in both forms.
    want = [r for r in W.build_windows(df, policy).select(*cols).collect() if r.window_index <= 9]
    assert len(want) == 10 and all(got[r.window_index] == r for r in want)


def test_golden_persistent_flag(spark):
    rows = [(f"g{i}", T0 + dt.timedelta(seconds=i), T0 + dt.timedelta(seconds=i), "n", "payments-api", 0.9, 1.0) for i in range(3)]
    got = DT.detector_signals(spark.createDataFrame(rows, SCHEMA)).orderBy("generated_at").collect()
    assert [r.anomaly_flag for r in got] == [False, False, True]
    assert [r.reason_codes for r in got] == [["stabilizing_window"]] * 2 + [["service_threshold_breach", "persistent_window"]]


ENRICHED = """select 'enriched_anomaly_event_v0_1' as schema_version, 'evt-001' as event_id, timestamp'2026-05-19 10:00:00' as timestamp, 's' as source,
 array('payments-api', 'orders-api', 'checkout-api', 'redis') as services_observed, 'payments-api' as primary_service,
 map('payments-api', 0.91D, 'orders-api', 0.22D, 'checkout-api', 0.31D) as iforest_scores,
 map('payments-api', 'anomalous', 'orders-api', 'normal', 'checkout-api', 'normal') as iforest_labels,
 struct(true as enabled, 'm' as model, 'prop_sig_001' as propagation_signature_id, true as propagation_detected,
   map('payments-api_to_redis', 40, 'redis_to_checkout-api', 30) as lag_pattern_seconds, 0.82D as confidence) as correlation_engine,
 0.94D as window_data_quality_score, 'high' as severity_preliminary, array('r') as evidence_refs, array('x') as raw_event_refs"""


def test_sample_incident(spark):
    row = N.incidents(spark.sql(ENRICHED)).first()
    assert row.related_services == ["orders-api", "checkout-api", "redis"] and row.estimated_tokens == 1140
    assert (row.severity, row.evidence_strength, row.retrieval_quality, row.model_uncertainty) == ("high", "high", "low", "medium")
    assert row.confidence_score == pytest.approx(0.7305) and row.human_review_required and row.recommendation_type == "escalate"
    assert row.propagation_summary == "Propagation detected via prop_sig_001 with confidence 0.82 and lag pattern payments-api_to_redis=40s, redis_to_checkout-api=30s."


def test_forbidden_field(spark):
    ok = spark.sql(ENRICHED)
    body = ok.selectExpr("*", "to_json(struct(*)) as payload")
    bad = ok.selectExpr("*", "to_json(struct(*, 1 as chaos_template)) as payload")
    assert enriched_event_errors(body, raw_json="payload").first().errors == []
    assert enriched_event_errors(bad, raw_json="payload").first().errors == ["forbidden field: chaos_template"]


def test_sources_and_sinks(spark, tmp_path):
    wide = X.wide_events(spark, "/root/testdata/sf0.001").limit(50)
    for name in ("a.parquet", "b.csv"):
        path = writers.write_frame(wide.drop("raw_score", "anomaly_score"), str(tmp_path / name))
        assert readers.read_frame(spark, path, readers.WIDE_EVENT if name == "a.parquet" else None).count() == 50
    with pytest.raises(ValueError):
        readers.read_frame(spark, "x.xlsx")
    with pytest.raises(ValueError):
        writers.write_frame(wide, "x.xlsx")
    log = tmp_path / "log.jsonl"
    log.write_text('{"event_id": "a", "anomaly_score": 0.5}\n\nnot json\n')
    good, bad = readers.read_json_lines(spark, str(log))
    assert [r.event_id for r in good.collect()] == ["a"] and [r.value for r in bad.collect()] == ["not json"]
    view = tmp_path / "view.json"
    view.write_text('[{"event_id": "a"},\n {"event_id": "b"}]')
    assert readers.read_json_array(spark, str(view), readers.DECISION).count() == 2
    inc = N.incidents(spark.sql(ENRICHED))
    writers.append_notifications(N.notification_intents(inc), str(tmp_path / "intents"))
    assert spark.read.json(str(tmp_path / "intents")).first().channel == "ops-console"
    calls = spark.sql("select 'evt-001' as event_id, 'shell_exec' as tool_name, 'ok' as status, 1 as records_found, array('records') as payload_keys")
    done = N.evaluate_policy(inc, calls)
    assert done.first().policy_evaluation_status == "blocked"
    writers.write_incident_bundle(N.incident_bundle(done), str(tmp_path / "bundle"))
    assert spark.read.parquet(str(tmp_path / "bundle")).first().incident_card.severity == "high"
    assert set(writers.export_views({"windows": wide}, str(tmp_path / "views"))) == {"windows"}


def test_streamed_order_across_a_restart(spark, tmp_path):
    """Falling and repeated sequence numbers, shuffled files and a copy of one: all grades equal those of the batch form."""
    schema = "event_id string, ts timestamp, sequence_number long, service_name string, metric_name string, metric_value double, scenario_tag string, chaos_suitability string"
    rng = random.Random(9)
    pairs = [("payments-api", "latency_p95"), ("payments-api", "error_rate"), ("redis", "redis_latency"), ("redis", "redis_queue_depth"), ("orders-api", "error_rate"), ("checkout-api", "latency_p95")]
    rows = []
    for i in range(500):
        seq = i - 3 if i % 97 == 0 else i
        rows.append((f"e{i}", T0 + dt.timedelta(seconds=(i - i % 2) * 1.5), None if i == 333 else seq, *rng.choice(pairs), rng.random() * 400, "S4", None))
    df = spark.createDataFrame(rows, schema)
    shuffled = spark.createDataFrame(rng.sample(rows[:250], 250), schema)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    far = [spark.createDataFrame([(f"far{h}", T0 + dt.timedelta(hours=h), 999, "redis", "redis_latency", 1.0, "S4", None)], schema) for h in (5, 10, 15)]
    policy = W.WindowingPolicy(min_events=1, max_missing_ratio=1.0, min_quality=0.1)
    for part in (shuffled, shuffled, df.where("cast(substring(event_id, 2) as int) >= 250"), *far):
        part.coalesce(1).write.mode("append").parquet(src)
        bus.append_log(stream_windows(spark.readStream.schema(df.schema).parquet(src), policy, anchor=T0, delay="30 minutes"), out, str(tmp_path / "state")).awaitTermination()
    got = {r.window_index: r for r in spark.read.parquet(out).collect()}
    batch = W.build_windows(df.unionByName(far[0]), policy)
    want = [r for r in batch.collect() if r.window_index <= 13]
    assert len(want) == 13 and {r.ordering_broken for r in want} == {True, False} and {r.accepted_for_training for r in want} == {True, False}
    for r in want:
        assert got[r.window_index].asDict() == {c: got[r.window_index][c] if isinstance(v, float) and abs(v - got[r.window_index][c]) < 1e-6 else v for c, v in r.asDict().items()}


def test_incident_sink_after_a_forced_replay(spark, tmp_path):
    from faultline.streaming import incidents as SI

    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    one = spark.sql(ENRICHED)
    calls = spark.sql("select 'evt-1' as event_id, 'shell_exec' as tool_name, 'ok' as status, 1 as records_found, array('records') as payload_keys")
    for i in range(3):
        one.withColumn("event_id", F.lit(f"evt-{i}")).coalesce(1).write.mode("append").parquet(src)
    source = lambda: spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(src)
    sink = SI.batch_sink(out, lambda b: SI.incident_tables(b, calls))
    seen = []

    def failing(batch, batch_id):
        seen.append(batch_id)
        if batch_id == 1:  # the tables are written, the ledger is not
            for name, table in SI.incident_tables(batch, calls).items():
                table.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
            raise RuntimeError("lost")
        sink(batch, batch_id)

    with pytest.raises(Exception):
        source().writeStream.foreachBatch(failing).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert [r.event_id for r in SI.read_table(spark, out, "incidents").collect()] == ["evt-0"] and seen == [0, 1]
    SI.write_incidents(source(), out, state, calls).awaitTermination()
    sink(one, 0)  # a batch in the ledger is not written again
    for name in ("slices", "incidents", "bundles"):
        assert sorted(r.event_id for r in SI.read_table(spark, out, name).collect()) == ["evt-0", "evt-1", "evt-2"]
    assert {r.event_id: r.audit_trace.policy_evaluation.status for r in SI.read_table(spark, out, "bundles").collect()}["evt-1"] == "blocked"


def test_texts_are_made_after_the_calls_are_joined(spark):
    """Counts joined to the enriched events give what the finished rows give, and no text goes through that shuffle."""
    calls = spark.createDataFrame([("evt-001", "shell_exec"), ("evt-001", None), ("evt-001", "runbook_reader"), ("other", "x")], "event_id string, tool_name string")
    ok = spark.sql(ENRICHED)
    late = N.evaluate_policy(N.incidents(ok), calls)
    early = N.evaluate_policy(N.incidents(N.with_calls(ok, N.call_counts(calls)), keep=N.CALLS))
    assert N.audit_trace(early).collect() == N.audit_trace(late).collect() and early.first().violations == 2
    none = N.evaluate_policy(N.incidents(N.with_calls(ok, N.call_counts(calls.limit(0))), keep=N.CALLS)).first()
    assert (none.reviewed_tools, none.violations) == (0, 0)
    plan = N.audit_trace(early)._jdf.queryExecution().optimizedPlan().toString()
    assert "Downstream" not in plan[plan.index("Join") :] and "Escalate to the owner" not in plan[plan.index("Join") :]


def test_cut_leaves_no_shuffle_files(spark):
    from faultline.session import CLEANUP, cut

    before = spark.conf.get(CLEANUP, "false")
    got = cut(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count())
    assert sorted(r["count"] for r in got.collect()) == [142] * 1 + [143] * 6 and spark.conf.get(CLEANUP, "false") == before


def test_batches_of_any_size_from_a_state_table(spark, tmp_path):
    """Signals and snapshots over three batches by the batch operators; a key that is missing from one keeps its state."""
    from faultline.streaming.detector import read_batches, write_enriched, write_signals

    df = scored(spark)
    df = df.where("not (cast(substring(event_id, 2) as int) between 50 and 89 and (service_name = 'orders-api' or source_node = 'node-1'))")
    src = str(tmp_path / "src")
    limits = {"payments-api": 0.3, "orders-api": 0.4, "checkout-api": 0.5}
    profiles = spark.createDataFrame([("S4_INTERSERVICE_CHAIN", 1, 0.5)], "scenario_tag string, cluster_id int, cluster_strength double")
    for keys in (("service_name",), ("source_node", "service_name")):
        base = str(tmp_path / "-".join(keys))
        for lo, hi in ((0, 50), (50, 90), (90, 120)):
            if keys == ("service_name",):
                df.where(f"cast(substring(event_id, 2) as int) >= {lo} and cast(substring(event_id, 2) as int) < {hi}").coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(df.schema).parquet(src)
            write_signals(stream, base, f"{base}-state", thresholds=limits, keys=keys).awaitTermination()
        cols = ["event_id", "anomaly_flag", "candidate_flag", "window_size", "window_fill", "reason_codes", "iforest_label", "service_candidate_rate"]
        want = DT.detector_signals(df, thresholds=limits, keys=keys)
        assert sorted(map(str, read_batches(spark, base).select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    batch = DT.detector_signals(df, thresholds=limits)
    log, out = str(tmp_path / "log"), str(tmp_path / "enriched")
    for lo, hi in ((0, 50), (50, 90), (90, 120)):
        batch.where(f"cast(substring(event_id, 2) as int) >= {lo} and cast(substring(event_id, 2) as int) < {hi}").coalesce(1).write.mode("append").parquet(log)
        source = spark.readStream.schema(batch.schema).parquet(log)
        write_enriched(source, profiles, out, f"{out}-state").awaitTermination()
    got = sorted((r.event_id, r.raw_event_refs, r.inferred_scenario) for r in read_batches(spark, out).collect())
    assert got == sorted((r.event_id, r.raw_event_refs, r.inferred_scenario) for r in CO.enrich(CO.snapshots(batch), profiles).collect())


def test_detector_leaves_no_key_to_one_python_task(spark):
    """The registered streams run on the batch operators: no grouped Python state, whatever the keys."""
    from faultline.operators.detector import signals_after

    plan = signals_after(scored(spark), None)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan and "_block" in plan


def test_events_with_counts_need_no_calls(spark):
    from faultline.streaming.incidents import incident_tables

    calls = spark.createDataFrame([("evt-001", "shell_exec")], "event_id string, tool_name string")
    ok = spark.sql(ENRICHED)
    early = incident_tables(N.with_calls(ok, N.call_counts(calls)))
    assert early["bundles"].collect() == incident_tables(ok, calls)["bundles"].collect()
    assert set(early) == {"slices", "incidents", "bundles"} and "bundles" not in incident_tables(ok)


def test_calls_meet_narrow_rows_by_a_shuffle(spark, monkeypatch):
    """Counts are joined before events are enriched; made by a generator, a row per event, they are not broadcast."""
    from faultline.plans import signal_queries as SQ

    calls = spark.sql("select id as event_id, inline(array(struct('shell_exec' as tool_name), struct('runbook_reader' as tool_name))) from range(1000)")
    plan = N.with_calls(spark.range(1000).withColumnRenamed("id", "event_id"), N.call_counts(calls))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    met, join = [], N.with_calls
    monkeypatch.setattr(N, "with_calls", lambda events, counts: (met.append(events.columns), join(events, counts))[1])
    SQ.evaluated(spark, "/root/testdata/sf0.001")
    assert len(met) == 1 and not {"services_observed", "correlation_engine", "snap_pay"} & set(met[0]) and len(met[0]) <= 7


def test_stream_tables_are_compressed(spark, tmp_path):
    from faultline.streaming.incidents import batch_sink, incident_tables

    base = str(tmp_path / "out")
    batch_sink(base, incident_tables)(spark.sql(ENRICHED), 0)
    for name in ("slices", "incidents"):
        assert all(f.endswith(".zstd.parquet") for f in spark.read.parquet(f"{base}/{name}").inputFiles())


def test_bundle_files_are_compressed_and_split_without_a_sort(spark, tmp_path):
    from faultline.sources.writers import OPEN_FILES

    ok, before, path = spark.sql(ENRICHED), spark.conf.get(OPEN_FILES), str(tmp_path / "bundle")
    calls = N.call_counts(spark.createDataFrame([], "event_id string, tool_name string"))
    bundle = N.incident_bundle(N.evaluate_policy(N.incidents(N.with_calls(ok, calls), keep=N.CALLS)))
    seen, write = [], type(bundle.write).parquet
    type(bundle.write).parquet = lambda self, *a, **k: (seen.append(spark.conf.get(OPEN_FILES)), write(self, *a, **k))[1]
    try:
        writers.write_incident_bundle(bundle, path)
    finally:
        type(bundle.write).parquet = write
    assert seen == ["16"] and spark.conf.get(OPEN_FILES) == before
    assert all(f.endswith(".zstd.parquet") for f in spark.read.parquet(path).inputFiles()) and spark.read.parquet(path).count() == ok.count()
    writers.append_notifications(N.notification_intents(N.incidents(ok), severities=("low", "medium", "high")), str(tmp_path / "i"), compression="gzip")
    read = spark.read.json(str(tmp_path / "i"))
    assert all(f.endswith(".json.gz") for f in read.inputFiles()) and read.count() == ok.count()
