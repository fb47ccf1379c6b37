"""Registered queries over detector signals, enriched events and incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline import fixtures as X
from faultline.operators import contracts as K
from faultline.operators import correlation as CO
from faultline.operators import detector as D
from faultline.operators import evaluation as EV
from faultline.operators import incidents as N
from faultline.operators import propagation as PR
from faultline.operators import topology as T
from faultline.plans.scoring_queries import rounded
from faultline.plans.telemetry_queries import r4, windows_of
from faultline.session import dropped, stored

MAP_TEXT = "array_join(array_sort(transform(map_entries({0}), e -> concat(e.key, '=', cast({1} as string)))), ',') as {2}"


def scored(spark, d):
    """Wide rows with a decision time some seconds after the event."""
    return with_scored_at(X.wide_events(spark, d))


def with_scored_at(w):
    return w.withColumn("scored_at", F.expr("timestamp_micros(unix_micros(generated_at) + cast(round(http_5xx_rate * 20) as bigint) * 1000000)"))


def signals(spark, d):
    return D.detector_signals(scored(spark, d), thresholds=X.TEST_THRESHOLDS)


def assignments(spark, d):
    """Stand-in cluster assignments per window, by index, so that later steps can be checked alone."""
    return windows_of(spark, d).selectExpr(
        "window_index", "window_id", "scenario_tag", "cast(window_index % 4 - 1 as int) as cluster_id",
        "window_index % 4 = 0 as noise", "round(window_data_quality_score, 2) as cluster_strength", "window_data_quality_score",
    )


def signal_log(spark, d):
    # Signals are a written dataset in the live path; fix them once here too.
    return stored(signals(spark, d).select("source_node", *CO.SNAP_FIELDS), "signals")


def enriched(spark, d):
    return CO.enrich(CO.snapshots(signal_log(spark, d)), PR.scenario_profiles(assignments(spark, d)))


# What the detector and the snapshots read of a scored row.
SCORED = ("source_node", "service_name", "event_id", "generated_at", "scored_at", "queue_length", "anomaly_score")


def log_with_calls(spark, d):
    """The signal log with call counts, which are joined to the narrow scored rows: no finished event goes through a shuffle."""
    known = stored(N.with_calls(scored(spark, d).select(*SCORED), call_counts(spark, d)), "scored")
    log = stored(D.detector_signals(known, thresholds=X.TEST_THRESHOLDS).select("source_node", *CO.SNAP_FIELDS, *N.CALLS), "signals")
    dropped(known)
    return log


def enriched_with_calls(spark, d, log):
    return CO.enrich(CO.snapshots(log, along=N.CALLS), PR.scenario_profiles(assignments(spark, d)), keep=N.CALLS)


def incident_rows(spark, d):
    return N.incidents(enriched(spark, d))


def invocations(spark, d):
    """Tool calls per event: two allowed ones, and a forbidden one for failing requests."""
    call = "named_struct('tool_name', {0}, 'status', {1}, 'records_found', {2}, 'payload_keys', array({3}))"
    calls = ", ".join((
        call.format("'metrics_query_tool'", "'ok'", "cast(cpu_pct as int) % 5", "'records'"),
        call.format("'topology_lookup_tool'", "'ok'", "0", "'upstream', 'downstream'"),
        "case when status_code = 503 then " + call.format("'shell_exec'", "cast(null as string)", "0", "'stdout'") + " end",
        "case when status_code = 429 then " + call.format("cast(null as string)", "'error'", "0", "'stderr'") + " end",
    ))
    return X.wide_events(spark, d).selectExpr("event_id", f"inline(filter(array({calls}), x -> x is not null))")


def call_counts(spark, d):
    return N.call_counts(invocations(spark, d))


def evaluated(spark, d):
    return N.evaluate_policy(N.incidents(enriched_with_calls(spark, d, log_with_calls(spark, d)), keep=N.CALLS), approval_always=False)


def scenario_profiles(spark, d):
    a = PR.scenario_profiles(assignments(spark, d)).withColumn("kept", F.lit("all"))
    b = PR.scenario_profiles(assignments(spark, d), kept_cluster_ids=(0, 1)).withColumn("kept", F.lit("0,1"))
    return rounded(a.unionByName(b))


def detector_signals(spark, d):
    return signal_columns(signals(spark, d))


def signal_columns(s):
    return rounded(s.select(
        "event_id", "service_name", "service_threshold", "candidate_flag", "anomaly_flag", "window_fill", "window_size",
        F.array_join("reason_codes", ",").alias("reason_codes"), "iforest_label", "decision_freshness_ms", "service_candidate_rate"))


def freshness_summary(spark, d):
    return rounded(D.freshness_summary(signals(spark, d)))


def signal_snapshots(spark, d):
    s = CO.snapshots(signal_log(spark, d))
    return s.select("event_id", *[F.col(c)["event_id"].alias(c) for c in CO.SNAP.values()])


def enriched_events(spark, d):
    return enriched_columns(enriched(spark, d))


def enriched_columns(e):
    return e.selectExpr(
        "event_id", "unix_micros(timestamp) as ts_us", "array_join(services_observed, ',') as services_observed", "primary_service",
        MAP_TEXT.format("iforest_labels", "e.value", "iforest_labels"),
        "floor(round(aggregate(map_values(iforest_scores), 0D, (a, x) -> a + x), 6) * 10000 + 0.5) / 10000 as score_total",
        "correlation_engine.propagation_signature_id as propagation_signature_id",
        "correlation_engine.propagation_detected as propagation_detected",
        MAP_TEXT.format("correlation_engine.lag_pattern_seconds", "e.value", "lag_pattern_seconds"),
        "floor(correlation_engine.confidence * 10000 + 0.5) / 10000 as confidence",
        "floor(window_data_quality_score * 10000 + 0.5) / 10000 as window_data_quality_score", "severity_preliminary",
        "inferred_scenario", "floor(post_filter_score * 10000 + 0.5) / 10000 as post_filter_score", "size(raw_event_refs) as n_refs",
    )


def contract_enriched_events(spark, d):
    e = enriched(spark, d)
    odd = "inferred_scenario = 'S4_INTERSERVICE_CHAIN'"
    e = e.withColumns({
        "severity_preliminary": F.expr("case when severity_preliminary = 'critical' then 'fatal' else severity_preliminary end"),
        "primary_service": F.expr(f"case when {odd} then 'batch-api' else primary_service end"),
        "payload": F.expr(
            "to_json(struct(schema_version, event_id, timestamp, source, services_observed, primary_service, iforest_scores, iforest_labels, "
            f"correlation_engine, severity_preliminary, evidence_refs, case when {odd} then null else raw_event_refs end as raw_event_refs, "
            "case when primary_service = 'orders-api' then 'x' end as chaos_template))"
        ),
    })
    return K.enriched_event_errors(e, raw_json="payload").select("event_id", F.array_join("errors", "; ").alias("errors"))


def context_slices(spark, d):
    return slice_columns(N.context_slices(enriched(spark, d)))


def slice_columns(s):
    return s.selectExpr(
        "event_id", "array_join(related_services, ',') as related_services",
        "array_join(array_sort(transform(recent_anomalies, a -> a.service_name)), ',') as recent_anomalies",
        "topology_summary", "propagation_summary", "estimated_tokens",
    )


def contract_context_slices(spark, d):
    s = N.context_slices(enriched(spark, d)).withColumn("max_tokens", F.lit(1100))
    return K.context_slice_errors(s).select("event_id", F.array_join("errors", "; ").alias("errors"))


def incident_records(spark, d):
    return incident_columns(incident_rows(spark, d))


def incident_columns(rows):
    return rows.select(
        "event_id", "severity", "routing_decision", "anomaly_count", "related_services_count", "diagnosis_summary",
        "suspected_scope", "probable_cause", "evidence_strength", "retrieval_quality", "model_uncertainty", "policy_status",
        r4("confidence_score"), "human_review_required", "confidence_reason", "recommendation_type",
        "recommendation_text", "requires_human_approval",
    )


def decision_query(spark, d):
    return rounded(N.query_decisions(signals(spark, d), service_name=" Payments-API ", anomalous_only=True, limit=25).select(
        "event_id", "service_name", "anomaly_score", "candidate_flag", F.array_join("reason_codes", ",").alias("reason_codes"), "scenario_tag"))


def log_query(spark, d):
    return N.query_logs(signals(spark, d), service_name="orders-api", severity="low", limit=10).selectExpr(
        "unix_micros(timestamp) as ts_us", "service_name", "severity", "event_id", "message")


def topology_lookup(spark, d):
    """Direct neighbours and criticality for every service seen in the telemetry."""
    seen = X.long_events(spark, d).groupBy("service_name").agg(F.count(F.lit(1)).alias("events"))
    graph = T.lookup_service(T.edge_table(spark), T.node_table(spark))
    j = seen.withColumn("_n", T.topology_node(F.col("service_name"))).join(graph, F.col("_n") == F.col("node"), "left")
    return j.selectExpr("service_name", "events", "array_join(upstream, ',') as upstream", "array_join(downstream, ',') as downstream", "criticality", "redis_dependency")


def policy_evaluation(spark, d):
    return evaluated(spark, d).select(
        "event_id", "reviewed_tools", "violations", "policy_evaluation_status", "policy_mode", "human_approval_required")


def policy_violations(spark, d):
    return N.policy_violations(invocations(spark, d))


def tool_usage(spark, d):
    return N.tool_usage(invocations(spark, d))


def audit_trace(spark, d):
    return N.audit_trace(evaluated(spark, d)).selectExpr(
        "event_id", "context_snapshot.recent_anomalies_count as recent_anomalies_count", "context_snapshot.estimated_tokens as estimated_tokens",
        "policy_evaluation.status as status", "policy_evaluation.violations as violations", "cognitive_provenance.evidence_source as evidence_source",
        "floor(cognitive_provenance.confidence_score * 10000 + 0.5) / 10000 as confidence_score", "decision_rationale.severity as severity",
        "decision_rationale.recommendation_type as recommendation_type",
    )


def notification_intents(spark, d):
    return N.notification_intents(incident_rows(spark, d)).select("event_id", "severity", "channel", "message")


def incident_bundle(spark, d):
    return bundle_columns(N.incident_bundle(evaluated(spark, d)))


def bundle_columns(b):
    return b.selectExpr(
        "event_id", "incident_card.severity as severity", "incident_card.diagnosis as diagnosis", "confidence_vector.evidence_strength as evidence_strength",
        "recommendation.recommendation_type as recommendation_type", "audit_trace.policy_evaluation.status as status")


def decision_slices(spark, d):
    return rounded(EV.decision_slices(signals(spark, d)))


def decision_features(spark, d):
    # Every scored row gets one decision, which changes none of the columns read here, so none is worked out.
    return rounded(EV.decision_features(scored(spark, d)))


def decision_counts(spark, d):
    return EV.decision_counts(signals(spark, d))


def decision_examples(spark, d):
    return rounded(EV.decision_examples(signals(spark, d)))


QUERIES = {
    f.__name__: f
    for f in (
        scenario_profiles, detector_signals, freshness_summary, signal_snapshots, enriched_events, contract_enriched_events,
        context_slices, contract_context_slices, incident_records, decision_query, log_query, topology_lookup,
        policy_evaluation, policy_violations, tool_usage, audit_trace, notification_intents, incident_bundle,
        decision_slices, decision_features, decision_counts, decision_examples,
    )
}
