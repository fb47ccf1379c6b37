"""Twins of the source, sink and windowed-stream queries."""

from oracles.base import FEATURES, FX_WIDE, L, PAIRS, S, WINDOWS, r4
from oracles.signals import EVALD, SIG
from oracles.signals import ORACLES as SIGNALS

ORACLES = {
    "dataset_files": f"""with {FX_WIDE}, k as (select 'parquet' as kind union all select 'csv')
        select kind, service_name, count(*) as rows, {r4('avg(latency_ms)', 'latency_ms')}, max(epoch_us(generated_at)) as last_us from fx_wide, k group by kind, service_name""",
    "decision_log_files": f"""with {SIG} select event_id, service_name, {r4('anomaly_score', 'anomaly_score')}, flag as anomaly_flag, cand as candidate_flag, reasons as reason_codes from sig""",
    "exported_views": f"with {FEATURES} select window_id, n_strict as strict_event_count, {r4('iforest_score_max', 'iforest_score_max')} from features",
    "json_array_file": f"with {SIG} select service_name, count(*) as decisions, count(*) filter (where flag) as flagged from sig group by service_name",
    "quarantined_envelopes": f"""with {FX_WIDE} select 'kept' as reason, count(*) as rows from fx_wide
        union all select case status_code when 503 then 'missing payload' else 'payload is not an object' end, count(*) from fx_wide where status_code in (429, 503) group by 1""",
    "incident_files": f"""with {EVALD} select 'intents' as sink, tri as severity, count(*) as rows from ev where tri = 'high' group by tri
        union all select 'bundle', tri, count(*) from ev group by tri""",
    "topic_round_trip": f"""with {FX_WIDE} select event_id, service_name, status_code, {r4('latency_ms', 'latency_ms')} from fx_wide""",
    "streamed_windows": f"""with {WINDOWS} select window_id, services as services_included, n_strict as strict_event_count, n_tol as late_events_within_tolerance,
        n_disc as late_discarded_count, covered as covered_pairs, {', '.join(r4(f'"{c}"', c.replace('-', '_')) for _, _, c in PAIRS)}, scenario_tag, degraded as degraded_quality,
        {r4('quality', 'window_data_quality_score')}, broken as ordering_broken, violators as ordering_violation_services, accepted as accepted_for_training
        from windows, span where ws + {L + S} <= ((t1 - 3600000000) // 1000) * 1000""",
    "streamed_incidents": SIGNALS["incident_records"],
    "streamed_slices": SIGNALS["context_slices"],
    "streamed_bundles": SIGNALS["incident_bundle"],
}
