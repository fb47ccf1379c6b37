"""Twins of the detector, correlation and incident queries."""

from faultline import constants as C
from oracles.base import FX_LONG, FX_WIDE, WINDOWS, case_map, r4

NUM = C.MODEL_FEATURES
THR = case_map("service_name", {"payments-api": 0.58, "orders-api": 0.56, "checkout-api": 0.60})
ORD = "generated_at, md5(event_id), event_id"
SIG = f"""{FX_WIDE},
s0 as (select *, {THR} as thr, anomaly_score >= thr as cand, epoch_us(generated_at) + cast(round(http_5xx_rate * 20) as bigint) * 1000000 as scored_us,
  row_number() over (partition by service_name order by {ORD}) as rn from fx_wide),
s1 as (select *, least(rn, 3) as fill, least(rn, 32) as wsize,
  sum(cand::int) over (partition by service_name order by {ORD} rows between 2 preceding and current row) as h3,
  avg(cand::int) over (partition by service_name order by {ORD} rows between 31 preceding and current row) as crate from s0),
sig as (select *, fill >= 3 and h3 = 3 as flag,
  case when fill < 3 then 'stabilizing_window' when fill >= 3 and h3 = 3 then 'service_threshold_breach,persistent_window'
    when cand then 'service_threshold_breach,awaiting_window_confirmation' else 'within_expected_range' end as reasons,
  greatest(0.0, (scored_us - epoch_us(generated_at)) / 1000.0) as fresh from s1)"""


def _snap(s: str) -> str:
    n = C.SHORT_NAME[s]
    return (
        f"last_value(case when service_name = '{s}' then {{'id': event_id, 'score': round(anomaly_score, 6), 'bad': flag or cand, 't': scored_us, "
        f"'q': queue_length}} end ignore nulls) over (partition by source_node order by {ORD} rows between unbounded preceding and current row) as sn_{n}"
    )


SNAPS = f"{SIG}, sn as (select sig.*, {', '.join(_snap(s) for s in C.API_SERVICES)} from sig)"
PROF = f"""{WINDOWS},
asg as (select k, window_id, scenario_tag, cast(k % 4 - 1 as integer) as cluster_id, k % 4 = 0 as noise, round(quality, 2) as strength, quality from windows)"""
PROFILES = f"""{PROF},
pc as (select scenario_tag, cluster_id, count(*) as n, round(avg(strength), 6) as s from asg group by all),
prof as (select * from (select *, row_number() over (partition by scenario_tag order by n desc, cluster_id) as r from pc) where r = 1)"""
_ALL = ", ".join(f"coalesce(sn_{n}.{{0}}, null)" for n in ("payments", "orders", "checkout"))


def _lst(field: str) -> str:
    return "list_filter([" + ", ".join(f"sn_{n}.{field}" for n in ("payments", "orders", "checkout")) + "], lambda x: x is not null)"


ENR = f"""{SNAPS}, {PROFILES},
e0 as (select *, coalesce(sn_payments.bad, false) as bp, coalesce(sn_orders.bad, false) as bo, coalesce(sn_checkout.bad, false) as bc,
  bp::int + bo::int + bc::int as nbad, list_sort({_lst('score')}) as scores, list_sort({_lst('t')}) as times, list_max({_lst('q')}) as queue,
  len(scores) as ns, scores[ns] as top from sn),
e1 as (select *, 
  case when coalesce(sn_checkout.score, -9) = top then 'checkout-api' when coalesce(sn_orders.score, -9) = top then 'orders-api' else 'payments-api' end as prim,
  case when bp and bo and bc then 'S4_INTERSERVICE_CHAIN' when bp and bc then 'S3_REDIS_TO_MULTISERVICE_PROPAGATION'
    when bp and queue >= 30 then 'S2_SERVICE_TO_REDIS_PROPAGATION' when nbad = 1 then 'S1_LOCAL_ANOMALY_ONLY' else 'S6_NOISE_FALSE_POSITIVE' end as scen,
  case ns when 1 then scores[1] when 2 then scores[1] + (scores[2] - scores[1]) * 0.25 else scores[1] + (scores[2] - scores[1]) * 0.5 end as p25,
  (times[len(times)] - times[1]) / 1e6 as tspan from e0 where nbad > 0),
e2 as (select e1.*, prof.cluster_id, prof.s as strength, p25 >= 0.3 and prof.scenario_tag is not null and scen not like 'S1%' and scen not like 'S6%' as prop
  from e1 left join prof on scen = prof.scenario_tag),
e3 as (select *,
  case prim when 'payments-api' then sn_payments.t when 'orders-api' then sn_orders.t else sn_checkout.t end as tp,
  round(cast((coalesce(strength, 0.35) + least(1.0, p25)) / 2 as decimal(18, 9)), 6)::double as conf,
  round(ns / 3.0 * 0.65 + (case when ns < 2 then 0.7 when tspan <= 45 then 1.0 when tspan <= 90 then 0.75 else 0.5 end) * 0.35, 6) as wq,
  case when prop and top >= 0.85 and nbad >= 2 then 'critical' when prop or top >= 0.7 then 'high' when top >= 0.45 then 'medium' else 'low' end as sev,
  array_to_string(list_filter([case when sn_payments is not null then 'payments-api' end, case when sn_orders is not null then 'orders-api' end,
    case when sn_checkout is not null then 'checkout-api' end, 'redis'], lambda x: x is not null), ',') as services from e2),
e4 as (select *, coalesce(nullif(cast(floor(abs(sn_checkout.t - tp) / 1e6) as int), 0), case when scen like 'S3%' then 30 else 25 end) as g1,
  coalesce(nullif(cast(floor(abs(sn_orders.t - sn_checkout.t) / 1e6) as int), 0), 20) as g2,
  case when prop and cluster_id is not null then 'prop_sig_cluster_' || cluster_id || '_' || event_id end as sigid from e3),
enr as (select *, case when scen like 'S2%' then prim || '_to_redis=' || greatest(10, least(90, cast(floor(queue) as int)))
   when scen like 'S3%' then prim || '_to_redis=20,redis_to_checkout-api=' || g1
   when scen like 'S4%' then 'checkout-api_to_orders-api=' || g2 || ',' || prim || '_to_redis=20,redis_to_checkout-api=' || g1 else '' end as lags,
  case when scen like 'S2%' then prim || '_to_redis=' || greatest(10, least(90, cast(floor(queue) as int))) || 's'
   when scen like 'S3%' then prim || '_to_redis=20s, redis_to_checkout-api=' || g1 || 's'
   when scen like 'S4%' then prim || '_to_redis=20s, redis_to_checkout-api=' || g1 || 's, checkout-api_to_orders-api=' || g2 || 's' else '' end as lagtext,
  array_to_string(list_filter([case when sn_checkout is not null then 'checkout-api=' || case when bc then 'anomalous' else 'normal' end end,
    case when sn_orders is not null then 'orders-api=' || case when bo then 'anomalous' else 'normal' end end,
    case when sn_payments is not null then 'payments-api=' || case when bp then 'anomalous' else 'normal' end end], lambda x: x is not null), ',') as labels,
  array_to_string(list_filter([case when bc then 'checkout-api' end, case when bo then 'orders-api' end, case when bp then 'payments-api' end], lambda x: x is not null), ',') as bads,
  array_to_string(list_filter([case when sn_payments is not null and prim <> 'payments-api' then 'payments-api' end,
    case when sn_orders is not null and prim <> 'orders-api' then 'orders-api' end,
    case when sn_checkout is not null and prim <> 'checkout-api' then 'checkout-api' end, 'redis'], lambda x: x is not null), ', ') as related,
  len(related) - len(replace(related, ',', '')) + 1 as nrel from e4)"""
INC = f"""{ENR},
i0 as (select *, case when prop and nbad >= 1 and nrel >= 2 then 'high' when prop or nbad >= 2 then 'medium' else 'low' end as tri,
  case when prop and nbad >= 1 then 'high' when prop or nbad >= 1 then 'medium' else 'low' end as evid from enr),
inc as (select *, round((case evid when 'low' then 0.45 when 'medium' then 0.65 else 0.85 end) * 0.45::double + 0.45::double * 0.20 + 0.20 + (1 - 0.08::double) * 0.15 - 0.08, 6) as cs,
  case when tri = 'high' then 'escalate' when cs >= 0.6 then 'investigate' else 'observe' end as rec,
  case when rec = 'escalate' then 'Escalate to the owner of ' || prim || ' and review downstream impact. Start from the propagation summary: '
       when rec = 'investigate' then 'Investigate ' || prim || ' with focus on recent anomalies and service relationships. Propagation view: '
       else 'Observe ' || prim || ' and monitor for repeat signals before escalation. Current propagation view: ' end as rectext,
  case when prop then 'Propagation detected via ' || coalesce(sigid, 'unknown_signature') || ' with confidence ' || printf('%.2f', conf) || ' and lag pattern ' ||
       coalesce(nullif(lagtext, ''), 'no lag details') || '.' else 'No propagation signature was detected by the correlation engine for this event.' end as proptext from i0)"""
INV = """inv as (
  select event_id, 'metrics_query_tool' as tool, 'ok' as status, cast(trunc(cpu_pct) as int) % 5 as found, 'detector_decisions' as source from fx_wide
  union all select event_id, 'topology_lookup_tool', 'ok', 0, 'service_topology' from fx_wide
  union all select event_id, 'shell_exec', 'unknown', 0, 'workspace_local' from fx_wide where status_code = 503
  union all select event_id, 'unknown_tool', 'error', 0, 'workspace_local' from fx_wide where status_code = 429)"""
EVALD = f"""{INC}, {INV},
calls as (select event_id, count(*) as nt, count(*) filter (where tool in ('shell_exec', 'unknown_tool')) as nv from inv group by event_id),
ev as (select inc.*, coalesce(nt, 0) as nt, coalesce(nv, 0) as nv, case when coalesce(nv, 0) > 0 then 'blocked' else 'warning' end as pst from inc left join calls using (event_id))"""

ORACLES = {
    "scenario_profiles": f"""with {PROFILES}, pk as (select * from (select *, row_number() over (partition by scenario_tag order by n desc, cluster_id) as r from pc where cluster_id in (0, 1)) where r = 1)
        select scenario_tag, cluster_id, {r4('s', 'cluster_strength')}, n as sample_count, 'all' as kept from prof
        union all select scenario_tag, cluster_id, {r4('s', 'cluster_strength')}, n, '0,1' from pk""",
    "detector_signals": f"""with {SIG} select event_id, service_name, {r4('round(thr, 6)', 'service_threshold')}, cand as candidate_flag, flag as anomaly_flag,
        cast(fill as integer) as window_fill, cast(wsize as integer) as window_size, reasons as reason_codes, case when flag then 'anomalous' else 'normal' end as iforest_label,
        {r4('fresh', 'decision_freshness_ms')}, {r4('crate', 'service_candidate_rate')} from sig""",
    "freshness_summary": f"""with {SIG}, u as (select service_name as scope, fresh from sig union all select '*', fresh from sig)
        select scope, count(*) as decisions, count(fresh) as with_freshness, {r4('avg(fresh)', 'mean_freshness_ms')}, {r4('max(fresh)', 'max_freshness_ms')} from u group by scope""",
    "signal_snapshots": f"with {SNAPS} select event_id, sn_payments.id as snap_payments, sn_orders.id as snap_orders, sn_checkout.id as snap_checkout from sn",
    "enriched_events": f"""with {ENR} select event_id, times[len(times)] as ts_us, services as services_observed, prim as primary_service, labels as iforest_labels,
        {r4('round(list_sum(scores), 6)', 'score_total')}, sigid as propagation_signature_id, prop as propagation_detected, lags as lag_pattern_seconds, {r4('conf', 'confidence')},
        {r4('wq', 'window_data_quality_score')}, sev as severity_preliminary, scen as inferred_scenario, {r4('p25', 'post_filter_score')}, cast(ns + 1 as integer) as n_refs from enr""",
    "contract_enriched_events": f"""with {ENR} select event_id, concat_ws('; ',
        case when prim = 'orders-api' then 'forbidden field: chaos_template' end,
        case when scen like 'S4%' then 'missing required field: raw_event_refs' end,
        case when scen like 'S4%' then 'primary_service must be included in services_observed' end,
        case when sev = 'critical' then 'severity_preliminary is outside the allowed set' end) as errors from enr""",
    "context_slices": f"""with {INC} select event_id, replace(related, ', ', ',') as related_services, bads as recent_anomalies,
        'Primary service ' || prim || ' is connected to related services ' || related || ' in the current slice.' as topology_summary,
        proptext as propagation_summary,
        cast(least(4000, 700 + nrel * 120 + nbad * 80) as integer) as estimated_tokens from inc""",
    "contract_context_slices": f"""with {ENR} select event_id, case when 700 + nrel * 120 + nbad * 80 > 1100 then 'token_budget.estimated_tokens cannot exceed token_budget.max_tokens' else '' end as errors from enr""",
    "incident_records": f"""with {INC} select event_id, tri as severity, case when tri = 'high' then 'escalate' else 'investigate' end as routing_decision,
        cast(nbad as integer) as anomaly_count, cast(nrel as integer) as related_services_count,
        case when prop then 'Likely downstream propagation originating near ' || prim || ' and affecting ' || related || '.' else 'Likely localized degradation centered on ' || prim || '.' end as diagnosis_summary,
        case when prop then 'multi_service_propagation' else 'service_localized_degradation' end as suspected_scope,
        case when prop then 'shared_dependency_pressure_or_downstream_cascade' else 'service_specific_anomaly' end as probable_cause,
        evid as evidence_strength, 'low' as retrieval_quality, 'medium' as model_uncertainty, 'warning' as policy_status, {r4('cs', 'confidence_score')}, true as human_review_required,
        'Evidence strength is ' || evid || ' and retrieval quality is low; policy status is warning. Missing context: runbook_refs, policy_refs.' as confidence_reason,
        rec as recommendation_type, rectext || proptext as recommendation_text, true as requires_human_approval from inc""",
    "decision_query": f"""with {SIG} select event_id, service_name, {r4('anomaly_score', 'anomaly_score')}, cand as candidate_flag, reasons as reason_codes, scenario_tag
        from sig where service_name = 'payments-api' and flag order by generated_at, event_id limit 25""",
    "log_query": f"""with {SIG}, r as (select * from sig where service_name = 'orders-api')
        select epoch_us(generated_at) as ts_us, service_name, 'low' as severity, event_id,
        'Detector observed service=' || service_name || ' score=' || cast(anomaly_score as varchar) || ' reasons=' || reasons as message
        from r where not flag and not cand order by generated_at, event_id limit 10""",
    "topology_lookup": f"""with {FX_LONG} select service_name, count(*) as events,
        case service_name when 'payments-api' then '' when 'redis' then 'payments' when 'checkout-api' then 'redis' else 'checkout,payments' end as upstream,
        case service_name when 'payments-api' then 'orders,redis' when 'redis' then 'checkout' when 'checkout-api' then 'orders' else '' end as downstream,
        cast(case service_name when 'payments-api' then 1 when 'redis' then 2 else 3 end as bigint) as criticality, service_name <> 'orders-api' as redis_dependency
        from fx_long group by service_name""",
    "policy_evaluation": f"""with {EVALD} select event_id, nt as reviewed_tools, nv as violations, pst as policy_evaluation_status, 'read_only' as policy_mode, true as human_approval_required from ev""",
    "policy_violations": f"""with {FX_WIDE}, {INV} select event_id, tool as tool_name, 'Tool ' || tool || ' is not allowlisted for the MVP.' as violation from inv where tool in ('shell_exec', 'unknown_tool')""",
    "tool_usage": f"""with {FX_WIDE}, {INV} select event_id, tool as tool_name, status, source, count(*) as calls, cast(sum(found) as bigint) as records_found from inv group by all""",
    "audit_trace": f"""with {EVALD} select event_id, cast(nbad as integer) as recent_anomalies_count, cast(least(4000, 700 + nrel * 120 + nbad * 80) as integer) as estimated_tokens,
        pst as status, nv as violations, 'tool_invocations' as evidence_source, {r4('cs', 'confidence_score')}, tri as severity, rec as recommendation_type from ev""",
    "notification_intents": f"""with {INC} select event_id, tri as severity, 'ops-console' as channel, rectext || proptext as message from inc where tri = 'high'""",
    "incident_bundle": f"""with {EVALD} select event_id, tri as severity, case when prop then 'shared_dependency_pressure_or_downstream_cascade' else 'service_specific_anomaly' end as diagnosis,
        evid as evidence_strength, rec as recommendation_type, pst as status from ev""",
    "decision_slices": f"""with {SIG}, m as (select *, round(round(anomaly_score, 6) - round(thr, 6), 6) as margin from sig) select service_name, scenario_tag, count(*) as row_count, {r4('100 * avg(cand::int)', 'candidate_rate_pct')}, {r4('100 * avg(flag::int)', 'flag_rate_pct')},
        {r4('avg(anomaly_score)', 'avg_score')}, {r4('avg(margin)', 'avg_margin')}, {r4('quantile_cont(margin, 0.5)', 'p50_margin')}, {r4('quantile_cont(margin, 0.95)', 'p95_margin')},
        count(*) filter (where scenario_tag = 'anomalous' and not flag) as false_negatives, count(*) filter (where scenario_tag = 'normal' and flag) as false_positives,
        count(*) filter (where scenario_tag = 'anomalous' and not cand) as candidate_misses from m group by service_name, scenario_tag""",
    "decision_features": f"with {FX_WIDE} "
    + " union all ".join(
        f"select scenario_tag, service_name, '{f}' as feature, {r4(f'avg({f})', 'mean')}, {r4(f'quantile_cont({f}, 0.5)', 'p50')}, {r4(f'quantile_cont({f}, 0.95)', 'p95')} from fx_wide group by scenario_tag, service_name"
        for f in NUM
    ),
    "decision_counts": f"""with {SIG}, u as (select service_name, scenario_tag, 'reason' as kind, unnest(string_split(reasons, ',')) as item from sig
        union all select service_name, scenario_tag, 'status', cast(status_code as varchar) from sig)
        select service_name, scenario_tag, kind, item, count(*) as rows from u group by all""",
    "decision_examples": f"""with {SIG}, k as (select *, case when scenario_tag = 'anomalous' and not flag then 'false_negative' when scenario_tag = 'normal' and flag then 'false_positive' end as kind from sig),
        r as (select *, row_number() over (partition by service_name, kind order by anomaly_score desc, event_id) as rk from k where kind is not null)
        select service_name, kind, event_id, {r4('anomaly_score', 'anomaly_score')}, cast(rk as integer) as rank from r where rk <= 5""",
}

# The streams must give what the batch forms give.
ORACLES["streamed_signals"] = ORACLES["detector_signals"]
ORACLES["streamed_signals_by_node"] = ORACLES["detector_signals"].replace("partition by service_name", "partition by source_node, service_name")
ORACLES["streamed_enriched"] = ORACLES["enriched_events"]
