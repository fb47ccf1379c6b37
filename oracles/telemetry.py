"""Twins of the contract, window and feature queries."""

from faultline import constants as C
from oracles.base import EW, FEATURES, FX_LONG, FX_WIDE, METRIC, PAIRS, SERVICE, TRAIL_NAMES, WINDOWS, proxy, r4

def _fault(mod: int, bad, good: str) -> str:
    lit = "null" if bad is None else f"'{bad}'"
    return f"case when event_id % {mod} = {mod - 1} then {lit} else {good} end"


RAW_LONG = f"""
raw0 as (select *, event_id as row_id, {SERVICE} as svc, {METRIC} as met from events),
raw as (select row_id,
  {_fault(59, 'v0', repr(C.LONG_EVENT_VERSION))} as schema_version,
  {_fault(61, None, 'cast(event_id as varchar)')} as eid,
  {_fault(67, 'not-a-time', "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')")} as tstamp,
  {_fault(71, '-5', 'cast(event_id as varchar)')} as seq,
  {_fault(73, 'unknown-service', 'svc')} as service_name,
  {_fault(79, '  ', 'met')} as metric_name,
  {_fault(83, 'abc', 'cast(value as varchar)')} as metric_value,
  {_fault(89, '', "'ratio'")} as unit,
  {_fault(97, 'mystery', "'runtime'")} as source,
  {_fault(101, 'yes', "'false'")} as training,
  {_fault(103, '[1]', 'props')} as metadata,
  {_fault(107, 'maybe', 'null')} as suit, day(ts) % 9 as bucket
  from raw0),
checked as (select *, case when eid is null then 'missing required field: event_id' else concat_ws('; ',
  case when schema_version <> '{C.LONG_EVENT_VERSION}' then 'schema_version mismatch' end,
  case when service_name not in ('payments-api','orders-api','checkout-api','redis') then 'invalid service_name' end,
  case when source not in ('synthetic_generator','runtime') then 'invalid source' end,
  case when suit is not null then 'invalid chaos_suitability' end,
  case when try_cast(seq as bigint) is null or try_cast(seq as bigint) < 0 then 'sequence_number must be a non-negative integer' end,
  case when trim(metric_name) = '' then 'metric_name must be a non-empty string' end,
  case when try_cast(metric_value as double) is null then 'metric_value must be numeric' end,
  case when trim(unit) = '' then 'unit must be a non-empty string' end,
  case when training not in ('true','false') then 'is_training_only_field must be boolean' end,
  case when metadata not like '{{%' then 'metadata must be an object' end,
  case when try_cast(tstamp as timestamp) is null then 'timestamp must be ISO-8601 compatible' end) end as errors
  from raw)"""

ORACLES = {
    "contract_long_events": f"with {RAW_LONG} select row_id, errors from checked",
    "contract_wide_events": f"""with {FX_WIDE}, bad as (select event_id, cpu_pct * 1.05 as cpu_pct,
        case when status_code = 429 then 'odd' else scenario_tag end as scenario_tag,
        case when status_code = 503 then 'batch-api' else service_name end as service_name from fx_wide)
        select event_id, concat_ws('; ',
          case when service_name not in ('payments-api','orders-api','checkout-api') then 'invalid service_name' end,
          case when cpu_pct not between 0 and 100 then 'cpu_pct must be within [0, 100]' end,
          case when scenario_tag not in ('normal','anomalous') then 'invalid scenario_tag' end) as errors from bad""",
    "structural_audit": f"""with {FX_WIDE}
        select 'size' as section, 'row_count' as item, count(*) as value from fx_wide
        union all select 'size', 'column_count', 18
        {' '.join(f"union all select 'nulls', '{f}', count(*) filter (where {f} is null) from fx_wide" for f in C.MODEL_FEATURES)}
        union all select 'service_name', service_name, count(*) from fx_wide group by service_name
        union all select 'scenario_tag', scenario_tag, count(*) from fx_wide group by scenario_tag""",
    "scenario_summary": f"""with {RAW_LONG}
        select 'S' || bucket as scenario_tag, count(*) as events_generated,
          count(*) filter (where errors <> '') as invalid_events,
          string_agg(distinct service_name, ',' order by service_name) as services_covered,
          {', '.join(f"count(*) filter (where service_name='{s}') as events_{C.SHORT_NAME[s]}" for s in C.ALL_SERVICES)},
          {', '.join(r4(f"avg(try_cast(metric_value as double)) filter (where metric_name='{m}')", f'mean_{m}') for m in C.API_METRICS + C.CACHE_METRICS)}
        from checked group by bucket""",
    "window_late_classes": f"with {EW} select k as window_index, event_id, cls as late_class from ew",
    "window_metric_series": f"""with {EW} select printf('temporal_window_%04d', k) as window_id, service_name, metric_name,
        us as ts_us, seq as sequence_number, {r4('v', 'metric_value')}, cls = 'tolerated' as within_late_tolerance
        from ew where cls <> 'discarded'""",
    "window_quality": f"""with {WINDOWS} select window_id, ws as window_start_us, services as services_included,
        {', '.join(r4(f'"{c}"', c.replace('-', '_')) for _, _, c in PAIRS)},
        {r4('quality', 'window_data_quality_score')}, scenario_tag, chaos_suitability,
        n_strict as strict_event_count, n_tol as late_events_within_tolerance, n_disc as late_discarded_count,
        covered as covered_pairs, {r4('round(1 - cov, 6)', 'missing_ratio')}, {r4('round(min_ev, 6)', 'min_event_ratio')},
        {r4('round(late, 6)', 'late_event_ratio')}, {r4('round(disc, 6)', 'late_discard_ratio')}, degraded as degraded_quality,
        broken as ordering_broken, violators as ordering_violation_services, accepted as accepted_for_training
        from windows""",
    "window_eligibility": f"""with {WINDOWS} select window_id, {r4('quality', 'window_data_quality_score')},
        accepted and quality >= 0.85 as eligible from windows""",
    "service_window_view": f"""with {FX_LONG}, e as (select *, coalesce(window_id, 'no_window') as w from fx_long),
        r as (select w, round(avg(v) filter (where metric_name='redis_latency'), 6) as rl,
                round(avg(v) filter (where metric_name='redis_queue_depth'), 6) as rq
              from e where service_name='redis' group by w),
        a as (select w, service_name, min(us) as start_us, max(us) as end_us,
                coalesce(round(avg(v) filter (where metric_name='latency_p95'), 6), 0.0) as lat,
                coalesce(round(avg(v) filter (where metric_name='error_rate'), 6), 0.0) as err,
                coalesce(round(avg(v) filter (where metric_name='throughput'), 6), 0.0) as thr,
                arg_min(scenario_tag, us) as scenario_tag, count(distinct metric_name) as nm
              from e where service_name <> 'redis' group by w, service_name),
        j as (select a.*, coalesce(rl, 0.0) as rl, coalesce(rq, 0.0) as rq from a left join r using (w))
        select w as window_id, service_name, start_us, end_us, {r4('lat', 'latency_p95')}, {r4('err', 'error_rate')},
          {r4('thr', 'throughput')}, {r4('rl', 'redis_latency')}, {r4('rq', 'redis_queue_depth')},
          {r4(proxy('lat', 'err', 'thr', 'rl', 'rq'), 'iforest_score')}, scenario_tag,
          {r4('least(nm / 3.0, 1.0)', 'window_data_quality_score')} from j""",
    "window_scores": f"""with {FEATURES} select window_id,
        {', '.join(r4(f'score_{n}', f'iforest_score_{n}') for n in ('payments', 'orders', 'checkout'))},
        {', '.join(r4(c, c) for c in ('iforest_score_max', 'iforest_score_mean', 'iforest_score_spread', 'window_anomaly_density', 'cache_health_score', 'flow_efficiency_payments', 'flow_efficiency_orders', 'flow_efficiency_checkout'))}
        from features""",
    "activation_order": f"""with {FEATURES} select window_id,
        {', '.join(f'act_{v}_{n} as activation_{v}_{n}' for v in ('v1', 'v2') for n in C.TOPOLOGY_NODES)},
        {r4('lag_payments_to_redis', 'lag_payments_to_redis')}, {r4('lag_redis_to_checkout', 'lag_redis_to_checkout')},
        cast(order_code as bigint) as service_degradation_order_encoded, origin as detected_origin_service,
        array_to_string(list_transform(list_sort([{', '.join("{'p': pos_%s, 's': '%s'}" % (C.SHORT_NAME[s], s) for s in C.ALL_SERVICES)}]), lambda x: x.s), '>') as decoded_order
        from features""",
    "topology_features": f"""with {FEATURES} select window_id, origin as detected_origin_service,
        {', '.join(r4(f'{stem}_{n}', f'{stem}_{n}') for stem in ('topological_distance', 'service_criticality', 'upstream_health') for n in C.TOPOLOGY_NODES)}
        from features""",
    "trailing_features": f"""with {FEATURES} select k as window_index,
        {', '.join(r4(n, n) for n in TRAIL_NAMES)} from features""",
    "temporal_memory": f"""with {FEATURES} select window_id, scenario_tag, {r4('delta_latency_orders', 'delta_latency_orders')},
        {r4('delta_latency_checkout', 'delta_latency_checkout')}, recovery_memory from features""",
    "feature_contract_v2": f"""with {FEATURES} select window_id, {', '.join(r4(c, c) for c in C.FEATURES_V2)} from features""",
    "feature_contract_v1": f"""with {FEATURES} select window_id, {', '.join(r4('order_code::double' if c == 'service_degradation_order_encoded' else c, c) for c in C.FEATURES_V1)} from features""",
    "feature_sanity_v1": f"""with {FEATURES}, d as (select *, window_anomaly_density * 2 as dens, lag_payments_to_redis - 500 as lag1 from features)
        select window_id, concat_ws('; ',
          case when dens not between 0 and 1 then 'window_anomaly_density must be between 0 and 1' end,
          case when lag1 < 0 then 'lag_payments_to_redis cannot be negative' end) as errors from d""",
    "feature_sanity_v2": f"""with {FEATURES}, d as (select *, window_anomaly_density * 2 as dens,
            topological_distance_orders - 1 as dist from features)
        select window_id, concat_ws('; ',
          case when dens not between 0 and 1 then 'window_anomaly_density must be between 0 and 1' end,
          case when dist < 0 then 'topological_distance_orders must be non-negative' end) as errors from d""",
    "fallback_features": f"""with {FEATURES}, s as (select *,
          latency_p95_payments/220.0 + error_rate_payments/0.02 as sp, redis_latency/10.0 + redis_queue_depth/40.0 as sr,
          latency_p95_checkout/220.0 + error_rate_checkout/0.02 as sk, latency_p95_orders/220.0 + error_rate_orders/0.02 as so
          from features),
        o as (select *, (sr > sp)::int + (sk > sp)::int + (so > sp)::int as p1, (sp >= sr)::int + (sk > sr)::int + (so > sr)::int as p2,
          (sp >= sk)::int + (sr >= sk)::int + (so > sk)::int as p3, (sp >= so)::int + (sr >= so)::int + (sk >= so)::int as p4 from s)
        select window_id, k % 2 = 0 as has_feature_row,
          cast(case when k % 2 = 0 then order_code else p1*1000 + p2*100 + p3*10 + p4 end as bigint) as service_degradation_order_encoded,
          {r4("case when k % 2 = 0 then window_anomaly_density else round(((sp>=1)::int+(sr>=1)::int+(sk>=1)::int+(so>=1)::int)/4.0, 6) end", 'window_anomaly_density')},
          {r4("case when k % 2 = 0 then score_payments else latency_p95_payments/400.0 + error_rate_payments end", 'iforest_score_payments')},
          {r4("case when k % 2 = 0 then lag_payments_to_redis end", 'lag_payments_to_redis')}
        from o""",
}
