"""Twins of the profiling, evaluation, threshold and label queries."""

from itertools import combinations

from faultline import constants as C
from faultline.operators.evaluation import SWEEP_EXTRA, SWEEP_QUANTILES
from oracles.base import FEATURES, FX_WIDE, case_map, r4

NUM = C.MODEL_FEATURES
BF = C.BURST_AUDIT_FIELDS


def nearest(col: str, q: float, cond: str = "true") -> str:
    return (
        f"list_sort(list({col}) filter (where {cond}))"
        f"[cast(floor((count(*) filter (where {cond}) - 1) * {q!r}::double + 0.5) as bigint) + 1]"
    )


POS = f"""{FX_WIDE},
pos0 as (select *, row_number() over (partition by service_name order by generated_at, md5(event_id), event_id) - 1 as idx,
  count(*) over (partition by service_name) as cnt from fx_wide),
pos as (select *, case when cnt > 1 then idx / (cnt - 1)::double else 0.0::double end as progress,
  case when progress < 0.33 then 'early' when progress < 0.66 then 'mid' else 'late' end as drift_slice,
  cast(least(floor(progress * 10), 9) as bigint) as temporal_bucket from pos0)"""
AN = f"""{POS},
lim as (select service_name as ls, {nearest('queue_length', 0.97)} as lq, {nearest('latency_ms', 0.97)} as ll,
  {nearest('http_5xx_rate', 0.97)} as lh from fx_wide group by service_name),
an as (select pos.*, (queue_length >= lq)::int + (latency_ms >= ll)::int + (http_5xx_rate >= lh)::int as bps, bps >= 2 as burst_proxy
  from pos left join lim on service_name = ls)"""
THR = case_map("service_name", C.SERVICE_THRESHOLDS)
FL = f"{AN}, fl as (select *, anomaly_score >= {THR} as flag from an)"
FLP = f"{POS}, fl as (select *, anomaly_score >= {THR} as flag from pos)"


def rate(cond: str, flag: str = "flag") -> str:
    return f"avg({flag}::int) filter (where {cond})"


_METRICS = ", ".join(
    r4(e, n)
    for e, n in (
        ("avg(flag::int)", "flag_rate_overall"),
        (rate("scenario_tag = 'normal'"), "false_positive_rate_on_normal"),
        (rate("scenario_tag = 'anomalous'"), "true_positive_rate_on_anomalous"),
        (rate("burst_proxy"), "burst_proxy_flag_rate"),
        (rate("drift_slice = 'late'"), "late_drift_flag_rate"),
    )
)
_SL = [("service_name",), ("scenario_tag",), ("service_name", "scenario_tag"), ("burst_proxy",), ("drift_slice",), ("service_name", "temporal_bucket")]
_K = ("burst_proxy", "drift_slice", "scenario_tag", "service_name", "temporal_bucket")


def _slice(s) -> str:
    keys = ", ".join(f"cast({k} as varchar) as {k}" if k in s else f"null::varchar as {k}" for k in _K)
    return f"""select '{'+'.join(s)}' as slice, {keys}, count(*) as row_count, {r4('avg(anomaly_score)', 'anomaly_score_mean')},
      {r4('quantile_cont(anomaly_score, 0.5)', 'anomaly_score_p50')}, {r4(nearest('anomaly_score', 0.95), 'anomaly_score_p95')},
      {r4('avg(flag::int)', 'flag_rate')} from fl group by {', '.join('fl.' + k for k in s)}"""


GRID = f"""{AN},
grid as (select distinct t from (select unnest([{', '.join(f'quantile_cont(anomaly_score, {q})' for q in SWEEP_QUANTILES)},
   {', '.join(str(x) + '::double' for x in SWEEP_EXTRA)}]) as t from fx_wide))"""
SWEEP = f"""{GRID},
sw0 as (select t, service_name, scenario_tag, burst_proxy, drift_slice, anomaly_score >= t as flag from grid, an),
span as (select t, max(r) - min(r) as span from (select t, service_name, avg(flag::int) as r from sw0 group by all) group by t),
sw as (select t, avg(flag::int) as fr, {rate("scenario_tag = 'normal'")} as fpr, {rate("scenario_tag = 'anomalous'")} as tpr,
   {rate('burst_proxy')} as br, {rate("drift_slice = 'late'")} as lr from sw0 group by t),
sweep as (select sw.*, span from sw join span using (t))"""


def _pick(label: str, fpr: float, span: float, tpr: float) -> str:
    return f"""select '{label}' as criteria, {r4('min(t)', 'threshold')},
      case when count(*) = 0 then 'no_threshold_met_strict_operating_criteria' else 'strict_operating_criteria' end as reason
      from (select t from sweep where fpr <= {fpr} and span <= {span} and tpr >= {tpr} order by -tpr, fpr, span, t limit 1)"""


def _profile(name: str, m: float) -> str:
    return f"""(select '{name}' as profile, {m}::double as max_fpr, {r4('t', 'threshold')}, {r4('fpr', 'false_positive_rate_on_normal')},
      {r4('tpr', 'true_positive_rate_on_anomalous')}, {r4('span', 'service_flag_rate_span')} from sweep
      order by fpr > {m}, case when fpr <= {m} then -tpr else abs(fpr - {m}) end, case when fpr <= {m} then fpr end, t limit 1)"""


V1 = ", ".join(
    f"coalesce({'order_code' if c == 'service_degradation_order_encoded' else c}, 0)::double as {c}"
    for c in C.FEATURES_V1
    if c not in ("delta_latency_orders", "delta_latency_checkout")
)
V1ROWS = f"""{FEATURES.replace('from sc left join tr on sc.k = tr.k', 'from (select * from sc where accepted and quality >= 0.85) sc left join tr on sc.k = tr.k')},
v1 as (select k, scenario_tag, {V1}, delta_latency_orders, delta_latency_checkout from features),
v1l as (unpivot (select * from v1) on {', '.join(C.FEATURES_V1)} into name feature value v)"""
EXPECT = case_map("scenario_tag", {t: e for t, e, *_ in C.SCENARIO_CATALOG}, "false").replace("True", "true").replace("False", "false")
_QUOTA = """per as (select service_name, count(*) as n, count(*) filter (where scenario_tag = 'anomalous') as bad from fx_wide group by all),
tq as (select *, sum(n) over () as total, sum(bad) over () as bt, count(*) over () as k, row_number() over (order by service_name) as i from per),
need as (select *, cast(greatest(0, greatest(round_even(total * 0.21::double, 0), 21) - bt) as bigint) as needed from tq)"""
W = {"cpu_pct": 1.0, "latency_ms": 1.3, "queue_length": 1.3, "http_5xx_rate": 1.2, "net_error_rate": 1.0, "throughput_rate": -0.8}
STRESS = f"""st as (select fx_wide.*, {' + '.join(f'({c} - m_{c}) / s_{c} * {w}' for c, w in W.items())} as stress from fx_wide join
  (select service_name as sv, {', '.join(f'avg({c}) as m_{c}, stddev_samp({c}) as s_{c}' for c in W)} from fx_wide where scenario_tag = 'normal' group by all)
  on service_name = sv where scenario_tag = 'normal')"""

ORACLES = {
    "feature_stats": f"with {FX_WIDE} "
    + " union all ".join(
        f"select '{f}' as feature, {', '.join(r4(e.format(f), n) for n, e in (('min', 'min({0})'), ('mean', 'avg({0})'), ('std', 'stddev_pop({0})'), ('p05', 'quantile_cont({0}, 0.05)'), ('p50', 'quantile_cont({0}, 0.5)'), ('p95', 'quantile_cont({0}, 0.95)'), ('max', 'max({0})')))} from fx_wide"
        for f in NUM
    ),
    "top_correlations": f"with {FX_WIDE}, c as ("
    + " union all ".join(f"select '{a}' as left_feature, '{b}' as right_feature, coalesce(corr({a}, {b}), 0) as p from fx_wide" for a, b in combinations(NUM, 2))
    + f") select left_feature, right_feature, {r4('p', 'pearson')} from c order by round(abs(p), 9) desc, 1, 2 limit 8",
    "burst_runs": f"""with {POS}, l as (select service_name as ls, {', '.join(f'quantile_cont({f}, 0.95) as q_{f}' for f in BF)} from fx_wide group by all),
        b as (select service_name, idx, ({' + '.join(f'({f} >= q_{f})::int' for f in BF)}) >= 2 as burst from pos join l on service_name = ls),
        isl as (select service_name, idx - row_number() over (partition by service_name order by idx) as g from b where burst),
        runs as (select service_name, count(*) as len from isl group by service_name, g),
        rr as (select service_name, count(*) as burst_runs, max(len) as max_burst_run from runs group by all)
        select service_name, count(*) as samples, count(*) filter (where burst) as burst_samples, {r4('avg(burst::int)', 'burst_sample_ratio')},
          coalesce(any_value(burst_runs), 0) as burst_runs, coalesce(any_value(max_burst_run), 0) as max_burst_run
        from b left join rr using (service_name) group by service_name""",
    "drift_summary": f"with {POS}, c as (select *, greatest(1, cnt // 5) as chunk from pos), m as ("
    + " union all ".join(
        f"select service_name, '{f}' as feature, avg({f}) filter (where idx < chunk) as e, avg({f}) filter (where idx >= cnt - chunk) as l from c group by all" for f in BF
    )
    + f") select service_name, feature, {r4('e', 'early_mean')}, {r4('l', 'late_mean')}, {r4('l - e', 'delta')}, {r4('case when e = 0 then 0 else (l - e) / e end', 'relative_delta')} from m",
    "export_profile": f"with {FX_WIDE} "
    + " union all ".join(f"select 'missing' as section, '{f}' as item, count(*) filter (where {f} is null) as value from fx_wide" for f in NUM)
    + " union all select 'time', 'first', min(epoch_us(generated_at)) from fx_wide union all select 'time', 'last', max(epoch_us(generated_at)) from fx_wide "
    + " ".join(f"union all select '{c}', {c}, count(*) from fx_wide group by {c}" for c in ("service_name", "scenario_tag", "telemetry_profile", "source_node")),
    "variance_ranking": f"with {V1ROWS} select feature, {r4('round(var_pop(v), 6)', 'variance')}, {r4('round(stddev_pop(v), 6)', 'std_dev')} from v1l group by feature",
    "strongest_pairs": f"""with {V1ROWS}, p as (select a.feature as left_feature, b.feature as right_feature, corr(a.v, b.v) as c
        from v1l a join v1l b on a.k = b.k and a.feature < b.feature group by all)
        select left_feature, right_feature, {r4('round(c, 6)', 'pearson')}, {r4('round(abs(c), 6)', 'abs_pearson')} from p
        where c is not null and not isnan(c) order by round(abs(c), 6) desc, 1, 2 limit 10""",
    "signal_contrast": f"""with {V1ROWS}, m as (select feature, coalesce(avg(v) filter (where {EXPECT}), 0) as p, coalesce(avg(v) filter (where not ({EXPECT})), 0) as n from v1l group by feature)
        select feature, {r4('round(p, 6)', 'positive_mean')}, {r4('round(n, 6)', 'negative_mean')},
        {r4('round(abs(p - n) / greatest(abs(p) + abs(n), 1e-9), 6)', 'relative_contrast')} from m""",
    "statistical_profile": f"""with {V1ROWS} select feature, count(*) as count, {r4('round(avg(v), 6)', 'mean')}, {r4('round(stddev_pop(v), 6)', 'std_dev')},
        {r4('round(min(v), 6)', 'min')}, {r4('round(quantile_cont(v, 0.5), 6)', 'p50')}, {r4('round(quantile_cont(v, 0.9), 6)', 'p90')},
        {r4('round(quantile_cont(v, 0.95), 6)', 'p95')}, {r4('round(max(v), 6)', 'max')}, {r4('round(avg((v = 0)::int), 6)', 'zero_ratio')} from v1l group by feature""",
    "score_summary": f"with {FX_WIDE} "
    + " union all ".join(
        f"select '{c}' as score, {', '.join(r4(e.format(c), n) for n, e in (('min', 'min({0})'), ('mean', 'avg({0})'), ('std', 'stddev_pop({0})'), ('p05', 'quantile_cont({0}, 0.05)'), ('p50', 'quantile_cont({0}, 0.5)'), ('p95', 'quantile_cont({0}, 0.95)'), ('max', 'max({0})')))} from fx_wide"
        for c in ("anomaly_score", "raw_score")
    ),
    "time_position": f"with {POS} select event_id, idx as service_event_index, cnt as service_event_count, {r4('progress', 'service_progress')}, drift_slice, temporal_bucket from pos",
    "burst_proxy": f"with {AN} select event_id, bps as burst_proxy_score, burst_proxy from an",
    "slice_summaries": f"with {FL} " + " union all ".join(_slice(s) for s in _SL),
    "flag_metrics": f"""with {FL} select count(*) as row_count, {_METRICS}, count(*) filter (where burst_proxy) as burst_row_count,
        {r4("avg((scenario_tag = 'anomalous')::int) filter (where burst_proxy)", 'burst_anomalous_share')},
        {r4(rate("drift_slice = 'early'"), 'early_drift_flag_rate')}, {r4("avg(anomaly_score) filter (where drift_slice = 'late')", 'late_anomaly_score_mean')},
        {r4('(select max(r) - min(r) from (select avg(flag::int) as r from fl group by service_name))', 'service_flag_rate_span')} from fl""",
    "flag_by_service": f"""with {FX_WIDE}, t as (select *, case service_name when 'payments-api' then {C.SERVICE_THRESHOLDS['payments-api']} when 'checkout-api' then {C.SERVICE_THRESHOLDS['checkout-api']} end as st from fx_wide)
        select event_id, service_name, {r4('st', 'service_threshold')}, anomaly_score >= st as predicted_flag from t""",
    "calibrate_thresholds": f"""with {FX_WIDE}, t as (select {nearest('anomaly_score', 0.995, "scenario_tag = 'normal'")} as a, {nearest('anomaly_score', 0.98)} as m from fx_wide)
        select {r4('any_value(a)', 'normal_quantile_threshold')}, {r4('any_value(m)', 'mixed_quantile_threshold')}, {r4('any_value(greatest(a, m))', 'recommended_threshold')},
        {r4("avg((anomaly_score >= greatest(a, m))::int) filter (where scenario_tag = 'normal')", 'false_positive_rate_on_normal')},
        {r4("avg((anomaly_score >= greatest(a, m))::int) filter (where scenario_tag = 'anomalous')", 'flag_rate_on_anomalous')} from fx_wide, t""",
    "matched_thresholds": f"""with {FX_WIDE}, n as (select * from fx_wide where scenario_tag = 'normal')
        select '*' as scope, {r4(nearest('anomaly_score', 0.95), 'threshold')} from n
        union all select service_name, {r4(nearest('anomaly_score', 0.95), 'threshold')} from n group by service_name""",
    "threshold_grid": f"with {GRID} select floor(t * 1e6 + 0.5) / 1e6 as threshold from grid",
    "threshold_sweep": f"""with {SWEEP} select {r4('t', 'threshold')}, {r4('fr', 'flag_rate_overall')}, {r4('fpr', 'false_positive_rate_on_normal')},
        {r4('tpr', 'true_positive_rate_on_anomalous')}, {r4('span', 'service_flag_rate_span')}, {r4('br', 'burst_proxy_flag_rate')}, {r4('lr', 'late_drift_flag_rate')} from sweep""",
    "recommend_threshold": f"with {SWEEP} {_pick('strict', 0.1, 0.08, 0.3)} union all {_pick('loose', 0.5, 0.5, 0.1)}",
    "operating_profiles": f"with {SWEEP} " + " union all ".join(_profile(n, m) for n, m in (("sensitivity", 0.12), ("balanced", 0.05), ("conservative", 0.01))),
    "policy_variants": f"""with {FX_WIDE}, b as (select avg((anomaly_score >= 0.55)::int) filter (where scenario_tag = 'normal') as f from fx_wide),
        n as (select * from fx_wide, b where scenario_tag = 'normal'),
        q as (select service_name as qs, list_sort(list(anomaly_score))[cast(floor((count(*) - 1) * (1 - any_value(f)) + 0.5) as bigint) + 1] as t from n group by all),
        g as (select list_sort(list(anomaly_score))[cast(floor((count(*) - 1) * (1 - any_value(f)) + 0.5) as bigint) + 1] as t from n),
        v as (select service_name, scenario_tag, 'score_samples' as score_policy, 'global' as threshold_mode, anomaly_score >= 0.55 as flag from fx_wide
          union all select service_name, scenario_tag, 'score_samples', 'service_specific', anomaly_score >= t from fx_wide join q on service_name = qs
          union all select service_name, scenario_tag, 'decision_function', 'global', anomaly_score >= t from fx_wide, g
          union all select service_name, scenario_tag, 'decision_function', 'service_specific', anomaly_score >= t from fx_wide join q on service_name = qs),
        s as (select score_policy, threshold_mode, max(r) - min(r) as sp from (select score_policy, threshold_mode, service_name, avg(flag::int) as r from v group by all) group by all),
        o as (select score_policy, threshold_mode, avg(flag::int) as fr, {rate("scenario_tag = 'normal'")} as fpr, {rate("scenario_tag = 'anomalous'")} as tpr from v group by all)
        select score_policy, threshold_mode, {r4('fr', 'flag_rate_overall')}, {r4('fpr', 'false_positive_rate_on_normal')}, {r4('tpr', 'true_positive_rate_on_anomalous')},
          {r4('sp', 'service_flag_rate_span')}, row_number() over (order by round(sp, 9), score_policy desc, threshold_mode) = 1 as best_span
        from o join s using (score_policy, threshold_mode)""",
    "top_outliers": f"""with {AN} select event_id, service_name, scenario_tag, {r4('anomaly_score', 'anomaly_score')}, {r4('latency_ms', 'latency_ms')},
        {r4('queue_length', 'queue_length')}, {r4('http_5xx_rate', 'http_5xx_rate')}, burst_proxy, drift_slice from an order by an.anomaly_score desc, event_id limit 20""",
    "top_outliers_per_service": f"""with {FX_WIDE}, r as (select *, cast(row_number() over (partition by service_name order by anomaly_score desc, event_id) as integer) as rank from fx_wide)
        select service_name, scenario_tag, event_id, {r4('anomaly_score', 'anomaly_score')}, {r4('latency_ms', 'latency_ms')}, rank from r where rank <= 12""",
    "score_bins": f"""with {FX_WIDE}, s as (select min(anomaly_score) as lo, max(anomaly_score) as hi from fx_wide)
        select service_name, scenario_tag, cast(least(floor((anomaly_score - lo) / ((hi - lo) / 24)), 23) as bigint) as bin, count(*) as rows from fx_wide, s group by all""",
    "cycle_table": f"""with {FLP} select temporal_bucket, service_name, count(*) as row_count, {r4('avg(flag::int)', 'flag_rate')}, {r4('avg(anomaly_score)', 'anomaly_score_mean')},
        {r4(rate("scenario_tag = 'anomalous'"), 'tpr_anomalous')}, {r4(rate("scenario_tag = 'normal'"), 'fpr_normal')} from fl group by temporal_bucket, service_name""",
    "cycle_summary": f"""with {FLP}, c as (select temporal_bucket, service_name, avg(flag::int) as fr, {rate("scenario_tag = 'anomalous'")} as tpr, {rate("scenario_tag = 'normal'")} as fpr from fl group by all)
        select temporal_bucket, count(*) as service_count, {r4('avg(fr)', 'mean_flag_rate')}, {r4('max(fr) - min(fr)', 'service_span')}, {r4('avg(tpr)', 'mean_tpr_anomalous')}, {r4('avg(fpr)', 'mean_fpr_normal')} from c group by temporal_bucket""",
    "persistence_summary": f"""with {FLP}, c as (select temporal_bucket, service_name, avg(flag::int) as fr, {rate("scenario_tag = 'anomalous'")} as tpr, {rate("scenario_tag = 'normal'")} as fpr from fl group by all),
        s as (select temporal_bucket, max(fr) - min(fr) as sp, avg(tpr) as t, avg(fpr) as f from c group by all)
        select {r4('avg(sp)', 'mean_service_span')}, {r4('max(sp)', 'max_service_span')}, {r4('avg(t)', 'mean_tpr_anomalous')}, {r4('avg(f)', 'mean_fpr_normal')} from s""",
    "stress_score": f"with {FX_WIDE}, {STRESS} select event_id, {r4('stress', 'stress_score')} from st",
    "residual_quota": f"""with {FX_WIDE}, {_QUOTA}, sh as (select *, cast(round_even(needed * (n / total::double), 0) as bigint) as share from need)
        select service_name, cast(needed // k + case when i <= needed % k then 1 else 0 end as bigint) as quota, 'balanced' as mode from need
        union all select service_name, cast(case when i = k then needed - coalesce(sum(share) over (order by i rows between unbounded preceding and 1 preceding), 0) else share end as bigint), 'share' from sh""",
    "residual_control": f"""with {FX_WIDE}, {_QUOTA}, {STRESS},
        rk as (select event_id as rid, service_name as rs, row_number() over (partition by service_name order by -round(stress, 9), md5(event_id), event_id) as r from st),
        hit as (select rid from rk join need on rs = service_name where r <= needed // k + case when i <= needed % k then 1 else 0 end)
        select event_id, case when rid is not null then 'anomalous' else scenario_tag end as scenario_tag,
          case when rid is not null and status_code = 200 then 429 else status_code end as status_code,
          {r4('case when rid is not null then least(greatest(http_5xx_rate, 0), 5.5) + 0.12 else http_5xx_rate end', 'http_5xx_rate')},
          {r4('case when rid is not null then net_error_rate + 0.03 else net_error_rate end', 'net_error_rate')}, rid is not null as relabelled
        from fx_wide left join hit on event_id = rid""",
    "label_rows": f"""with {FX_WIDE} select event_id, case when disk_io_pct >= 95 or cpu_pct >= 98 or http_5xx_rate >= 4.6 or queue_length >= 85 or latency_ms >= 360
        then 'anomalous' else 'normal' end as scenario_tag from fx_wide""",
    "dataset_report": f"""with {FX_WIDE}, n as (select count(*) as n from fx_wide)
        select 'service_count' as section, service_name as item, {r4('count(*)', 'value')} from fx_wide group by service_name
        union all select 'scenario_count', scenario_tag, {r4('count(*)', 'value')} from fx_wide group by scenario_tag
        union all select 'scenario_share', scenario_tag, {r4('round(count(*) / (select n from n)::double, 6)', 'value')} from fx_wide group by scenario_tag
        {' '.join(f"union all select 'feature_min', '{f}', {r4(f'min({f})', 'value')} from fx_wide union all select 'feature_mean', '{f}', {r4(f'avg({f})', 'value')} from fx_wide" for f in NUM)}""",
}
