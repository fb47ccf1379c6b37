"""Common table expressions shared by the twins: input adapters, windows, features.

They follow the definitions literally (interval joins, whole-window sorts) and
so share no method with the Spark side.
"""

from faultline import constants as C

L, S, TOL = 43_200_000_000, 21_600_000_000, 3_600_000_000


def r4(expr: str, name: str) -> str:
    return f"floor(({expr})::double * 10000.0 + 0.5) / 10000.0 as {name}"


def case_map(key: str, table: dict, default: str = "null") -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else repr(v)

    whens = " ".join(f"when {lit(k)} then {lit(v)}" for k, v in table.items())
    return f"case {key} {whens} else {default} end"


SERVICE = case_map(
    "event_type",
    {"purchase": "payments-api", "view": "orders-api", "click": "checkout-api", "error": "redis", "signup": "redis"},
)
METRIC = (
    "case when event_type='error' then 'redis_latency' when event_type='signup' then 'redis_queue_depth' "
    "when event_id % 3 = 0 then 'latency_p95' when event_id % 3 = 1 then 'error_rate' else 'throughput' end"
)
BASE = case_map("service_name || '|' || metric_name", {f"{s}|{m}": v for (s, m), v in C.BASELINE.items()})
TAG = case_map("day(ts) % 9", {int(t[1]): t for t, *_ in C.SCENARIO_CATALOG})
SUIT = case_map("scenario_tag", {t: s for t, _, s, _ in C.SCENARIO_CATALOG})

FX_LONG = f"""
fx0 as (select *, {SERVICE} as service_name, {METRIC} as metric_name, {TAG} as scenario_tag from events),
fx_long as (
  select cast(event_id as varchar) as event_id, event_id as eid, ts, epoch_us(ts) as us,
    case when event_id % 997 = 0 and event_id > 0 then event_id - 500 else event_id end as seq,
    service_name, metric_name, scenario_tag, {SUIT} as chaos_suitability,
    ({BASE}) * case when metric_name = 'throughput' then greatest(0.35, 1.3 - value / 100)
                    else 0.5 + value / 50 end as v,
    case when event_id % 41 <> 0 then strftime(ts, 'win_%Y%m%d') end as window_id
  from fx0)"""

_LIMITS = {}
_LIMITS2 = {}
for (_s, _m), _b in C.BASELINE.items():
    _l = _b * C.ACTIVATION_FACTOR[_m]
    _LIMITS[f"{_s}|{_m}"] = _l
    _LIMITS2[f"{_s}|{_m}"] = max(_l, C.ERROR_RATE_FLOOR) if _m == "error_rate" else _l


def _crossed(limits: dict) -> str:
    lim = case_map("service_name || '|' || metric_name", limits)
    return f"case when metric_name = 'throughput' then v <= ({lim}) else v >= ({lim}) end"


PAIRS = [(s, m, f"{s}__{m}") for s, m in C.EXPECTED_PAIRS]
EW = f"""{FX_LONG},
span as (select min(us) as t0, max(us) as t1 from fx_long),
starts as (select k, t0 + k * {S} as ws from span, unnest(range(0, (t1 - t0) // {S} + 1)) as u(k)),
ew as (
  select k, ws, e.*, case when us < ws + {L} then 'strict' when us < ws + {L + TOL} then 'tolerated'
                          else 'discarded' end as cls
  from starts join fx_long e on e.us >= ws and e.us < ws + {L + S})"""

_means = ",\n".join(
    f"round(avg(v) filter (where cls <> 'discarded' and service_name='{s}' and metric_name='{m}'), 6) as \"{c}\""
    for s, m, c in PAIRS
)
_acts = ",\n".join(
    f"min(us) filter (where cls <> 'discarded' and service_name='{s}' and {_crossed(lim)}) as act_{v}_{C.SHORT_NAME[s]}"
    for s in C.ALL_SERVICES
    for v, lim in (("v1", _LIMITS), ("v2", _LIMITS2))
)
WINDOWS = f"""{EW},
seqs as (
  select k, service_name, seq <= lag(seq) over (partition by k, service_name order by us, seq) as bad
  from ew where cls <> 'discarded'),
viol as (select k, string_agg(distinct service_name, ',' order by service_name) as violators
         from seqs where bad group by k),
agg as (
  select k, min(ws) as ws,
    count(*) filter (where cls = 'strict') as n_strict,
    count(*) filter (where cls = 'tolerated') as n_tol,
    count(*) filter (where cls = 'discarded') as n_disc,
    count(distinct service_name || metric_name) filter (where cls = 'strict') as covered,
    string_agg(distinct service_name, ',' order by service_name) filter (where cls <> 'discarded') as services,
    min(scenario_tag) filter (where cls <> 'discarded') as scenario_tag,
    min(chaos_suitability) filter (where cls <> 'discarded') as chaos_suitability,
    {_means},
    {_acts}
  from ew group by k),
g0 as (
  select agg.*, coalesce(violators, '') as violators, violators is not null as broken,
    covered / 11.0::double as cov, least(n_strict / 10.0::double, 1.0) as min_ev,
    n_tol / (n_strict + n_tol)::double as late,
    n_disc / (n_strict + n_tol + n_disc)::double as disc
  from agg left join viol using (k) where n_strict + n_tol > 0),
g1 as (select *, disc > 0.05 as degraded,
  round(greatest(least(cov * 0.55 + min_ev * 0.20 + (1 - late) * 0.10 + (1 - disc) * 0.15, 1.0), 0.0), 6) as q0 from g0),
g2 as (select *, case when degraded then round(greatest(q0 - 0.10, 0.0), 6) else q0 end as q1 from g1),
g3 as (select *, case when broken then round(greatest(q1 - 0.20, 0.0), 6) else q1 end as quality from g2),
windows as (
  select *, printf('temporal_window_%04d', k) as window_id,
    (1 - cov) <= 0.20 and n_strict >= 10 and quality >= 0.80 and not broken as accepted
  from g3)"""

API = [(s, C.SHORT_NAME[s]) for s in C.API_SERVICES]


def proxy(lat: str, err: str, thr: str, rl: str, rq: str) -> str:
    return (
        f"round((least({lat}/400.0, 1.5) + least({err}/0.08, 1.5) + least(greatest((220.0-{thr})/220.0, 0.0), 1.0)"
        f" + least({rl}/25.0 + {rq}/300.0, 1.5)) / 4.0, 6)"
    )


_lvl = []
for _s, _n in API:
    _lvl += [
        f"coalesce(\"{_s}__latency_p95\", 0.0) as latency_p95_{_n}",
        f"coalesce(\"{_s}__error_rate\", 0.0) as error_rate_{_n}",
        f"coalesce(\"{_s}__throughput\", 0.0) as thr_{_n}",
    ]
_scores = ", ".join(
    proxy(f"latency_p95_{n}", f"error_rate_{n}", f"thr_{n}", "redis_latency", "redis_queue_depth") + f" as score_{n}"
    for _, n in API
)
_flow = ", ".join(f"round(thr_{n} / (latency_p95_{n} + 1.0), 6) as flow_efficiency_{n}" for _, n in API)
_trail = []
for _s, _n in API:
    _trail += [
        f"max(ema) filter (where service_name='{_s}' and metric_name='error_rate') as degradation_intensity_{_n}",
        f"max(slope) filter (where service_name='{_s}' and metric_name='error_rate') as propagation_velocity_{_n}",
        f"max(pressure) filter (where service_name='{_s}' and metric_name='throughput') as traffic_pressure_{_n}",
        f"max(stress) filter (where service_name='{_s}' and metric_name='throughput') as stress_rate_{_n}",
    ]
TRAIL_NAMES = [
    f"{stem}_{n}"
    for _, n in API
    for stem in ("degradation_intensity", "propagation_velocity", "traffic_pressure", "stress_rate")
]
_DIST = {}
for _src, _row in {
    "payments": {"payments": 0, "redis": 1, "checkout": 2, "orders": 2},
    "redis": {"redis": 0, "checkout": 1, "orders": 2},
    "checkout": {"checkout": 0, "orders": 1},
    "orders": {"orders": 0},
}.items():
    for _t, _d in _row.items():
        _DIST[f"{_src}|{_t}"] = float(_d)
_topo = ", ".join(
    f"coalesce({case_map(chr(34) + 'origin' + chr(34) + f' || {chr(39)}|{n}{chr(39)}', {k: v for k, v in _DIST.items() if k.endswith('|' + n)})}, 0.0) as topological_distance_{n}"
    for n in C.TOPOLOGY_NODES
)
_crit = ", ".join(f"{float(C.TOPOLOGY_CRITICALITY[n])}::double as service_criticality_{n}" for n in C.TOPOLOGY_NODES)
_ord = []
for _s in C.ALL_SERVICES:
    _n = C.SHORT_NAME[_s]
    _ord.append(
        "("
        + " + ".join(
            f"case when coalesce(act_v1_{C.SHORT_NAME[o]}, 4e18::bigint) < coalesce(act_v1_{_n}, 4e18::bigint) or "
            f"(coalesce(act_v1_{C.SHORT_NAME[o]}, 4e18::bigint) = coalesce(act_v1_{_n}, 4e18::bigint) and '{o}' < '{_s}') then 1 else 0 end"
            for o in C.ALL_SERVICES
            if o != _s
        )
        + f") as pos_{_n}"
    )
_origin = "case " + " ".join(
    "when act_v2_{n} is not null and act_v2_{n} = least({all}) then '{n}'".format(
        n=n, all=", ".join(f"coalesce(act_v2_{m}, 9e18::bigint)" for m in C.TOPOLOGY_NODES)
    )
    for n in sorted(C.TOPOLOGY_NODES)
) + " end as origin"

FEATURES = f"""{WINDOWS},
lv as (select *, {', '.join(_lvl)}, coalesce("redis__redis_latency", 0.0) as redis_latency,
        coalesce("redis__redis_queue_depth", 0.0) as redis_queue_depth from windows),
sc as (select *, {_scores}, {_flow},
        round(least(greatest(1.0 / (1.0 + redis_queue_depth + redis_latency / 100.0), 0.0), 1.0), 6) as cache_health_score,
        {', '.join(_ord)}, {_origin},
        case when act_v1_redis >= act_v1_payments then (act_v1_redis - act_v1_payments) / 1e6 end as lag_payments_to_redis,
        case when act_v1_checkout >= act_v1_redis then (act_v1_checkout - act_v1_redis) / 1e6 end as lag_redis_to_checkout
        from lv),
pts as (
  select k, service_name, metric_name, us, v,
    row_number() over (partition by k, service_name, metric_name order by us, seq, event_id) as i,
    count(*) over (partition by k, service_name, metric_name) as n
  from ew where cls <> 'discarded' and service_name <> 'redis' and metric_name in ('error_rate', 'throughput')),
tr0 as (
  select k, service_name, metric_name, max(n) as n,
    round(sum(v * case when i = 1 then pow(0.7, n - 1) else 0.3 * pow(0.7, n - i) end), 6) as ema,
    max(v) filter (where i = n) as v1, max(v) filter (where i = n - 1) as v2, max(v) filter (where i = n - 3) as v4,
    max(us) filter (where i = n) as u1, max(us) filter (where i = n - 1) as u2, max(us) filter (where i = n - 3) as u4,
    avg(v) filter (where i > n - 6) as m6, stddev_pop(v) filter (where i > n - 6) as s6
  from pts group by all),
tr1 as (select *,
    case when n >= 4 and u1 > u4 then round((v1 - v4) / ((u1 - u4) / 1e6), 6) else 0.0 end as slope,
    case when n >= 2 and u1 > u2 then round((v2 - v1) / ((u1 - u2) / 1e6), 6) else 0.0 end as stress,
    case when n >= 2 and s6 > 0 then round((v1 - m6) / s6, 6) else 0.0 end as pressure from tr0),
tr as (select k, {', '.join(_trail)} from tr1 group by k),
ft as (
  select sc.*, {', '.join(f'coalesce(tr.{n}, 0.0) as {n}' for n in TRAIL_NAMES)},
    round(greatest(score_payments, score_orders, score_checkout), 6) as iforest_score_max,
    round((score_payments + score_orders + score_checkout) / 3.0, 6) as iforest_score_mean,
    round(greatest(score_payments, score_orders, score_checkout) - least(score_payments, score_orders, score_checkout), 6) as iforest_score_spread,
    round(((score_payments >= 0.55)::int + (score_orders >= 0.55)::int + (score_checkout >= 0.55)::int) / 3.0, 6) as window_anomaly_density,
    pos_payments * 1000 + pos_redis * 100 + pos_checkout * 10 + pos_orders as order_code,
    {_topo}, {_crit},
    round(1.0 - cache_health_score, 6) as stress_redis,
    row_number() over (partition by coalesce(scenario_tag, '') order by ws, sc.k) - 1 as idx,
    greatest(error_rate_payments, error_rate_orders, error_rate_checkout) <= 0.1 as clean
  from sc left join tr on sc.k = tr.k),
features as (
  select *,
    0.0 as upstream_health_payments,
    round(error_rate_payments, 6) as upstream_health_redis,
    round((stress_redis + error_rate_payments) / 2.0, 6) as upstream_health_checkout,
    round((error_rate_checkout + error_rate_payments + stress_redis) / 3.0, 6) as upstream_health_orders,
    coalesce(round(latency_p95_orders - lag(latency_p95_orders) over w, 6), 0.0) as delta_latency_orders,
    coalesce(round(latency_p95_checkout - lag(latency_p95_checkout) over w, 6), 0.0) as delta_latency_checkout,
    (idx - coalesce(max(case when clean then idx end) over (partition by coalesce(scenario_tag, '') order by ws, k
       rows unbounded preceding), -1))::double as recovery_memory
  from ft window w as (partition by coalesce(scenario_tag, '') order by ws, k))"""

SVC = case_map("l_returnflag", {"R": "payments-api", "N": "orders-api", "A": "checkout-api"})


def _cents(c: str) -> str:
    return f"cast(cast(round({c} * 100, 0) as bigint) as varchar)"


FX_WIDE = f"""
fx_wide as (
  select md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, {_cents('l_quantity')},
      {_cents('l_extendedprice')}, {_cents('l_discount')}, {_cents('l_tax')}, l_returnflag, l_linestatus,
      strftime(l_shipdate, '%Y%m%d'))) as event_id,
    l_shipdate as generated_at, 'node-' || (l_orderkey % 16) as source_node, {SVC} as service_name,
    (l_partkey % 100) / 20.0::double as http_5xx_rate,
    case when http_5xx_rate >= 4 then 503 when http_5xx_rate >= 3 then 429 else 200 end as status_code,
    case when l_linestatus = 'O' and l_quantity > 30 then 'anomalous' else 'normal' end as scenario_tag,
    'simple' as telemetry_profile,
    least(100.0, 2 * l_quantity) as cpu_pct, 40 + 500 * l_tax as memory_pct, l_extendedprice / 200 as latency_ms,
    least(100.0, 1000 * l_discount) as disk_io_pct, l_discount * l_quantity as net_error_rate,
    l_quantity * (1 + 10 * l_tax) as queue_length, 1000 / (1 + l_quantity) as throughput_rate,
    round(0.35 + 0.004 * l_quantity + 0.000001 * floor(l_extendedprice) + 0.5 * l_discount, 6) as anomaly_score,
    -anomaly_score as raw_score
  from lineitem)"""
