"""Twins of the clustering and propagation queries."""

from faultline import constants as C
from oracles.base import FEATURES, WINDOWS, case_map, r4

ORDER = "service_degradation_order_encoded"
COL = {c: ("order_code::double" if c == ORDER else f"coalesce({c}, 0)::double") for c in C.FEATURES_V1}
ASG = "asg as (select *, cast(k % 4 - 1 as integer) as cluster_id, k % 4 = 0 as noise, round(quality, 2) as strength from features)"
ELIG = FEATURES.replace("from sc left join tr on sc.k = tr.k", "from (select * from sc where accepted and quality >= 0.85) sc left join tr on sc.k = tr.k")
CL = f"""p as (select vec_id as id, embedding::double[] as x, 'label_' || label as tag from embeddings),
e as materialized (select a.id as u, b.id as v from p a join p b on list_distance(a.x, b.x) <= 1.13),
core as (select u as id from e group by u having count(*) >= 4),
ce as (select u, v from e where u in (select id from core) and v in (select id from core)),
reach as (select u, v from ce union select r.u, ce.v from reach r join ce on r.v = ce.u),
lab as (select u as id, min(v) as label from reach group by u),
al as (select id, label from lab union all select e.u, min(lab.label) from e join lab on e.v = lab.id where e.u not in (select id from core) group by e.u),
num as (select label, cast(row_number() over (order by label) - 1 as integer) as cid, n from (select label, count(*) as n from al group by label)),
cl as (select p.id, p.tag, coalesce(cid, -1) as cluster_id, cid is null as noise, coalesce(n / (select count(*) from p)::double, 0) as strength
  from p left join al on p.id = al.id left join num on al.label = num.label)"""
SHORT = {"payments": "latency_p95_payments > 0 or sp0 > 0", "redis": "redis_queue_depth > 0 or redis_latency > 0"}
_pos = {"payments-api": 1000, "redis": 100, "checkout-api": 10, "orders-api": 1}


def _sigs(head: str, has: str) -> str:
    return f"""{head},
fb as (select *, latency_p95_payments/220.0 + error_rate_payments/0.02 as sp, redis_latency/10.0 + redis_queue_depth/40.0 as sr,
   latency_p95_checkout/220.0 + error_rate_checkout/0.02 as sk, latency_p95_orders/220.0 + error_rate_orders/0.02 as so, {has} as has from asg),
rs as (select *, case when has then order_code else ((sr > sp)::int + (sk > sp)::int + (so > sp)::int) * 1000 + ((sp >= sr)::int + (sk > sr)::int + (so > sr)::int) * 100
   + ((sp >= sk)::int + (sr >= sk)::int + (so > sk)::int) * 10 + (sp >= so)::int + (sr >= so)::int + (sk >= so)::int end as code,
   case when has then score_payments else latency_p95_payments/400.0 + error_rate_payments end as ip,
   case when has then lag_payments_to_redis end as l1, case when has then lag_redis_to_checkout end as l2 from fb),
cev as (select cluster_id, count(*) as n, round(quantile_cont(l1, 0.1), 6) as l1a, round(quantile_cont(l1, 0.9), 6) as l1b, round(quantile_cont(l2, 0.1), 6) as l2a,
   round(quantile_cont(l2, 0.9), 6) as l2b, round(min(redis_latency), 6) as rmin, round(max(redis_latency), 6) as rmax from rs group by cluster_id),
sg as (select rs.*, n, l1a, l1b, l2a, l2b, rmin, rmax, list_transform(list_filter(list_sort([
   {{'p': code // 1000, 's': 'payments-api', 'on': coalesce(latency_p95_payments, 0) <> 0 or coalesce(ip, 0) <> 0}},
   {{'p': (code % 1000) // 100, 's': 'redis', 'on': redis_queue_depth <> 0 or redis_latency <> 0}},
   {{'p': (code % 100) // 10, 's': 'checkout-api', 'on': error_rate_checkout <> 0 or latency_p95_checkout <> 0}},
   {{'p': code % 10, 's': 'orders-api', 'on': error_rate_orders <> 0 or latency_p95_orders <> 0}}]), lambda x: x."on"), lambda x: x.s) as chain
   from rs join cev using (cluster_id))"""


def _el(head: str, has: str) -> str:
    return f"""{_sigs(head, has)}, el0 as (select *, coalesce(abs(l1b - l1a) > 30, false) as w1, coalesce(abs(l2b - l2a) > 30, false) as w2, round(quality, 6) as q, strength as c from sg),
el1 as (select *, round(least((case when cluster_id <> -1 and not noise then 0.35::double else 0 end) + least(len(chain) / 6.0::double, 0.20) + q * 0.25 + c * 0.20, 1), 6) as es,
  round(least(0.10::double + (case when len(chain) >= 4 then 0.25 when len(chain) >= 3 then 0.15 else 0 end) + greatest(0, 0.20 - c * 0.20) + greatest(0, 0.20 - q * 0.20)
   + (case when w1 or w2 then 0.10 else 0 end), 1), 6) as rs_ from el0),
el as (select *, case when es < 0.40 then 'not_suitable' when rs_ > 0.55 then 'requires_review' else 'draft' end as st from el1)"""


EXP = case_map("scenario_tag", {t: e for t, e, *_ in C.SCENARIO_CATALOG}, "false").replace("True", "true").replace("False", "false")
_dig = {s: f"((order_code // {v}) % 10)" for s, v in _pos.items()}


def _v1(chain) -> str:
    return " and ".join(f"{_dig[a]} < {_dig[b]}" for a, b in zip(chain, chain[1:]))


def _v2(chain) -> str:
    n = [C.SHORT_NAME[s] for s in chain]
    steps = [f"origin = '{n[0]}'", f"topological_distance_{n[0]} = 0"] + [f"topological_distance_{a} <= topological_distance_{b}" for a, b in zip(n, n[1:])]
    return "coalesce(" + " and ".join(steps) + ", false)"


_CH = [(t, ch) for t, _, _, ch in C.SCENARIO_CATALOG if ch]
OM = "om as (select *, {} as v1m, {} as v2m, {} as pos from asg)".format(
    "case scenario_tag " + " ".join(f"when '{t}' then {_v1(c)}" for t, c in _CH) + " end",
    "case scenario_tag " + " ".join(f"when '{t}' then {_v2(c)}" for t, c in _CH) + " end",
    EXP,
)


def _val(v: str) -> str:
    rate = lambda a, b: f"coalesce(round(avg(({a})::int) filter (where {b}), 6), 0)"
    return f"""select '{v}' as version, count(*) as window_count, count(*) filter (where pos) as positive_windows, count(*) filter (where not pos) as negative_windows,
      {r4(rate('not noise', 'pos'), 'propagation_detection_rate')}, {r4(rate('not noise', 'not pos'), 'false_propagation_rate')}, {r4(rate('noise', 'not pos'), 'noise_rejection_rate')},
      {r4(rate('pos', 'not noise'), 'precision')}, {r4(rate(f'coalesce({v}m, false)', 'pos'), 'propagation_order_accuracy')},
      {r4(rate('coalesce("payments-api__latency_p95" >= 0 and "redis__redis_latency" >= 0, false)', 'pos'), 'temporal_coverage')},
      count(*) filter (where noise) as noise_window_count, count(distinct cluster_id) filter (where cluster_id <> -1) as cluster_count,
      {r4('round(1 - ' + rate('not noise', 'not pos') + ', 6)', 'specificity')}, {r4('coalesce((select round(sum(t)::double / sum(s), 6) from pu), 0)', 'cluster_purity')} from om"""


PU = "pu as (select max(n) as t, sum(n) as s from (select cluster_id, scenario_tag, count(*) as n from asg where cluster_id <> -1 group by all) group by cluster_id)"


def _pf(name: str, t: float, agg: str) -> str:
    conf = {"percentile_25": "quantile_cont(iforest_score_mean, 0.25)", "median": "quantile_cont(iforest_score_mean, 0.5)", "mean": "avg(iforest_score_mean)"}[agg]
    return f"""(with c as (select cluster_id, round({conf}, 6) as conf from asg where cluster_id <> -1 group by cluster_id),
      lim as (select case when max(conf) < {t} then round(quantile_cont(conf, 0.7), 6) else {t} end as t, case when max(conf) < {t} then 'adaptive_quantile_fallback' else 'fixed_threshold' end as pol from c),
      j as (select asg.*, c.conf, lim.t, lim.pol, asg.cluster_id = -1 or conf >= t as ok from asg left join c using (cluster_id), lim)
      select '{name}' as case_name, window_id, cluster_id as raw_cluster_id, cast(case when ok then cluster_id else -1 end as integer) as cluster_id, case when ok then noise else true end as noise,
      {r4('case when ok then strength else 0 end', 'cluster_strength')}, {r4('coalesce(conf, 0)', 'cluster_iforest_confidence')}, {r4('t', 'post_filter_threshold')}, pol as post_filter_policy, ok as post_filter_passed from j)"""


POST_FILTER = """c as (select cluster_id, round(quantile_cont(iforest_score_mean, 0.25), 6) as conf from asg0 where cluster_id <> -1 group by cluster_id),
lim as (select case when max(conf) < 0.37 then round(quantile_cont(conf, 0.7), 6) else 0.37 end as t, case when max(conf) < 0.37 then 'adaptive_quantile_fallback' else 'fixed_threshold' end as pol from c),
pfj as (select asg0.*, c.conf, lim.t, lim.pol, cluster_id = -1 or conf >= t as ok from asg0 left join c using (cluster_id), lim),
asg as materialized (select * exclude (cluster_id, noise, strength), cluster_id as raw_cluster_id, case when ok then cluster_id else -1 end as cluster_id,
  case when ok then noise else true end as noise, case when ok then strength else 0 end as strength from pfj)"""


def _clusters(contract) -> str:
    """Scaled contract, sequential rule over all pairs of windows, post-filter."""
    cols, eps = (C.FEATURES_V1, 0.62) if contract == "v1" else (C.FEATURES_V2, 1.1)
    val = lambda c: "order_code::double" if c == ORDER else f"coalesce({c}, 0)::double"
    scale = lambda c: f"case when max(f_{c}) over () = min(f_{c}) over () then 0 else round((f_{c} - min(f_{c}) over ()) / (max(f_{c}) over () - min(f_{c}) over ()), 6) end"
    dist = f"sqrt(list_sum(list_transform(range(1, {len(cols) + 1}), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i]))))"
    return f"""{FEATURES}, fmat as materialized (select *, {', '.join(f'{val(c)} as f_{c}' for c in cols)} from features),
fx as materialized (select k, [{', '.join(scale(c) for c in cols)}] as x from fmat),
fe as materialized (select a.k as u, b.k as v from fx a join fx b on {dist} <= {eps}),
fcore as materialized (select u as k from fe group by u having count(*) >= 3),
fce as materialized (select u, v from fe where u in (select k from fcore) and v in (select k from fcore)),
freach as (select u, v from fce union select r.u, e.v from freach r join fce e on r.v = e.u),
flab as materialized (select u as k, min(v) as label from freach group by u),
fal as materialized (select k, label from flab union all select e.u, min(flab.label) from fe e join flab on e.v = flab.k where e.u not in (select k from fcore) group by e.u),
fnum as (select label, cast(row_number() over (order by label) - 1 as integer) as cid, n from (select label, count(*) as n from fal group by label)),
asg0 as materialized (select fmat.*, coalesce(cid, -1) as cluster_id, cid is null as noise, coalesce(round(n / (select count(*) from fmat)::double, 6), 0) as strength
  from fmat left join fal using (k) left join fnum using (label)),
{POST_FILTER}"""


def _clustered(contract: str) -> str:
    return f"""with recursive {_clusters(contract)} select window_id, raw_cluster_id, cluster_id, noise, {r4('strength', 'cluster_strength')},
        {r4('coalesce(conf, 0)', 'cluster_iforest_confidence')}, {r4('t', 'post_filter_threshold')}, pol as post_filter_policy, ok as post_filter_passed from asg"""


SIGNATURES = f"""select 'prop_sig_' || window_id as signature_id, cluster_id, cluster_id <> -1 as detected, noise, array_to_string(chain, '>') as chain,
        {r4('l1a', 'lag_p10')}, {r4('l1b', 'lag_p90')}, n as sample_window_count, case when n >= 30 then 'precise' else 'imprecise' end as precision,
        nullif(concat_ws(',', case when redis_queue_depth >= 40 then 'redis_queue_depth' end, case when redis_latency >= 10 then 'redis_latency' end), '') as affected_redis,
        nullif(concat_ws(',', case when latency_p95_payments >= 220 then 'latency_p95' end, case when ip >= 0.45 then 'iforest_score' end), '') as affected_payments,
        {r4('rmin', 'redis_latency_min')}, {r4('rmax', 'redis_latency_max')}, ws as start_us from sg"""
ELIGIBILITY = f"""select 'prop_sig_' || window_id as source_signature_id, es >= 0.55 and st <> 'not_suitable' as eligible, {r4('es', 'eligibility_score')}, {r4('rs_', 'risk_score')}, st as recommended_status,
        cast(3 + list_contains(chain, 'redis')::int + (len(chain) >= 4)::int as integer) as n_preconditions,
        concat_ws('; ', case when noise then 'signature flagged as noise in the defensive lane' end, case when q < 0.85 then 'window quality is below preferred replay threshold' end,
          case when rs_ > 0.55 then 'risk score is elevated and requires human review' end, case when w1 then 'payments-api_to_redis shows moderate or high variance' end,
          case when w2 then 'redis_to_checkout-api shows moderate or high variance' end) as warnings from el"""
SUMMARY = "select count(*) as window_count, count(distinct cluster_id) filter (where cluster_id <> -1) as cluster_count, count(*) filter (where cluster_id = -1) as noise_window_count, count(*) filter (where cluster_id <> -1) as clustered_window_count from asg"
HIERARCHY = [("eom", "eom", 0.0, False), ("leaf", "leaf", 0.0, False), ("wide", "leaf", 0.8, False), ("single", "eom", 0.0, True)]
SWEEP = [(f"{method}_{eps}_{str(single).lower()}", method, eps, single) for method in ("eom", "leaf") for eps in (0.0, 0.4) for single in (False, True)]


def _hierarchy(contract: str, m: int, k: int, cases) -> str:
    """All pairs, Prim's tree, Kruskal's labels after every edge, condensed clusters, selection; hl has case_name, k, cluster_id, noise, cluster_strength."""
    head = _clusters(contract)
    head = head[: head.index(", fe as materialized") if ", fe as materialized" in head else head.index(",\nfe as materialized")]
    n = len(C.FEATURES_V1 if contract == "v1" else C.FEATURES_V2)
    values = ", ".join(f"('{name}', '{method}', {eps}, {str(single).lower()})" for name, method, eps, single in cases)
    lam = lambda w: f"case when {w} is null then 0 when {w} > 0 then 1 / {w} else 'infinity'::double end"
    return f"""{head},
hd as materialized (select a.k as a, b.k as b, round(sqrt(list_sum(list_transform(range(1, {n + 1}), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i])))), 9) as d from fx a, fx b),
hc as materialized (select a as k, list_sort(list(d))[least({k} + 1, count(*))] as core from hd group by a),
hp as materialized (select a, b, greatest(d, p.core, q.core) as w from hd join hc p on a = p.k join hc q on b = q.k where a < b),
prim as (select 0 as step, [min(k)] as inside, null::bigint as a, null::bigint as b, null::double as w from fx union all
  select step + 1, list_append(inside, case when list_contains(inside, a) then b else a end), a, b, w from (
    select p.step, p.inside, hp.a, hp.b, hp.w, row_number() over (order by hp.w, hp.a, hp.b) as rn from prim p join hp on list_contains(p.inside, hp.a) <> list_contains(p.inside, hp.b)) where rn = 1),
te as materialized (select row_number() over (order by w, md5(a || '-' || b)) as r, a, b, w from prim where step > 0),
kr as (select 0::bigint as r, list(k order by k) as lab, list(k order by k) as ks from fx union all
  select te.r, list_transform(kr.lab, lambda x: case when x = kr.lab[list_position(kr.ks, te.b)] then kr.lab[list_position(kr.ks, te.a)] else x end), kr.ks from kr join te on te.r = kr.r + 1),
lp as materialized (select r, unnest(ks) as k, unnest(lab) as label from kr),
sz as materialized (select r, label, count(*) as n from lp group by all),
ev as materialized (select te.*, p.label as la, q.label as lb, sp.n as sa, sq.n as sb,
  case when sp.n >= {m} and sq.n >= {m} then 'split' when sp.n >= {m} or sq.n >= {m} then 'absorb' when sp.n + sq.n >= {m} then 'birth' else 'small' end as kind
  from te join lp p on p.r = te.r - 1 and p.k = te.a join lp q on q.r = te.r - 1 and q.k = te.b join sz sp on sp.r = te.r - 1 and sp.label = p.label join sz sq on sq.r = te.r - 1 and sq.label = q.label),
mk as materialized (select e.r, max(f.r) filter (where lp.label = e.la) as ma, max(f.r) filter (where lp.label = e.lb) as mb
  from ev e join ev f on f.r < e.r and f.kind in ('birth', 'split') join lp on lp.r = e.r - 1 and lp.k = f.a group by e.r),
par as (select ma as c, ev.r as parent, w as birth from ev join mk using (r) where kind = 'split' union all select mb, ev.r, w from ev join mk using (r) where kind = 'split'),
cw as (select r as c, w, sa + sb as n from ev where kind in ('birth', 'split') union all
  select case when sa >= {m} then ma else mb end, w, case when sa >= {m} then sb else sa end from ev join mk using (r) where kind = 'absorb'),
st as (select cw.c, sum(case when {lam('w')} = {lam('birth')} then 0 else ({lam('w')} - {lam('birth')}) * n end) as stab, max({lam('w')}) as peak from cw left join par using (c) group by cw.c),
cs as materialized (select row_number() over (order by e.r) as i, e.r as c, par.parent, par.birth, e.w as death, stab, peak from ev e left join par on par.c = e.r join st on st.c = e.r where kind in ('birth', 'split')),
up as (select 0::bigint as i, [{{'p': -1::bigint, 'c': -1::bigint, 'v': 0::double, 'keep': false, 'leaf': false}}] as s union all
  select i, list_append(s, {{'p': coalesce(parent, -2), 'c': c, 'v': case when below is null or stab >= below then stab else below end, 'keep': below is null or stab >= below, 'leaf': below is null}})
  from (select cs.*, up.s, list_sum(list_transform(list_filter(up.s, lambda x: x.p = cs.c), lambda x: x.v)) as below from up join cs on cs.i = up.i + 1)),
kp as materialized (select u.c, u.keep, u.leaf from (select unnest(s) as u from up where i = (select max(i) from up)) where u.c > 0),
cases as (select * from (values {values}) as t(case_name, method, eps, single)),
ok as (select case_name, eps, cs.c, case when parent is null then single and (pick or (eps > 0 and death <= eps)) when eps <= 0 then pick when birth > eps then pick or death <= eps else true end as yes
  from (select *, case when method = 'eom' then keep else leaf end as pick from cases, kp) x join cs using (c)),
anc as (select c, c as a from cs union all select anc.c, cs.parent from anc join cs on cs.c = anc.a where cs.parent is not null),
ch as (select case_name, any_value(eps) as eps, anc.c, max(a) as chosen from anc join ok on ok.c = anc.a where yes group by case_name, anc.c),
jn as materialized (select fx.k, min(ev.r) as r from fx join lp on lp.k = fx.k join ev on ev.r - 1 = lp.r and kind in ('birth', 'absorb') and ((lp.label = la and sa < {m}) or (lp.label = lb and sb < {m})) group by fx.k),
dc as (select jn.k, ev.w, case when kind = 'birth' then ev.r when sa >= {m} then ma else mb end as c from jn join ev using (r) left join mk using (r)),
pl as (select case_name, dc.k, case when cs.parent is not null or (case when eps > 0 then w <= eps else {lam('w')} >= peak end) then chosen end as chosen, {lam('w')} as l, peak
  from dc join ch using (c) join cs on cs.c = chosen),
nm as (select case_name, chosen, row_number() over (partition by case_name order by min(k)) - 1 as cid from pl where chosen is not null group by case_name, chosen),
hl as materialized (select cases.case_name, fx.k, coalesce(nm.cid, -1)::integer as cluster_id, nm.cid is null as noise,
  case when nm.cid is null then 0 when peak = 0 or isinf(l) then 1 else round(least(l, peak) / peak, 6) end as cluster_strength
  from cases cross join fx left join pl on pl.case_name = cases.case_name and pl.k = fx.k left join nm on nm.case_name = pl.case_name and nm.chosen = pl.chosen)"""


def _sweep() -> str:
    """Post-filter and propagation metrics of every case, all read from hl."""
    out = []
    for name, *_ in SWEEP:
        out.append(f"""select * from (with asg0 as materialized (select fmat.*, cluster_id, noise, cluster_strength as strength from fmat join hl using (k) where case_name = '{name}'),
{POST_FILTER}, {OM}, {PU}, v as ({_val('v2')}) select '{name}' as case_name, (select count(distinct raw_cluster_id) filter (where raw_cluster_id <> -1) from asg) as raw_cluster_count, * exclude (version) from v)""")
    return f"with recursive {_hierarchy('v1', 5, 3, SWEEP)} " + " union all ".join(out)


ORACLES = {
    "clustered_windows_v1": _clustered("v1"),
    "clustered_windows_v2": _clustered("v2"),
    "clustered_validation": f"with recursive {_clusters('v1')}, {OM}, {PU} {_val('v2')}",
    "training_matrix": f"with {FEATURES} select window_id, {', '.join(r4(f'case when k % 3 <> 0 then {e} else 0.0 end', c) for c, e in COL.items())} from features",
    "min_max_matrix": f"with {ELIG}, m as (select window_id, {', '.join(f'{e} as {c}' for c, e in COL.items())} from features) select window_id, "
    + ", ".join(r4(f"case when max({c}) over () = min({c}) over () then 0 else round(({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()), 6) end", c) for c in C.FEATURES_V1)
    + " from m",
    "density_clusters": f"with recursive {CL} select id, cluster_id, noise, {r4('round(strength, 6)', 'cluster_strength')} from cl",
    "cluster_purity": f"with recursive {CL}, pu as (select max(n) as t, sum(n) as s from (select cluster_id, tag, count(*) as n from cl where cluster_id <> -1 group by all) group by cluster_id) select {r4('round(sum(t)::double / sum(s), 6)', 'cluster_purity')} from pu",
    "cluster_summary": f"with {FEATURES}, {ASG} select count(*) as window_count, count(distinct cluster_id) filter (where cluster_id <> -1) as cluster_count, count(*) filter (where cluster_id = -1) as noise_window_count, count(*) filter (where cluster_id <> -1) as clustered_window_count from asg",
    "post_filter": f"with {FEATURES}, {ASG} {_pf('fixed', 0.37, 'percentile_25')} union all {_pf('fallback', 0.9, 'mean')} union all {_pf('median', 0.39, 'median')}",
    "propagation_signatures": f"with {_sigs(f'{FEATURES}, {ASG}', 'k % 2 = 0')} {SIGNATURES}",
    "eligibility_report": f"with {_el(f'{FEATURES}, {ASG}', 'k % 2 = 0')} {ELIGIBILITY}",
    "clustered_signatures": f"with recursive {_sigs(_clusters('v1'), 'true')} {SIGNATURES}",
    "clustered_eligibility": f"with recursive {_el(_clusters('v1'), 'true')} {ELIGIBILITY}",
    "clustered_summary": f"with recursive {_clusters('v1')} {SUMMARY}",
    "hierarchical_windows": f"with recursive {_hierarchy('v2', 5, 3, HIERARCHY)} select case_name, k as window_index, cluster_id, noise, {r4('cluster_strength', 'cluster_strength')} from hl",
    "selection_sweep": _sweep(),
    "order_match": f"with {FEATURES}, {ASG}, {OM} select window_id, v1m as v1_matches, v2m as v2_matches from om",
    "validate_propagation": f"with {FEATURES}, {ASG}, {OM}, {PU} {_val('v2')} union all {_val('v1')}",
    "partition_summary": f"""with {WINDOWS} select case when k < 80 then 'training' else 'validation' end as part, scenario_tag, count(*) as profile_count, min(k) as first_seed, max(k) as last_seed from windows group by 1, 2""",
}
