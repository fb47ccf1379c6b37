"""Correlation of detector signals: per-scope snapshots and enriched anomaly events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.ordinals import GROUP, SLICE_ROWS, dealt, sliced

SNAP = {s: f"snap_{C.SHORT_NAME[s]}" for s in C.API_SERVICES}
# What the snapshot keeps of a signal.
SNAP_FIELDS = (
    "service_name", "anomaly_score", "anomaly_flag", "candidate_flag", "iforest_label", "scored_at", "generated_at",
    "queue_length", "event_id",
)
SNAP_STRUCT = f"struct({', '.join(SNAP_FIELDS)})"
# Arrival order, with ``_tie`` from the shuffle; rows of one id and instant stand by their values, wherever they are compared.
ARRIVAL = ", ".join(("unix_micros(generated_at)", "_tie", "event_id", *[c for c in SNAP_FIELDS if c not in ("generated_at", "event_id")]))


def latest(signals: DataFrame, before: DataFrame | None = None, *, scope: str = "source_node") -> DataFrame:
    """(scope, one snapshot per API service): the state after these signals, and after those of ``before`` where a service sent none."""
    api = signals.where(F.col("service_name").isin(*C.API_SERVICES))
    order = "struct(unix_micros(generated_at), md5(event_id), event_id)"
    out = api.groupBy(scope).agg(
        *[F.expr(f"max_by({SNAP_STRUCT}, {order}) filter (where service_name = '{s}')").alias(SNAP[s]) for s in C.API_SERVICES]
    )
    if before is None:
        return out
    every = out.withColumn("_old", F.lit(False)).unionByName(before.withColumn("_old", F.lit(True)))
    return every.groupBy(scope).agg(*[F.expr(f"min_by({c}, _old) filter (where {c} is not null)").alias(c) for c in SNAP.values()])


def snapshots(signals: DataFrame, *, scope: str = "source_node", block: int = SLICE_ROWS, before: DataFrame | None = None, along: Sequence[str] = ()) -> DataFrame:
    """Latest signal per API service as of each signal, within its scope; ``before`` is the state of :func:`latest` that it starts from.

    A scope is one independent system.  Rows are dealt out once, by scope and a
    slice of the time line of about ``block`` rows; the last signal per service of
    every slice is carried forward over a table of a row per slice, so a scope of
    any size stays spread out.  Columns of ``along`` are wanted later: compared
    last, they let both uses of the rows read one shuffle.
    """
    api = signals.where(F.col("service_name").isin(*C.API_SERVICES))
    # Dealt out by slice once, for the slice's last signals, the join and the window.
    rows = dealt(sliced(api, [scope], F.unix_micros("generated_at"), F.col("event_id"), slice_rows=block), F.col("event_id"))
    mine = {s: f"case when service_name = '{s}' then {SNAP_STRUCT} end" for s in C.API_SERVICES}
    arrival = ", ".join((ARRIVAL, *along))
    order = f"struct({arrival})"
    ends = rows.groupBy(*GROUP).agg(
        *[F.expr(f"max_by({SNAP_STRUCT}, {order}) filter (where service_name = '{s}')").alias(f"_end_{SNAP[s]}") for s in C.API_SERVICES]
    )
    earlier = "over (partition by _key order by _slice, _sub rows between unbounded preceding and 1 preceding)"
    carry = ends.select(*GROUP, *[F.expr(f"last(_end_{c}, true) {earlier}").alias(f"_carry_{c}") for c in SNAP.values()])
    inside = f"over (partition by {', '.join(GROUP)} order by {arrival} rows between unbounded preceding and current row)"
    seen = rows.withColumns({f"_seen_{SNAP[s]}": F.expr(f"last({mine[s]}, true) {inside}") for s in C.API_SERVICES})
    snaps = {c: F.expr(f"coalesce(_seen_{c}, _carry_{c})") for c in SNAP.values()}
    out = seen.join(carry, list(GROUP), "left").withColumns(snaps).select(*signals.columns, *SNAP.values())
    if before is None:
        return out
    start = before.select(F.col(scope).alias("_s"), *[F.col(c).alias(f"_start_{c}") for c in SNAP.values()])
    out = out.join(start, F.expr(f"{scope} <=> _s"), "left")
    return out.select(*signals.columns, *[F.expr(f"coalesce({c}, _start_{c}) as {c}") for c in SNAP.values()])


def enrich(
    snaps: DataFrame, profiles: DataFrame, *, post_filter: float = 0.3, model: str = "density_policy_v1", keep: Sequence[str] = ()
) -> DataFrame:
    """Enriched anomaly events from snapshots; signals without an anomalous service drop out, columns of ``keep`` pass through.

    ``profiles`` is the scenario profile table (scenario_tag, cluster_id,
    cluster_strength), one row per scenario.
    """
    every = f"filter(array({', '.join(SNAP.values())}), x -> x is not null)"
    base = snaps.withColumn("_all", F.expr(every)).withColumns(
        {
            "_bad": F.expr(
                "transform(filter(_all, x -> x.anomaly_flag or x.candidate_flag or x.iforest_label = 'anomalous'), x -> x.service_name)"
            ),
            "_scores": F.expr("array_sort(transform(_all, x -> round(x.anomaly_score, 6)))"),
            "_times": F.expr("filter(transform(_all, x -> coalesce(x.scored_at, x.generated_at)), t -> t is not null)"),
            "_queue": F.expr("array_max(transform(_all, x -> coalesce(x.queue_length, 0D)))"),
            # Ties go to the first service name.
            "primary_service": F.expr(
                "array_sort(transform(_all, x -> struct(-round(x.anomaly_score, 6) as s, x.service_name as n)))[0].n"
            ),
        }
    ).where("size(_bad) > 0")
    # Scenario names by which services degrade.
    scenario = (
        "case when array_contains(_bad, 'payments-api') and array_contains(_bad, 'checkout-api') and array_contains(_bad, 'orders-api') then 'S4_INTERSERVICE_CHAIN' "
        "when array_contains(_bad, 'payments-api') and array_contains(_bad, 'checkout-api') then 'S3_REDIS_TO_MULTISERVICE_PROPAGATION' "
        "when array_contains(_bad, 'payments-api') and _queue >= 30 then 'S2_SERVICE_TO_REDIS_PROPAGATION' "
        "when size(_bad) = 1 then 'S1_LOCAL_ANOMALY_ONLY' else 'S6_NOISE_FALSE_POSITIVE' end"
    )
    pos = "0.25D * (size(_scores) - 1)"
    p25 = (
        f"_scores[cast(floor({pos}) as int)] + (_scores[cast(least(floor({pos}) + 1, size(_scores) - 1) as int)] "
        f"- _scores[cast(floor({pos}) as int)]) * ({pos} - floor({pos}))"
    )
    base = base.withColumns({"inferred_scenario": F.expr(scenario), "post_filter_score": F.expr(p25)})
    prof = profiles.selectExpr("scenario_tag as _tag", "cluster_id as _cluster", "cluster_strength as _strength")
    j = base.join(prof, F.expr("inferred_scenario = _tag"), "left")
    j = j.withColumn(
        "propagation_detected",
        F.expr(
            f"post_filter_score >= {post_filter}D and _tag is not null and "
            "inferred_scenario not in ('S1_LOCAL_ANOMALY_ONLY', 'S6_NOISE_FALSE_POSITIVE')"
        ),
    )
    span = "(unix_micros(array_max(_times)) - unix_micros(array_min(_times))) / 1e6D"
    fresh = f"case when size(_times) < 2 then 0.7D when {span} <= 45 then 1.0D when {span} <= 90 then 0.75D else 0.5D end"
    top = "_scores[size(_scores) - 1]"

    def at(service: str) -> str:
        by_name = f"filter(_all, x -> x.service_name = {service})[0]"
        return f"unix_micros(coalesce({by_name}.scored_at, {by_name}.generated_at))"

    def gap(a: str, b: str, default: int) -> str:
        whole = f"cast(floor(abs({at(b)} - {at(a)}) / 1e6D) as int)"
        return f"coalesce(nullif({whole}, 0), {default})"

    lag = (
        "case inferred_scenario "
        "when 'S2_SERVICE_TO_REDIS_PROPAGATION' then map(concat(primary_service, '_to_redis'), greatest(10, least(90, cast(floor(_queue) as int)))) "
        "when 'S3_REDIS_TO_MULTISERVICE_PROPAGATION' then map(concat(primary_service, '_to_redis'), 20, "
        f"'redis_to_checkout-api', {gap('primary_service', repr('checkout-api'), 30)}) "
        "when 'S4_INTERSERVICE_CHAIN' then map(concat(primary_service, '_to_redis'), 20, "
        f"'redis_to_checkout-api', {gap('primary_service', repr('checkout-api'), 25)}, "
        f"'checkout-api_to_orders-api', {gap(repr('checkout-api'), repr('orders-api'), 20)}) "
        "else cast(map() as map<string,int>) end"
    )
    cols = {
        "cluster_id": "case when propagation_detected then _cluster end",
        # Rounded as a decimal: the halves of six-digit scores end in ties.
        "confidence": "cast(round(cast(least(greatest((coalesce(_strength, 0.35D) + least(1D, post_filter_score)) / 2, 0D), 1D) as decimal(20, 9)), 6) as double)",
        "window_data_quality_score": f"round(least(greatest(size(_all) / 3D * 0.65D + ({fresh}) * 0.35D, 0D), 1D), 6)",
        "severity_preliminary": (
            f"case when propagation_detected and {top} >= 0.85 and size(_bad) >= 2 then 'critical' "
            f"when propagation_detected or {top} >= 0.7 then 'high' when {top} >= 0.45 then 'medium' else 'low' end"
        ),
        "lag_pattern_seconds": lag,
        "services_observed": "concat(transform(_all, x -> x.service_name), array('redis'))",
        "iforest_scores": "map_from_entries(transform(_all, x -> struct(x.service_name, round(x.anomaly_score, 6))))",
        "iforest_labels": "map_from_entries(transform(_all, x -> struct(x.service_name, case when array_contains(_bad, x.service_name) then 'anomalous' else 'normal' end)))",
        "timestamp": "array_max(_times)",
        "raw_event_refs": "concat(array(concat('stream://signals/', event_id)), transform(_all, x -> concat('event://telemetry/', x.event_id)))",
    }
    out = j.withColumns({k: F.expr(v) for k, v in cols.items()})
    return out.selectExpr(
        f"'{C.ENRICHED_EVENT_VERSION}' as schema_version",
        "event_id",
        "timestamp",
        "'correlation_bridge' as source",
        "services_observed",
        "primary_service",
        "iforest_scores",
        "iforest_labels",
        f"struct(true as enabled, '{model}' as model, "
        "case when cluster_id is not null then concat('prop_sig_cluster_', cluster_id, '_', event_id) end as propagation_signature_id, "
        "propagation_detected, lag_pattern_seconds, confidence) as correlation_engine",
        "window_data_quality_score",
        "severity_preliminary",
        f"array('policy://detector/service_thresholds', 'policy://correlation/{model}', concat('scenario://', inferred_scenario)) as evidence_refs",
        "raw_event_refs",
        "inferred_scenario",
        "post_filter_score",
        "cluster_id",
        *keep,
    )
