"""Cluster post-filter, propagation signatures, eligibility and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.quantiles import long_quantiles
from faultline.session import cut


def catalog_table(spark: SparkSession) -> DataFrame:
    """The scenario catalog: nine fixed rows."""
    rows = ", ".join(
        "('{}', {}, array({}))".format(t, str(e).lower(), ", ".join(f"'{s}'" for s in chain) or "cast(null as string)")
        for t, e, _, chain in C.SCENARIO_CATALOG
    )
    return spark.sql(
        f"select tag as scenario_tag, expected as expected_propagation, filter(chain, x -> x is not null) as propagation_chain "
        f"from values {rows} as t(tag, expected, chain)"
    )


def cluster_summary(assignments: DataFrame) -> DataFrame:
    """One row: windows, clusters, noise and clustered windows."""
    per = assignments.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.sum("n").alias("window_count"), F.expr("count_if(cluster_id <> -1)").alias("cluster_count"),
        F.expr("coalesce(sum(case when cluster_id = -1 then n end), 0)").alias("noise_window_count"),
        F.expr("coalesce(sum(case when cluster_id <> -1 then n end), 0)").alias("clustered_window_count"),
    )


_AGGREGATION = {"mean": None, "median": 0.5, "percentile_25": 0.25}


def cluster_confidence(scored: DataFrame, aggregation: str) -> DataFrame:
    """(cluster_id, mean, confidence) from ``iforest_score_mean`` of the cluster's windows."""
    if aggregation not in _AGGREGATION:
        raise ValueError(f"unsupported aggregation: {aggregation}")
    members = scored.where("cluster_id <> -1").selectExpr("cluster_id", "coalesce(iforest_score_mean, 0D) as value")
    means = members.groupBy("cluster_id").agg(F.avg("value").alias("m"))
    if aggregation == "mean":
        return means.selectExpr("cluster_id", "round(m, 6) as mean_score", "round(m, 6) as confidence")
    q = long_quantiles(members, ["cluster_id"], {"q": _AGGREGATION[aggregation]}, few=False).withColumnRenamed("cluster_id", "_c")
    return means.join(q, F.expr("cluster_id = _c")).selectExpr("cluster_id", "round(m, 6) as mean_score", "round(q, 6) as confidence")


def post_filter(
    assignments: DataFrame, features: DataFrame, *, threshold: float = 0.30, fallback_quantile: float = 0.70,
    aggregation: str = "percentile_25",
) -> DataFrame:
    """Keep clusters whose score reaches the threshold; turn the others into noise.

    When even the best cluster falls short, the threshold drops to a quantile
    of the cluster scores.  Rows that were noise already pass unchanged.
    """
    f = features.selectExpr("window_id as _w", "iforest_score_mean")
    scored = assignments.drop("iforest_score_mean").join(f, F.expr("window_id = _w"), "left").drop("_w")
    # One row per cluster, used three times below.
    conf = cut(cluster_confidence(scored, aggregation))
    # One row per cluster; linear quantile over them only when the best falls short.
    low = long_quantiles(conf.selectExpr("confidence as value"), [], {"q": fallback_quantile})
    limit = conf.agg(F.max("confidence").alias("best")).withColumn("q", low.select("q").scalar()).selectExpr(
        f"case when best < {threshold}D then struct(round(q, 6) as t, 'adaptive_quantile_fallback' as p) "
        f"else struct({threshold}D as t, 'fixed_threshold' as p) end as s"
    ).scalar()
    c = conf.selectExpr("cluster_id as _c", "mean_score", "confidence")
    j = assignments.join(c, F.expr("cluster_id = _c"), "left").withColumn("_t", F.coalesce(limit, F.struct(F.lit(float(threshold)).alias("t"), F.lit("fixed_threshold").alias("p"))))
    rest = [x for x in assignments.columns if x not in ("cluster_id", "noise", "cluster_strength")]
    passed = "(cluster_id = -1 or confidence >= _t.t)"
    return j.selectExpr(
        *rest, "cluster_id as raw_cluster_id", f"case when {passed} then cluster_id else -1 end as cluster_id",
        f"case when {passed} then noise else true end as noise", f"case when {passed} then cluster_strength else 0D end as cluster_strength",
        "coalesce(mean_score, 0D) as cluster_iforest_score_mean", "coalesce(confidence, 0D) as cluster_iforest_confidence",
        "_t.t as post_filter_threshold", "_t.p as post_filter_policy", f"{passed} as post_filter_passed",
    )


# Metrics that show a service took part, thresholds of an affected
# metric, metrics with observed ranges, windows needed for a precise lag.
SELECTION = {
    "payments-api": ("latency_p95_payments", "iforest_score_payments"),
    "orders-api": ("error_rate_orders", "latency_p95_orders"),
    "checkout-api": ("error_rate_checkout", "latency_p95_checkout"),
    "redis": ("redis_queue_depth", "redis_latency"),
}
AFFECTED_AT = {
    "iforest_score_payments": 0.45,
    "error_rate_orders": 0.02,
    "error_rate_checkout": 0.02,
    "redis_queue_depth": 40.0,
    "redis_latency": 10.0,
    "latency_p95_payments": 220.0,
    "latency_p95_orders": 220.0,
    "latency_p95_checkout": 220.0,
}
RANGE_KEYS = (
    "latency_p95_payments",
    "latency_p95_orders",
    "latency_p95_checkout",
    "error_rate_orders",
    "error_rate_checkout",
    "redis_queue_depth",
    "redis_latency",
    "iforest_score_payments",
)
PRECISE_WINDOWS = 30
LAGS = {"payments-api_to_redis": "lag_payments_to_redis", "redis_to_checkout-api": "lag_redis_to_checkout"}


def cluster_evidence(assignments: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row per cluster (noise included): size, lag p10/p50/p90, metric ranges.

    Grouped once per cluster, not once per window.
    """
    cols = [*LAGS.values(), *RANGE_KEYS]
    f = resolved.select(F.col("window_id").alias("_w"), *cols)
    j = assignments.select("window_id", "cluster_id").join(f, F.expr("window_id = _w"), "left")
    ranges = j.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("sample_window_count"),
        *[F.expr(f"round({fn}({k}), 6)").alias(f"{k}_{fn}") for k in RANGE_KEYS for fn in ("min", "max")],
    )
    stack = ", ".join(f"'{v}', cast({v} as double)" for v in LAGS.values())
    lags = j.selectExpr("cluster_id", f"stack({len(LAGS)}, {stack}) as (lag, value)")
    q = long_quantiles(lags, ["cluster_id", "lag"], {"p10": 0.1, "p50": 0.5, "p90": 0.9}, few=False)
    wide = q.groupBy(F.col("cluster_id").alias("_c")).agg(
        *[F.expr(f"round(max(case when lag = '{v}' then {p} end), 6)").alias(f"{v}_{p}") for v in LAGS.values() for p in ("p10", "p50", "p90")]
    )
    out = ranges.join(wide, F.expr("cluster_id = _c"), "left").drop("_c")
    return out.withColumn("precision", F.expr(f"case when sample_window_count >= {PRECISE_WINDOWS} then 'precise' else 'imprecise' end"))


def signatures(assignments: DataFrame, windows: DataFrame, resolved: DataFrame) -> DataFrame:
    """One propagation signature per assigned window.

    Cluster members stay in the assignment table; each signature points to its
    cluster instead of carrying the member list.
    """
    from faultline.operators.features import decode_order

    ev = cluster_evidence(assignments, resolved).withColumnRenamed("cluster_id", "_c")
    f = resolved.select(F.col("window_id").alias("_w"), "service_degradation_order_encoded", *RANGE_KEYS)
    w = windows.select(F.col("window_id").alias("_v"), "window_start", "window_end")
    j = (
        assignments.join(f, F.expr("window_id = _w"), "left").join(w, F.expr("window_id = _v"), "left")
        .join(ev, F.expr("cluster_id = _c"), "left")
    )
    active = "map({})".format(
        ", ".join(f"'{s}', {' or '.join(f'coalesce({m}, 0D) <> 0' for m in ms)}" for s, ms in SELECTION.items())
    )
    public = lambda m: m.replace("_payments", "").replace("_orders", "").replace("_checkout", "")
    hit = lambda s: "filter(array({}), x -> x is not null)".format(
        ", ".join(f"case when {m} >= {AFFECTED_AT[m]}D then '{public(m)}' end" for m in SELECTION[s])
    )
    affected = "map_filter(map({}), (k, v) -> size(v) > 0)".format(", ".join(f"'{s}', {hit(s)}" for s in SELECTION))
    j = j.withColumn("_order", decode_order(F.col("service_degradation_order_encoded"))).withColumn("_active", F.expr(active))
    chain = "filter(_order, s -> _active[s])"
    # Fixed value: service order used when no order code exists.
    default = "array('payments-api', 'redis', 'checkout-api', 'orders-api')"
    lag_ci = ", ".join(f"'{k}', struct({v}_p10 as p10, {v}_p50 as p50, {v}_p90 as p90)" for k, v in LAGS.items())
    ranges = ", ".join(f"'{k}', struct({k}_min as min, {k}_max as max)" for k in RANGE_KEYS)
    return j.selectExpr(
        "concat('prop_sig_', window_id) as signature_id", "cluster_id", "window_id", "cluster_id <> -1 as detected", "noise",
        f"case when size({chain}) > 0 then {chain} when size(_order) > 0 then _order else {default} end as services_chain_observed",
        f"map({lag_ci}) as lag_pattern_seconds_ci", "struct(sample_window_count, precision) as lag_ci_metadata",
        f"{affected} as affected_metrics", f"map_filter(map({ranges}), (k, v) -> v.min is not null) as metric_ranges_observed",
        "round(window_data_quality_score, 6) as window_data_quality_score", "round(cluster_strength, 6) as propagation_order_confidence",
        "struct(window_start as start, window_end as end) as observation_period", "scenario_tag",
    )


def eligibility(sigs: DataFrame) -> DataFrame:
    """Eligibility and risk scores, status, warnings and preconditions per signature."""
    n, q, c = "size(services_chain_observed)", "window_data_quality_score", "propagation_order_confidence"
    wide = "abs(v.p90 - v.p10) > 30"
    score = f"round(least(case when detected and not noise then 0.35D else 0D end + least({n} / 6D, 0.20D) + {q} * 0.25D + {c} * 0.20D, 1D), 6)"
    risk = (
        f"round(least(0.10D + case when {n} >= 4 then 0.25D when {n} >= 3 then 0.15D else 0D end + greatest(0D, 0.20D - {c} * 0.20D) "
        f"+ greatest(0D, 0.20D - {q} * 0.20D) + case when exists(map_values(lag_pattern_seconds_ci), v -> coalesce({wide}, false)) then 0.10D else 0D end, 1D), 6)"
    )
    out = sigs.withColumns({"eligibility_score": F.expr(score), "risk_score": F.expr(risk)}).withColumn(
        "recommended_status", F.expr("case when eligibility_score < 0.40 then 'not_suitable' when risk_score > 0.55 then 'requires_review' else 'draft' end")
    )
    # Warning and precondition texts.
    warnings = (
        "concat(filter(array(case when noise then 'signature flagged as noise in the defensive lane' end, "
        f"case when {q} < 0.85 then 'window quality is below preferred replay threshold' end, "
        "case when risk_score > 0.55 then 'risk score is elevated and requires human review' end), x -> x is not null), "
        f"transform(filter(map_entries(lag_pattern_seconds_ci), e -> coalesce(abs(e.value.p90 - e.value.p10) > 30, false)), "
        "e -> concat(e.key, ' shows moderate or high variance')))"
    )
    pre = (
        "filter(array('requires isolated lab environment', 'requires Redis test instance', 'requires non-production service endpoints', "
        "case when array_contains(services_chain_observed, 'redis') then 'requires Redis dependency isolation before replay' end, "
        f"case when {n} >= 4 then 'requires bounded multi-service blast-radius controls' end), x -> x is not null)"
    )
    return out.selectExpr(
        "signature_id as source_signature_id", "eligibility_score >= 0.55 and recommended_status <> 'not_suitable' as eligible",
        "eligibility_score", "risk_score", "recommended_status", f"{pre} as preconditions", f"{warnings} as warnings",
    )


def with_order_match(df: DataFrame, *, version: str = "v2") -> DataFrame:
    """Does a window's observed order agree with ``propagation_chain``?

    v2: the origin is the chain's first service and distances never fall along
    the chain.  v1: positions in the order code strictly rise.
    """
    if version == "v1":
        digits = (
            "map('payments-api', service_degradation_order_encoded div 1000, 'redis', (service_degradation_order_encoded % 1000) div 100, "
            "'checkout-api', (service_degradation_order_encoded % 100) div 10, 'orders-api', service_degradation_order_encoded % 10)"
        )
        steps = f"transform(propagation_chain, s -> cast(try_element_at({digits}, s) as double))"
        rising, start = "<", "true"
    else:
        nodes = ", ".join(f"'{n}', topological_distance_{n}" for n in C.TOPOLOGY_NODES)
        steps = f"transform(propagation_chain, s -> try_element_at(map({nodes}), replace(s, '-api', '')))"
        rising = "<="
        start = "coalesce(detected_origin_service = replace(propagation_chain[0], '-api', ''), false) and coalesce(_steps[0] = 0, false)"
    ok = (
        f"{start} and forall(_steps, x -> x is not null) and "
        f"forall(sequence(1, greatest(size(_steps) - 1, 1)), i -> size(_steps) < 2 or coalesce(get(_steps, i - 1) {rising} get(_steps, i), false))"
    )
    out = df.withColumn("_steps", F.expr(steps))
    return out.withColumn("order_matches", F.expr(f"case when size(propagation_chain) > 0 then {ok} end")).drop("_steps")


def cluster_purity(assignments: DataFrame) -> DataFrame:
    """One row: share of windows carrying their cluster's dominant tag (noise and null tags aside)."""
    counts = assignments.where("cluster_id <> -1 and scenario_tag is not null").groupBy("cluster_id", "scenario_tag").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("cluster_id").agg(F.max("n").alias("top"), F.sum("n").alias("size"))
    return per.agg(F.expr("coalesce(round(sum(top) / sum(size), 6), 0D)").alias("cluster_purity"))


def validate(assignments: DataFrame, features: DataFrame, windows: DataFrame, *, version: str = "v2") -> DataFrame:
    """One row of propagation metrics over the assigned windows.

    ``specificity`` is 1 minus the false propagation rate; ``precision`` is the
    share of detections that are true.  ``temporal_coverage`` is the share of
    positive windows with both lead metrics present.
    """
    spark = assignments.sparkSession
    need = ["detected_origin_service", *[f"topological_distance_{n}" for n in C.TOPOLOGY_NODES]] if version == "v2" else ["service_degradation_order_encoded"]
    f = features.select(F.col("window_id").alias("_w"), *need)
    lead = ("payments-api__latency_p95", "redis__redis_latency")
    w = windows.select(F.col("window_id").alias("_v"), F.expr(" and ".join(f"coalesce(`{c}` >= 0, false)" for c in lead)).alias("_lead"))
    cat = catalog_table(spark).withColumnRenamed("scenario_tag", "_tag")
    j = (
        assignments.join(f, F.expr("window_id = _w"), "left").join(w, F.expr("window_id = _v"), "left")
        .join(F.broadcast(cat), F.expr("scenario_tag = _tag"), "left")
    )
    j = with_order_match(j.withColumn("_pos", F.expr("coalesce(expected_propagation, false)")), version=version)
    rate = lambda a, b: f"case when count_if({b}) > 0 then round(count_if(({b}) and ({a})) / count_if({b}), 6) else 0D end"
    m = j.agg(
        F.count(F.lit(1)).alias("window_count"), F.expr("count_if(_pos)").alias("positive_windows"), F.expr("count_if(not _pos)").alias("negative_windows"),
        F.expr(rate("not noise", "_pos")).alias("propagation_detection_rate"), F.expr(rate("not noise", "not _pos")).alias("false_propagation_rate"),
        F.expr(rate("noise", "not _pos")).alias("noise_rejection_rate"), F.expr(rate("_pos", "not noise")).alias("precision"),
        F.expr(rate("order_matches", "_pos and size(propagation_chain) > 0")).alias("propagation_order_accuracy"),
        F.expr(rate("_lead", "_pos")).alias("temporal_coverage"), F.expr("count_if(noise)").alias("noise_window_count"),
        F.expr("count(distinct case when cluster_id <> -1 then cluster_id end)").alias("cluster_count"),
    )
    return m.withColumn("specificity", F.expr("round(1 - false_propagation_rate, 6)")).withColumn(
        "cluster_purity", cluster_purity(assignments).scalar()
    )


def scenario_profiles(assignments: DataFrame, *, kept_cluster_ids: Sequence[int] = ()) -> DataFrame:
    """Per scenario: dominant cluster, its mean strength and window count (ties: lowest cluster)."""
    rows = assignments.where("cluster_id is not null and scenario_tag is not null")
    if kept_cluster_ids:
        rows = rows.where(F.col("cluster_id").isin(*kept_cluster_ids))
    per = rows.groupBy("scenario_tag", "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("cluster_strength", F.lit(0.0))).alias("s"))
    best = per.groupBy("scenario_tag").agg(F.expr("max_by(struct(cluster_id, n, s), struct(n, -cluster_id))").alias("b"))
    return best.selectExpr("scenario_tag", "b.cluster_id as cluster_id", "round(b.s, 6) as cluster_strength", "b.n as sample_count")


def partition_summary(windows: DataFrame, *, partition: str, seed: str) -> DataFrame:
    """Per (partition, scenario): profile count and seed range."""
    return windows.groupBy(partition, "scenario_tag").agg(
        F.count(F.lit(1)).alias("profile_count"), F.min(seed).alias("first_seed"), F.max(seed).alias("last_seed")
    )
