"""Registered queries over long telemetry: contracts, windows, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import constants as C
from faultline import fixtures as X
from faultline.functions.scalars import micros
from faultline.operators import contracts as K
from faultline.operators import features as FT
from faultline.operators import windows as W

POLICY = X.TEST_POLICY


def r4(col: str | Column, name: str | None = None) -> Column:
    c = F.col(f"`{col}`") if isinstance(col, str) else col
    return (F.floor(c * 10000.0 + 0.5) / 10000.0).alias(name or col)


def joined(col: str, sep: str = ",") -> Column:
    return F.array_join(col, sep).alias(col)


def windows_of(spark: SparkSession, d: str) -> DataFrame:
    return W.build_windows(X.long_events(spark, d), POLICY)


def features_of(spark: SparkSession, d: str) -> DataFrame:
    ev = X.long_events(spark, d)
    span = W.time_span(ev)
    return FT.build_features(ev, W.build_windows(ev, POLICY, span=span), POLICY, span=span)


def contract_long_events(spark, d):
    return K.long_event_errors(X.raw_long_events(spark, d)).select("row_id", joined("errors", "; "))


def contract_wide_events(spark, d):
    # Push part of the rows over their bounds so that both outcomes are seen.
    df = (
        X.wide_events(spark, d)
        .withColumn("cpu_pct", F.col("cpu_pct") * 1.05)
        .withColumn("scenario_tag", F.when(F.col("status_code") == 429, F.lit("odd")).otherwise(F.col("scenario_tag")))
        .withColumn("service_name", F.when(F.col("status_code") == 503, F.lit("batch-api")).otherwise(F.col("service_name")))
    )
    return K.wide_event_errors(df).select("event_id", joined("errors", "; "))


def structural_audit(spark, d):
    return K.structural_audit(X.wide_events(spark, d))


def scenario_summary(spark, d):
    day = X.table(spark, d, "events").select(F.col("event_id").alias("_e"), (F.dayofmonth("ts") % 9).alias("_d"))
    raw = K.long_event_errors(X.raw_long_events(spark, d)).join(day, F.col("row_id") == F.col("_e"))
    raw = raw.withColumn("scenario_tag", F.concat(F.lit("S"), F.col("_d").cast("string")))
    raw = raw.withColumn("metric_value", F.col("metric_value").try_cast("double"))
    out = K.scenario_summary(raw)
    means = [c for c in out.columns if c.startswith("mean_")]
    rest = [c for c in out.columns if c not in means and c != "services_covered"]
    return out.select(*rest, joined("services_covered"), *[r4(c) for c in means])


def window_late_classes(spark, d):
    return W.late_classes(X.long_events(spark, d), POLICY).select("window_index", "event_id", "late_class")


def window_metric_series(spark, d):
    return W.metric_series(X.long_events(spark, d), POLICY).select(
        "window_id", "service_name", "metric_name", micros(F.col("ts")).alias("ts_us"), "sequence_number",
        r4("metric_value"), "within_late_tolerance",
    )


def window_quality(spark, d):
    return windows_of(spark, d).select(
        "window_id",
        micros(F.col("window_start")).alias("window_start_us"),
        joined("services_included"),
        *[r4(c, c.replace("-", "_")) for c in W.PAIR_COLUMNS],
        r4("window_data_quality_score"),
        "scenario_tag", "chaos_suitability", "strict_event_count", "late_events_within_tolerance",
        "late_discarded_count", "covered_pairs", r4("missing_ratio"), r4("min_event_ratio"), r4("late_event_ratio"),
        r4("late_discard_ratio"), "degraded_quality", "ordering_broken", joined("ordering_violation_services"),
        "accepted_for_training",
    )


def window_eligibility(spark, d):
    return W.quality_split(windows_of(spark, d)).select("window_id", r4("window_data_quality_score"), "eligible")


def service_window_view(spark, d):
    v = W.service_window_view(X.long_events(spark, d))
    return v.select(
        "window_id", "service_name", micros(F.col("window_start")).alias("start_us"), micros(F.col("window_end")).alias("end_us"),
        *[r4(c) for c in (*C.API_METRICS, *C.CACHE_METRICS, "iforest_score")], "scenario_tag", r4("window_data_quality_score"),
    )


_SCORES = (
    [f"iforest_score_{n}" for n in ("payments", "orders", "checkout")]
    + ["iforest_score_max", "iforest_score_mean", "iforest_score_spread", "window_anomaly_density", "cache_health_score"]
    + [f"flow_efficiency_{n}" for n in ("payments", "orders", "checkout")]
)


def window_scores(spark, d):
    return FT.level_features(windows_of(spark, d)).select("window_id", *[r4(c) for c in _SCORES])


def activation_order(spark, d):
    f = FT.activation_order(windows_of(spark, d))
    return f.select(
        "window_id",
        *[f"activation_{v}_{n}" for v in ("v1", "v2") for n in C.TOPOLOGY_NODES],
        r4("lag_payments_to_redis"), r4("lag_redis_to_checkout"),
        "service_degradation_order_encoded", "detected_origin_service",
        F.array_join(FT.decode_order(F.col("service_degradation_order_encoded")), ">").alias("decoded_order"),
    )


def topology_features(spark, d):
    f = FT.topology_features(FT.activation_order(FT.level_features(windows_of(spark, d))))
    cols = [f"{s}_{n}" for s in ("topological_distance", "service_criticality", "upstream_health") for n in C.TOPOLOGY_NODES]
    return f.select("window_id", "detected_origin_service", *[r4(c) for c in cols])


def trailing_features(spark, d):
    t = FT.trailing_features(X.long_events(spark, d), POLICY)
    return t.select("window_index", *[r4(c) for c in t.columns if c != "window_index"])


def temporal_memory(spark, d):
    f = FT.temporal_memory(FT.level_features(windows_of(spark, d)))
    return f.select("window_id", "scenario_tag", r4("delta_latency_orders"), r4("delta_latency_checkout"), "recovery_memory")


def feature_contract_v2(spark, d):
    return FT.contract_columns(features_of(spark, d)).select("window_id", *[r4(c) for c in C.FEATURES_V2])


def feature_contract_v1(spark, d):
    f = FT.temporal_memory(FT.activation_order(FT.level_features(windows_of(spark, d))))
    return FT.contract_columns(f, "v1").select("window_id", *[r4(c) for c in C.FEATURES_V1])


def feature_sanity_v1(spark, d):
    f = FT.activation_order(FT.level_features(windows_of(spark, d)))
    f = f.withColumn("window_anomaly_density", F.col("window_anomaly_density") * 2)
    f = f.withColumn("lag_payments_to_redis", F.col("lag_payments_to_redis") - 500)
    return K.feature_errors_v1(f).select("window_id", joined("errors", "; "))


def feature_sanity_v2(spark, d):
    f = FT.topology_features(FT.activation_order(FT.level_features(windows_of(spark, d))))
    f = f.withColumn("window_anomaly_density", F.col("window_anomaly_density") * 2)
    f = f.withColumn("topological_distance_orders", F.col("topological_distance_orders") - 1)
    return K.feature_errors_v2(f).select("window_id", joined("errors", "; "))


def fallback_features(spark, d):
    w = windows_of(spark, d)
    computed = FT.activation_order(FT.level_features(w)).where(F.col("window_index") % 2 == 0)
    return FT.resolve_features(w, computed).select(
        "window_id", "has_feature_row", "service_degradation_order_encoded",
        r4("window_anomaly_density"), r4("iforest_score_payments"), r4("lag_payments_to_redis"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        contract_long_events, contract_wide_events, structural_audit, scenario_summary,
        window_late_classes, window_metric_series, window_quality, window_eligibility, service_window_view,
        window_scores, activation_order, topology_features, trailing_features, temporal_memory,
        feature_contract_v2, feature_contract_v1, feature_sanity_v1, feature_sanity_v2, fallback_features,
    )
}
