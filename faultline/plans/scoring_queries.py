"""Registered queries over wide telemetry: profiling, evaluation, thresholds, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline import constants as C
from faultline import fixtures as X
from faultline.operators import evaluation as EV
from faultline.operators import features as FT
from faultline.operators import labels as LB
from faultline.operators import profiling as P
from faultline.operators import windows as W
from faultline.plans.telemetry_queries import POLICY, r4, windows_of

LABEL_PROFILES = {
    "simple": {"force_on_intensity": True, "label_bursts": True, "http_5xx": 4.6, "queue": 85.0, "latency": 360.0}
}


def rounded(df, *plain):
    """Round every double column to 4 digits, keep the rest."""
    doubles = {f.name for f in df.schema if f.dataType.simpleString() == "double"} - set(plain)
    return df.select(*[r4(c) if c in doubles else F.col(c) for c in df.columns])


def wide(spark, d):
    return X.wide_events(spark, d)


def analysed(spark, d):
    return EV.analysis_columns(wide(spark, d))


def flagged(spark, d):
    return EV.flag_by_service(analysed(spark, d))


def feature_rows_v1(spark, d):
    w = W.quality_split(windows_of(spark, d)).where("eligible")
    return FT.temporal_memory(FT.activation_order(FT.level_features(w)))


def feature_stats(spark, d):
    return rounded(P.feature_stats(wide(spark, d)))


def top_correlations(spark, d):
    return rounded(P.top_correlations(wide(spark, d)))


def burst_runs(spark, d):
    return rounded(P.burst_runs(wide(spark, d)))


def drift_summary(spark, d):
    return rounded(P.drift_summary(wide(spark, d)))


def export_profile(spark, d):
    return P.export_profile(wide(spark, d))


def variance_ranking(spark, d):
    return rounded(P.variance_ranking(feature_rows_v1(spark, d), C.FEATURES_V1))


def strongest_pairs(spark, d):
    return rounded(P.strongest_pairs(feature_rows_v1(spark, d).fillna(0.0), C.FEATURES_V1))


def signal_contrast(spark, d):
    expected = {t: e for t, e, *_ in C.SCENARIO_CATALOG}
    pairs = ", ".join(f"'{t}', {str(e).lower()}" for t, e in expected.items())
    rows = feature_rows_v1(spark, d).withColumn("expected_propagation", F.expr(f"try_element_at(map({pairs}), scenario_tag)"))
    return rounded(P.signal_contrast(rows, C.FEATURES_V1))


def statistical_profile(spark, d):
    return rounded(P.statistical_profile(feature_rows_v1(spark, d), C.FEATURES_V1))


def score_summary(spark, d):
    w = wide(spark, d)
    a = EV.score_summary(w).withColumn("score", F.lit("anomaly_score"))
    b = EV.score_summary(w, value="raw_score").withColumn("score", F.lit("raw_score"))
    return rounded(a.unionByName(b))


def time_position(spark, d):
    return rounded(EV.time_position(wide(spark, d)).select(
        "event_id", "service_event_index", "service_event_count", "service_progress", "drift_slice", "temporal_bucket"))


def burst_proxy(spark, d):
    return EV.burst_proxy(wide(spark, d)).select("event_id", "burst_proxy_score", "burst_proxy")


def slice_summaries(spark, d):
    return rounded(EV.slice_summaries(flagged(spark, d)))


def flag_metrics(spark, d):
    return rounded(EV.flag_metrics(flagged(spark, d)))


def flag_by_service(spark, d):
    kept = {s: t for s, t in C.SERVICE_THRESHOLDS.items() if s != "orders-api"}
    return rounded(EV.flag_by_service(wide(spark, d), kept).select("event_id", "service_name", "service_threshold", "predicted_flag"))


def calibrate_thresholds(spark, d):
    return rounded(EV.calibrate(wide(spark, d)))


def matched_thresholds(spark, d):
    return rounded(EV.matched_thresholds(wide(spark, d)))


def threshold_grid(spark, d):
    return EV.threshold_grid(wide(spark, d)).select(F.expr("floor(threshold * 1e6D + 0.5D) / 1e6D").alias("threshold"))


def _sweep(spark, d):
    return EV.threshold_sweep(analysed(spark, d), EV.threshold_grid(wide(spark, d)))


def threshold_sweep(spark, d):
    return rounded(_sweep(spark, d))


def recommend_threshold(spark, d):
    # The strict defaults admit no threshold on this surrogate; relax the span to see a pick.
    s = _sweep(spark, d)
    strict = EV.recommend_threshold(s).withColumn("criteria", F.lit("strict"))
    loose = EV.recommend_threshold(s, max_fpr=0.5, max_span=0.5, min_tpr=0.1).withColumn("criteria", F.lit("loose"))
    return rounded(strict.unionByName(loose))


def operating_profiles(spark, d):
    return rounded(EV.operating_profiles(_sweep(spark, d)))


def policy_variants(spark, d):
    return rounded(EV.policy_variants(wide(spark, d), global_threshold=0.55, offset=-0.5))


def top_outliers(spark, d):
    return rounded(EV.top_outliers(analysed(spark, d), columns=(*[c for c in EV.OUTLIER_COLUMNS if c != "generated_at"], "burst_proxy", "drift_slice")))


def top_outliers_per_service(spark, d):
    return rounded(EV.top_outliers_per_service(wide(spark, d)).select("service_name", "scenario_tag", "event_id", "anomaly_score", "latency_ms", "rank"))


def score_bins(spark, d):
    return EV.score_bins(wide(spark, d))


def cycle_table(spark, d):
    return rounded(EV.cycle_table(EV.flag_by_service(EV.time_position(wide(spark, d)))))


def cycle_summary(spark, d):
    return rounded(EV.cycle_summary(EV.cycle_table(EV.flag_by_service(EV.time_position(wide(spark, d))))))


def persistence_summary(spark, d):
    return rounded(EV.persistence_summary(EV.cycle_summary(EV.cycle_table(EV.flag_by_service(EV.time_position(wide(spark, d)))))))


def stress_score(spark, d):
    return rounded(LB.stress_score(wide(spark, d).where("scenario_tag = 'normal'")).select("event_id", "stress_score"))


def residual_control(spark, d):
    out = LB.residual_control(wide(spark, d), target_rate=0.21, minimum_count=21)
    return rounded(out.select("event_id", "scenario_tag", "status_code", "http_5xx_rate", "net_error_rate", "relabelled"))


def residual_quota(spark, d):
    w = wide(spark, d)
    a = LB.residual_quota(w, target_rate=0.21, minimum_count=21).withColumn("mode", F.lit("balanced"))
    b = LB.residual_quota(w, target_rate=0.21, minimum_count=21, balanced=False).withColumn("mode", F.lit("share"))
    return a.unionByName(b)


def label_rows(spark, d):
    w = wide(spark, d).withColumns({
        "scenario_intensity": F.expr("case when disk_io_pct >= 95 then 1D else 0D end"),
        "burst_active": F.expr("cpu_pct >= 98"),
    })
    return LB.label_rows(w, LABEL_PROFILES).select("event_id", "scenario_tag")


def dataset_report(spark, d):
    return rounded(LB.dataset_report(wide(spark, d)))


QUERIES = {
    f.__name__: f
    for f in (
        feature_stats, top_correlations, burst_runs, drift_summary, export_profile, variance_ranking, strongest_pairs,
        signal_contrast, statistical_profile, score_summary, time_position, burst_proxy, slice_summaries, flag_metrics,
        flag_by_service, calibrate_thresholds, matched_thresholds, threshold_grid, threshold_sweep, recommend_threshold,
        operating_profiles, policy_variants, top_outliers, top_outliers_per_service, score_bins, cycle_table,
        cycle_summary, persistence_summary, stress_score, residual_control, residual_quota, label_rows, dataset_report,
    )
}
