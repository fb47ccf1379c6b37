"""Registered queries over clusters: matrix, density, post-filter, signatures, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline import constants as C
from faultline import fixtures as X
from faultline.operators import density as DE
from faultline.operators import features as FT
from faultline.operators import hierarchy as H
from faultline.operators import propagation as PR
from faultline.operators import stability as ST
from faultline.operators import windows as W
from faultline.plans.scoring_queries import feature_rows_v1, rounded
from faultline.session import cut
from faultline.plans.signal_queries import assignments
from faultline.plans.telemetry_queries import features_of, r4, windows_of

POINT_EPS, POINT_MIN = 1.13, 4
CLUSTER_EPS = {"v1": 0.62, "v2": 1.1}
POST_THRESHOLD = 0.37


def _rows(spark, d):
    """Windows and their first-generation feature rows."""
    w = windows_of(spark, d)
    return w, FT.temporal_memory(FT.activation_order(FT.level_features(w)))


def training_matrix(spark, d):
    w, f = _rows(spark, d)
    m = DE.training_matrix(w, f.where("window_index % 3 <> 0"), contract=C.FEATURES_V1)
    return m.select("window_id", *[r4(c) for c in C.FEATURES_V1])


def min_max_matrix(spark, d):
    w = W.quality_split(windows_of(spark, d)).where("eligible")
    f = FT.temporal_memory(FT.activation_order(FT.level_features(w)))
    m = DE.min_max(DE.training_matrix(w, f, contract=C.FEATURES_V1), C.FEATURES_V1)
    return m.select("window_id", *[r4(c) for c in C.FEATURES_V1])


def point_clusters(spark, d):
    return DE.density_clusters(X.points(spark, d), [f"x{i}" for i in range(X.POINT_DIMS)], eps=POINT_EPS, min_samples=POINT_MIN)


def density_clusters(spark, d):
    return rounded(point_clusters(spark, d).select("id", "cluster_id", "noise", "cluster_strength"))


def cluster_purity(spark, d):
    return rounded(PR.cluster_purity(point_clusters(spark, d)))


def cluster_summary(spark, d):
    return PR.cluster_summary(assignments(spark, d))


def post_filter(spark, d):
    a = cut(assignments(spark, d))
    f = cut(_rows(spark, d)[1].select("window_id", "iforest_score_mean"))
    cases = (("fixed", 0.37, "percentile_25"), ("fallback", 0.9, "mean"), ("median", 0.39, "median"))
    out = None
    for name, t, agg in cases:
        p = PR.post_filter(a, f, threshold=t, aggregation=agg).withColumn("case_name", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return rounded(out.select(
        "case_name", "window_id", "raw_cluster_id", "cluster_id", "noise", "cluster_strength", "cluster_iforest_confidence",
        "post_filter_threshold", "post_filter_policy", "post_filter_passed"))


def _signatures(spark, d):
    w, f = _rows(spark, d)
    return PR.signatures(assignments(spark, d), w, FT.resolve_features(w, f.where("window_index % 2 = 0")))


def _clustered_signatures(spark, d):
    """Signatures of the clusters found in the telemetry, every window with its features."""
    w, f, a = _clusters(spark, d, "v1")
    kept = cut(PR.post_filter(a, f, threshold=POST_THRESHOLD))
    return PR.signatures(kept, w, FT.resolve_features(w, f))


def propagation_signatures(spark, d):
    return _signature_columns(_signatures(spark, d))


def clustered_signatures(spark, d):
    return _signature_columns(_clustered_signatures(spark, d))


def _signature_columns(found):
    return found.selectExpr(
        "signature_id", "cluster_id", "detected", "noise", "array_join(services_chain_observed, '>') as chain",
        "floor(lag_pattern_seconds_ci['payments-api_to_redis'].p10 * 1e4 + 0.5) / 1e4 as lag_p10",
        "floor(lag_pattern_seconds_ci['payments-api_to_redis'].p90 * 1e4 + 0.5) / 1e4 as lag_p90",
        "lag_ci_metadata.sample_window_count as sample_window_count", "lag_ci_metadata.precision as precision",
        "array_join(affected_metrics['redis'], ',') as affected_redis", "array_join(affected_metrics['payments-api'], ',') as affected_payments",
        "floor(metric_ranges_observed['redis_latency'].min * 1e4 + 0.5) / 1e4 as redis_latency_min",
        "floor(metric_ranges_observed['redis_latency'].max * 1e4 + 0.5) / 1e4 as redis_latency_max",
        "unix_micros(observation_period.start) as start_us",
    )


def eligibility_report(spark, d):
    return _eligibility_columns(_signatures(spark, d))


def clustered_eligibility(spark, d):
    return _eligibility_columns(_clustered_signatures(spark, d))


def clustered_summary(spark, d):
    w, f, a = _clusters(spark, d, "v1")
    return PR.cluster_summary(cut(PR.post_filter(a, f, threshold=POST_THRESHOLD)))


def _eligibility_columns(found):
    return rounded(PR.eligibility(found).select(
        "source_signature_id", "eligible", "eligibility_score", "risk_score", "recommended_status",
        F.size("preconditions").alias("n_preconditions"), F.array_join("warnings", "; ").alias("warnings")))


def order_match(spark, d):
    w, f = _rows(spark, d)
    f2 = FT.topology_features(f).join(PR.catalog_table(spark).withColumnRenamed("scenario_tag", "_t"), F.expr("scenario_tag = _t"))
    v1 = PR.with_order_match(f2, version="v1").withColumnRenamed("order_matches", "v1_matches")
    return PR.with_order_match(v1).select("window_id", "v1_matches", F.col("order_matches").alias("v2_matches"))


def validate_propagation(spark, d):
    w, f = _rows(spark, d)
    f2 = FT.topology_features(f)
    a = assignments(spark, d)
    v2 = PR.validate(a, f2, w).withColumn("version", F.lit("v2"))
    v1 = PR.validate(a, f2, w, version="v1").withColumn("version", F.lit("v1"))
    return rounded(v2.unionByName(v1))


def _clusters(spark, d, contract):
    """Windows, features and the clusters of the scaled feature contract."""
    w, f = _rows(spark, d)
    f = features_of(spark, d) if contract == "v2" else FT.topology_features(f)
    w, f = cut(w), cut(f)
    cols = C.FEATURES_V2 if contract == "v2" else C.FEATURES_V1
    m = DE.min_max(DE.training_matrix(w, f, keys=cols), cols)
    return w, f, cut(DE.density_clusters(m, cols, eps=CLUSTER_EPS[contract], min_samples=3, id_col="window_index").drop(*cols))


def _clustered(spark, d, contract):
    """Matrix, scaling, clusters and post-filter in one run."""
    w, f, a = _clusters(spark, d, contract)
    return rounded(PR.post_filter(a, f, threshold=POST_THRESHOLD).select(
        "window_id", "raw_cluster_id", "cluster_id", "noise", "cluster_strength", "cluster_iforest_confidence", "post_filter_threshold",
        "post_filter_policy", "post_filter_passed"))


def clustered_windows_v1(spark, d):
    return _clustered(spark, d, "v1")


def clustered_windows_v2(spark, d):
    return _clustered(spark, d, "v2")


def clustered_validation(spark, d):
    """The whole way from telemetry to propagation metrics, on found clusters."""
    w, f, a = _clusters(spark, d, "v1")
    kept = cut(PR.post_filter(a, f, threshold=POST_THRESHOLD))
    return rounded(PR.validate(kept, f, w).withColumn("version", F.lit("v2")))


HIERARCHY = [("eom", "eom", 0.0, False), ("leaf", "leaf", 0.0, False), ("wide", "leaf", 0.8, False), ("single", "eom", 0.0, True)]
SWEEP = [(f"{method}_{eps}_{str(single).lower()}", method, eps, single) for method in ("eom", "leaf") for eps in (0.0, 0.4) for single in (False, True)]


def _hierarchy(spark, d, contract):
    """Windows, features and the condensed tree of the scaled feature contract."""
    w, f = _rows(spark, d)
    f = features_of(spark, d) if contract == "v2" else FT.topology_features(f)
    w, f = cut(w), cut(f)
    cols = C.FEATURES_V2 if contract == "v2" else C.FEATURES_V1
    m = DE.min_max(DE.training_matrix(w, f, keys=cols), cols)
    return w, f, m, H.build_tree(m, cols, min_cluster_size=5, min_samples=3, id_col="window_index")


def hierarchical_windows(spark, d):
    """Hierarchical clusters of the 40-column matrix, several selections of one tree."""
    _, _, _, tree = _hierarchy(spark, d, "v2")
    return rounded(H.select_clusters(tree, HIERARCHY).withColumnRenamed("id", "window_index"))


def selection_sweep(spark, d):
    """Propagation metrics for every method, epsilon and single-cluster choice, all read from one tree."""
    w, f, m, tree = _hierarchy(spark, d, "v1")
    return rounded(ST.selection_sweep(tree, m, f, w, SWEEP, id_col="window_index", threshold=POST_THRESHOLD))


def bootstrap_stability(spark, d):
    """Leave-one-out stability of the window features."""
    f = feature_rows_v1(spark, d)
    cols = list(C.FEATURES_V1)
    rows = cut(f.select("window_index", "scenario_tag", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols]))
    return rounded(ST.bootstrap_stability(rows, cols, eps=0.25, min_samples=3, id_col="window_index"))


def parameter_sweep(spark, d):
    w, f = _rows(spark, d)
    f = cut(FT.topology_features(f).select("window_id", "iforest_score_mean", "detected_origin_service",
                                           *[f"topological_distance_{n}" for n in C.TOPOLOGY_NODES], *[c for c in C.FEATURES_V1 if c != "iforest_score_mean"]))
    w = cut(w)
    cols = list(C.FEATURES_V1)
    m = DE.min_max(DE.training_matrix(w, f, keys=cols), cols)
    return rounded(ST.parameter_sweep(m, cols, f, w, eps_values=(0.3, 0.45, 0.6), min_samples=3))


def partition_summary(spark, d):
    w = windows_of(spark, d).withColumn("part", F.expr("case when window_index < 80 then 'training' else 'validation' end"))
    return PR.partition_summary(w, partition="part", seed="window_index")


QUERIES = {
    f.__name__: f
    for f in (
        training_matrix, min_max_matrix, clustered_windows_v1, clustered_windows_v2, clustered_validation, clustered_signatures, clustered_eligibility, clustered_summary,
        hierarchical_windows, selection_sweep, density_clusters, cluster_purity, cluster_summary, post_filter,
        bootstrap_stability, parameter_sweep, propagation_signatures, eligibility_report, order_match, validate_propagation, partition_summary,
    )
}
