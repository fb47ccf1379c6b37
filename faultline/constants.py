"""Fixed values shared by every operator.

All of them are defaults: operators take them as parameters where a user may
want another value.
"""

from __future__ import annotations

# Contract versions.
LONG_EVENT_VERSION = "common_telemetry_event_v0_1"
ENRICHED_EVENT_VERSION = "enriched_anomaly_event_v0_1"

# Services and their metrics.
API_SERVICES = ("payments-api", "orders-api", "checkout-api")
CACHE_SERVICE = "redis"
ALL_SERVICES = ("payments-api", "orders-api", "checkout-api", "redis")
SHORT_NAME = {
    "payments-api": "payments",
    "orders-api": "orders",
    "checkout-api": "checkout",
    "redis": "redis",
}
API_METRICS = ("latency_p95", "error_rate", "throughput")
CACHE_METRICS = ("redis_latency", "redis_queue_depth")
EXPECTED_PAIRS = tuple((s, m) for s in API_SERVICES for m in API_METRICS) + tuple(
    (CACHE_SERVICE, m) for m in CACHE_METRICS
)

# Units per metric.
METRIC_UNIT = {
    "latency_p95": "milliseconds",
    "error_rate": "ratio",
    "throughput": "requests_per_interval",
    "redis_latency": "milliseconds",
    "redis_queue_depth": "items",
}

# Healthy level of every expected (service, metric) pair.
BASELINE = {
    ("payments-api", "latency_p95"): 180.0,
    ("payments-api", "error_rate"): 0.012,
    ("payments-api", "throughput"): 220.0,
    ("orders-api", "latency_p95"): 165.0,
    ("orders-api", "error_rate"): 0.010,
    ("orders-api", "throughput"): 190.0,
    ("checkout-api", "latency_p95"): 175.0,
    ("checkout-api", "error_rate"): 0.011,
    ("checkout-api", "throughput"): 170.0,
    ("redis", "redis_latency"): 7.5,
    ("redis", "redis_queue_depth"): 24.0,
}

# Activation factors against the baseline, and the floor the
# newer feature set puts under the error-rate threshold.
ACTIVATION_FACTOR = {
    "latency_p95": 1.20,
    "error_rate": 1.60,
    "throughput": 0.90,
    "redis_latency": 1.35,
    "redis_queue_depth": 2.0,
}
ERROR_RATE_FLOOR = 0.1

# Allowed contract values.
ALLOWED_SOURCES = ("synthetic_generator", "runtime")
ALLOWED_SUITABILITY = (
    "not_suitable",
    "suitable_with_limits",
    "suitable_full_replay",
    "requires_review",
)
LONG_EVENT_REQUIRED = (
    "schema_version",
    "event_id",
    "timestamp",
    "sequence_number",
    "service_name",
    "metric_name",
    "metric_value",
    "unit",
    "source",
    "is_training_only_field",
    "metadata",
)

# The eight model inputs of a wide telemetry row.
MODEL_FEATURES = (
    "cpu_pct",
    "memory_pct",
    "latency_ms",
    "disk_io_pct",
    "net_error_rate",
    "queue_length",
    "throughput_rate",
    "http_5xx_rate",
)
BURST_AUDIT_FIELDS = ("cpu_pct", "latency_ms", "queue_length", "http_5xx_rate")

# Scenario catalog (tag, propagation expected, suitability, chain).
SCENARIO_CATALOG = (
    ("S0_NORMAL_BASELINE", False, "not_suitable", ()),
    ("S1_LOCAL_ANOMALY_ONLY", False, "requires_review", ()),
    ("S2_SERVICE_TO_REDIS_PROPAGATION", True, "suitable_with_limits", ("payments-api", "redis")),
    (
        "S3_REDIS_TO_MULTISERVICE_PROPAGATION",
        True,
        "suitable_with_limits",
        ("redis", "payments-api", "orders-api", "checkout-api"),
    ),
    (
        "S4_INTERSERVICE_CHAIN",
        True,
        "suitable_full_replay",
        ("payments-api", "redis", "checkout-api", "orders-api"),
    ),
    ("S5_DRIFT_WITHOUT_INCIDENT", False, "not_suitable", ()),
    ("S6_NOISE_FALSE_POSITIVE", False, "not_suitable", ()),
    (
        "S7_RECOVERY_AFTER_DEGRADATION",
        True,
        "suitable_with_limits",
        ("payments-api", "redis", "checkout-api"),
    ),
    ("S8_HIGH_DENSITY_UNCORRELATED_NOISE", False, "requires_review", ()),
)

# Service topology (source, target, weight) and node criticality.
TOPOLOGY_EDGES = (
    ("payments", "redis", 1),
    ("redis", "checkout", 1),
    ("checkout", "orders", 1),
    ("payments", "orders", 2),
)
TOPOLOGY_CRITICALITY = {"payments": 1, "redis": 2, "checkout": 3, "orders": 3}
TOPOLOGY_NODES = ("payments", "redis", "checkout", "orders")

# Label-like columns that must never reach a training matrix.
LEAKY_COLUMNS = (
    "scenario_tag",
    "chaos_suitability",
    "source_signature_id",
    "eligibility_score",
    "ground_truth",
    "label",
    "training_label",
)

# Published per-service alert thresholds and flag window.
SERVICE_THRESHOLDS = {
    "checkout-api": 0.691832591180323,
    "orders-api": 0.6712653569641552,
    "payments-api": 0.7016270755997039,
}
MIN_FLAG_WINDOW = 3

# Feature contracts, in column order.
FEATURES_V1 = (
    "iforest_score_max",
    "iforest_score_mean",
    "iforest_score_spread",
    "latency_p95_payments",
    "latency_p95_orders",
    "latency_p95_checkout",
    "delta_latency_orders",
    "delta_latency_checkout",
    "error_rate_payments",
    "error_rate_orders",
    "error_rate_checkout",
    "redis_queue_depth",
    "redis_latency",
    "window_anomaly_density",
    "lag_payments_to_redis",
    "lag_redis_to_checkout",
    "service_degradation_order_encoded",
)


def _per(prefix: str, nodes: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(f"{prefix}_{n}" for n in nodes)


_API_SHORT = ("payments", "orders", "checkout")
FEATURES_V2 = (
    _per("latency_p95", _API_SHORT)
    + ("delta_latency_orders", "delta_latency_checkout")
    + _per("error_rate", _API_SHORT)
    + ("redis_queue_depth", "redis_latency", "window_anomaly_density", "cache_health_score")
    + _per("degradation_intensity", _API_SHORT)
    + _per("propagation_velocity", _API_SHORT)
    + _per("traffic_pressure", _API_SHORT)
    + _per("flow_efficiency", _API_SHORT)
    + _per("stress_rate", _API_SHORT)
    + _per("service_criticality", TOPOLOGY_NODES)
    + _per("topological_distance", TOPOLOGY_NODES)
    + _per("upstream_health", TOPOLOGY_NODES)
    + ("recovery_memory",)
)
