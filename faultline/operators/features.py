"""Temporal and topological features per window.

Everything that depends on single readings (trailing values, the moving
average) is taken from panes, see :mod:`faultline.operators.windows`: only the
last few readings of each pane survive the first shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from faultline import constants as C
from faultline.functions.scalars import clamp, r6
from faultline.operators import topology as T
from faultline.operators.windows import (
    DISCARDED,
    WindowingPolicy,
    assign_windows,
    pair_column,
    proxy_score,
    time_span,
    with_panes,
)

EMA_ALPHA = 0.3
TRAFFIC_POINTS = 6
VELOCITY_POINTS = 4
_TAIL = max(TRAFFIC_POINTS, VELOCITY_POINTS)
# Spark cuts a ranking before its shuffle up to this many rows a key.
NEWEST = 1_000
_SHORT_APIS = tuple(C.SHORT_NAME[s] for s in C.API_SERVICES)


def _exact_depth(alpha: float) -> int:
    """Readings after which a moving average's weight times any double is below 1e-12."""
    return math.ceil((308.3 * math.log(10) + 12 * math.log(10)) / -math.log(1.0 - alpha))


def _plain_limit(alpha: float) -> float:
    """Largest value that ``NEWEST`` places make lighter than 1e-12."""
    return 10.0 ** min(300.0, -NEWEST * math.log10(1.0 - alpha) - 12)


def trailing_features(
    events: DataFrame,
    policy: WindowingPolicy,
    *,
    span: Column | None = None,
    alpha: float = EMA_ALPHA,
) -> DataFrame:
    """Per window: error-rate moving average and slope, throughput pressure and stress.

    A reading more than ``_exact_depth`` places from the end of its pane has a
    weight so small that no finite value can move the result.  Unless a pane
    holds a value beyond ``_plain_limit``, ``NEWEST`` places are as good, and a
    ranking that stops there is cut by every task before the shuffle, which so
    carries at most ``NEWEST`` readings of a pane from each task.
    """
    span = time_span(events) if span is None else span
    wanted = F.col("service_name").isin(*C.API_SERVICES) & F.col("metric_name").isin("error_rate", "throughput")
    placed = with_panes(events.where(wanted), policy, span)
    key = ["pane", "service_name", "metric_name"]
    newest = W.partitionBy(*key).orderBy(F.desc("offset_us"), F.desc("sequence_number"), F.desc("event_id"))

    def last(rows: DataFrame, depth: int) -> DataFrame:
        return rows.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= depth)

    exact = _exact_depth(alpha)
    if exact <= NEWEST:
        recent = last(placed, exact)
    else:
        # Panes with huge values, of which there should be none, are ranked in full.
        huge = placed.where(F.abs("metric_value") > _plain_limit(alpha)).select(*key).distinct()
        recent = last(placed, NEWEST).join(huge, key, "left_anti").unionByName(last(placed.join(huge, key, "left_semi"), exact))
    keep = F.pow(F.lit(1.0 - alpha), F.col("rn") - 1)
    point = F.struct("offset_us", "sequence_number", "event_id", F.col("metric_value").alias("v"))
    ends = recent.groupBy(*key).agg(
        F.sum(F.col("metric_value") * keep * alpha).alias("weighted"),
        F.array_sort(F.collect_list(F.when(F.col("rn") <= _TAIL, point))).alias("tail"),
        F.max("last_us").alias("last_us"),
    )
    sizes = placed.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("metric_value", F.struct("offset_us", "sequence_number", "event_id")).alias("oldest"),
    )
    panes = ends.join(sizes, key)
    by_window = (
        assign_windows(panes, policy)
        .where(F.col("late_class") != DISCARDED)
        .groupBy("window_index", "service_name", "metric_name")
        .agg(
            F.array_sort(F.collect_list(F.struct("pane", "n", "weighted", "oldest"))).alias("parts"),
            F.array_sort(F.flatten(F.collect_list("tail"))).alias("points"),
        )
    )
    rest = F.lit(1.0 - alpha)

    def fold(state: Column, part: Column) -> Column:
        decay = F.pow(rest, part["n"])
        seed = rest * part["oldest"] * F.pow(rest, part["n"] - 1)
        carried = F.when(state.isNull(), seed).otherwise(state * decay)
        return carried + part["weighted"]

    ema = F.aggregate("parts", F.lit(None).cast("double"), fold)
    pts = F.when(
        F.size("points") > _TAIL, F.slice("points", -_TAIL, _TAIL)
    ).otherwise(F.col("points"))
    by_window = by_window.withColumn("ema", r6(ema)).withColumn("points", pts)
    n = F.size("points")

    def back(i: int) -> Column:
        return F.get("points", n - i)

    def seconds(i: int) -> Column:
        return (back(1)["offset_us"] - back(i)["offset_us"]) / F.lit(1_000_000.0)

    slope = F.when(
        (n >= VELOCITY_POINTS) & (seconds(VELOCITY_POINTS) > 0),
        r6((back(1)["v"] - back(VELOCITY_POINTS)["v"]) / seconds(VELOCITY_POINTS)),
    ).otherwise(F.lit(0.0))
    stress = F.when(
        (n >= 2) & (seconds(2) > 0), r6((back(2)["v"] - back(1)["v"]) / seconds(2))
    ).otherwise(F.lit(0.0))
    values = F.transform("points", lambda p: p["v"])
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    pressure = F.when((n >= 2) & (var > 0), r6((back(1)["v"] - mean) / F.sqrt(var))).otherwise(F.lit(0.0))
    by_window = by_window.withColumn("slope", slope).withColumn("stress", stress).withColumn("pressure", pressure)

    out = []
    for s in C.API_SERVICES:
        short = C.SHORT_NAME[s]
        for stem, metric, col in (
            ("degradation_intensity", "error_rate", "ema"),
            ("propagation_velocity", "error_rate", "slope"),
            ("traffic_pressure", "throughput", "pressure"),
            ("stress_rate", "throughput", "stress"),
        ):
            here = (F.col("service_name") == s) & (F.col("metric_name") == metric)
            out.append(F.coalesce(F.max(F.when(here, F.col(col))), F.lit(0.0)).alias(f"{stem}_{short}"))
    return by_window.groupBy("window_index").agg(*out)


def _metric(service: str, metric: str) -> Column:
    return F.coalesce(F.col(pair_column(service, metric)), F.lit(0.0))


def level_features(windows: DataFrame) -> DataFrame:
    """Latency, error and cache levels, proxy scores and their spread, cache health, flow."""
    r_lat, r_queue = _metric("redis", "redis_latency"), _metric("redis", "redis_queue_depth")
    out = windows.withColumn("redis_latency", r_lat).withColumn("redis_queue_depth", r_queue)
    for s in C.API_SERVICES:
        short = C.SHORT_NAME[s]
        lat, err, thr = (_metric(s, m) for m in C.API_METRICS)
        out = (
            out.withColumn(f"latency_p95_{short}", lat)
            .withColumn(f"error_rate_{short}", err)
            .withColumn(f"iforest_score_{short}", proxy_score(lat, err, thr, r_lat, r_queue))
            .withColumn(f"flow_efficiency_{short}", r6(thr / (lat + 1.0)))
        )
    scores = [F.col(f"iforest_score_{n}") for n in _SHORT_APIS]
    total = scores[0] + scores[1] + scores[2]
    hot = sum((F.when(s >= 0.55, 1).otherwise(0) for s in scores[1:]), F.when(scores[0] >= 0.55, 1).otherwise(0))
    health = clamp(1.0 / (1.0 + F.col("redis_queue_depth") + F.col("redis_latency") / 100.0))
    return (
        out.withColumn("iforest_score_max", r6(F.greatest(*scores)))
        .withColumn("iforest_score_mean", r6(total / 3.0))
        .withColumn("iforest_score_spread", r6(F.greatest(*scores) - F.least(*scores)))
        .withColumn("window_anomaly_density", r6(hot / F.lit(3.0)))
        .withColumn("cache_health_score", r6(health))
    )


def activation_order(windows: DataFrame) -> DataFrame:
    """Lags between first crossings, the order code, and the detected origin."""
    late = F.lit(2**62)
    entries = [
        F.struct(
            F.coalesce(F.col(f"activation_v1_{C.SHORT_NAME[s]}"), late).alias("at"),
            F.lit(s).alias("service"),
        )
        for s in C.ALL_SERVICES
    ]
    ranked = F.transform(F.array_sort(F.array(*entries)), lambda e: e["service"])

    def place(service: str) -> Column:
        return F.array_position(ranked, service) - 1

    def lag(a: str, b: str) -> Column:
        gap = F.col(f"activation_v1_{b}") - F.col(f"activation_v1_{a}")
        return F.when(gap >= 0, gap / F.lit(1_000_000.0))

    # Decimal place of each service in the order code.
    code = place("payments-api") * 1000 + place("redis") * 100 + place("checkout-api") * 10 + place("orders-api")
    first = F.array_min(
        F.filter(
            F.array(
                *[
                    F.struct(F.col(f"activation_v2_{n}").alias("at"), F.lit(n).alias("node"))
                    for n in C.SHORT_NAME.values()
                ]
            ),
            lambda e: e["at"].isNotNull(),
        )
    )
    return (
        windows.withColumn("lag_payments_to_redis", lag("payments", "redis"))
        .withColumn("lag_redis_to_checkout", lag("redis", "checkout"))
        .withColumn("service_degradation_order_encoded", code.cast("long"))
        .withColumn("detected_origin_service", first["node"])
    )


def decode_order(code: Column) -> Column:
    """Service names by ascending position from an order code (null code: empty)."""
    digits = {
        "payments-api": F.floor(code / 1000),
        "redis": F.floor(code % 1000 / 100),
        "checkout-api": F.floor(code % 100 / 10),
        "orders-api": code % 10,
    }
    rank = {s: i for i, s in enumerate(digits)}
    entries = F.array_sort(
        F.array(
            *[
                F.struct(d.cast("long").alias("p"), F.lit(rank[s]).alias("i"), F.lit(s).alias("s"))
                for s, d in digits.items()
            ]
        )
    )
    return F.when(code.isNull(), F.array().cast("array<string>")).otherwise(F.transform(entries, lambda e: e["s"]))


def topology_features(df: DataFrame, *, edges=C.TOPOLOGY_EDGES, criticality=C.TOPOLOGY_CRITICALITY) -> DataFrame:
    """Distances from the detected origin, criticality and mean upstream stress per node.

    The graph is configuration: its derived tables have one row per node pair,
    so broadcasting them is bounded.  ``raw_distance_*`` keeps unreachable
    apart from the origin itself, which both read 0 in the contract column.
    """
    spark = df.sparkSession
    nodes = tuple(criticality)
    e, n = T.edge_table(spark, edges), T.node_table(spark, criticality)
    dist = T.shortest_distances(e, n, n_nodes=len(nodes))
    wide_dist = dist.groupBy(F.col("source").alias("_o")).agg(
        *[F.max(F.when(F.col("target") == x, F.col("distance"))).cast("double").alias(f"raw_distance_{x}") for x in nodes]
    )
    out = df.join(F.broadcast(wide_dist), F.col("detected_origin_service") == F.col("_o"), "left").drop("_o")
    up = (
        T.ancestors(e, n_nodes=len(nodes))
        .groupBy("node")
        .agg(F.collect_set("ancestor").alias("ups"))
        .agg(F.map_from_entries(F.collect_list(F.struct("node", "ups"))).alias("m"))
    )
    stress = {x: F.col(f"error_rate_{x}") for x in _SHORT_APIS}
    stress[C.CACHE_SERVICE] = r6(1.0 - F.col("cache_health_score"))
    flat = [v for k, col in stress.items() for v in (F.lit(k), col)]
    out = out.withColumn("_stress", F.create_map(*flat)).withColumn("_ups", up.scalar())
    cols = {}
    for x in nodes:
        ups = f"try_element_at(_ups, '{x}')"
        summed = f"aggregate({ups}, 0D, (a, u) -> a + coalesce(try_element_at(_stress, u), 0D))"
        cols[f"service_criticality_{x}"] = F.lit(float(criticality[x]))
        cols[f"topological_distance_{x}"] = F.coalesce(f"raw_distance_{x}", F.lit(0.0))
        cols[f"upstream_health_{x}"] = F.expr(f"coalesce(round(try_divide({summed}, size({ups})), 6), 0D)")
    return out.withColumns(cols).drop("_stress", "_ups")


def temporal_memory(df: DataFrame) -> DataFrame:
    """Latency change against, and windows since the last clean one of, the same scenario.

    Runs on the window table, which has one row per stride of covered time.
    """
    order = W.partitionBy(F.coalesce("scenario_tag", F.lit(""))).orderBy("window_start", "window_index")
    out = df
    for n in ("orders", "checkout"):
        col = F.col(f"latency_p95_{n}")
        out = out.withColumn(f"delta_latency_{n}", F.coalesce(r6(col - F.lag(col).over(order)), F.lit(0.0)))
    clean = F.greatest(*[F.col(f"error_rate_{n}") for n in _SHORT_APIS]) <= C.ERROR_RATE_FLOOR
    out = out.withColumn("_i", F.row_number().over(order) - 1).withColumn("_clean", clean)
    last = F.last(F.when(F.col("_clean"), F.col("_i")), ignorenulls=True).over(
        order.rowsBetween(W.unboundedPreceding, 0)
    )
    return out.withColumn("recovery_memory", (F.col("_i") - F.coalesce(last, F.lit(-1))).cast("double")).drop("_i", "_clean")


def build_features(
    events: DataFrame, windows: DataFrame, policy: WindowingPolicy, *, span: Column | None = None
) -> DataFrame:
    """All feature columns of both contract generations, one row per window."""
    trail = trailing_features(events, policy, span=span)
    names = [c for c in trail.columns if c != "window_index"]
    out = windows.join(trail.withColumnRenamed("window_index", "_w"), F.col("window_index") == F.col("_w"), "left").drop("_w")
    for c in names:
        out = out.withColumn(c, F.coalesce(c, F.lit(0.0)))
    return temporal_memory(topology_features(activation_order(level_features(out))))


def contract_columns(df: DataFrame, version: str = "v2") -> DataFrame:
    """The feature contract in its fixed column order, keyed by window."""
    cols = C.FEATURES_V2 if version == "v2" else C.FEATURES_V1
    return df.select("window_id", *[F.col(c).cast("double").alias(c) for c in cols])


def fallback_features(windows: DataFrame) -> DataFrame:
    """Feature row from window means alone, for windows without a feature row."""
    lat = {s: _metric(s, "latency_p95") for s in C.API_SERVICES}
    err = {s: _metric(s, "error_rate") for s in C.API_SERVICES}
    r_lat, r_queue = _metric("redis", "redis_latency"), _metric("redis", "redis_queue_depth")
    # Scale of the ratio signals, and the order that breaks ties.
    signal = {
        "payments-api": lat["payments-api"] / 220.0 + err["payments-api"] / 0.02,
        "redis": r_lat / 10.0 + r_queue / 40.0,
        "checkout-api": lat["checkout-api"] / 220.0 + err["checkout-api"] / 0.02,
        "orders-api": lat["orders-api"] / 220.0 + err["orders-api"] / 0.02,
    }
    entries = F.array_sort(
        F.array(
            *[
                F.struct((-v).alias("neg"), F.lit(i).alias("i"), F.lit(s).alias("s"))
                for i, (s, v) in enumerate(signal.items())
            ]
        )
    )
    ranked = F.transform(entries, lambda e: e["s"])

    def place(s: str) -> Column:
        return F.array_position(ranked, s) - 1

    code = place("payments-api") * 1000 + place("redis") * 100 + place("checkout-api") * 10 + place("orders-api")
    hot = sum((F.when(v >= 1.0, 1).otherwise(0) for v in signal.values()), F.lit(0))
    cols = [F.col("window_id")]
    for s in C.API_SERVICES:
        cols.append(lat[s].alias(f"latency_p95_{C.SHORT_NAME[s]}"))
    for s in ("orders-api", "checkout-api"):
        cols.append(err[s].alias(f"error_rate_{C.SHORT_NAME[s]}"))
    cols += [r_queue.alias("redis_queue_depth"), r_lat.alias("redis_latency")]
    for s in C.API_SERVICES:
        cols.append(F.greatest(lat[s] / 400.0 + err[s], F.lit(0.0)).alias(f"iforest_score_{C.SHORT_NAME[s]}"))
    cols += [
        r6(hot / F.lit(4.0)).alias("window_anomaly_density"),
        F.lit(None).cast("double").alias("lag_payments_to_redis"),
        F.lit(None).cast("double").alias("lag_redis_to_checkout"),
        code.cast("long").alias("service_degradation_order_encoded"),
        F.col("window_data_quality_score"),
        F.col("scenario_tag"),
    ]
    return windows.select(*cols)


def resolve_features(windows: DataFrame, features: DataFrame) -> DataFrame:
    """Feature rows for all windows: the computed row where it exists, else the fallback."""
    back = fallback_features(windows)
    shared = [c for c in back.columns if c not in ("window_id",)]
    own = features.select(F.col("window_id").alias("_w"), F.lit(True).alias("_has"), *[F.col(c).alias(f"_f_{c}") for c in shared])
    j = back.join(own, F.col("window_id") == F.col("_w"), "left")
    return j.select(
        "window_id",
        *[F.when(F.col("_has"), F.col(f"_f_{c}")).otherwise(F.col(c)).alias(c) for c in shared],
        F.coalesce("_has", F.lit(False)).alias("has_feature_row"),
    )

