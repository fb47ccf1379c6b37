"""Overlapping, quality-graded time windows over long telemetry events.

Windows start at the first event and advance by a stride; an event can be
strict, tolerated-late or discarded-late for several windows.  Instead of
copying every event into each of its windows, events are first reduced to
panes: pieces of the time line that no window border cuts.  Panes are combined
on the map side, so what is copied into windows afterwards is a few rows per
pane, whatever the event rate or the skew between services.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from faultline import constants as C
from faultline.functions.scalars import clamp, lookup, micros, r6

SECOND = 1_000_000
STRICT, TOLERATED, DISCARDED = "strict", "tolerated", "discarded"


@dataclass(frozen=True)
class WindowingPolicy:
    length_s: int = 120
    stride_s: int = 60
    tolerance_s: int = 10
    late_discard_ratio: float = 0.05
    min_events: int = 10
    max_missing_ratio: float = 0.20
    min_quality: float = 0.80

    @property
    def length(self) -> int:
        return self.length_s * SECOND

    @property
    def stride(self) -> int:
        return self.stride_s * SECOND

    @property
    def tolerance(self) -> int:
        return self.tolerance_s * SECOND

    @property
    def reach(self) -> int:
        """How far past its start a window still looks at events."""
        return self.length + max(self.stride, self.tolerance)


def pair_column(service: str, metric: str) -> str:
    return f"{service}__{metric}"


PAIR_COLUMNS = tuple(pair_column(s, m) for s, m in C.EXPECTED_PAIRS)


def time_span(events: DataFrame) -> Column:
    """Scalar struct (t0, t1): first and last event in microseconds; one column is read."""
    us = micros(F.col("ts"))
    return events.agg(F.struct(F.min(us).alias("t0"), F.max(us).alias("t1")).alias("s")).scalar()


def with_panes(events: DataFrame, policy: WindowingPolicy, span: Column | None = None) -> DataFrame:
    """Add ``offset_us`` (from the anchor), ``pane`` (pane start) and ``last_us``."""
    span = time_span(events) if span is None else span
    s = policy.stride
    borders = sorted({0, policy.length % s, (policy.length + policy.tolerance) % s})
    df = events.withColumn("_span", span).withColumn("offset_us", micros(F.col("ts")) - F.col("_span.t0"))
    into = F.pmod(F.col("offset_us"), F.lit(s))
    border = F.lit(0)
    for b in borders[1:]:
        border = F.when(into >= b, F.lit(b)).otherwise(border)
    return df.withColumn("pane", F.col("offset_us") - into + border).withColumn(
        "last_us", F.col("_span.t1") - F.col("_span.t0")
    ).withColumn("anchor_us", F.col("_span.t0")).drop("_span")


def assign_windows(panes: DataFrame, policy: WindowingPolicy) -> DataFrame:
    """One row per (pane, window it matters to) with ``window_index`` and ``late_class``."""
    s = F.lit(policy.stride)
    at = F.col("pane")
    first = F.greatest(F.lit(0).cast("long"), F.floor((at - policy.reach) / s) + 1)
    last = F.least(F.floor(at / s), F.floor(F.col("last_us") / s))
    spread = panes.withColumn(
        "window_index",
        F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))),
    )
    into = at - F.col("window_index") * s
    cls = (
        F.when(into < policy.length, F.lit(STRICT))
        .when(into < policy.length + policy.tolerance, F.lit(TOLERATED))
        .when(into < policy.length + policy.stride, F.lit(DISCARDED))
    )
    return spread.withColumn("late_class", cls).where(F.col("late_class").isNotNull())


def late_classes(
    events: DataFrame, policy: WindowingPolicy, span: Column | None = None
) -> DataFrame:
    """Row level: every event with each of its windows and its late class there."""
    return assign_windows(with_panes(events, policy, span), policy)


def _crossed(floor: float) -> Column:
    """Does one reading cross the activation threshold of its (service, metric)?"""
    key = F.concat_ws("|", "service_name", "metric_name")
    limits = {}
    for (s, m), base in C.BASELINE.items():
        limit = base * C.ACTIVATION_FACTOR[m]
        limits[f"{s}|{m}"] = max(limit, floor) if m == "error_rate" else limit
    limit = lookup(key, limits)
    low_is_bad = F.col("metric_name") == "throughput"
    value = F.col("metric_value")
    return F.when(low_is_bad, value <= limit).otherwise(value >= limit)


def pane_metrics(events: DataFrame, policy: WindowingPolicy, span: Column | None = None) -> DataFrame:
    """Events reduced to (pane, service, metric): counts, sums, first crossings, tags."""
    us = F.col("offset_us") + F.col("anchor_us")
    return (
        with_panes(events, policy, span)
        .groupBy("pane", "service_name", "metric_name")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("metric_value").alias("total"),
            F.min(F.when(_crossed(0.0), us)).alias("cross_v1"),
            F.min(F.when(_crossed(C.ERROR_RATE_FLOOR), us)).alias("cross_v2"),
            F.min("scenario_tag").alias("scenario_tag"),
            F.min("chaos_suitability").alias("chaos_suitability"),
            F.max("last_us").alias("last_us"),
            F.max("anchor_us").alias("anchor_us"),
        )
    )


def sequence_breaks(
    events: DataFrame,
    policy: WindowingPolicy,
    span: Column | None = None,
    *,
    blocks_per_stride: int = 16,
) -> DataFrame:
    """(window_index, service_name) where a sequence number fails to rise.

    Order is (ts, sequence).  Readings are reduced per instant, checked inside
    short time blocks, and blocks are then checked against their predecessor,
    so a busy service never sits in one task.
    """
    width = max(policy.stride // blocks_per_stride, 1)
    within = F.col("offset_us") - F.col("pane")
    instants = (
        with_panes(events, policy, span)
        .withColumn("block", F.col("pane") + within - F.pmod(within, F.lit(width)))
        .groupBy("service_name", "pane", "block", "offset_us")
        .agg(
            F.min("sequence_number").alias("low"),
            F.max("sequence_number").alias("high"),
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("sequence_number").alias("n_distinct"),
            F.max("last_us").alias("last_us"),
        )
    )
    inside = W.partitionBy("service_name", "pane", "block").orderBy("offset_us")
    broken = (F.col("n") > F.col("n_distinct")) | (F.col("low") <= F.lag("high").over(inside))
    blocks = (
        instants.withColumn("broken", F.coalesce(broken, F.lit(False)))
        .groupBy("service_name", "pane", "block")
        .agg(
            F.max("broken").alias("broken"),
            F.min_by("low", "offset_us").alias("first"),
            F.max_by("high", "offset_us").alias("last"),
            F.max("last_us").alias("last_us"),
        )
    )
    placed = assign_windows(blocks, policy).where(F.col("late_class") != DISCARDED)
    across = W.partitionBy("window_index", "service_name").orderBy("block")
    edge = F.coalesce(F.col("first") <= F.lag("last").over(across), F.lit(False))
    return (
        placed.withColumn("hit", F.col("broken") | edge)
        .groupBy("window_index", "service_name")
        .agg(F.max("hit").alias("hit"))
        .where("hit")
        .drop("hit")
    )


def window_pairs(panes: DataFrame, policy: WindowingPolicy) -> DataFrame:
    """Panes rolled up to (window, service, metric)."""
    kept = F.col("late_class") != DISCARDED

    def n_of(cls: str) -> Column:
        return F.sum(F.when(F.col("late_class") == cls, F.col("n")).otherwise(0))

    return (
        assign_windows(panes, policy)
        .groupBy("window_index", "service_name", "metric_name")
        .agg(
            n_of(STRICT).alias("n_strict"),
            n_of(TOLERATED).alias("n_tolerated"),
            n_of(DISCARDED).alias("n_discarded"),
            F.sum(F.when(kept, F.col("total"))).alias("total"),
            F.min(F.when(kept, F.col("cross_v1"))).alias("cross_v1"),
            F.min(F.when(kept, F.col("cross_v2"))).alias("cross_v2"),
            F.min(F.when(kept, F.col("scenario_tag"))).alias("scenario_tag"),
            F.min(F.when(kept, F.col("chaos_suitability"))).alias("chaos_suitability"),
            F.max("anchor_us").alias("anchor_us"),
        )
    )


def build_windows(
    events: DataFrame,
    policy: WindowingPolicy = WindowingPolicy(),
    *,
    span: Column | None = None,
    expected: Sequence[tuple[str, str]] = C.EXPECTED_PAIRS,
) -> DataFrame:
    """One graded row per non-empty window, with first-crossing times per service."""
    span = time_span(events) if span is None else span
    pairs = window_pairs(pane_metrics(events, policy, span), policy)
    kept_n = F.col("n_strict") + F.col("n_tolerated")
    seen = kept_n > 0
    svc = F.col("service_name")
    aggs = [
        F.sum("n_strict").alias("strict_event_count"),
        F.sum("n_tolerated").alias("late_events_within_tolerance"),
        F.sum("n_discarded").alias("late_discarded_count"),
        F.count_if(F.col("n_strict") > 0).alias("covered_pairs"),
        F.array_sort(F.collect_set(F.when(seen, svc))).alias("services_included"),
        F.min("scenario_tag").alias("scenario_tag"),
        F.min("chaos_suitability").alias("chaos_suitability"),
        F.max("anchor_us").alias("anchor_us"),
    ]
    for s, m in expected:
        here = f"service_name = '{s}' and metric_name = '{m}' and n_strict + n_tolerated > 0"
        mean = f"try_divide(sum(case when {here} then total end), sum(case when {here} then n_strict + n_tolerated end))"
        aggs.append(F.expr(f"round({mean}, 6)").alias(pair_column(s, m)))
    for s in C.ALL_SERVICES:
        for v in ("v1", "v2"):
            aggs.append(F.expr(f"min(case when service_name = '{s}' then cross_{v} end)").alias(f"activation_{v}_{C.SHORT_NAME[s]}"))
    wide = pairs.groupBy("window_index").agg(*aggs)

    breaks = (
        sequence_breaks(events, policy, span)
        .groupBy(F.col("window_index").alias("_w"))
        .agg(F.array_sort(F.collect_set("service_name")).alias("ordering_violation_services"))
    )
    joined = wide.join(breaks, F.col("window_index") == F.col("_w"), "left").drop("_w")
    return grade_windows(joined, policy, n_expected=len(expected))


def grade_windows(df: DataFrame, policy: WindowingPolicy, *, n_expected: int) -> DataFrame:
    """Ratios, quality score and training acceptance from the window counts."""
    c = F.col
    total = "(strict_event_count + late_events_within_tolerance)"
    out = df.where(f"{total} > 0").selectExpr(
        *[f"`{x}`" for x in df.columns if x != "ordering_violation_services"],
        "coalesce(ordering_violation_services, cast(array() as array<string>)) as ordering_violation_services",
        "coalesce(size(ordering_violation_services), 0) > 0 as ordering_broken",
        f"{total} as total_event_count",
        f"covered_pairs / {float(max(n_expected, 1))}D as _cov",
        f"least(strict_event_count / {float(max(policy.min_events, 1))}D, 1D) as _min_ev",
        f"late_events_within_tolerance / {total} as _late",
        f"late_discarded_count / ({total} + late_discarded_count) as _disc",
    )
    out = out.withColumn("degraded_quality", F.expr(f"_disc > {policy.late_discard_ratio}D"))
    # Weights of the score, and what degraded or misordered windows lose.
    out = out.withColumn(
        "_q", F.expr("round(least(greatest(_cov * 0.55D + _min_ev * 0.20D + (1 - _late) * 0.10D + (1 - _disc) * 0.15D, 0D), 1D), 6)")
    )
    for flag, penalty in (("degraded_quality", 0.10), ("ordering_broken", 0.20)):
        out = out.withColumn("_q", F.expr(f"case when {flag} then round(greatest(_q - {penalty}D, 0D), 6) else _q end"))
    missing = 1 - c("_cov")
    accepted = F.expr(
        f"1 - _cov <= {policy.max_missing_ratio}D and strict_event_count >= {policy.min_events} and _q >= {policy.min_quality}D and not ordering_broken"
    )
    start = c("anchor_us") + c("window_index") * policy.stride
    return out.select(
        "window_index",
        F.format_string("temporal_window_%04d", c("window_index")).alias("window_id"),
        F.timestamp_micros(start).alias("window_start"),
        F.timestamp_micros(start + policy.length).alias("window_end"),
        "services_included",
        *PAIR_COLUMNS,
        c("_q").alias("window_data_quality_score"),
        "scenario_tag",
        "chaos_suitability",
        "strict_event_count",
        "late_events_within_tolerance",
        "late_discarded_count",
        "total_event_count",
        "covered_pairs",
        r6(missing).alias("missing_ratio"),
        r6(c("_cov")).alias("coverage_ratio"),
        r6(c("_min_ev")).alias("min_event_ratio"),
        r6(c("_late")).alias("late_event_ratio"),
        r6(c("_disc")).alias("late_discard_ratio"),
        "degraded_quality",
        "ordering_broken",
        "ordering_violation_services",
        accepted.alias("accepted_for_training"),
        *[f"activation_{v}_{n}" for n in C.SHORT_NAME.values() for v in ("v1", "v2")],
    )


def metric_series(events: DataFrame, policy: WindowingPolicy, *, span: Column | None = None) -> DataFrame:
    """Ordered readings per window as a child table, one row per (window, reading).

    The readings of a window are left as rows: packing them into one array
    would put a busy service's window into a single record.
    """
    return late_classes(events, policy, span).where(F.col("late_class") != DISCARDED).select(
        F.format_string("temporal_window_%04d", F.col("window_index")).alias("window_id"),
        "service_name",
        "metric_name",
        "ts",
        "sequence_number",
        "metric_value",
        (F.col("late_class") == TOLERATED).alias("within_late_tolerance"),
        F.col("event_id"),
    )


def quality_split(windows: DataFrame, *, min_quality: float = 0.85) -> DataFrame:
    """Add ``eligible``: accepted windows whose quality reaches the training bar."""
    ok = F.coalesce(
        (F.col("window_data_quality_score") >= min_quality) & F.col("accepted_for_training"), F.lit(False)
    )
    return windows.withColumn("eligible", ok)


def proxy_score(latency: Column, error: Column, throughput: Column, r_lat: Column, r_queue: Column) -> Column:
    """Bounded mean of latency, error, throughput and cache pressure (round 6)."""
    # Scale of each component.
    parts = (
        F.least(latency / 400.0, F.lit(1.5))
        + F.least(error / 0.08, F.lit(1.5))
        + clamp((220.0 - throughput) / 220.0)
        + F.least(r_lat / 25.0 + r_queue / 300.0, F.lit(1.5))
    )
    return r6(parts / 4.0)


def service_window_view(events: DataFrame) -> DataFrame:
    """Per given ``window_id`` and API service: metric means with the cache's means beside them.

    The first reading's tags are kept; "first" is by (ts, sequence, event id).
    """
    wid = F.coalesce(F.nullif(F.col("window_id"), F.lit("")), F.lit("no_window"))
    ev = events.withColumn("window_id", wid)

    def mean_of(metric: str) -> Column:
        return F.coalesce(r6(F.avg(F.when(F.col("metric_name") == metric, F.col("metric_value")))), F.lit(0.0))

    first = F.struct("ts", "sequence_number", "event_id")
    api = (
        ev.where(F.col("service_name").isin(*C.API_SERVICES))
        .groupBy("window_id", "service_name")
        .agg(
            F.min("ts").alias("window_start"),
            F.max("ts").alias("window_end"),
            *[mean_of(m).alias(m) for m in C.API_METRICS],
            F.min_by("scenario_tag", first).alias("scenario_tag"),
            F.min_by("chaos_suitability", first).alias("chaos_suitability"),
            F.count_distinct("metric_name").alias("_metrics"),
        )
    )
    cache = (
        ev.where(F.col("service_name") == C.CACHE_SERVICE)
        .groupBy(F.col("window_id").alias("_w"))
        .agg(*[mean_of(m).alias(m) for m in C.CACHE_METRICS])
    )
    out = api.join(cache, F.col("window_id") == F.col("_w"), "left")
    for m in C.CACHE_METRICS:
        out = out.withColumn(m, F.coalesce(m, F.lit(0.0)))
    return out.select(
        "window_id",
        "service_name",
        "window_start",
        "window_end",
        *C.API_METRICS,
        *C.CACHE_METRICS,
        proxy_score(*[F.col(m) for m in C.API_METRICS + C.CACHE_METRICS]).alias("iforest_score"),
        "scenario_tag",
        "chaos_suitability",
        r6(F.least(F.col("_metrics") / 3.0, F.lit(1.0))).alias("window_data_quality_score"),
    )
