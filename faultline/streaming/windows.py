"""Quality-graded windows on a stream, with late classes, watermark, deduplication and sequence order.

Events are first reduced to short blocks per service, which no window border
cuts; a block's readings are ordered when the watermark closes it, and give its
breaks, its first and its last sequence number.  Windows are then built from
closed blocks alone, so their state is a few rows per block whatever the event
rate.  Both steps are keyed by time, so work spreads with the blocks.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.scalars import micros, r6
from faultline.operators.windows import WindowingPolicy, _crossed, grade_windows, pair_column

_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
BLOCKS_A_STRIDE = 16


def _block_width(policy: WindowingPolicy) -> int:
    """Microseconds of a block: a part of the stride that ends at every border of a window."""
    whole = math.gcd(policy.stride, policy.length, policy.tolerance) if policy.tolerance else math.gcd(policy.stride, policy.length)
    parts = max(1, -(-BLOCKS_A_STRIDE * whole // policy.stride))
    while whole % parts:
        parts += 1
    return whole // parts


def stream_blocks(events: DataFrame, policy: WindowingPolicy, anchor_us: int) -> DataFrame:
    """One row per block and service, in append mode: counts, sums and crossings per metric, and the order of its readings."""
    width = _block_width(policy)
    block = F.window("ts", f"{width} microseconds", startTime=f"{anchor_us % width} microseconds")
    us = micros(F.col("ts"))
    rows = events.where(us >= anchor_us).withColumns({
        "_reading": F.struct(us.alias("at"), F.col("sequence_number").alias("seq")),
        "_v1": F.when(_crossed(0.0), us), "_v2": F.when(_crossed(C.ERROR_RATE_FLOOR), us),
    })
    metrics = sorted({m for _, m in C.EXPECTED_PAIRS})
    aggs = [
        F.count(F.lit(1)).alias("n"), F.collect_list("_reading").alias("readings"), F.min("_v1").alias("cross_v1"), F.min("_v2").alias("cross_v2"),
        F.min("scenario_tag").alias("scenario_tag"), F.min("chaos_suitability").alias("chaos_suitability"),
    ]
    for m in metrics:
        here = f"metric_name = '{m}'"
        aggs += [F.expr(f"count_if({here})").alias(f"n_{m}"), F.expr(f"sum(case when {here} then metric_value end)").alias(f"t_{m}")]
    made = rows.groupBy(block.alias("block"), "service_name").agg(*aggs).withColumn("readings", F.array_sort("readings"))
    rises = "forall(sequence(1, n), i -> get(readings, i - 1).seq is not null and (i = 1 or get(readings, i - 1).seq > get(readings, i - 2).seq))"
    return made.withColumns({
        "broken": F.expr(f"not coalesce({rises.replace('sequence(1, n)', 'sequence(1, cast(n as int))')}, false)"),
        "first": F.expr("array_min(transform(filter(readings, r -> r.at = readings[0].at), r -> r.seq))"),
        "last": F.expr("array_max(transform(filter(readings, r -> r.at = element_at(readings, -1).at), r -> r.seq))"),
    }).drop("readings")


def stream_windows(
    events: DataFrame, policy: WindowingPolicy, *, anchor: dt.datetime | int, delay: str | None = None, deduplicate: bool = True
) -> DataFrame:
    """Graded windows in append mode; a window is emitted once nothing can reach it any more.

    ``anchor`` (a time, or microseconds since 1970) takes the place of the first
    event, which a stream cannot know; earlier events are dropped.
    Windows reach past their end by the larger of stride and tolerance, so late
    classes fall out of the offset inside the window.  All columns equal those of
    the batch form once a window is closed.
    """
    if isinstance(anchor, dt.datetime):
        anchor = round((anchor.replace(tzinfo=anchor.tzinfo or dt.timezone.utc) - _EPOCH) / dt.timedelta(microseconds=1))
    anchor_us = int(anchor)
    late = events.withWatermark("ts", delay or f"{policy.tolerance_s} seconds")
    if deduplicate:
        late = late.dropDuplicatesWithinWatermark(["event_id"])
    blocks = stream_blocks(late, policy, anchor_us)
    start = f"{anchor_us % policy.stride} microseconds"
    w = F.window(F.window_time("block"), f"{policy.reach} microseconds", f"{policy.stride} microseconds", start)
    placed = blocks.withColumn("_from", micros(F.col("block.start"))).withColumn("_w", w).withColumn("_s", micros(F.col("_w.start")))
    into = "(_from - _s)"
    placed = placed.withColumn(
        "late_class",
        F.expr(
            f"case when {into} < {policy.length} then 'strict' when {into} < {policy.length + policy.tolerance} then 'tolerated' "
            f"when {into} < {policy.length + policy.stride} then 'discarded' end"
        ),
    ).where(f"late_class is not null and _s >= {anchor_us}")
    kept = "late_class <> 'discarded'"
    aggs = [
        F.expr("coalesce(sum(case when late_class = 'strict' then n end), 0)").alias("strict_event_count"),
        F.expr("coalesce(sum(case when late_class = 'tolerated' then n end), 0)").alias("late_events_within_tolerance"),
        F.expr("coalesce(sum(case when late_class = 'discarded' then n end), 0)").alias("late_discarded_count"),
        F.expr(f"min(case when {kept} then scenario_tag end)").alias("scenario_tag"),
        F.expr(f"min(case when {kept} then chaos_suitability end)").alias("chaos_suitability"),
        F.expr(f"collect_list(case when {kept} then struct(service_name as service, _from as at, broken, first, last) end)").alias("_blocks"),
    ]
    covered, services = [], []
    for s, m in C.EXPECTED_PAIRS:
        here = f"service_name = '{s}' and {kept}"
        mean = f"try_divide(sum(case when {here} then t_{m} end), sum(case when {here} then n_{m} end))"
        aggs.append(r6(F.expr(mean)).alias(pair_column(s, m)))
        aggs.append(F.expr(f"max(case when service_name = '{s}' and late_class = 'strict' and n_{m} > 0 then 1 else 0 end)").alias(f"_c_{s}_{m}"))
        covered.append(f"`_c_{s}_{m}`")
    for s in C.ALL_SERVICES:
        aggs.append(F.expr(f"max(case when service_name = '{s}' and {kept} then '{s}' end)").alias(f"_s_{s}"))
        services.append(f"`_s_{s}`")
        for v in ("v1", "v2"):
            aggs.append(F.expr(f"min(case when service_name = '{s}' and {kept} then cross_{v} end)").alias(f"activation_{v}_{C.SHORT_NAME[s]}"))
    wide = placed.groupBy("_w").agg(*aggs).withColumn("_blocks", F.array_sort("_blocks"))
    # Blocks of a service are neighbours in the sorted list; a fall between two of them breaks the order too.
    falls = "(b.broken or (i > 0 and get(_blocks, i - 1).service = b.service and coalesce(b.first <= get(_blocks, i - 1).last, false)))"
    violations = f"array_distinct(transform(filter(transform(_blocks, (b, i) -> struct(b.service as service, {falls} as hit)), x -> x.hit), x -> x.service))"
    wide = wide.selectExpr(
        "*", f"(unix_micros(_w.start) - {anchor_us}) div {policy.stride} as window_index", f"{anchor_us} as anchor_us",
        f"cast({' + '.join(covered)} as bigint) as covered_pairs", f"array_sort(filter(array({', '.join(services)}), x -> x is not null)) as services_included",
        f"{violations} as ordering_violation_services",
    )
    return grade_windows(wide, policy, n_expected=len(C.EXPECTED_PAIRS))
