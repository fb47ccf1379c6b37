"""Detector signals in batch form: thresholds, persistent flags, reasons, freshness.

The streaming form in :mod:`faultline.streaming.detector` gives the same
columns; batch replays are its test oracle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from faultline import constants as C
from faultline.functions.ordinals import GROUP, SLICE_ROWS, dealt, group_offsets, sliced, tie_key
from faultline.functions.scalars import lookup

BUFFER = 32


def buffer_size(min_flag_window: int = C.MIN_FLAG_WINDOW, buffer: int = BUFFER) -> int:
    return max(buffer, 4 * min_flag_window)


def candidate_flags(df: DataFrame, thresholds: Mapping[str, float] = C.SERVICE_THRESHOLDS) -> DataFrame:
    """Threshold per row and its breach; an unknown service gets the largest threshold."""
    limit = F.coalesce(lookup(F.col("service_name"), thresholds), F.lit(max(thresholds.values())))
    return df.withColumn("service_threshold", limit).withColumn(
        "candidate_flag", F.expr("anomaly_score >= service_threshold")
    )


def reason_codes(fill: Column, persistent: Column, candidate: Column, m: int) -> Column:
    # Reason codes.
    pick = lambda *codes: F.array(*[F.lit(c) for c in codes])
    return (
        F.when(fill < m, pick("stabilizing_window"))
        .when(persistent, pick("service_threshold_breach", "persistent_window"))
        .when(candidate, pick("service_threshold_breach", "awaiting_window_confirmation"))
        .otherwise(pick("within_expected_range"))
    )


def with_decision(df: DataFrame, m: int) -> DataFrame:
    """Labels, reasons and freshness from fill, flags and times (shared with the stream)."""
    fresh = "greatest(0D, (unix_micros(scored_at) - unix_micros(generated_at)) / 1000D)"
    return df.withColumns(
        {
            "reason_codes": reason_codes(F.col("window_fill"), F.col("anomaly_flag"), F.col("candidate_flag"), m),
            "iforest_label": F.expr("case when anomaly_flag then 'anomalous' else 'normal' end"),
            "decision_freshness_ms": F.expr(f"round({fresh}, 6)"),
            "anomaly_score": F.round("anomaly_score", 6),
            "service_threshold": F.round("service_threshold", 6),
            "min_flag_window": F.lit(m),
        }
    )


def detector_signals(
    df: DataFrame,
    *,
    thresholds: Mapping[str, float] = C.SERVICE_THRESHOLDS,
    min_flag_window: int = C.MIN_FLAG_WINDOW,
    buffer: int = BUFFER,
    block: int = SLICE_ROWS,
    keys: tuple[str, ...] = ("service_name",),
) -> DataFrame:
    """One decision per scored row, looking back over the service's last flags.

    Rows are dealt out once, by service and a slice of the time line of about
    ``block`` rows, so no task holds a whole service; every slice starts from the
    last flags before it, which travel in a table of a row per slice.
    """
    out = signals_after(df, None, thresholds=thresholds, min_flag_window=min_flag_window, buffer=buffer, block=block, keys=keys)
    return out.drop("ordinal_count")


def signals_after(
    df: DataFrame,
    before: DataFrame | None,
    *,
    thresholds: Mapping[str, float] = C.SERVICE_THRESHOLDS,
    min_flag_window: int = C.MIN_FLAG_WINDOW,
    buffer: int = BUFFER,
    block: int = SLICE_ROWS,
    keys: tuple[str, ...] = ("service_name",),
) -> DataFrame:
    """:func:`detector_signals` of rows that arrive after those of ``before``, with their ``ordinal`` and ``ordinal_count``.

    ``before`` holds the last flags of each key (keys, candidate_flag, place
    from 0), as :func:`last_flags` gives them; ordinals count on from there.
    """
    limit = buffer_size(min_flag_window, buffer)
    rows = candidate_flags(df, thresholds)
    when = F.unix_micros("generated_at")
    if before is not None:
        # Kept flags come before every row, in their own order.
        rows = rows.withColumns({"_when": when, "_old": F.lit(False)}).unionByName(
            before.select(*keys, "candidate_flag", (F.col("place") - F.lit(1 << 62)).alias("_when"), F.lit(True).alias("_old")), allowMissingColumns=True
        )
        when = F.col("_when")
    flag = F.coalesce(F.col("candidate_flag").cast("int"), F.lit(-1))  # unknown ones take a place and count as none
    keyed = sliced(rows, keys, when, F.col("event_id"), slice_rows=block)
    table = group_offsets(keyed, "ordinal_count").join(_flags_before(keyed, when, flag, limit - 1), list(GROUP), "left")
    # Rows of one id and instant stand by their flags, here and in the table of flags before.
    in_group = W.partitionBy(*GROUP).orderBy(when, "_tie", F.col("event_id"), "_flag")
    out = dealt(keyed, F.col("event_id")).withColumn("_flag", flag).withColumn("_rn", F.row_number().over(in_group) - 1)
    for name, width in (("_m", min_flag_window), ("_n", limit)):
        frame = in_group.rowsBetween(1 - width, 0)
        out = out.withColumn(name, F.struct(F.count_if(F.col("_flag") == 1).over(frame).alias("hits"), F.count_if(F.col("_flag") >= 0).over(frame).alias("known")))
    out = out.join(table, list(GROUP), "left").withColumn("ordinal", F.expr("cast(_rn + _off as long)"))
    for name, width in (("_m", min_flag_window), ("_n", limit)):
        # The newest flags before the group, as many as the frame still lacks.
        lacks = f"least({width - 1} - _rn, size(_block_flags))"
        more = f"case when _rn < {width - 1} and size(_block_flags) > 0 then slice(_block_flags, 1 + size(_block_flags) - {lacks}, {lacks}) end"
        out = out.withColumn("_more", F.expr(more)).withColumn(
            name, F.expr(f"named_struct('hits', {name}.hits + coalesce(size(filter(_more, x -> x = 1)), 0), 'known', {name}.known + coalesce(size(filter(_more, x -> x >= 0)), 0))")
        )
    out = out.withColumns(
        {
            "window_fill": F.expr(f"cast(least(ordinal + 1, {min_flag_window}) as int)"),
            "window_size": F.expr(f"cast(least(ordinal + 1, {limit}) as int)"),
            "_hits": F.expr("case when _m.known > 0 then _m.hits end"),
            "service_candidate_rate": F.expr("case when _n.known > 0 then _n.hits / _n.known end"),
        }
    )
    if before is not None:
        out = out.where("not _old")
    out = out.withColumn("anomaly_flag", F.expr(f"window_fill >= {min_flag_window} and _hits = {min_flag_window}"))
    return with_decision(out, min_flag_window).drop(*GROUP, "_tie", "_rn", "_flag", "_m", "_n", "_more", "_off", "_block_flags", "_hits", "_when", "_old")


def _flags_before(keyed: DataFrame, when: Column, flag: Column, back: int) -> DataFrame:
    """``GROUP`` and ``_block_flags``: the last ``back`` flags of the key before the group, oldest first.

    Every task cuts a group to its last ``back`` rows before anything is shuffled.
    """
    newest = W.partitionBy(*GROUP).orderBy(F.desc("_w"), F.desc("_t"), F.desc("_f"))
    kept = keyed.select(*GROUP, when.alias("_w"), F.unhex(tie_key(F.col("event_id"))).alias("_t"), flag.alias("_f"))
    kept = kept.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= back)
    # A group's last rows are all kept, so the last ``back`` kept rows up to its end stand without a gap.
    upto = W.partitionBy("_key").orderBy("_slice", "_sub", F.desc("_r")).rowsBetween(1 - back, 0)
    ends = kept.withColumn("_upto", F.collect_list("_f").over(upto)).where("_r = 1")
    return ends.select(*GROUP, F.lag("_upto").over(W.partitionBy("_key").orderBy("_slice", "_sub")).alias("_block_flags"))


def last_flags(signals: DataFrame, before: DataFrame | None, limit: int, keys: tuple[str, ...] = ("service_name",)) -> DataFrame:
    """(keys, candidate_flag, place): the last ``limit`` flags of each key after these signals, which carry their ordinals."""
    kept = signals.where(F.col("ordinal") >= F.col("ordinal_count") - limit).select(*keys, "candidate_flag", F.col("ordinal").alias("place"))
    if before is not None:
        kept = kept.unionByName(before.select(*keys, "candidate_flag", "place"))
    over = "over (partition by " + ", ".join(keys) + ")"
    last = kept.withColumn("_n", F.expr(f"max(place) {over} + 1")).where(F.col("place") >= F.col("_n") - limit)
    return last.select(*keys, "candidate_flag", F.expr(f"place - greatest(_n - {limit}, 0)").alias("place"))


def freshness_summary(signals: DataFrame) -> DataFrame:
    """Per service and overall (``*``): decisions, mean and largest freshness."""
    return (
        signals.selectExpr("explode(array('*', service_name)) as scope", "decision_freshness_ms as f")
        .groupBy("scope")
        .agg(F.count(F.lit(1)).alias("decisions"), F.count("f").alias("with_freshness"),
             F.avg("f").alias("mean_freshness_ms"), F.max("f").alias("max_freshness_ms"))
    )
