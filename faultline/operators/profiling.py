"""Feature and telemetry profiling: moments, quantiles, correlations, bursts, drift."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.ordinals import BLOCK, with_ordinal
from faultline.functions.quantiles import column_quantiles, long_quantiles, unpivot
from faultline.operators.contracts import value_counts

def feature_stats(df: DataFrame, features: Sequence[str] = C.MODEL_FEATURES) -> DataFrame:
    """(feature, min, mean, std, p05, p50, p95, max); population deviation, linear quantiles."""
    aggs = [F.expr(f"{fn}({f})").alias(f"{f}_{n}") for f in features for n, fn in
            (("min", "min"), ("mean", "avg"), ("std", "stddev_pop"), ("max", "max"))]
    rows = ", ".join(f"'{f}', {f}_min, {f}_mean, {f}_std, {f}_max" for f in features)
    moments = df.agg(*aggs).selectExpr(f"stack({len(features)}, {rows}) as (feature, min, mean, std, max)")
    q = long_quantiles(unpivot(df, [], features), ["metric"], {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return moments.join(q, F.col("feature") == F.col("metric")).drop("metric")


def top_correlations(df: DataFrame, features: Sequence[str] = C.MODEL_FEATURES, *, limit: int = 8) -> DataFrame:
    """Strongest absolute correlations over all column pairs, in one aggregation (0 when constant)."""
    pairs = list(combinations(features, 2))
    aggs = [F.expr(f"coalesce(nanvl(corr({a}, {b}), 0D), 0D)").alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    rows = ", ".join(f"'{a}', '{b}', c{i}" for i, (a, b) in enumerate(pairs))
    out = df.agg(*aggs).selectExpr(f"stack({len(pairs)}, {rows}) as (left_feature, right_feature, pearson)")
    return out.orderBy(F.expr("round(abs(pearson), 9)").desc(), "left_feature", "right_feature").limit(limit)


def strongest_pairs(df: DataFrame, features: Sequence[str], *, limit: int = 10) -> DataFrame:
    """Strongest absolute correlations among many columns; constant columns drop out.

    Pairs of the (fixed) feature list are formed inside each row and combined
    on the map side, so wide feature sets need no wide aggregate.
    """
    items = ", ".join(f"named_struct('f', '{f}', 'v', cast({f} as double))" for f in sorted(features))
    pairs = (
        df.selectExpr(f"array({items}) as a")
        .selectExpr("a", "explode(a) as l")
        .selectExpr("l", "explode(filter(a, x -> x.f > l.f)) as r")
        .groupBy(F.col("l.f").alias("left_feature"), F.col("r.f").alias("right_feature"))
        .agg(F.expr("corr(l.v, r.v)").alias("p"))
        .where("p is not null and not isnan(p)")
    )
    out = pairs.selectExpr("left_feature", "right_feature", "round(p, 6) as pearson", "round(abs(p), 6) as abs_pearson")
    return out.orderBy(F.desc("abs_pearson"), "left_feature", "right_feature").limit(limit)


def in_arrival_order(df: DataFrame, keys: Sequence[str] = ("service_name",)) -> DataFrame:
    """Exact arrival ordinal per key by (generated_at, hash of event id)."""
    return with_ordinal(df, list(keys), F.unix_micros("generated_at"), F.col("event_id"))


def burst_runs(
    df: DataFrame, *, fields: Sequence[str] = C.BURST_AUDIT_FIELDS, min_hits: int = 2, block: int = BLOCK
) -> DataFrame:
    """Per service: samples, burst samples, ratio, number of runs and longest run.

    Runs are found inside blocks of consecutive rows; only runs that touch a
    block edge are then stitched across blocks.
    """
    limits = column_quantiles(df, ["service_name"], fields, {"p95": 0.95})
    hits = " + ".join(f"cast({f} >= {f}_p95 as int)" for f in fields)
    # Rank before the join: the ranking reads its input more than once.
    ordered = in_arrival_order(df.select("service_name", "generated_at", "event_id", *fields))
    rows = ordered.join(F.broadcast(limits.withColumnRenamed("service_name", "_svc")), F.expr("service_name <=> _svc")).selectExpr(
        "service_name", "ordinal", f"ordinal div {block} as blk", f"({hits}) >= {min_hits} as burst"
    )
    totals = rows.groupBy("service_name").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if("burst").alias("burst_samples")
    )
    islands = (
        rows.where("burst")
        .withColumn("isl", F.expr("ordinal - row_number() over (partition by service_name, blk order by ordinal)"))
        .groupBy("service_name", "blk", "isl")
        .agg(F.min("ordinal").alias("a"), F.max("ordinal").alias("b"))
    )
    edge = f"a % {block} = 0 or b % {block} = {block - 1}"
    inner = islands.where(f"not ({edge})").groupBy("service_name").agg(
        F.count(F.lit(1)).alias("runs"), F.expr("max(b - a + 1)").alias("longest")
    )
    # At most two edge runs per block of rows: this table is rows / block in size.
    chain = (
        islands.where(edge)
        .withColumn("new", F.expr("coalesce(cast(a > lag(b) over (partition by service_name order by a) + 1 as int), 1)"))
        .withColumn("run", F.expr("sum(new) over (partition by service_name order by a)"))
        .groupBy("service_name", "run")
        .agg(F.expr("sum(b - a + 1)").alias("len"))
        .groupBy("service_name")
        .agg(F.count(F.lit(1)).alias("runs"), F.max("len").alias("longest"))
    )
    runs = inner.unionByName(chain).groupBy(F.col("service_name").alias("_svc")).agg(
        F.sum("runs").alias("burst_runs"), F.max("longest").alias("max_burst_run")
    )
    return totals.join(runs, F.col("service_name") == F.col("_svc"), "left").selectExpr(
        "service_name", "samples", "burst_samples", "burst_samples / samples as burst_sample_ratio",
        "coalesce(burst_runs, 0L) as burst_runs", "coalesce(max_burst_run, 0L) as max_burst_run",
    )


def drift_summary(df: DataFrame, *, fields: Sequence[str] = C.BURST_AUDIT_FIELDS) -> DataFrame:
    """Per (service, feature): mean of the first and last fifth, difference, relative difference."""
    rows = in_arrival_order(df.select("service_name", "generated_at", "event_id", *fields))
    rows = rows.withColumn("chunk", F.expr("greatest(1, ordinal_count div 5)"))
    aggs = []
    for f in fields:
        aggs.append(F.expr(f"avg(case when ordinal < chunk then {f} end)").alias(f"{f}_e"))
        aggs.append(F.expr(f"avg(case when ordinal >= ordinal_count - chunk then {f} end)").alias(f"{f}_l"))
    stack = ", ".join(f"'{f}', {f}_e, {f}_l" for f in fields)
    out = rows.groupBy("service_name").agg(*aggs).selectExpr(
        "service_name", f"stack({len(fields)}, {stack}) as (feature, early_mean, late_mean)"
    )
    return out.selectExpr(
        "*", "late_mean - early_mean as delta",
        "case when early_mean = 0 then 0D else (late_mean - early_mean) / early_mean end as relative_delta",
    )


def export_profile(df: DataFrame, features: Sequence[str] = C.MODEL_FEATURES) -> DataFrame:
    """(section, item, value): nulls per feature, value counts, first and last time (µs)."""
    facts = [F.expr(f"count_if({f} is null)").alias(f) for f in features]
    rng = [F.expr("unix_micros(min(generated_at))").alias("t0"), F.expr("unix_micros(max(generated_at))").alias("t1")]
    rows = ", ".join(f"'missing', '{f}', {f}" for f in features) + ", 'time', 'first', t0, 'time', 'last', t1"
    head = df.agg(*facts, *rng).selectExpr(f"stack({len(features) + 2}, {rows}) as (section, item, value)")
    return head.unionByName(value_counts(df, ("service_name", "scenario_tag", "telemetry_profile", "source_node")))


def variance_ranking(df: DataFrame, features: Sequence[str]) -> DataFrame:
    long = unpivot(df, [], features).fillna(0.0, ["value"])
    return (
        long.groupBy(F.col("metric").alias("feature"))
        .agg(F.expr("round(coalesce(var_pop(value), 0D), 6)").alias("variance"),
             F.expr("round(coalesce(stddev_pop(value), 0D), 6)").alias("std_dev"))
        .orderBy(F.desc("variance"), "feature")
    )


def signal_contrast(df: DataFrame, features: Sequence[str], *, positive: str = "expected_propagation") -> DataFrame:
    """How far positive and negative rows differ per feature, relative to their size."""
    long = unpivot(df.withColumn("_pos", F.expr(f"coalesce({positive}, false)")), ["_pos"], features)
    m = (
        long.fillna(0.0, ["value"])
        .groupBy(F.col("metric").alias("feature"))
        .agg(F.expr("coalesce(avg(case when _pos then value end), 0D)").alias("p"),
             F.expr("coalesce(avg(case when not _pos then value end), 0D)").alias("n"))
    )
    return m.selectExpr(
        "feature", "round(p, 6) as positive_mean", "round(n, 6) as negative_mean",
        "round(abs(p - n) / greatest(abs(p) + abs(n), 1e-9D), 6) as relative_contrast",
    ).orderBy(F.desc("relative_contrast"), "feature")


def statistical_profile(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, count, mean, std_dev, min, p50, p90, p95, max, zero_ratio), rounded to 6."""
    long = unpivot(df, [], features).fillna(0.0, ["value"])
    m = long.groupBy("metric").agg(
        F.expr("count(1)").alias("count"), F.expr("round(avg(value), 6)").alias("mean"),
        F.expr("round(stddev_pop(value), 6)").alias("std_dev"), F.expr("round(min(value), 6)").alias("min"),
        F.expr("round(max(value), 6)").alias("max"), F.expr("round(count_if(value = 0) / count(1), 6)").alias("zero_ratio"),
    )
    q = long_quantiles(long, ["metric"], {"p50": 0.5, "p90": 0.9, "p95": 0.95}).withColumnRenamed("metric", "_m")
    return m.join(q, F.col("metric") == F.col("_m")).selectExpr(
        "metric as feature", "count", "mean", "std_dev", "min", "round(p50, 6) as p50", "round(p90, 6) as p90",
        "round(p95, 6) as p95", "max", "zero_ratio",
    )

