"""Row labelling, residual anomaly control and dataset reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.ordinals import with_ordinal

# Weight of each metric in the stress score.
STRESS_WEIGHTS = {
    "cpu_pct": 1.0,
    "latency_ms": 1.3,
    "queue_length": 1.3,
    "http_5xx_rate": 1.2,
    "net_error_rate": 1.0,
    "throughput_rate": -0.8,
}


def stress_score(df: DataFrame, weights: Mapping[str, float] = STRESS_WEIGHTS) -> DataFrame:
    """Weighted sum of z-scores within each service's rows (sample deviation, 0 when constant)."""
    aggs = []
    for c in weights:
        aggs += [F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}")]
    stats = df.groupBy(F.col("service_name").alias("_svc")).agg(*aggs)
    terms = " + ".join(
        f"coalesce(case when _s_{c} > 0 then ({c} - _m_{c}) / _s_{c} end, 0D) * {w}D" for c, w in weights.items()
    )
    # One row per service; unless it travels, every row would go to its service's task.
    return df.join(F.broadcast(stats), F.expr("service_name <=> _svc")).select(*df.columns, F.expr(terms).alias("stress_score"))


def residual_quota(df: DataFrame, *, target_rate: float, minimum_count: int, balanced: bool = True) -> DataFrame:
    """(service_name, quota): how many normal rows of each service to relabel.

    Works on one row per service; the windows below run over that table only.
    """
    per = df.groupBy("service_name").agg(F.count(F.lit(1)).alias("n"), F.expr("count_if(scenario_tag = 'anomalous')").alias("bad"))
    t = per.selectExpr(
        "*", "sum(n) over () as total", "sum(bad) over () as bad_total", "count(1) over () as k",
        "row_number() over (order by service_name) as i",
    ).selectExpr(
        "*", f"greatest(0L, greatest(cast(bround(total * {float(target_rate)}D) as bigint), {int(minimum_count)}L) - bad_total) as needed"
    )
    if balanced:
        return t.selectExpr("service_name", "needed div k + case when i <= needed % k then 1 else 0 end as quota")
    share = t.selectExpr("*", "cast(bround(needed * (n / total)) as bigint) as share")
    return share.selectExpr(
        "service_name",
        "case when i = k then needed - coalesce(sum(share) over (order by i rows between unbounded preceding and 1 preceding), 0) else share end as quota",
    )


def residual_control(
    df: DataFrame, *, target_rate: float = 0.004, minimum_count: int = 0, balanced: bool = True
) -> DataFrame:
    """Relabel the most stressed normal rows until the anomalous share is reached."""
    quota = residual_quota(df, target_rate=target_rate, minimum_count=minimum_count, balanced=balanced)
    normal = stress_score(df.where("scenario_tag = 'normal'"))
    ranked = with_ordinal(normal, ["service_name"], -F.round("stress_score", 9), F.col("event_id"))
    q = quota.withColumnRenamed("service_name", "_svc")
    picked = ranked.join(F.broadcast(q), F.expr("service_name <=> _svc"), "left").withColumn("_hit", F.expr("ordinal < coalesce(quota, 0)"))
    changed = {
        "scenario_tag": "case when _hit then 'anomalous' else scenario_tag end",
        "status_code": "case when _hit and status_code = 200 then 429 else status_code end",
        "http_5xx_rate": "case when _hit then least(greatest(http_5xx_rate, 0D), 5.5D) + 0.12D else http_5xx_rate end",
        "net_error_rate": "case when _hit then net_error_rate + 0.03D else net_error_rate end",
    }
    out = picked.select(*[F.expr(changed[c]).alias(c) if c in changed else F.col(c) for c in df.columns], F.col("_hit").alias("relabelled"))
    rest = df.where("not (scenario_tag <=> 'normal')").withColumn("relabelled", F.lit(False))
    return out.unionByName(rest)


def label_rows(df: DataFrame, profiles: Mapping[str, Mapping[str, float | bool]]) -> DataFrame:
    """Label rows by their profile's limits.

    Expects ``scenario_intensity`` and ``burst_active``; ``profiles`` maps a
    telemetry profile to its limits and switches.
    """
    rows = [
        (p, bool(v["force_on_intensity"]), bool(v["label_bursts"]), float(v["http_5xx"]), float(v["queue"]), float(v["latency"]))
        for p, v in profiles.items()
    ]
    values = ", ".join(f"('{p}', {str(a).lower()}, {str(b).lower()}, {x}D, {y}D, {z}D)" for p, a, b, x, y, z in rows)
    limits = df.sparkSession.sql(
        f"select * from values {values} as t(_profile, _force, _bursts, _http, _queue, _latency)"
    )
    hit = (
        "coalesce((_force and scenario_intensity > 0) or (_bursts and burst_active) or http_5xx_rate >= _http "
        "or queue_length >= _queue or latency_ms >= _latency, false)"
    )
    j = df.join(F.broadcast(limits), F.col("telemetry_profile") == F.col("_profile"), "left")
    label = F.expr(f"case when {hit} then 'anomalous' else 'normal' end")
    keep = [c for c in df.columns if c != "scenario_tag"]
    return j.select(*keep, label.alias("scenario_tag"))


def dataset_report(df: DataFrame, features: Sequence[str] = C.MODEL_FEATURES) -> DataFrame:
    """(section, item, value): counts and shares per scenario and service, min and mean per feature."""
    counts = (
        df.selectExpr("stack(2, 'service', service_name, 'scenario', scenario_tag) as (section, item)")
        .groupBy("section", "item")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    shares = counts.withColumn("_total", total).selectExpr(
        "explode(filter(array(named_struct('section', concat(section, '_count'), 'item', item, 'value', cast(n as double)), "
        "case when section = 'scenario' then named_struct('section', 'scenario_share', 'item', item, 'value', round(n / _total, 6)) end), x -> x is not null)) as r"
    ).select("r.*")
    aggs = [F.expr(f"{fn}({f})").alias(f"{f}_{fn}") for f in features for fn in ("min", "avg")]
    rows = ", ".join(f"'feature_min', '{f}', {f}_min, 'feature_mean', '{f}', {f}_avg" for f in features)
    stats = df.agg(*aggs).selectExpr(f"stack({2 * len(features)}, {rows}) as (section, item, value)")
    return shares.unionByName(stats)
