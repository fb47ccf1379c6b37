"""Score evaluation, threshold calibration and sweeps over one scored table.

Scores are kept to six decimals, so any group has at most about a million
distinct values: exact ranks are read from per-score counts, which combine on
the map side however many rows a group holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.quantiles import column_quantiles, long_quantiles, unpivot
from faultline.functions.scalars import count_at_most, lookup
from faultline.operators.profiling import in_arrival_order

# Default sweep grid and operating criteria.
SWEEP_QUANTILES = (
    0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.92, 0.94, 0.95, 0.96, 0.97, 0.975, 0.98, 0.985, 0.99,
    0.9925, 0.995, 0.9975, 0.999,
)
SWEEP_EXTRA = (0.58,)
MAX_FPR, MAX_SPAN, MIN_TPR = 0.1, 0.08, 0.3
PROFILES = {"sensitivity": 0.12, "balanced": 0.05, "conservative": 0.01}
BURST_FIELDS = ("queue_length", "latency_ms", "http_5xx_rate")


def time_position(df: DataFrame) -> DataFrame:
    """Ordinal per service, progress in [0, 1], drift slice and temporal bucket."""
    out = in_arrival_order(df).withColumnsRenamed(
        {"ordinal": "service_event_index", "ordinal_count": "service_event_count"}
    )
    out = out.withColumn(
        "service_progress",
        F.expr("case when service_event_count > 1 then service_event_index / (service_event_count - 1) else 0D end"),
    )
    return out.withColumns(
        {
            "drift_slice": F.expr(
                "case when service_progress < 0.33 then 'early' when service_progress < 0.66 then 'mid' else 'late' end"
            ),
            "temporal_bucket": F.expr("cast(least(floor(service_progress * 10), 9) as bigint)"),
        }
    )


def burst_proxy(
    df: DataFrame, *, q: float = 0.97, fields: Sequence[str] = BURST_FIELDS, source: DataFrame | None = None
) -> DataFrame:
    """Flag rows at or above their service's nearest-rank quantile in two or more metrics.

    ``source`` may give the same rows before costly derived columns; the limits
    are then read from it.
    """
    limits = column_quantiles(df if source is None else source, ["service_name"], fields, {"lim": q}, mode="nearest")
    limits = limits.withColumnRenamed("service_name", "_svc")
    hits = " + ".join(f"cast({f} >= {f}_lim as int)" for f in fields)
    # One row per service; unless it travels, every row would go to its service's task.
    return df.join(F.broadcast(limits), F.expr("service_name <=> _svc"), "left").select(
        *df.columns, F.expr(hits).alias("burst_proxy_score"), F.expr(f"({hits}) >= 2").alias("burst_proxy")
    )


def analysis_columns(df: DataFrame) -> DataFrame:
    return burst_proxy(time_position(df), source=df)


def score_quantiles(
    hist: DataFrame, keys: Sequence[str], specs: Mapping[str, tuple[float, str]], *, value: str = "anomaly_score",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Exact quantiles from counts per (keys, score); a column per spec (probability, mode).

    ``extra`` aggregates over the same counts join the result in one pass.
    """
    part = ", ".join([f"`{k}`" for k in keys]) or "1"
    ranked = hist.where(F.col(value).isNotNull()).withColumns(
        {
            "_end": F.expr(f"sum(n) over (partition by {part} order by `{value}`)"),
            "_tot": F.expr(f"sum(n) over (partition by {part})"),
        }
    )
    aggs = list(extra)
    for name, (p, mode) in specs.items():
        pos = f"(_tot - 1) * {float(p)!r}D"
        low = f"floor({pos} + 0.5)" if mode == "nearest" else f"floor({pos})"
        high = low if mode == "nearest" else f"least(floor({pos}) + 1, _tot - 1)"
        at = lambda r: f"max(case when _end > {r} and _end - n <= {r} then `{value}` end)"
        w = "0D" if mode == "nearest" else f"max({pos} - floor({pos}))"
        aggs.append(F.expr(f"{at(low)} + ({at(high)} - {at(low)}) * {w}").alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def score_histogram(df: DataFrame, keys: Sequence[str] = (), *, value: str = "anomaly_score") -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def score_summary(df: DataFrame, *, value: str = "anomaly_score") -> DataFrame:
    """min, mean, population std, p05, p50, p95, max of the score."""
    hist = score_histogram(df, value=value)
    specs = {n: (p, "linear") for n, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))}
    both = score_quantiles(hist, [], specs, value=value, extra=[
        F.expr(f"min({value})").alias("min"), F.expr(f"max({value})").alias("max"),
        F.expr(f"sum({value} * n) / sum(n)").alias("mean"), F.expr(f"sum({value} * {value} * n) / sum(n)").alias("m2"),
    ])
    return both.selectExpr("min", "mean", "sqrt(greatest(m2 - mean * mean, 0D)) as std", "p05", "p50", "p95", "max")


# The slices a report breaks the scores down by.
SLICES = (
    ("service_name",),
    ("scenario_tag",),
    ("service_name", "scenario_tag"),
    ("burst_proxy",),
    ("drift_slice",),
    ("service_name", "temporal_bucket"),
)


def slice_summaries(flagged: DataFrame, slices: Sequence[Sequence[str]] = SLICES) -> DataFrame:
    """All slices in one pass: (slice, keys…, row_count, mean, p50, p95, flag_rate).

    Grouping sets run over per-score counts, one shuffle for every slice.
    """
    keys = sorted({k for s in slices for k in s})
    view = flagged.select(
        *[F.col(k).cast("string").alias(k) for k in keys], "anomaly_score", F.col("predicted_flag").cast("int").alias("_f")
    )
    # One entry per slice: its name and its key values, the other keys null.
    entries = ", ".join(
        "named_struct('slice', '{}', {})".format(
            "+".join(s), ", ".join(f"'{k}', {k if k in s else 'cast(null as string)'}" for k in keys)
        )
        for s in slices
    )
    hist = (
        view.groupBy(*keys, "anomaly_score")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_f").alias("hit"), F.count("_f").alias("known"))
        .selectExpr(f"inline(array({entries}))", "anomaly_score", "n", "hit", "known")
        .groupBy("slice", *keys, "anomaly_score")
        .agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"), F.sum("known").alias("known"))
    )
    group = ["slice", *keys]
    specs = {"anomaly_score_p50": (0.5, "linear"), "anomaly_score_p95": (0.95, "nearest")}
    return score_quantiles(hist, group, specs, extra=[
        F.sum("n").alias("row_count"), F.expr("sum(anomaly_score * n) / sum(n)").alias("anomaly_score_mean"),
        F.expr("sum(hit) / nullif(sum(known), 0)").alias("flag_rate"),
    ])


def flag_metrics(flagged: DataFrame) -> DataFrame:
    """One row: overall rate, rates on normal/anomalous/burst/early/late rows, service span."""
    f = "cast(predicted_flag as int)"
    cond = {
        "all": "true", "normal": "scenario_tag = 'normal'", "anom": "scenario_tag = 'anomalous'",
        "burst": "burst_proxy", "early": "drift_slice = 'early'", "late": "drift_slice = 'late'",
    }
    aggs = [F.count(F.lit(1)).alias("rows")]
    for k, c in cond.items():
        aggs += [F.expr(f"sum(case when {c} then {f} end)").alias(f"h_{k}"), F.expr(f"count(case when {c} then {f} end)").alias(f"n_{k}")]
    aggs += [
        F.expr("count_if(burst_proxy)").alias("b_rows"), F.expr("count_if(burst_proxy and scenario_tag = 'anomalous')").alias("b_anom"),
        F.expr("sum(case when drift_slice = 'late' then anomaly_score end)").alias("l_sum"),
        F.expr("count(case when drift_slice = 'late' then anomaly_score end)").alias("l_n"),
    ]
    by_service = flagged.groupBy("service_name").agg(*aggs)
    rate = lambda k: f"sum(h_{k}) / nullif(sum(n_{k}), 0)"
    return by_service.agg(
        F.sum("rows").alias("row_count"),
        F.expr(rate("all")).alias("flag_rate_overall"),
        F.expr(rate("normal")).alias("false_positive_rate_on_normal"),
        F.expr(rate("anom")).alias("true_positive_rate_on_anomalous"),
        F.sum("b_rows").alias("burst_row_count"),
        F.expr(rate("burst")).alias("burst_proxy_flag_rate"),
        F.expr("sum(b_anom) / nullif(sum(b_rows), 0)").alias("burst_anomalous_share"),
        F.expr(rate("early")).alias("early_drift_flag_rate"),
        F.expr(rate("late")).alias("late_drift_flag_rate"),
        F.expr("sum(l_sum) / nullif(sum(l_n), 0)").alias("late_anomaly_score_mean"),
        F.expr("max(h_all / nullif(n_all, 0)) - min(h_all / nullif(n_all, 0))").alias("service_flag_rate_span"),
    )


def flag_global(df: DataFrame, threshold: float | Column) -> DataFrame:
    return df.withColumn("predicted_flag", F.col("anomaly_score") >= threshold)


def flag_by_service(df: DataFrame, thresholds: Mapping[str, float] = C.SERVICE_THRESHOLDS) -> DataFrame:
    """Flags against the service's threshold; null for a service without one."""
    out = df.withColumn("service_threshold", lookup(F.col("service_name"), thresholds))
    return out.withColumn("predicted_flag", F.expr("anomaly_score >= service_threshold"))


def calibrate(df: DataFrame, *, normal_q: float = 0.995, mixed_q: float = 0.98) -> DataFrame:
    """One row: quantile thresholds, the recommended one, and the rates it gives."""
    hist = df.groupBy("scenario_tag", "anomaly_score").agg(F.count(F.lit(1)).alias("n"))
    whole = hist.groupBy("anomaly_score").agg(F.sum("n").alias("n"), F.expr("sum(case when scenario_tag = 'normal' then n end)").alias("nn"))
    mixed = score_quantiles(whole, [], {"v": (mixed_q, "nearest")}).select("v").scalar()
    normal_hist = whole.where("nn is not null").selectExpr("anomaly_score", "nn as n")
    normal = score_quantiles(normal_hist, [], {"v": (normal_q, "nearest")}).select("v").scalar()
    anyway = score_quantiles(whole, [], {"v": (normal_q, "nearest")}).select("v").scalar()
    rated = hist.withColumns({"_a": F.coalesce(normal, anyway), "_m": mixed}).withColumn("_t", F.greatest("_a", "_m"))
    rate = lambda tag: f"sum(case when scenario_tag = '{tag}' and anomaly_score >= _t then n else 0 end) / nullif(sum(case when scenario_tag = '{tag}' then n end), 0)"
    return rated.agg(
        F.max("_a").alias("normal_quantile_threshold"), F.max("_m").alias("mixed_quantile_threshold"),
        F.max("_t").alias("recommended_threshold"), F.expr(rate("normal")).alias("false_positive_rate_on_normal"),
        F.expr(rate("anomalous")).alias("flag_rate_on_anomalous"),
    )


def matched_thresholds(df: DataFrame, *, target_fpr: float = 0.05) -> DataFrame:
    """(scope, threshold) on normal rows: ``*`` for all services, then each service."""
    q = min(max(1.0 - target_fpr, 0.0), 1.0)
    hist = score_histogram(df.where("scenario_tag = 'normal'"), ["service_name"])
    both = hist.selectExpr("explode(array('*', service_name)) as scope", "anomaly_score", "n")
    both = both.groupBy("scope", "anomaly_score").agg(F.sum("n").alias("n"))
    return score_quantiles(both, ["scope"], {"threshold": (q, "nearest")})


def threshold_grid(
    df: DataFrame, *, quantiles: Sequence[float] = SWEEP_QUANTILES, extra: Sequence[float] = SWEEP_EXTRA
) -> DataFrame:
    """Distinct candidate thresholds, ascending."""
    names = [f"q{i}" for i in range(len(quantiles))]
    row = score_quantiles(score_histogram(df), [], {n: (p, "linear") for n, p in zip(names, quantiles)})
    fixed = ", ".join(f"{float(x)!r}D" for x in extra)
    every = ", ".join([*names, fixed] if fixed else names)
    return row.selectExpr(f"explode(array_sort(array_distinct(array({every})))) as threshold")


def threshold_sweep(df: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """Flag metrics for every threshold of the grid in one pass over the scores.

    Without ``grid`` the default one is taken from ``df``; give it when the
    scores can be read more cheaply than ``df`` itself.
    """
    grid = threshold_grid(df) if grid is None else grid
    cuts = grid.agg(F.expr("array_sort(collect_list(threshold))").alias("g")).scalar()
    view = df.select("service_name", "scenario_tag", "burst_proxy", "drift_slice", "anomaly_score").withColumn("_g", cuts)
    counts = (
        view.withColumn("bucket", F.expr(count_at_most("_g", "anomaly_score")))
        .groupBy("service_name", "bucket")
        .agg(
            F.count(F.lit(1)).alias("all"), F.expr("count_if(scenario_tag = 'normal')").alias("normal"),
            F.expr("count_if(scenario_tag = 'anomalous')").alias("anom"), F.expr("count_if(burst_proxy)").alias("burst"),
            F.expr("count_if(drift_slice = 'late')").alias("late"),
        )
        # Joined to the counts: as an aggregate the array would have every row sorted.
        .withColumn("_g", cuts)
    )
    kinds = ("all", "normal", "anom", "burst", "late")
    per_service = (
        counts.selectExpr("*", "posexplode(_g) as (i, threshold)")
        .groupBy("threshold", "service_name")
        .agg(*[F.expr(f"sum(case when bucket > i then `{k}` else 0 end)").alias(f"h_{k}") for k in kinds],
             *[F.sum(k).alias(f"n_{k}") for k in kinds])
    )
    rate = lambda k: F.expr(f"sum(h_{k}) / nullif(sum(n_{k}), 0)")
    return per_service.groupBy("threshold").agg(
        rate("all").alias("flag_rate_overall"), rate("normal").alias("false_positive_rate_on_normal"),
        rate("anom").alias("true_positive_rate_on_anomalous"),
        F.expr("max(h_all / n_all) - min(h_all / n_all)").alias("service_flag_rate_span"),
        rate("burst").alias("burst_proxy_flag_rate"), rate("late").alias("late_drift_flag_rate"),
    )


_FPR = "coalesce(false_positive_rate_on_normal, 0D)"
_TPR = "coalesce(true_positive_rate_on_anomalous, 0D)"
_SPAN = "coalesce(service_flag_rate_span, 0D)"


def recommend_threshold(sweep: DataFrame, *, max_fpr=MAX_FPR, max_span=MAX_SPAN, min_tpr=MIN_TPR) -> DataFrame:
    """One row: the best threshold under the strict criteria, or the reason there is none."""
    ok = f"{_FPR} <= {max_fpr}D and {_SPAN} <= {max_span}D and {_TPR} >= {min_tpr}D"
    best = sweep.agg(
        F.expr(f"min_by(threshold, named_struct('a', -{_TPR}, 'b', {_FPR}, 'c', {_SPAN}, 'd', threshold)) filter (where {ok})").alias("threshold")
    )
    return best.selectExpr(
        "threshold",
        "case when threshold is null then 'no_threshold_met_strict_operating_criteria' else 'strict_operating_criteria' end as reason",
    )


def operating_profiles(sweep: DataFrame, profiles: Mapping[str, float] = PROFILES) -> DataFrame:
    """Per profile: best TPR within its FPR bound, else the threshold nearest that bound."""
    items = ", ".join(f"named_struct('profile', '{p}', 'max_fpr', {v}D)" for p, v in profiles.items())
    rows = sweep.selectExpr("*", f"inline(array({items}))")
    inside = f"{_FPR} <= max_fpr"
    key = (
        f"case when {inside} then named_struct('o', 0, 'a', -{_TPR}, 'b', {_FPR}, 'c', threshold) "
        f"else named_struct('o', 1, 'a', abs({_FPR} - max_fpr), 'b', 0D, 'c', threshold) end"
    )
    pick = lambda c: F.expr(f"min_by({c}, {key})").alias(c)
    cols = ("threshold", "false_positive_rate_on_normal", "true_positive_rate_on_anomalous", "service_flag_rate_span")
    return rows.groupBy("profile", "max_fpr").agg(*[pick(c) for c in cols])


def policy_variants(df: DataFrame, *, global_threshold: float, offset: float) -> DataFrame:
    """Flag metrics of {score, decision} × {global, per service} at a matched false-positive rate.

    The decision score is the raw score minus ``offset``; both variants are
    derived columns of one scored table.
    """
    hit = f"cast(anomaly_score >= {global_threshold}D as int)"
    base = df.where("scenario_tag = 'normal'").agg(F.expr(f"avg({hit})").alias("fpr")).scalar()
    normal = df.where("scenario_tag = 'normal'")
    hist = score_histogram(normal, ["service_name"])
    both = hist.selectExpr("explode(array('*', service_name)) as scope", "anomaly_score", "n")
    both = both.groupBy("scope", "anomaly_score").agg(F.sum("n").alias("n")).withColumn("_p", 1 - base)
    ranked = both.withColumns(
        {
            "_end": F.expr("sum(n) over (partition by scope order by anomaly_score)"),
            "_rank": F.expr("floor((sum(n) over (partition by scope) - 1) * _p + 0.5)"),
        }
    )
    limits = ranked.groupBy("scope").agg(
        F.expr("max(case when _end > _rank and _end - n <= _rank then anomaly_score end)").alias("t")
    )
    table = limits.agg(F.expr("map_from_entries(collect_list(struct(scope, t)))").alias("m")).scalar()
    view = df.withColumn("_t", table).withColumn("decision", F.expr(f"-(raw_score - ({offset}D))"))
    variants = (
        ("score_samples", "global", f"anomaly_score >= {global_threshold}D"),
        ("score_samples", "service_specific", "anomaly_score >= try_element_at(_t, service_name)"),
        ("decision_function", "global", f"round(decision, 9) >= round(try_element_at(_t, '*') + ({offset}D), 9)"),
        ("decision_function", "service_specific", f"round(decision, 9) >= round(try_element_at(_t, service_name) + ({offset}D), 9)"),
    )
    items = ", ".join(f"named_struct('score_policy', '{p}', 'threshold_mode', '{m}', 'hit', cast({e} as int))" for p, m, e in variants)
    by_service = (
        view.selectExpr("service_name", "scenario_tag", f"inline(array({items}))")
        .groupBy("score_policy", "threshold_mode", "service_name")
        .agg(
            F.expr("sum(hit)").alias("h"), F.expr("count(hit)").alias("n"),
            F.expr("sum(case when scenario_tag = 'normal' then hit end)").alias("hn"), F.expr("count(case when scenario_tag = 'normal' then hit end)").alias("nn"),
            F.expr("sum(case when scenario_tag = 'anomalous' then hit end)").alias("ha"), F.expr("count(case when scenario_tag = 'anomalous' then hit end)").alias("na"),
        )
    )
    out = by_service.groupBy("score_policy", "threshold_mode").agg(
        F.expr("sum(h) / sum(n)").alias("flag_rate_overall"), F.expr("sum(hn) / nullif(sum(nn), 0)").alias("false_positive_rate_on_normal"),
        F.expr("sum(ha) / nullif(sum(na), 0)").alias("true_positive_rate_on_anomalous"),
        F.expr("max(h / n) - min(h / n)").alias("service_flag_rate_span"),
    )
    # Four rows: the ranking window below is over them only.
    return out.withColumn(
        "best_span", F.expr("row_number() over (order by round(service_flag_rate_span, 9), score_policy desc, threshold_mode) = 1")
    )


OUTLIER_COLUMNS = (
    "event_id", "generated_at", "service_name", "scenario_tag", "anomaly_score", "latency_ms", "queue_length", "http_5xx_rate",
)


def top_outliers(df: DataFrame, n: int = 20, columns: Sequence[str] = OUTLIER_COLUMNS) -> DataFrame:
    return df.select(*columns).orderBy(F.desc("anomaly_score"), "event_id").limit(n)


def top_outliers_per_service(df: DataFrame, n: int = 12, columns: Sequence[str] = OUTLIER_COLUMNS) -> DataFrame:
    """The ranking filter lets Spark keep only ``n`` rows per service before the shuffle."""
    rank = F.expr("row_number() over (partition by service_name order by anomaly_score desc, event_id)")
    return df.select(*columns).withColumn("rank", rank).where(F.col("rank") <= n)


def score_bins(df: DataFrame, *, bins: int = 24, keys: Sequence[str] = ("service_name", "scenario_tag")) -> DataFrame:
    """Counts per key and equal-width bin over the whole score range; the last bin is closed."""
    hist = score_histogram(df, list(keys))
    span = hist.agg(F.expr("struct(min(anomaly_score) as lo, max(anomaly_score) as hi)").alias("s")).scalar()
    width = f"(_s.hi - _s.lo) / {bins}"
    bin_no = f"case when _s.hi = _s.lo then {bins - 1} else least(floor((anomaly_score - _s.lo) / ({width})), {bins - 1}) end"
    return hist.withColumn("_s", span).withColumn("bin", F.expr(f"cast({bin_no} as bigint)")).groupBy(*keys, "bin").agg(F.sum("n").alias("rows"))


def cycle_table(flagged: DataFrame) -> DataFrame:
    """Per (temporal bucket, service): rows, flag rate, mean score, TPR, FPR."""
    f = "cast(predicted_flag as int)"
    return flagged.groupBy("temporal_bucket", "service_name").agg(
        F.count(F.lit(1)).alias("row_count"), F.expr(f"avg({f})").alias("flag_rate"),
        F.avg("anomaly_score").alias("anomaly_score_mean"),
        F.expr(f"avg(case when scenario_tag = 'anomalous' then {f} end)").alias("tpr_anomalous"),
        F.expr(f"avg(case when scenario_tag = 'normal' then {f} end)").alias("fpr_normal"),
    )


def cycle_summary(cycles: DataFrame) -> DataFrame:
    return cycles.groupBy("temporal_bucket").agg(
        F.count(F.lit(1)).alias("service_count"), F.avg("flag_rate").alias("mean_flag_rate"),
        F.expr("max(flag_rate) - min(flag_rate)").alias("service_span"), F.avg("tpr_anomalous").alias("mean_tpr_anomalous"),
        F.avg("fpr_normal").alias("mean_fpr_normal"),
    )


def persistence_summary(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.avg("service_span").alias("mean_service_span"), F.max("service_span").alias("max_service_span"),
        F.avg("mean_tpr_anomalous").alias("mean_tpr_anomalous"), F.avg("mean_fpr_normal").alias("mean_fpr_normal"),
    )


def decision_slices(signals: DataFrame) -> DataFrame:
    """Per (service, scenario): count, candidate and flag %, mean score, margin mean/p50/p95."""
    v = signals.withColumn("margin", F.expr("round(anomaly_score - service_threshold, 6)"))
    keys = ["service_name", "scenario_tag"]
    hist = v.groupBy(*keys, "margin").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("candidate_flag").alias("cand"), F.count_if("anomaly_flag").alias("flag"),
        F.sum("anomaly_score").alias("score"),
    )
    specs = {"p50_margin": (0.5, "linear"), "p95_margin": (0.95, "linear")}
    q = score_quantiles(hist, keys, specs, value="margin", extra=[
        F.sum("n").alias("row_count"), F.expr("100 * sum(cand) / sum(n)").alias("candidate_rate_pct"),
        F.expr("100 * sum(flag) / sum(n)").alias("flag_rate_pct"), F.expr("sum(score) / sum(n)").alias("avg_score"),
        F.expr("sum(margin * n) / sum(n)").alias("avg_margin"), F.sum("cand").alias("_c"), F.sum("flag").alias("_f"),
    ])
    return q.selectExpr(
        *keys, "row_count", "candidate_rate_pct", "flag_rate_pct", "avg_score", "avg_margin", "p50_margin", "p95_margin",
        "case when scenario_tag = 'anomalous' then row_count - _f else 0 end as false_negatives",
        "case when scenario_tag = 'normal' then _f else 0 end as false_positives",
        "case when scenario_tag = 'anomalous' then row_count - _c else 0 end as candidate_misses",
    )


def decision_features(signals: DataFrame, features: Sequence[str] = C.MODEL_FEATURES) -> DataFrame:
    """(scenario, service, feature, mean, p50, p95) of the decision's telemetry."""
    long = unpivot(signals, ["scenario_tag", "service_name"], features)
    keys = ["scenario_tag", "service_name", "metric"]
    m = long.groupBy(*keys).agg(F.avg("value").alias("mean"))
    q = long_quantiles(long, keys, {"p50": 0.5, "p95": 0.95}).withColumnsRenamed({k: f"_{k}" for k in keys})
    return m.join(q, F.expr(" and ".join(f"{k} <=> _{k}" for k in keys))).select(*keys, "mean", "p50", "p95").withColumnRenamed("metric", "feature")


def decision_counts(signals: DataFrame) -> DataFrame:
    """(service, scenario, kind, item, rows): reason codes and status codes."""
    items = (
        "concat(transform(reason_codes, r -> struct('reason' as kind, r as item)), "
        "array(struct('status' as kind, cast(status_code as string) as item)))"
    )
    return signals.selectExpr("service_name", "scenario_tag", f"inline({items})").groupBy(
        "service_name", "scenario_tag", "kind", "item"
    ).agg(F.count(F.lit(1)).alias("rows"))


def decision_examples(signals: DataFrame, n: int = 5) -> DataFrame:
    """Per service the highest-scoring missed anomalies and false alarms."""
    kind = (
        "case when scenario_tag = 'anomalous' and not anomaly_flag then 'false_negative' "
        "when scenario_tag = 'normal' and anomaly_flag then 'false_positive' end"
    )
    rank = F.expr("row_number() over (partition by service_name, kind order by anomaly_score desc, event_id)")
    return (
        signals.withColumn("kind", F.expr(kind)).where("kind is not null")
        .select("service_name", "kind", "event_id", "anomaly_score").withColumn("rank", rank).where(F.col("rank") <= n)
    )
