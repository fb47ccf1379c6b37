"""Exact grouped quantiles without holding a group's values in one task.

Pass one sketches a narrow bracket around every wanted rank.  Pass two counts
the rows below each bracket and gathers the distinct values inside it, both
combined on the map side.  The wanted ranks are then read off the few bracket
values.  The rows between two brackets keep their count and both end values, so
the ranks next to a bracket are known too and small groups need no path of their
own.  The sketch error is far smaller than the bracket, and a rank that falls
outside all of this raises instead of returning a wrong value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ACCURACY = 50_000
MARGIN = 0.0002


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long form (keys, metric, value) of double columns, without a shuffle."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    return df.selectExpr(*[f"`{k}`" for k in keys], f"stack({len(columns)}, {pairs}) as (metric, value)")


def long_quantiles(
    long: DataFrame,
    keys: Sequence[str],
    probs: Mapping[str, float],
    *,
    mode: str = "linear",
    accuracy: int = ACCURACY,
    margin: float = MARGIN,
    few: bool = True,
) -> DataFrame:
    """One row per key with a column per named probability.

    ``mode`` is ``linear`` (interpolated) or ``nearest`` (value at the rounded
    rank).  Null values are ignored; NaN ranks above every number.  Without keys
    and without values the one row holds nulls; a key without values has no row.
    ``few`` keys (services, scenarios, metrics) have their brackets sent to the rows, which
    would else all meet in their key's task; say no where keys grow with the rows.
    """
    if mode not in ("linear", "nearest"):
        raise ValueError(f"unknown quantile mode: {mode}")
    keys = list(keys)
    names = list(probs)
    data = long.where(F.col("value").isNotNull())
    edges = []
    for name in names:
        p = probs[name]
        edges += [max(p - margin, 0.0), min(p + margin, 1.0)]
    sketch = data.groupBy(*keys).agg(
        F.percentile_approx("value", F.array(*[F.lit(e) for e in edges]), accuracy).alias("_b"),
    )
    lows, highs = [], []
    for i, name in enumerate(names):
        at_start, at_end = probs[name] - margin <= 0, probs[name] + margin >= 1
        bottom, top = F.lit(float("-inf")), F.lit(float("nan"))  # NaN ranks above every number
        lows.append(bottom if at_start else F.col("_b")[2 * i])
        highs.append(top if at_end else F.col("_b")[2 * i + 1])
    plan = sketch.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.struct(F.array(*lows).alias("lo"), F.array(*highs).alias("hi")).alias("_t"),
    )
    if keys:
        cond = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        hit = data.join(F.broadcast(plan) if few else plan, cond, "inner").select(*keys, "value", "_t")
    else:
        hit = data.withColumn("_t", plan.select("_t").scalar())

    # A value inside some bracket keeps its own row; the values between two
    # brackets share one row with their least and greatest value.
    span = range(len(names))
    inside = " or ".join(f"(value >= _t.lo[{i}] and value <= _t.hi[{i}])" for i in span)
    band = " + ".join(f"cast(value >= _t.lo[{i}] as int)" for i in span)
    counts = (
        hit.groupBy(*keys, F.expr(f"case when {inside} then value end").alias("_v"), F.expr(f"case when {inside} then -1 else {band} end").alias("_band"))
        .agg(F.count(F.lit(1)).alias("_c"), F.min("value").alias("_o"), F.max("value").alias("_m"))
    )
    over = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    ranked = counts.withColumns(
        {
            "_end": F.sum("_c").over(over.orderBy("_o").rowsBetween(W.unboundedPreceding, 0)),
            "_tot": F.sum("_c").over(over),
        }
    )
    aggs = []
    for i, name in enumerate(names):
        pos = f"(_tot - 1) * {float(probs[name])!r}D"
        low = f"floor({pos} + 0.5D)" if mode == "nearest" else f"floor({pos})"
        high = low if mode == "nearest" else f"least(floor({pos}) + 1, _tot - 1)"
        for tag, rank in (("lo", low), ("hi", high)):
            value = f"case when _end - _c = {rank} then _o when _end - 1 = {rank} then _m else _v end"
            aggs.append(F.expr(f"max(case when _end > {rank} and _end - _c <= {rank} then {value} end)").alias(f"_{tag}{i}"))
        aggs.append(F.expr("0D" if mode == "nearest" else f"max({pos} - floor({pos}))").alias(f"_w{i}"))
    picked = ranked.groupBy(*keys).agg(*aggs, F.max("_tot").alias("_n"))
    miss = "cast(raise_error('quantile rank outside its bracket; raise margin') as double)"
    return picked.select(
        *keys,
        *[
            F.expr(f"case when _n is null then null when _lo{i} is null or _hi{i} is null then {miss} else _lo{i} + (_hi{i} - _lo{i}) * _w{i} end").alias(n)
            for i, n in enumerate(names)
        ],
    )


def column_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probs: Mapping[str, float],
    *,
    mode: str = "linear",
) -> DataFrame:
    """Quantiles of several columns: one row per key, columns ``<column>_<name>``."""
    long = unpivot(df, keys, columns)
    q = long_quantiles(long, [*keys, "metric"], probs, mode=mode)
    wide = [
        F.max(F.when(F.col("metric") == c, F.col(n))).alias(f"{c}_{n}") for c in columns for n in probs
    ]
    return q.groupBy(*keys).agg(*wide)
