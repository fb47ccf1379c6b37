"""Bootstrap stability of clusters and clustering parameter sweeps.

Replicas, left-out features and parameter values become group columns of one
clustering run; nothing loops over data on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.ordinals import with_ordinal
from faultline.operators.density import density_clusters, min_max
from faultline.operators.hierarchy import CondensedTree, select_clusters
from faultline.operators.propagation import post_filter, validate
from faultline.session import cut

ALL = "*"
# Fixed value: smallest change of mean purity that counts.
SIGNIFICANT = 0.03


def resample(df: DataFrame, *, iterations: int, seed: int, id_col: str) -> DataFrame:
    """``iterations`` replicas of exactly n rows drawn with replacement, keyed by ``replica`` and ``draw``.

    The draw is a hash of (seed, replica, draw number), so a retried task draws
    the same rows again.
    """
    n = df.count()
    indexed = with_ordinal(df, [], F.col(id_col), F.col(id_col), ordinal="_i", total="_rows").drop("_rows")
    draws = df.sparkSession.range(n * iterations).selectExpr(
        f"cast(id div {max(n, 1)} as int) as replica", f"id % {max(n, 1)} as draw", f"pmod(xxhash64({seed}, id), {max(n, 1)}L) as _pick"
    )
    return draws.join(indexed, F.expr("_pick = _i")).drop("_pick", "_i")


def bootstrap_stability(
    rows: DataFrame, columns: Sequence[str], *, eps: float, min_samples: int, id_col: str, iterations: int = 12, seed: int = 20260512
) -> DataFrame:
    """Mean purity with all features and with each one left out, its change, and its class.

    A left-out feature is held constant in its group, which scaling turns into
    a zero distance.
    """
    base = resample(rows.select(id_col, "scenario_tag", *columns), iterations=iterations, seed=seed, id_col=id_col)
    cases = ", ".join(f"'{c}'" for c in (ALL, *columns))
    wide = base.withColumn("left_out", F.expr(f"explode(array({cases}))"))
    wide = wide.select("replica", "left_out", "draw", "scenario_tag", *[F.expr(f"case when left_out = '{c}' then 0D else `{c}` end").alias(c) for c in columns])
    by = ["replica", "left_out"]
    scaled = cut(min_max(wide, columns, by=by))
    clustered = density_clusters(scaled, columns, eps=eps, min_samples=min_samples, id_col="draw", by=by)
    tags = clustered.where("cluster_id <> -1 and scenario_tag is not null").groupBy(*by, "cluster_id", "scenario_tag").agg(F.count(F.lit(1)).alias("n"))
    purity = (
        tags.groupBy(*by, "cluster_id").agg(F.max("n").alias("top"), F.sum("n").alias("size"))
        .groupBy(*by).agg(F.expr("round(sum(top) / sum(size), 6)").alias("purity"))
    )
    # Replicas without any cluster count as purity 0.
    mean = purity.groupBy("left_out").agg(F.expr(f"round(sum(purity) / {iterations}D, 6)").alias("mean_purity"))
    known = rows.sparkSession.sql("select explode(array({})) as feature".format(cases)).join(mean, F.expr("feature = left_out"), "left")
    known = cut(known.selectExpr("feature", "coalesce(mean_purity, 0D) as mean_purity"))
    whole = known.where(f"feature = '{ALL}'").select("mean_purity").scalar()
    out = known.withColumn("stability_with_feature", whole).selectExpr(
        "feature", "stability_with_feature", "mean_purity as stability_without_feature", "round(mean_purity - stability_with_feature, 6) as delta"
    )
    return out.where(f"feature <> '{ALL}'").withColumn(
        "classification",
        F.expr(f"case when delta <= -{SIGNIFICANT} then 'stabilizer' when delta >= {SIGNIFICANT} then 'destabilizer_or_redundant' else 'neutral' end"),
    )


def selection_sweep(
    tree: CondensedTree, rows: DataFrame, features: DataFrame, windows: DataFrame, cases: Sequence[tuple[str, str, float, bool]], *,
    id_col: str = "window_index", threshold: float = 0.30,
) -> DataFrame:
    """Propagation metrics for each selection (name, method, epsilon, single) from one condensed tree.

    ``rows`` has ``id_col`` and the window columns.  The loop below only builds
    one metric row per (few) cases.
    """
    found = cut(select_clusters(tree, cases).withColumnRenamed("id", "_id"))
    keep = [c for c in ("window_id", "scenario_tag", "window_data_quality_score") if c in rows.columns]
    assigned = cut(rows.select(id_col, *keep).join(found, F.expr(f"cast({id_col} as bigint) = _id")).drop("_id"))
    out = None
    for name, *_ in cases:
        kept = cut(post_filter(assigned.where(F.col("case_name") == name).drop("case_name"), features, threshold=threshold))
        raw = kept.agg(F.expr("count(distinct case when raw_cluster_id <> -1 then raw_cluster_id end)").alias("n"))
        row = validate(kept, features, windows).withColumns({"case_name": F.lit(name), "raw_cluster_count": raw.scalar()})
        out = row if out is None else out.unionByName(row)
    return out


def parameter_sweep(
    matrix: DataFrame, columns: Sequence[str], features: DataFrame, windows: DataFrame, *, eps_values: Sequence[float], min_samples: int,
    id_col: str = "window_index", threshold: float = 0.30,
) -> DataFrame:
    """Propagation metrics for each ``eps``; all values are clustered in one run.

    Dividing the points by ``eps`` lets every value share the radius 1.  The
    loop below only builds one metric row per (few) parameter values.
    """
    values = ", ".join(f"{float(e)!r}D" for e in eps_values)
    wide = matrix.withColumn("eps", F.expr(f"explode(array({values}))"))
    wide = wide.withColumns({c: F.expr(f"`{c}` / eps") for c in columns})
    assigned = cut(density_clusters(wide, columns, eps=1.0, min_samples=min_samples, id_col=id_col, by=["eps"]).drop(*columns))
    out = None
    for e in eps_values:
        kept = cut(post_filter(assigned.where(F.col("eps") == float(e)), features, threshold=threshold))
        raw = kept.agg(
            F.expr("count(distinct case when raw_cluster_id <> -1 then raw_cluster_id end)").alias("raw_cluster_count"),
            F.max("post_filter_threshold").alias("post_filter_threshold"),
        )
        row = validate(kept, features, windows).withColumn("eps", F.lit(float(e))).withColumn("_r", raw.select(F.struct("*")).scalar())
        row = row.select("*", "_r.raw_cluster_count", "_r.post_filter_threshold").drop("_r")
        out = row if out is None else out.unionByName(row)
    return out
