"""Isolation forest: per-tree training on bounded samples, vectorised scoring.

Each tree sees at most ``psi`` rows (256 by default), so a tree is built inside
one small group.  Trees form a flat node table whose size is bounded by
``trees * 2 * psi`` whatever the data size; scoring ships it to the executors
and walks all trees over Arrow batches.

After Liu, Ting and Zhou, "Isolation Forest" (ICDM 2008).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.operators import evaluation as EV
from faultline.session import cut

EULER_GAMMA = 0.5772156649015329
NODE_SCHEMA = "tree_id int, node int, feature int, split double, lower int, upper int, depth int, size int"


def require_features(columns: Sequence[str], features: Sequence[str] = C.MODEL_FEATURES) -> None:
    missing = [f for f in features if f not in columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")


def normaliser(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    out = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, out))


def sample_rows(
    df: DataFrame, *, trees: int, psi: int, seed: int, id_col: str, features: Sequence[str]
) -> DataFrame:
    """``psi`` rows without replacement for every tree.

    Every (row, tree) pair draws a hash-based uniform number; a row enters a
    tree's shortlist when the number is below a rate that yields about twice
    ``psi`` rows, and the ``psi`` smallest numbers stay.  The draw depends on
    the row id and seed only, not on partitioning, so retries repeat it.
    Numbers per row are drawn through geometric skips over the trees, so a row
    costs its few hits rather than one test per tree.
    """
    n = df.count()
    psi = min(psi, n)
    rate = min(1.0, (2.0 * psi + 64.0) / max(n, 1))
    names = list(features)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            rng_seed = pdf["_h"].to_numpy(dtype=np.int64).view(np.uint64)
            rows, tree_ids, marks = [], [], []
            if rate >= 1.0:
                for t in range(trees):
                    u = _uniform(rng_seed, t)
                    rows.append(np.arange(len(pdf)))
                    tree_ids.append(np.full(len(pdf), t))
                    marks.append(u)
            else:
                # Next tree hit by each row: geometric skip with success rate ``rate``.
                at = np.full(len(pdf), -1, dtype=np.int64)
                live = np.arange(len(pdf))
                step = 0
                while len(live):
                    u = _uniform(rng_seed[live], 1_000_003 + step)
                    at[live] += 1 + np.floor(np.log1p(-u) / math.log1p(-rate)).astype(np.int64)
                    live = live[at[live] < trees]
                    if len(live):
                        rows.append(live)
                        tree_ids.append(at[live].copy())
                        marks.append(_uniform(rng_seed[live], 2_000_003 + step))
                    step += 1
            if not rows:
                continue
            pick = np.concatenate(rows)
            out = pdf.iloc[pick][names].reset_index(drop=True)
            out.insert(0, "mark", np.concatenate(marks))
            out.insert(0, "tree_id", np.concatenate(tree_ids).astype("int32"))
            out.insert(0, "row", pdf[id_col].to_numpy()[pick].astype(str))
            yield out

    view = df.select(
        F.col(id_col).cast("string").alias(id_col), F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)).alias("_h"),
        *[F.col(f).cast("double").alias(f) for f in names],
    )
    schema = "row string, tree_id int, mark double, " + ", ".join(f"{f} double" for f in names)
    drawn = view.mapInPandas(draw, schema)
    rank = F.expr("row_number() over (partition by tree_id order by mark, row)")
    return drawn.withColumn("_r", rank).where(F.col("_r") <= psi).drop("_r")


def _uniform(keys: np.ndarray, stream: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit keys and a stream number (splitmix mixing)."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64(((stream + 1) * 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _grow(tree_id: int, x: np.ndarray, limit: int, seed: int) -> pd.DataFrame:
    rng = np.random.default_rng([seed, tree_id])
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        rows, depth, parent, is_upper = todo.pop()
        me = len(nodes)
        nodes.append([tree_id, me, -1, 0.0, -1, -1, depth, len(rows)])
        if parent >= 0:
            nodes[parent][5 if is_upper else 4] = me
        if depth >= limit or len(rows) <= 1:
            continue
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        open_cols = np.flatnonzero(hi > lo)
        if not len(open_cols):
            continue
        f = int(rng.choice(open_cols))
        s = float(rng.uniform(lo[f], hi[f]))
        below = x[rows, f] <= s
        nodes[me][2], nodes[me][3] = f, s
        todo.append((rows[~below], depth + 1, me, True))
        todo.append((rows[below], depth + 1, me, False))
    return pd.DataFrame(nodes, columns=["tree_id", "node", "feature", "split", "lower", "upper", "depth", "size"])


def train_forest(
    df: DataFrame, *, id_col: str = "event_id", features: Sequence[str] = C.MODEL_FEATURES, trees: int = 300, max_samples: int = 256, seed: int = 42
) -> DataFrame:
    """Flat node table (tree_id, node, feature, split, lower, upper, depth, size)."""
    require_features(df.columns, features)
    names = list(features)
    sample = sample_rows(df, trees=trees, psi=max_samples, seed=seed, id_col=id_col, features=names)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mark", "row"])
        limit = max(1, math.ceil(math.log2(max(len(pdf), 2))))
        return _grow(int(pdf["tree_id"].iloc[0]), pdf[names].to_numpy(dtype=float), limit, seed)

    return sample.groupBy("tree_id").applyInPandas(build, NODE_SCHEMA)


def forest_arrays(nodes: DataFrame) -> dict[str, np.ndarray]:
    """Node table as dense arrays; its size depends on trees and sample size only."""
    pdf = nodes.orderBy("tree_id", "node").toPandas()
    trees = pdf["tree_id"].nunique()
    width = int(pdf["node"].max()) + 1
    dense = {}
    index = pdf["tree_id"].rank(method="dense").astype(int).to_numpy() - 1
    for c, fill in (("feature", -1), ("split", 0.0), ("lower", -1), ("upper", -1)):
        a = np.full((trees, width), fill, dtype=float if c == "split" else np.int32)
        a[index, pdf["node"]] = pdf[c]
        dense[c] = a
    leaf = np.zeros((trees, width))
    leaf[index, pdf["node"]] = pdf["depth"] + normaliser(pdf["size"])
    dense["path"] = leaf
    dense["psi"] = np.array([int(pdf.loc[pdf["node"] == 0, "size"].max())])
    return dense


def path_scores(x: np.ndarray, forest: Mapping[str, np.ndarray]) -> np.ndarray:
    """Anomaly score 2^(-E[path] / c(psi)) of each row; higher is stranger."""
    n = len(x)
    total = np.zeros(n)
    rows = np.arange(n)
    for t in range(forest["feature"].shape[0]):
        feature, split, lower, upper = (forest[k][t] for k in ("feature", "split", "lower", "upper"))
        at = np.zeros(n, dtype=np.int64)
        live = rows[feature[at] >= 0]
        while len(live):
            f = feature[at[live]]
            goes_low = x[live, f] <= split[at[live]]
            at[live] = np.where(goes_low, lower[at[live]], upper[at[live]])
            live = live[feature[at[live]] >= 0]
        total += forest["path"][t][at]
    mean = total / forest["feature"].shape[0]
    return np.power(2.0, -mean / float(normaliser(forest["psi"][0])))


def score_forest(df: DataFrame, nodes: DataFrame, *, features: Sequence[str] = C.MODEL_FEATURES) -> DataFrame:
    """Append ``raw_score`` and ``anomaly_score`` (six decimals); works on batches and streams."""
    require_features(df.columns, features)
    shared = df.sparkSession.sparkContext.broadcast(forest_arrays(nodes))

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        return pd.Series(np.round(path_scores(x, shared.value), 6))

    out = df.drop("raw_score", "anomaly_score").withColumn("anomaly_score", score(*[F.col(f).cast("double") for f in features]))
    return out.withColumn("raw_score", -F.col("anomaly_score"))


def decision_offset(training_scores: DataFrame, contamination: float):
    """Scalar column: the contamination quantile of raw training scores."""
    hist = EV.score_histogram(training_scores, value="raw_score")
    return EV.score_quantiles(hist, [], {"q": (contamination, "linear")}, value="raw_score").select("q").scalar()


def decision_scores(df: DataFrame, offset) -> DataFrame:
    """``decision_score`` = raw score minus the offset; negative means outlier."""
    return df.withColumn("decision_score", F.col("raw_score") - offset)


def contamination_sweep(
    training: DataFrame, validation: DataFrame, *, values: Sequence[float], threshold: float
) -> DataFrame:
    """Metrics per contamination value at a fixed score threshold.

    Contamination moves only the decision offset, so one model and one scoring
    pass serve every value; ``outlier_rate`` shows what the offset does.
    ``validation`` needs the analysis columns and scores of the same model.
    """
    names = [f"c{i}" for i in range(len(values))]
    hist = EV.score_histogram(training, value="raw_score")
    q = EV.score_quantiles(hist, [], {n: (v, "linear") for n, v in zip(names, values)}, value="raw_score")
    offsets = q.selectExpr("array({}) as o".format(", ".join(f"struct({v}D as contamination, {n} as offset)" for n, v in zip(names, values))))
    metrics = EV.flag_metrics(EV.flag_global(validation, threshold))
    fields = ("flag_rate_overall", "false_positive_rate_on_normal", "true_positive_rate_on_anomalous", "service_flag_rate_span",
              "burst_proxy_flag_rate", "late_drift_flag_rate")
    counts = EV.score_histogram(validation, value="raw_score").withColumn("_o", offsets.scalar())
    rates = counts.selectExpr("raw_score", "n", "inline(_o)").groupBy("contamination", "offset").agg(
        F.expr("sum(case when raw_score < offset then n else 0 end) / sum(n)").alias("outlier_rate")
    )
    out = rates.withColumn("_m", metrics.select(F.struct(*fields)).scalar())
    return out.select("contamination", "offset", "outlier_rate", *[F.col(f"_m.{f}").alias(f) for f in fields])


def recommend_contamination(sweep: DataFrame, *, min_tpr: float = 0.45, max_fpr: float = 0.08) -> DataFrame:
    """One row: best contamination by span, TPR, FPR, and whether the value had any effect."""
    ok = f"coalesce(true_positive_rate_on_anomalous, 0D) >= {min_tpr}D and coalesce(false_positive_rate_on_normal, 0D) <= {max_fpr}D"
    key = ("struct(coalesce(service_flag_rate_span, 999D) as a, -coalesce(true_positive_rate_on_anomalous, 0D) as b, "
           "coalesce(false_positive_rate_on_normal, 999D) as c, contamination as d)")
    same = "struct(round(flag_rate_overall, 9), round(false_positive_rate_on_normal, 9), round(true_positive_rate_on_anomalous, 9), round(service_flag_rate_span, 9))"
    return sweep.agg(
        F.expr(f"min_by(contamination, {key}) filter (where {ok})").alias("recommended_contamination"),
        F.expr(f"count(distinct {same}) > 1").alias("contamination_effect_detected"),
    )


def materialise(nodes: DataFrame) -> DataFrame:
    """Fix a trained forest so that every later use sees the same trees."""
    return cut(nodes)
