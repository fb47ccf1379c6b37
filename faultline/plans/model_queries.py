"""Registered queries that train and apply the isolation forest."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline import fixtures as X
from faultline.operators import evaluation as EV
from faultline.operators import forest as FO
from faultline.plans.scoring_queries import rounded
from faultline.session import cut

TREES, CONTAMINATION = 300, (0.004, 0.005, 0.006, 0.0075, 0.01, 0.0125, 0.015, 0.02)


def model(spark, d):
    normal = X.wide_events(spark, d).where("scenario_tag = 'normal'")
    return FO.materialise(FO.train_forest(normal, trees=TREES))


def forest_training(spark, d):
    """Shape of the trained forest, one row per tree."""
    return model(spark, d).groupBy("tree_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"), F.max("size").alias("sample_size"))


def forest_scores(spark, d):
    w = X.wide_events(spark, d)
    return FO.score_forest(w, model(spark, d)).select("event_id", "service_name", "scenario_tag", "anomaly_score", "raw_score")


def decision_scores(spark, d):
    w = X.wide_events(spark, d)
    # Every use of the scores would walk the forest again: they are fixed once, in the columns that count.
    scored = cut(FO.score_forest(w, model(spark, d)).select("scenario_tag", "raw_score"))
    offset = FO.decision_offset(scored.where("scenario_tag = 'normal'"), 0.02)
    return rounded(FO.decision_scores(scored, offset).groupBy("scenario_tag").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("decision_score") < 0).alias("outliers"), F.avg("decision_score").alias("mean_decision")))


def contamination_sweep(spark, d):
    w = EV.analysis_columns(X.wide_events(spark, d))
    needed = ("service_name", "scenario_tag", "burst_proxy", "drift_slice", "anomaly_score", "raw_score")
    scored = cut(FO.score_forest(w, model(spark, d)).select(*needed))
    sweep = cut(FO.contamination_sweep(scored.where("scenario_tag = 'normal'"), scored, values=CONTAMINATION, threshold=0.5))
    rec = FO.recommend_contamination(sweep, min_tpr=0.0, max_fpr=1.0).select(F.struct("*").alias("r")).scalar()
    return rounded(sweep.withColumn("_r", rec).select("*", "_r.recommended_contamination", "_r.contamination_effect_detected").drop("_r"))


QUERIES = {f.__name__: f for f in (forest_training, forest_scores, decision_scores, contamination_sweep)}
