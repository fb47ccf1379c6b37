"""Service graph: weighted distances, ancestors, direct neighbours.

Graphs are configuration-sized: their tables stay in one partition, so the
joins below need no shuffle.  Paths grow by doubling (a self-join of the
distance table per round), so ``ceil(log2(nodes))`` rounds reach every pair.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import constants as C


def edge_table(spark: SparkSession, edges: Sequence[tuple[str, str, int]] = C.TOPOLOGY_EDGES) -> DataFrame:
    rows = ", ".join(f"('{s}', '{t}', {int(w)}L)" for s, t, w in edges)
    return spark.sql(f"select * from values {rows} as e(source, target, weight)").coalesce(1)


def node_table(spark: SparkSession, criticality: Mapping[str, int] = C.TOPOLOGY_CRITICALITY) -> DataFrame:
    rows = ", ".join(f"('{n}', {int(c)}L)" for n, c in criticality.items())
    return spark.sql(f"select * from values {rows} as n(node, criticality)").coalesce(1)


def _rounds(n_nodes: int) -> int:
    return max(1, math.ceil(math.log2(max(n_nodes, 2))))


def shortest_distances(edges: DataFrame, nodes: DataFrame, *, n_nodes: int) -> DataFrame:
    """(source, target, distance) for every reachable pair, a node to itself being 0."""
    best = (
        edges.select("source", "target", F.col("weight").alias("distance"))
        .unionByName(nodes.select(F.col("node").alias("source"), F.col("node").alias("target"), F.lit(0).cast("long").alias("distance")))
        .groupBy("source", "target")
        .agg(F.min("distance").alias("distance"))
    )
    for _ in range(_rounds(n_nodes)):
        left = best.select(F.col("source").alias("a"), F.col("target").alias("mid"), F.col("distance").alias("d1"))
        right = best.select(F.col("source").alias("mid"), F.col("target").alias("b"), F.col("distance").alias("d2"))
        best = (
            left.join(right, "mid")
            .groupBy(F.col("a").alias("source"), F.col("b").alias("target"))
            .agg(F.min(F.col("d1") + F.col("d2")).alias("distance"))
        )
    return best


def ancestors(edges: DataFrame, *, n_nodes: int) -> DataFrame:
    """(node, ancestor) pairs over one or more edges; a node on a cycle is its own ancestor."""
    reach = edges.select(F.col("target").alias("node"), F.col("source").alias("ancestor")).distinct()
    for _ in range(_rounds(n_nodes)):
        further = reach.select(F.col("node").alias("ancestor_of"), F.col("ancestor").alias("far"))
        longer = reach.join(further, F.col("ancestor") == F.col("ancestor_of")).select(
            "node", F.col("far").alias("ancestor")
        )
        reach = reach.unionByName(longer).distinct()
    return reach


def lookup_service(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per node: direct upstream and downstream lists, criticality, cache dependency."""
    up = edges.groupBy(F.col("target").alias("node")).agg(F.array_sort(F.collect_set("source")).alias("upstream"))
    down = edges.groupBy(F.col("source").alias("node")).agg(F.array_sort(F.collect_set("target")).alias("downstream"))
    none = F.array().cast("array<string>")
    out = nodes.join(up, "node", "left").join(down, "node", "left")
    out = out.withColumn("upstream", F.coalesce("upstream", none)).withColumn("downstream", F.coalesce("downstream", none))
    uses_cache = (
        F.array_contains("upstream", C.CACHE_SERVICE)
        | F.array_contains("downstream", C.CACHE_SERVICE)
        | (F.col("node") == C.CACHE_SERVICE)
    )
    return out.withColumn("redis_dependency", uses_cache)


def topology_node(service_name):
    """Node name of a service: trimmed, lower case, without the ``-api`` suffix."""
    return F.replace(F.lower(F.trim(service_name)), F.lit("-api"), F.lit(""))
