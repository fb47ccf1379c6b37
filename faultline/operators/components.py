"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import cut


def _signature(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node that has an edge; the label is the smallest node.

    ``edges`` has columns ``u`` and ``v`` of any one orderable type.  Each round
    is written out, so a lost executor costs one round and plans stay short.
    """
    e = cut(edges.where("u <> v").selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct())
    before = _signature(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = e.unionByName(e.selectExpr("v as u", "u as v"))
        low = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).selectExpr("x", "least(x, m) as m")
        large = both.join(low, F.expr("u = x")).where("v > u").selectExpr("v as u", "m as v").distinct()
        low2 = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = (
            large.join(low2, F.expr("u = x"))
            .selectExpr("inline(array(struct(u as a, m as b), struct(v as a, m as b)))")
            .where("a <> b").selectExpr("a as u", "b as v").distinct()
        )
        e = cut(small)
        after = _signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return e.selectExpr("u as node", "v as label").unionByName(e.selectExpr("v as node", "v as label")).distinct()
