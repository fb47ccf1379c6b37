"""Hierarchical density clustering: spanning tree of mutual reachability, condensed tree, cluster selection.

Core distance of a point is the distance to its ``min_samples``-th other point;
the mutual reachability of two points is the greatest of their distance and
core distances.  The hierarchy is that of the minimum spanning tree under it,
with edges in the order of ``edge_order``; a component of ``min_cluster_size``
points is a cluster, which ends where it is joined by another cluster.

1. ``neighbours`` prunes the search of core distances and of each component's
   least outgoing edge (rounds that at least halve the components).
2. Edges are ranked and cut into bands of at most ``BAND`` edges.  Components
   of everything lighter become the nodes of a band (halving the bands, one
   connected-components run per halving), so each band is merged on its own.
3. Merges that join two clusters leave one region per first-born cluster; the
   condensed tree is kept as one row per cluster.  Points only carry their
   region and the weight at which they joined a cluster.
4. Selection reads the condensed tree in slices of ``BAND`` clusters, up for
   the sums of stability and down for the choice; any number of selections can
   be read from one tree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.ordinals import with_ordinal
from faultline.operators import neighbours as NB
from faultline.operators.components import connected_components
from faultline.session import cut

BAND = 500_000
ROWS_A_SLICE = 100_000
ROOT = -1


def spanning_tree(points: DataFrame, *, min_samples: int, direct: int = NB.DIRECT) -> DataFrame:
    """(a, b, w), a < b: the minimum spanning tree of (id, v) rows under mutual reachability."""
    n = points.count()
    if n <= direct:
        return cut(points.withColumn("whole", F.lit("")).groupBy("whole").applyInArrow(_small_tree(min_samples), "a long, b long, w double"))
    index = NB.Index(points)
    core = cut(index.core_distances(min_samples))
    index = index.with_cores(core)
    labels = cut(core.selectExpr("id", "id as label"))
    tree = None
    while True:
        least = cut(index.least_outward(labels))
        if least.isEmpty():
            break
        edges = cut(least.selectExpr("a", "b", "w").distinct())
        tree = edges if tree is None else tree.unionByName(edges)
        to = connected_components(least.selectExpr("label as u", "other as v")).selectExpr("node", "label as least_label")
        labels = cut(labels.join(to, F.expr("label = node"), "left").selectExpr("id", "coalesce(least_label, label) as label"))
    return cut(tree.distinct()) if tree is not None else points.sparkSession.createDataFrame([], "a long, b long, w double")


def _small_tree(min_samples: int):
    """Prim's rule over a bounded table of points."""

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        order = np.argsort(ids)
        ids, x = ids[order], NB.matrix(t.column("v"))[order]
        n = len(ids)
        core = np.zeros(n)
        k = min(min_samples, n - 1)
        if k > 0:
            for i in range(n):
                core[i] = np.partition(NB.distances(x[i], x), k)[k]
        best = np.full(n, np.inf)
        link, out = np.full(n, -1), []
        inside = np.zeros(n, bool)
        at = 0
        for _ in range(n - 1):
            inside[at] = True
            w = np.maximum(np.maximum(NB.distances(x[at], x), core), core[at])
            low, high = np.minimum(ids[at], ids), np.maximum(ids[at], ids)
            old_low, old_high = np.minimum(ids[link], ids), np.maximum(ids[link], ids)
            better = (w < best) | ((w == best) & ((low < old_low) | ((low == old_low) & (high < old_high))))
            better &= ~inside
            best[better], link[better] = w[better], at
            free = np.flatnonzero(~inside)
            least = free[best[free] == best[free].min()]
            low, high = np.minimum(ids[link[least]], ids[least]), np.maximum(ids[link[least]], ids[least])
            at = int(least[np.lexsort((high, low))[0]])
            out.append((min(ids[link[at]], ids[at]), max(ids[link[at]], ids[at]), best[at]))
        return pa.table({"a": pa.array([e[0] for e in out], pa.int64()), "b": pa.array([e[1] for e in out], pa.int64()), "w": pa.array([e[2] for e in out], pa.float64())})

    return run


def _slice_count(df: DataFrame) -> int:
    return 2 + df.count() // ROWS_A_SLICE


def edge_order(tree: DataFrame) -> DataFrame:
    """``rank`` of each edge by weight, then by a hash of its ends: the order in which equal weights merge."""
    return with_ordinal(tree, [], F.col("w"), F.concat_ws("-", "a", "b"), ordinal="rank", total="_edges", slices=_slice_count(tree)).drop("_edges")


def merge_events(edges: DataFrame, nodes: DataFrame, *, band: int = BAND) -> DataFrame:
    """What each edge joins, in rank order: size and last mark of the components of both its ends.

    ``edges``: rank (dense from 0), u, v, mark (the rank, or null where the merge
    names no cluster); ``nodes``: node, size, mark of every end.  Gives rank, u, v,
    size_u, size_v, mark_u, mark_v.
    """
    total = edges.count()
    live = cut(edges.selectExpr("rank", "u", "v", "mark", "0L as lo", f"{total}L as hi"))
    known = cut(nodes.selectExpr("0L as lo", "node", "size", "mark"))
    width = total
    while width > band:
        width = -(-width // 2)
        light = live.where("rank < (lo + hi) div 2")
        key = lambda c: f"struct(lo, {c} as node)"
        comp = cut(connected_components(light.selectExpr(f"{key('u')} as u", f"{key('v')} as v")).selectExpr("node.lo", "node.node", "label.node as into"))
        heavy = live.where("rank >= (lo + hi) div 2")
        for end in ("u", "v"):
            to = comp.selectExpr("lo as _lo", "node as _n", "into")
            heavy = heavy.join(to, F.expr(f"lo = _lo and {end} = _n"), "left").withColumn(end, F.coalesce("into", end)).drop("_lo", "_n", "into")
        # A contracted node has all points of its parts and the last mark among its edges and parts.
        marks = light.join(comp, ["lo"]).where("u = node").groupBy("lo", "into").agg(F.max("mark").alias("top")).selectExpr("lo as _lo", "into as _into", "top")
        joined = known.join(comp, ["lo", "node"], "left").withColumn("node", F.coalesce("into", "node"))
        sums = joined.groupBy("lo", "node").agg(F.sum("size").alias("size"), F.max("mark").alias("mark"))
        merged = sums.join(marks, F.expr("lo = _lo and node = _into"), "left").selectExpr("lo", "node", "size", "greatest(mark, top) as mark")
        spans = live.selectExpr("lo", "(lo + hi) div 2 as mid").distinct()
        merged = merged.join(spans, "lo").selectExpr("mid as lo", "node", "size", "mark")
        live = cut(light.selectExpr("rank", "u", "v", "mark", "lo", "(lo + hi) div 2 as hi").unionByName(heavy.selectExpr("rank", "u", "v", "mark", "(lo + hi) div 2 as lo", "hi")))
        used = live.selectExpr("lo", "explode(array(u, v)) as node").distinct()
        known = cut(known.unionByName(merged).join(used, ["lo", "node"], "left_semi"))
    ends = live
    for end in ("u", "v"):
        of = known.selectExpr("lo as _lo", "node as _n", f"size as size_{end}", f"mark as mark_{end}")
        ends = ends.join(of, F.expr(f"lo = _lo and {end} = _n")).drop("_lo", "_n")
    return ends.groupBy("lo").applyInArrow(_merge_band, "rank long, u long, v long, size_u long, size_v long, mark_u long, mark_v long")


def _merge_band(t: pa.Table) -> pa.Table:
    """One band of edges merged in order; nodes are the components of everything lighter."""
    t = t.sort_by("rank")
    rank, u, v, mark = (t.column(c).to_pylist() for c in ("rank", "u", "v", "mark"))
    size, last, up = {}, {}, {}
    for end, nodes in (("u", u), ("v", v)):
        for node, s, m in zip(nodes, t.column(f"size_{end}").to_pylist(), t.column(f"mark_{end}").to_pylist()):
            size[node], last[node], up[node] = s, m, node

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    rows = []
    for k, a, b, own in zip(rank, u, v, mark):
        p, q = find(a), find(b)
        rows.append((k, a, b, size[p], size[q], last[p], last[q]))
        if size[p] < size[q]:
            p, q = q, p
        marks = [m for m in (last[p], last[q], own) if m is not None]
        up[q], size[p], last[p] = p, size[p] + size[q], max(marks, default=None)
    names = ("rank", "u", "v", "size_u", "size_v", "mark_u", "mark_v")
    return pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})


class CondensedTree:
    """``clusters``: cluster, parent, birth and death (weights), size, stability, peak (largest lambda of its rows); ``points``: id, cluster rows.

    A cluster is named by the rank of the edge that made it.  ``points`` has id,
    leaf (the first-born cluster of its region), joined (rank) and w (weight at
    which it joined a cluster).
    """

    def __init__(self, clusters: DataFrame, points: DataFrame):
        self.clusters, self.points = clusters, points


def condensed_tree(points: DataFrame, tree: DataFrame, *, min_cluster_size: int, band: int = BAND) -> CondensedTree:
    """Condense the hierarchy of a spanning tree; ``points`` has id."""
    m = int(min_cluster_size)
    ranked = cut(edge_order(tree))
    ids = points.selectExpr("id as node", "1L as size", "cast(null as bigint) as mark")
    edges = ranked.selectExpr("rank", "a as u", "b as v", "cast(null as bigint) as mark")
    sized = merge_events(edges, ids, band=band).selectExpr("rank as _rank", "size_u", "size_v")
    sized = cut(ranked.join(sized, F.expr("rank = _rank")).drop("_rank").withColumn("kind", F.expr(
        f"case when size_u >= {m} and size_v >= {m} then 'split' when size_u >= {m} or size_v >= {m} then 'absorb' when size_u + size_v >= {m} then 'birth' else 'small' end"
    )))
    # Points that meet before any cluster, as one node.
    small = connected_components(sized.where("kind = 'small'").selectExpr("a as u", "b as v"))
    groups = cut(points.select("id").join(small, F.expr("id = node"), "left").selectExpr("id", "coalesce(label, id) as node"))
    nodes = groups.groupBy("node").agg(F.count(F.lit(1)).alias("size")).withColumn("mark", F.lit(None).cast("long"))
    large = sized.where("kind <> 'small'")
    for end in ("a", "b"):
        large = large.join(groups.selectExpr("id as _id", f"node as {end}_node"), F.expr(f"{end} = _id")).drop("_id")
    large = cut(large)
    dense = with_ordinal(large.select("rank", "w", "kind", "a_node", "b_node"), [], F.col("rank"), F.col("rank"), ordinal="place", total="_t", slices=_slice_count(large)).drop("_t")
    dense = cut(dense)
    events = merge_events(dense.selectExpr("place as rank", "a_node as u", "b_node as v", "case when kind <> 'absorb' then rank end as mark"), nodes, band=band)
    events = cut(dense.join(events.withColumnRenamed("rank", "_place"), F.expr("place = _place")).selectExpr("rank", "w", "kind", "a_node", "b_node", "size_u", "size_v", "mark_u", "mark_v"))

    born = events.where("kind <> 'absorb'").selectExpr("rank as cluster", "w as death", "size_u + size_v as at_start", "kind")
    children = events.where("kind = 'split'").selectExpr("inline(array(struct(mark_u as cluster, rank as parent, w as birth, size_u as size), struct(mark_v as cluster, rank as parent, w as birth, size_v as size)))")
    # Rows of a cluster: points that join it (a birth brings its own), and the two clusters it comes from.
    rows = events.where("kind = 'birth'").selectExpr("rank as cluster", "w", "size_u + size_v as size", "true as point").unionByName(
        events.where("kind = 'absorb'").selectExpr(f"case when size_u >= {m} then mark_u else mark_v end as cluster", "w", f"case when size_u >= {m} then size_v else size_u end as size", "true as point")
    ).unionByName(events.where("kind = 'split'").selectExpr("rank as cluster", "w", "size_u + size_v as size", "false as point"))
    whole = points.count()
    known = cut(born.drop("at_start", "kind").join(children, "cluster", "left").selectExpr("cluster", f"coalesce(parent, {ROOT}L) as parent", "birth", "death", f"coalesce(size, {whole}L) as size"))
    lam = lambda w: f"case when {w} is null then 0D when {w} > 0 then 1 / {w} else double('infinity') end"
    gain = rows.join(known.selectExpr("cluster", f"{lam('birth')} as since"), "cluster").withColumn("l", F.expr(lam("w")))
    sums = gain.groupBy("cluster").agg(F.sum(F.expr("case when l = since then 0D else (l - since) * size end")).alias("stability"), F.max("l").alias("peak"))
    clusters = cut(known.join(sums, "cluster"))

    # A point's region is what is left around it without the splits; its first-born cluster names the region.
    unsplit = events.where("kind <> 'split'")
    region = connected_components(unsplit.selectExpr("a_node as u", "b_node as v"))
    leaf = unsplit.where("kind = 'birth'").join(region, F.expr("a_node = node")).selectExpr("label as _label", "rank as leaf")
    of_node = region.join(leaf, F.expr("label = _label")).selectExpr("node as _node", "leaf")
    first = events.selectExpr("inline(array(struct(a_node as n, rank as r, w), struct(b_node as n, rank as r, w)))")
    joined = first.groupBy("n").agg(F.min(F.struct("r", "w")).alias("j")).selectExpr("n", "j.r as joined", "j.w as w")
    placed = groups.join(of_node, F.expr("node = _node"), "left").drop("_node").join(joined, F.expr("node = n"), "left").select("id", "leaf", "joined", "w")
    return CondensedTree(clusters, cut(placed))


def _slices(clusters: DataFrame, band: int) -> tuple[DataFrame, int]:
    """Clusters with the slice they are read in; children come before their parents."""
    n = clusters.count()
    if n <= band:
        return clusters.withColumn("slice", F.lit(0)), min(n, 1)
    ranked = with_ordinal(clusters, [], F.col("cluster"), F.col("cluster"), ordinal="_place", total="_all")
    return cut(ranked.withColumn("slice", F.expr(f"cast(_place div {band} as int)")).drop("_place", "_all")), -(-n // band)


def _best_subtrees(t: pa.Table) -> pa.Table:
    """Of each cluster, the most stability that it or its parts give, and whether it is its own (ties) or has no parts."""
    t = t.sort_by("cluster")
    cluster, parent, own = (t.column(c).to_pylist() for c in ("cluster", "parent", "stability"))
    below = {c: x for c, x in zip(cluster, t.column("below").to_pylist()) if x is not None}
    value, keeps, leaf = [], [], []
    for c, p, s in zip(cluster, parent, own):
        parts = below.get(c)
        leaf.append(parts is None)
        keeps.append(parts is None or s >= parts)
        value.append(s if keeps[-1] else parts)
        below[p] = below.get(p, 0.0) + value[-1]
    return pa.table({"cluster": t.column("cluster"), "value": pa.array(value, pa.float64()), "keeps": keeps, "leaf": leaf})


def _chosen(cases: Sequence[tuple[str, str, float, bool]]):
    """Downwards: the selected cluster that each cluster lies in, for every case (name, method, epsilon, single)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("cluster", "descending")])
        cluster, parent, birth, death, keeps, leaf, above = (t.column(c).to_pylist() for c in ("cluster", "parent", "birth", "death", "keeps", "leaf", "above"))
        names, out = [], []
        for number, (_, method, eps, single) in enumerate(cases):
            inside: dict[int, int | None] = {}
            for c, p, w_birth, w_death, own, end, known in zip(cluster, parent, birth, death, keeps, leaf, above):
                up = inside[p] if p in inside else dict(known or []).get(number)
                picked = own if method == "eom" else end
                if up is None:
                    if p == ROOT:
                        up = c if single and (picked or (eps > 0 and w_death <= eps)) else None
                    elif eps <= 0:
                        up = c if picked else None
                    elif w_birth > eps:
                        up = c if picked or w_death <= eps else None
                    else:  # no part of the root is born beyond epsilon
                        up = c
                inside[c] = up
                names.append((number, c))
                out.append(up)
        return pa.table({"number": pa.array([n for n, _ in names], pa.int32()), "cluster": pa.array([c for _, c in names], pa.int64()), "chosen": pa.array(out, pa.int64())})

    return run


def select_clusters(tree: CondensedTree, cases: Sequence[tuple[str, str, float, bool]], *, band: int = BAND) -> DataFrame:
    """case_name, id, cluster_id, noise, cluster_strength for every case (name, method, epsilon, single), all from one tree.

    ``eom`` keeps a cluster that is at least as stable as its parts, ``leaf``
    those without parts.  A chosen cluster born at or below ``epsilon`` is
    replaced by its first forebear born above it.  The root is no cluster unless
    ``single``; then its points count that joined at or below epsilon, or, with
    epsilon 0, last.  Clusters are numbered by their smallest id; strength is the
    point's lambda over the cluster's peak.
    """
    for _, method, _, _ in cases:
        if method not in ("eom", "leaf"):
            raise ValueError(f"unknown selection method: {method}")
    spark = tree.points.sparkSession
    sliced, slices = _slices(tree.clusters, band)
    up = None
    for s in range(slices):
        part = sliced.where(F.col("slice") == s)
        if up is None:
            part = part.withColumn("below", F.lit(None).cast("double"))
        else:
            sums = up.join(sliced.selectExpr("cluster", "parent"), "cluster").groupBy("parent").agg(F.sum("value").alias("below")).withColumnRenamed("parent", "_p")
            part = part.join(sums, F.expr("cluster = _p"), "left").drop("_p")
        done = part.select("cluster", "parent", "stability", "below").withColumn("whole", F.lit("")).groupBy("whole").applyInArrow(_best_subtrees, "cluster long, value double, keeps boolean, leaf boolean")
        up = cut(done if up is None else up.unionByName(done))
    down = spark.createDataFrame([], "number int, cluster long, chosen long") if up is None else None
    for s in reversed(range(slices)):
        part = sliced.where(F.col("slice") == s).join(up, "cluster")
        if down is None:
            part = part.withColumn("above", F.expr("cast(null as map<int, bigint>)"))
        else:
            maps = down.where("chosen is not null").groupBy("cluster").agg(F.expr("map_from_entries(collect_list(struct(number, chosen))) as above")).withColumnRenamed("cluster", "_p")
            part = part.join(maps, F.expr("parent = _p"), "left").drop("_p")
        done = part.select("cluster", "parent", "birth", "death", "keeps", "leaf", "above").withColumn("whole", F.lit("")).groupBy("whole").applyInArrow(_chosen(cases), "number int, cluster long, chosen long")
        down = cut(done if down is None else down.unionByName(done))

    of = down.join(tree.clusters.selectExpr("cluster as chosen", "parent", "peak"), "chosen", "left").select("number", F.col("cluster").alias("leaf"), "chosen", "parent", "peak")
    numbers = F.explode(F.array(*[F.lit(i) for i in range(len(cases))])).alias("number")
    points = tree.points.select("id", "leaf", "joined", "w", numbers).join(of, ["leaf", "number"], "left")
    lam = "case when w > 0 then 1 / w else double('infinity') end"
    limit = "case number " + " ".join(f"when {i} then {float(e)!r}D" for i, (_, _, e, _) in enumerate(cases)) + " end"
    inside = f"chosen is not null and case when parent = {ROOT} then case when {limit} > 0 then w <= {limit} else {lam} >= peak end else joined < parent end"
    placed = cut(points.selectExpr("number", "id", f"case when {inside} then chosen end as chosen", f"{lam} as l", "peak"))
    first = cut(placed.where("chosen is not null").groupBy("number", "chosen").agg(F.min("id").alias("first")))
    ordered = with_ordinal(first, ["number"], F.col("first"), F.col("first"), ordinal="cluster_id", total="_all", slices=_slice_count(first)).drop("_all", "first")
    names = "case number " + " ".join(f"when {i} then '{n}'" for i, (n, _, _, _) in enumerate(cases)) + " end as case_name"
    ordered = ordered.selectExpr("number as _number", "chosen as _chosen", "cluster_id")
    strength = "round(case when chosen is null then 0D when peak = 0 or isnan(l) or l = double('infinity') then 1D else least(l, peak) / peak end, 6) as cluster_strength"
    return placed.join(ordered, F.expr("number = _number and chosen = _chosen"), "left").selectExpr(
        names, "id", "cast(coalesce(cluster_id, -1) as int) as cluster_id", "chosen is null as noise", strength
    )


def points_of(df: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
    return df.selectExpr(f"cast({id_col} as bigint) as id", "array({}) as v".format(", ".join(f"cast(`{c}` as double)" for c in columns)))


def build_tree(df: DataFrame, columns: Sequence[str], *, min_cluster_size: int, min_samples: int | None = None, id_col: str = "id", direct: int = NB.DIRECT, band: int = BAND) -> CondensedTree:
    """The condensed tree of the rows; ``id_col`` is a unique number per row.  Empty tables give an empty tree."""
    if min_cluster_size < 2:
        raise ValueError("min_cluster_size must be 2 or more")
    points = cut(points_of(df, columns, id_col))
    tree = spanning_tree(points, min_samples=min_samples or min_cluster_size, direct=direct)
    return condensed_tree(points.select("id"), tree, min_cluster_size=min_cluster_size, band=band)


def hierarchical_clusters(
    df: DataFrame, columns: Sequence[str], *, min_cluster_size: int, min_samples: int | None = None, method: str = "eom", epsilon: float = 0.0,
    single: bool = False, id_col: str = "id", direct: int = NB.DIRECT, band: int = BAND,
) -> DataFrame:
    """The rows with ``cluster_id``, ``noise`` and ``cluster_strength``."""
    tree = build_tree(df, columns, min_cluster_size=min_cluster_size, min_samples=min_samples, id_col=id_col, direct=direct, band=band)
    found = select_clusters(tree, [("", method, epsilon, single)], band=band).drop("case_name").withColumnRenamed("id", "_id")
    return df.join(found, F.expr(f"cast({id_col} as bigint) = _id")).drop("_id")
