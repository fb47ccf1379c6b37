"""Hierarchical density clustering against a sequential version, on both paths of every step."""

import hashlib

import numpy as np
import pytest

from faultline.operators import hierarchy as H
from faultline.operators import neighbours as NB


def brute(ids, x, m, k, cases):
    """All pairs, Kruskal, condensing from the root down, stability sums, selection by walking up; one point at a time."""
    n = len(ids)
    d = [[float(np.round(np.sqrt(((x[i] - x[j]) ** 2).sum()), 9)) for j in range(n)] for i in range(n)]
    core = [sorted(d[i])[min(k, n - 1)] for i in range(n)]
    pairs = sorted((max(d[i][j], core[i], core[j]), min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(n) for j in range(i))
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    tree = []
    for w, a, b in pairs:
        if find(a) != find(b):
            up[find(a)] = find(b)
            tree.append((w, hashlib.md5(f"{a}-{b}".encode()).hexdigest(), a, b))
    tree.sort()
    # Binary dendrogram: node -> (points, weight, left, right).
    top = {i: ("p", i) for i in ids}
    nodes = {("p", i): ([i], None, None, None) for i in ids}
    for at, (w, _, a, b) in enumerate(tree):
        p, q = top[a], top[b]
        nodes["e", at] = (nodes[p][0] + nodes[q][0], w, p, q)
        for i in nodes["e", at][0]:
            top[i] = ("e", at)
    lam = lambda w: np.inf if w == 0 else 1 / w
    clusters = []  # dict: parent, birth, death, rows
    point = {}  # id -> (cluster, lambda, weight)

    def condense(node, parent, birth):
        me = len(clusters)
        clusters.append({"parent": parent, "birth": birth, "rows": [], "parts": [], "death": None})
        stack = node
        while True:
            points, w, left, right = nodes[stack]
            a, b = len(nodes[left][0]), len(nodes[right][0])
            clusters[me]["death"] = w
            if a >= m and b >= m:
                for child in (left, right):
                    clusters[me]["rows"].append((lam(w), len(nodes[child][0])))
                    clusters[me]["parts"].append(condense(child, me, w))
                return me
            gone = [c for c, s in ((left, a), (right, b)) if s < m]
            for c in gone:
                for i in nodes[c][0]:
                    point[i] = (me, lam(w), w)
                    clusters[me]["rows"].append((lam(w), 1))
            if len(gone) == 2:
                return me
            stack = left if a >= m else right

    if n >= m and tree:
        condense(("e", len(tree) - 1), None, None)
    out = {}
    for name, method, eps, single in cases:
        value, keeps = {}, {}
        for c in reversed(range(len(clusters))):
            since = 0 if clusters[c]["birth"] is None else lam(clusters[c]["birth"])
            own = sum(0 if r == since else (r - since) * s for r, s in clusters[c]["rows"])
            below = sum(value[p] for p in clusters[c]["parts"])
            keeps[c] = not clusters[c]["parts"] or own >= below - 1e-12 * abs(below)
            value[c] = own if keeps[c] else below

        def path(c):
            got = []
            while c is not None:
                got.append(c)
                c = clusters[c]["parent"]
            return got

        picked = set()
        for c in range(len(clusters)):
            if (keeps[c] if method == "eom" else not clusters[c]["parts"]) and (c or single):
                picked.add(c)
        picked = {c for c in picked if not picked & set(path(c)[1:])} if method == "eom" else picked
        if eps > 0:
            moved = set()
            for c in picked:
                if c == 0 or clusters[c]["birth"] > eps:
                    moved.add(c)
                    continue
                ups = [a for a in path(c) if a != 0]
                high = [a for a in ups if clusters[a]["birth"] > eps]
                moved.add(high[0] if high else (0 if single else ups[-1]))
            picked = {c for c in moved if not moved & set(path(c)[1:])}
        labels = {}
        for i in ids:
            on = [c for c in path(point[i][0]) if c in picked] if i in point else []
            if on and on[0] == 0 and not (point[i][2] <= eps if eps > 0 else point[i][1] >= max(r for r, _ in clusters[0]["rows"])):
                on = []
            labels[i] = on[0] if on else None
        number = {c: k for k, c in enumerate(sorted(set(labels.values()) - {None}, key=lambda c: min(i for i in ids if labels[i] == c)))}
        for i in ids:
            c = labels[i]
            if c is None:
                out[name, i] = (-1, True, 0.0)
                continue
            peak, own = max(r for r, _ in clusters[c]["rows"]), point[i][1]
            out[name, i] = (number[c], False, 1.0 if peak == 0 or own == np.inf else round(min(own, peak) / peak, 6))
    return out


CASES = [("eom", "eom", 0.0, False), ("leaf", "leaf", 0.0, False), ("single", "eom", 0.0, True), ("near", "eom", 0.9, False), ("far", "leaf", 1.6, True), ("all", "leaf", 99.0, True), ("most", "eom", 99.0, False)]


def blobs(seed, n, d, spread=0.3, copies=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 2, (5, d))
    x = np.concatenate([centers[i % 5] + rng.normal(0, spread * (1 + i % 3), d)[None, :] for i in range(n)] + [np.repeat(centers[:1], copies, axis=0)])
    ids = rng.permutation(len(x) * 3)[: len(x)].tolist()
    return ids, np.round(x, 3)


def frame(spark, ids, x):
    cols = [f"x{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in zip(ids, x)], "id long, " + ", ".join(f"{c} double" for c in cols)).repartition(3), cols


@pytest.mark.parametrize("seed, n, d, m, k, copies", [(1, 120, 2, 5, 3, 0), (2, 90, 6, 4, 4, 12), (3, 60, 40, 6, 2, 0)])
def test_equal_to_the_sequential_version(spark, seed, n, d, m, k, copies):
    ids, x = blobs(seed, n, d, copies=copies)
    df, cols = frame(spark, ids, x)
    tree = H.build_tree(df, cols, min_cluster_size=m, min_samples=k)
    found = H.select_clusters(tree, CASES).collect()
    got = {(r.case_name, r.id): (r.cluster_id, r.noise, r.cluster_strength) for r in found}
    want = brute(ids, x, m, k, CASES)
    assert len(got) == len(found) == len(want)
    wrong = {key: (got[key], want[key]) for key in want if got[key][:2] != want[key][:2] or abs(got[key][2] - want[key][2]) > 2e-6}
    assert not wrong
    assert len({c for (name, _), (c, _, _) in want.items() if name == "leaf"}) > 2
    if seed == 1:  # the condensed tree read in slices of two clusters
        sliced = H.select_clusters(tree, CASES, band=2).collect()
        assert {(r.case_name, r.id): (r.cluster_id, r.noise, r.cluster_strength) for r in sliced} == got


def test_rounds_give_the_same_spanning_tree(spark):
    ids, x = blobs(2, 50, 3, copies=6)
    df, cols = frame(spark, ids, x)
    points = H.points_of(df, cols, "id").cache()
    whole, rounds = (sorted(map(tuple, H.spanning_tree(points, min_samples=3, direct=n).collect())) for n in (1000, 0))
    assert whole == rounds and len(whole) == 55


def test_bands_merge_alike(spark):
    ids, x = blobs(5, 45, 2)
    df, cols = frame(spark, ids, x)
    tree = sorted(H.spanning_tree(H.points_of(df, cols, "id"), min_samples=2).collect(), key=lambda e: e.w)
    edges = spark.createDataFrame([(r, e.a, e.b, r if r % 5 == 0 else None) for r, e in enumerate(tree)], "rank long, u long, v long, mark long")
    nodes = spark.createDataFrame([(i, 1, None) for i in ids], "node long, size long, mark long")
    one, many = (sorted(map(tuple, H.merge_events(edges, nodes, band=b).select("rank", "size_u", "size_v", "mark_u", "mark_v").collect())) for b in (1000, 15))
    assert one == many and len(one) == 44


def test_few_rows(spark):
    for n in (0, 1, 2, 3):
        ids, x = list(range(n)), np.arange(n, dtype=float).reshape(n, 1)
        df, cols = frame(spark, ids, x) if n else (spark.createDataFrame([], "id long, x0 double"), ["x0"])
        got = H.hierarchical_clusters(df, cols, min_cluster_size=4)
        assert got.columns == [*df.columns, "cluster_id", "noise", "cluster_strength"]
        assert [(r.cluster_id, r.noise, r.cluster_strength) for r in got.collect()] == [(-1, True, 0.0)] * n
    with pytest.raises(ValueError):
        H.hierarchical_clusters(df, cols, min_cluster_size=1)


def test_search_compares_few_pairs(spark):
    """With clusters apart, most blocks are never asked."""
    rng = np.random.default_rng(7)
    n, d = 1500, 64
    x = rng.normal(0, 1, (30, d))[np.arange(n) % 30] * 4 + rng.normal(0, 0.2, (n, d))
    df, cols = frame(spark, list(range(n)), x)
    index = NB.Index(H.points_of(df, cols, "id").cache(), block_rows=32)
    got = {r.id: r.core for r in index.core_distances(5).collect()}
    assert index.compared(index.asks) < 0.15 * n * n
    for i in range(0, n, 97):
        assert got[i] == sorted(NB.distances(x[i], x))[5]


def test_every_far_group_has_a_pivot():
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (30, 64))[np.arange(160) % 30] * 4 + rng.normal(0, 0.2, (160, 64))
    drawn = x[np.argsort((np.arange(160) % 30 > 4) & (np.arange(160) < 150), kind="stable")]  # the first half is of few groups
    pivots = NB.spread_out(drawn, 50)
    assert len(pivots) == 50 and (pivots[:25] == drawn[:25]).all()
    assert NB.to_pivots(x, pivots).min(axis=1).max() < 5  # groups are 30 and more apart
    assert NB.to_pivots(x, drawn[:50]).min(axis=1).max() > 5
    assert len(NB.spread_out(np.zeros((9, 2)), 6)) == 3 and len(NB.spread_out(np.zeros((0, 0)), 1)) == 0
