"""Density clustering against the sequential rule; post-filter, leakage, forest."""

import numpy as np
import pytest

from faultline.operators import density as D
from faultline.operators import forest as FO
from faultline.operators import propagation as PR
from faultline.operators import topology as T


def sequential(pts, eps, m):
    n = len(pts)
    near = [[j for j in range(n) if np.sqrt(((pts[i] - pts[j]) ** 2).sum()) <= eps] for i in range(n)]
    core = [len(x) >= m for x in near]
    label, c = [-1] * n, 0
    for i in range(n):
        if core[i] and label[i] == -1:
            stack, label[i] = [i], c
            while stack:
                for v in near[stack.pop()]:
                    if core[v] and label[v] == -1:
                        label[v] = c
                        stack.append(v)
            c += 1
    return [label[i] if core[i] else min([label[j] for j in near[i] if core[j]], default=-1) for i in range(n)]


@pytest.mark.parametrize("d,eps,m,direct", [(2, 0.12, 4, 4), (3, 0.3, 5, 10_000), (5, 0.7, 3, 10)])
def test_density_equals_sequential(spark, monkeypatch, d, eps, m, direct):
    monkeypatch.setattr(D, "DIRECT_PAIRS", direct)
    monkeypatch.setattr(D, "SALT_ROWS", 5)
    rng = np.random.default_rng(d)
    pts = np.vstack([rng.normal(c, 0.15, (50, d)) for c in (0, 1, 2)] + [rng.uniform(-1, 3, (50, d))])
    pts[5:9] = pts[5]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, " + ", ".join(f"x{i} double" for i in range(d)))
    got = D.density_clusters(df, [f"x{i}" for i in range(d)], eps=eps, min_samples=m).orderBy("id").collect()
    assert [r.cluster_id for r in got] == sequential(pts, eps, m)
    assert all(r.noise == (r.cluster_id == -1) for r in got)


def test_density_groups_are_separate(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for g in ("a", "b"):
        pts = rng.normal(0, 0.3, (60, 2))
        want[g] = sequential(pts, 0.15, 3)
        rows += [(g, i, float(p[0]), float(p[1])) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double")
    got = D.density_clusters(df, ["x", "y"], eps=0.15, min_samples=3, by=["g"]).orderBy("g", "id").collect()
    assert {g: [r.cluster_id for r in got if r.g == g] for g in want} == want


def test_leakage_guard():
    with pytest.raises(D.LeakageError):
        D.check_leakage(["iforest_score_payments", "scenario_tag"])


def test_post_filter_fixed_and_fallback(spark):
    a = spark.createDataFrame([("w1", 0, False, 0.5, "x"), ("w2", 0, False, 0.5, "x"), ("w3", 1, False, 0.5, "y"), ("w4", -1, True, 0.0, "y")],
                              "window_id string, cluster_id int, noise boolean, cluster_strength double, scenario_tag string")
    f = spark.createDataFrame([("w1", 0.5), ("w2", 0.6), ("w3", 0.1), ("w4", 0.9)], "window_id string, iforest_score_mean double")
    got = {r.window_id: (r.cluster_id, r.post_filter_passed, r.post_filter_policy) for r in PR.post_filter(a, f).collect()}
    assert got == {"w1": (0, True, "fixed_threshold"), "w2": (0, True, "fixed_threshold"), "w3": (-1, False, "fixed_threshold"), "w4": (-1, True, "fixed_threshold")}
    low = PR.post_filter(a, f, threshold=0.95).first()
    assert low.post_filter_policy == "adaptive_quantile_fallback" and low.post_filter_threshold == pytest.approx(0.1 + 0.7 * (0.525 - 0.1))


def test_topology(spark):
    e, n = T.edge_table(spark), T.node_table(spark)
    dist = {(r.source, r.target): r.distance for r in T.shortest_distances(e, n, n_nodes=4).collect()}
    assert dist["payments", "checkout"] == 2 and dist["payments", "orders"] == 2 and ("orders", "payments") not in dist
    assert {r.ancestor for r in T.ancestors(e, n_nodes=4).where("node = 'orders'").collect()} == {"checkout", "payments", "redis"}


def test_forest(spark):
    rng = np.random.default_rng(0)
    normal = rng.normal(50, 5, (1000, 8))
    odd = np.full((10, 8), 500.0) + rng.normal(0, 5, (10, 8))
    cols = list(FO.C.MODEL_FEATURES)
    df = spark.createDataFrame([(f"e{i}", *map(float, r)) for i, r in enumerate(np.vstack([normal, odd]))], "event_id string, " + ", ".join(f"{c} double" for c in cols))
    nodes = FO.materialise(FO.train_forest(df, trees=50))
    again = FO.train_forest(df.repartition(7), trees=50)
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, again.collect()))
    scored = FO.score_forest(df, nodes).orderBy("anomaly_score", ascending=False).collect()
    assert {r.event_id for r in scored[:10]} == {f"e{i}" for i in range(1000, 1010)}
    assert all(0 < r.anomaly_score < 1 for r in scored)
    # Arrow scoring equals a plain walk of the node table.
    tree = {(r.tree_id, r.node): r for r in nodes.collect()}
    row = df.where("event_id = 'e7'").first()
    total = 0.0
    for t in range(50):
        at = tree[t, 0]
        while at.feature >= 0:
            at = tree[t, at.lower if row[cols[at.feature]] <= at.split else at.upper]
        total += at.depth + float(FO.normaliser(at.size))
    want = 2 ** (-(total / 50) / float(FO.normaliser(256)))
    assert next(r.anomaly_score for r in scored if r.event_id == "e7") == pytest.approx(want, abs=1e-6)
    assert float(FO.normaliser(2)) == 1.0 and float(FO.normaliser(1)) == 0.0


@pytest.mark.parametrize("d,tile", [(17, 7), (17, 1_000), (40, 20)])
def test_density_in_many_dimensions(spark, monkeypatch, d, tile):
    monkeypatch.setattr(D, "TILE_ROWS", tile)
    rng = np.random.default_rng(d)
    pts = np.vstack([rng.normal(c, 0.1, (40, d)) for c in (0, 0.45, 3)] + [rng.uniform(-1, 3, (30, d))])
    pts[50:56] = pts[50]
    eps = 0.15 * np.sqrt(2 * d)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, " + ", ".join(f"x{i} double" for i in range(d)))
    got = D.density_clusters(df, [f"x{i}" for i in range(d)], eps=eps, min_samples=5).orderBy("id").collect()
    want = sequential(pts, eps, 5)
    assert [r.cluster_id for r in got] == want
    assert len(set(want)) > 2


@pytest.mark.parametrize("d,eps,m,by", [(5, 0.7, 3, False), (17, 0.9, 5, True)])
def test_density_by_pivots(spark, monkeypatch, d, eps, m, by):
    """Above the size of one task, groups included: the sequential labels."""
    monkeypatch.setattr(D, "DIRECT", 10)
    rng = np.random.default_rng(d)
    rows, want = [], {}
    for g in ("a", "b") if by else ("a",):
        pts = np.vstack([rng.normal(c, 0.12, (60, d)) for c in (0, 0.45, 3)] + [rng.uniform(-1, 3, (30, d))])
        pts[50:56] = pts[50]
        want[g] = sequential(pts, eps, m)
        rows += [(g, i, *map(float, p)) for i, p in enumerate(pts)]
    cols = [f"x{i}" for i in range(d)]
    df = spark.createDataFrame(rows, "g string, id long, " + ", ".join(f"{c} double" for c in cols))
    got = D.density_clusters(df, cols, eps=eps, min_samples=m, by=["g"] if by else []).orderBy("g", "id").collect()
    assert {g: [r.cluster_id for r in got if r.g == g] for g in want} == want
    assert all(len(set(w)) > 2 for w in want.values())
    assert D.density_clusters(df.limit(0), cols, eps=eps, min_samples=m).count() == 0


def test_pivots_spare_most_pairs(spark):
    """Thirty groups on 64 axes: core points found with under 15 % of all pairs compared."""
    from faultline.operators import neighbours as NB

    rng = np.random.default_rng(1)
    pts = np.vstack([rng.normal(c, 0.02, (100, 64)) for c in rng.uniform(0, 1, (30, 64))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id long, v array<double>")
    index = NB.Index(df, block_rows=16)
    got = {r.id for r in index.cores_within(0.23, 40).select("id").collect()}
    near = NB.within(pts, pts, 0.23).sum(axis=1)
    assert got == set(np.flatnonzero(near >= 40).tolist()) and 0 < len(got) < len(pts)
    assert index.compared(index.asks) < 0.15 * len(pts) ** 2


def test_density_writes_no_pair_list(spark, monkeypatch):
    """A crowded ball of n points: every written table has at most a few rows per point."""
    n, d = 300, 17
    sizes = []
    real = D.cut

    def counted(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(D, "cut", counted)
    pts = np.random.default_rng(3).normal(0, 0.01, (n, d))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, " + ", ".join(f"x{i} double" for i in range(d)))
    got = D.density_clusters(df, [f"x{i}" for i in range(d)], eps=0.2, min_samples=4).select("cluster_id").distinct().collect()
    assert [r.cluster_id for r in got] == [0]
    assert max(sizes) <= n


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 101, 2_500, 60_000])
@pytest.mark.parametrize("mode", ["linear", "nearest"])
def test_quantiles_take_one_path_at_every_size(spark, n, mode):
    from faultline.functions.quantiles import long_quantiles

    values = np.random.default_rng(n).integers(0, max(2, n // 3), n).astype(float)
    long = spark.createDataFrame(__import__("pandas").DataFrame({"g": "a", "value": values}))
    probs = {f"q{i}": p for i, p in enumerate((0.0, 0.1, 0.25, 0.33, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0))}
    got = long_quantiles(long, ["g"], probs, mode=mode).first()
    s = np.sort(values)
    for name, p in probs.items():
        pos = (n - 1) * p
        k = int(np.floor(pos))
        want = s[int(np.floor(pos + 0.5))] if mode == "nearest" else s[k] + (s[min(k + 1, n - 1)] - s[k]) * (pos - k)
        assert abs(got[name] - want) < 1e-9, (n, p)


def test_quantiles_of_nothing(spark):
    from faultline.functions.quantiles import long_quantiles

    none = spark.createDataFrame([], "k string, value double")
    assert long_quantiles(none, [], {"q": 0.5}).collect()[0].q is None and long_quantiles(none, ["k"], {"q": 0.5}).collect() == []
    nulls = spark.createDataFrame([("a", None), ("b", 1.0), ("b", 2.0)], "k string, value double")
    assert {r.k: r.q for r in long_quantiles(nulls, ["k"], {"q": 0.5}).collect()} == {"b": 1.5}


def test_post_filter_without_clusters(spark):
    from faultline.operators.propagation import post_filter

    rows = spark.createDataFrame([("w1", -1, True, 0.0), ("w2", -1, True, 0.0)], "window_id string, cluster_id int, noise boolean, cluster_strength double")
    scores = spark.createDataFrame([("w1", 0.4), ("w2", 0.5)], "window_id string, iforest_score_mean double")
    got = post_filter(rows, scores, threshold=0.3).collect()
    assert [(r.cluster_id, r.noise, r.cluster_strength, r.post_filter_threshold, r.post_filter_policy, r.post_filter_passed) for r in got] == [(-1, True, 0.0, 0.3, "fixed_threshold", True)] * 2


def test_reach_is_met_in_tiles(spark, monkeypatch):
    """Points without groups, where nearly all blocks are asked: no row per (point, block), right counts and labels over many tiles."""
    from faultline.operators import neighbours as NB

    monkeypatch.setattr(NB, "TILE_ROWS", 120)
    pts = np.random.default_rng(4).normal(0, 1, (700, 20))
    pts[:40] = pts[0]
    gaps = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(axis=2))
    eps = float(np.median(gaps))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id long, v array<double>")
    index = NB.Index(df, pivots=5, block_rows=8)
    sent = []
    real = NB.Index._met_in_tiles

    def spied(self, asking, columns, types, choose, members, b, *rest):
        sent.append((asking.count(), int(self._tiles(b)[1].max()) + 1))
        return real(self, asking, columns, types, choose, members, b, *rest)

    monkeypatch.setattr(NB.Index, "_met_in_tiles", spied)
    m = 350
    core = index.cores_within(eps, m).cache()
    near = NB.within(pts, pts, eps)
    assert {r.id for r in core.collect()} == set(np.flatnonzero(near.sum(axis=1) >= m).tolist())
    assert index.asks.count() > 20 * len(pts) and sent[0][1] < 10  # blocks asked against tiles sent to
    named = core.selectExpr("*", "(id * 7) % 1000 as label")
    got = {r.id: r.least for r in index.least_label_within(named, named, eps, other=True).collect()}
    ids = np.array(sorted(r.id for r in core.collect()))
    label = ids * 7 % 1000
    want = {int(i): min((int(b) for j, b in zip(ids, label) if near[i, j] and b != a), default=None) for i, a in zip(ids, label)}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_reach_at_its_edge():
    """Grid points at exactly the distance, equal points, huge and missing values: as summed axis by axis."""
    from faultline.operators import neighbours as NB

    rng = np.random.default_rng(2)
    x = np.vstack([rng.integers(0, 4, (80, 5)) * 0.1, [[1e200] * 5] * 2, [[np.nan] * 5], [[np.inf] * 5], rng.normal(1e6, 0.1, (20, 5))])
    with np.errstate(all="ignore"):
        for eps in (0.1, 0.2, 0.3, 0.0, float(np.sqrt(0.02))):
            total = np.zeros((len(x), len(x)))
            for i in range(5):
                gap = x[:, i, None] - x[None, :, i]
                total += gap * gap
            assert (NB.within(x, x, eps) == (np.sqrt(total) <= eps)).all()


def test_distances_by_products_hold_at_any_size():
    """Single precision decides what it can; copies, near copies, outliers and unknowns are summed. Pivots need no table of all axes."""
    import tracemalloc

    from faultline.operators import neighbours as NB

    rng = np.random.default_rng(3)
    for d in (2, 64):
        for scale in (1e-200, 1e-20, 1e-3, 1.0, 1e5, 1e19, 1e160):
            for off in (0, 100):
                x, y = (rng.normal(size=(20, d)) + off) * scale, (rng.normal(size=(150, d)) + off) * scale
                y[:20], y[20:40], y[40] = x, x * (1 + 1e-8), np.nan
                gap = (x[:, None] - y[None]).transpose(2, 0, 1)
                with np.errstate(all="ignore"):
                    total = np.zeros(gap.shape[1:])
                    for g in gap:
                        total += g * g
                    real = np.sqrt(total)
                for eps in (float(np.sort(real[3])[75]), float(np.sort(real[3])[1]), scale, 0.0):
                    assert (NB.within(x, y, eps) == (real <= eps)).all()
                if scale <= 1:
                    assert np.nanmax(np.abs(NB.to_pivots(x, y) - real)) < NB.SLACK / 2
    x, pivots = rng.normal(size=(64, 64)), rng.normal(size=(1024, 64))
    tracemalloc.start()
    NB.to_pivots(x, pivots)
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()
