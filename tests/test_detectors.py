import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veracell.operators import detectors as DT, explain as EX, knn, profile as P, scoring as SC


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)],
                                 "row_id long, x array<double>").repartition(4)


@pytest.fixture(scope="module")
def cloud():
    """Two clusters, far outliers, and a third of all rows at one and the same spot."""
    rng = np.random.default_rng(5)
    a = rng.normal(0, 1, (150, 3))
    b = rng.normal(12, 1, (150, 3))
    far = np.array([[40., 40, 40], [-30, 5, 60], [6, 6, -50]])
    copies = np.repeat(rng.normal(0, 1, (1, 3)), 150, axis=0)
    return np.vstack([a, b, far, copies])


def brute(x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :k]
    return order, np.take_along_axis(d, order, 1)


@pytest.mark.parametrize("block", [16, 64, 100_000])
def test_neighbours_match_brute_force(spark, cloud, block):
    got = knn.edges(points(spark, cloud), 7, block).toPandas().sort_values(["row_id", "rank"])
    _, dist = brute(cloud, 7)
    assert len(got) == 7 * len(cloud)
    np.testing.assert_allclose(got["distance"].to_numpy().reshape(len(cloud), 7), dist, atol=1e-9)


def test_lof_counts_every_copy(spark, cloud):
    k = 10
    order, dist = brute(cloud, k)
    kd = dist[:, -1]
    lrd = 1 / (np.maximum(dist, kd[order]).mean(1) + 1e-10)
    want = lrd[order].mean(1) / lrd
    got = DT.local_outlier_factor(points(spark, cloud), k, block=64).scores.toPandas() \
        .sort_values("row_id")
    mine = np.arange(len(cloud)) < 303  # copies tie at distance zero, which copies are taken varies
    np.testing.assert_allclose(got["lof"].to_numpy()[mine], want[mine], rtol=1e-6)


def test_forest_and_reconstruction(spark, cloud):
    feats = points(spark, cloud)
    f = DT.isolation_forest(feats, trees=60, sample=128)
    top = f.scores.orderBy(F.desc("score")).limit(3).toPandas()["row_id"]
    assert set(top) == {300, 301, 302}
    assert abs(sum(f.meta["importances"]) - 1) < 1e-9
    r = DT.reconstruction_error(feats).scores.toPandas().sort_values("row_id")
    c = cloud - cloud.mean(0)
    w, v = np.linalg.eigh(c.T @ c)
    rest = c - c @ v[:, -1:] @ v[:, -1:].T
    np.testing.assert_allclose(r["raw"], (rest ** 2).mean(1), rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("cells", [1 << 22, 200])
def test_robust_pca_matches_numpy(spark, cloud, monkeypatch, cells):
    monkeypatch.setattr(DT, "TASK_CELLS", cells)  # one task, and tasks that exchange sums
    x = cloud / cloud.std(0)
    n, d = x.shape
    lam, mu = 1 / np.sqrt(max(n, d)), n * d / (4 * np.abs(x).sum() + 1e-10)
    s, y = np.zeros_like(x), np.zeros_like(x)
    for _ in range(12):
        u, sig, vt = np.linalg.svd(x - s + y / mu, full_matrices=False)
        low = u * np.maximum(sig - 1 / mu, 0) @ vt
        t = x - low + y / mu
        s = np.sign(t) * np.maximum(np.abs(t) - lam / mu, 0)
        y = y + mu * (x - low - s)
    got = DT.robust_pca(points(spark, x), max_iter=12, refresh=5).scores.toPandas() \
        .sort_values("row_id")
    np.testing.assert_allclose(got["raw"], np.abs(s).mean(1), atol=1e-8)


def test_density_clusters_find_the_planted_ones(spark, cloud):
    found = DT.density_clusters(points(spark, cloud[:303]))
    rows = found.scores.join(found.clusters, "row_id").toPandas().sort_values("row_id")
    c = rows["cluster"].to_numpy()
    main = [pd.Series(c[s][c[s] != "-1"]).mode()[0] for s in (slice(0, 150), slice(150, 300))]
    assert main[0] != main[1]
    assert (c[300:303] == "-1").all()
    assert rows["score"].to_numpy()[300:303].min() > np.median(rows["score"])


def test_components_distributed_equals_local(spark):
    rng = np.random.default_rng(2)
    chain = [(i, i + 1) for i in range(40)] + [(100, int(v)) for v in range(101, 160)]
    extra = [(int(a) + 200, int(b) + 200) for a, b in rng.integers(0, 60, (40, 2))]
    df = spark.createDataFrame(chain + extra, "a long, b long").repartition(6)
    a = DT.components(df, small=0).orderBy("node").toPandas()
    b = DT.components(df).orderBy("node").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_stability_and_hopkins(spark, cloud):
    feats = points(spark, cloud)
    ss = SC.stability(feats, DT.reconstruction_error, 0.05, runs=2)
    assert 0 <= ss <= 1
    rng = np.random.default_rng(0)
    flat = spark.createDataFrame(pd.DataFrame(rng.random((2000, 2)), columns=["a", "b"])
                                 .assign(k=range(2000)))
    assert abs(P.hopkins(flat, ["a", "b"], "k") - 0.5) < 0.15
    tight = spark.createDataFrame(pd.DataFrame(cloud[:300], columns=list("abc"))
                                  .assign(k=range(300)))
    assert P.hopkins(tight, list("abc"), "k") > 0.8


def test_twins_are_nearest_normal_rows(spark, cloud):
    flags = spark.createDataFrame([(i, i >= 300 and i < 303) for i in range(len(cloud))],
                                  "row_id long, flagged boolean")
    got = EX.clean_twins(points(spark, cloud), flags, block=32).toPandas()
    normal = np.r_[0:300, 303:len(cloud)]
    for _, r in got.iterrows():
        d = np.sqrt(((cloud[normal] - cloud[int(r["row_id"])]) ** 2).sum(1))
        assert abs(r["distance"] - d.min()) < 1e-9
    assert set(got["row_id"]) == {300, 301, 302}


def test_registry():
    assert DT.choose("lof,robust_pca") == ["lof", "robust_pca"]
    assert DT.contamination_level(None, 0.5) == 0.2
    assert DT.contamination_level(None, None) == 0.05
    assert DT.penalty("lof", 200_000, 5) == 0.4


def _brute_near(x, q, k):
    d = np.sqrt(((x[q][:, None, :] - x[None]) ** 2).sum(-1))
    d[np.arange(len(q)), q] = np.inf
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def test_matrix_search_equals_plain_distances(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 6)) + 1e4  # far from the origin, where squares cancel
    x[500:520] = x[3]
    feats = points(spark, x)
    for block in (64, 2048):
        got = knn.edges(feats, 5, block).toPandas().sort_values(["row_id", "rank"])
        d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        want = np.sort(d, axis=1)[:, :5]
        np.testing.assert_allclose(got["distance"].to_numpy().reshape(-1, 5), want, rtol=1e-12)


def test_hashed_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 16)) * 3
    x = centres[rng.integers(0, 60, 12_000)] + rng.normal(size=(12_000, 16)) @ (
        np.eye(16) * np.r_[np.ones(4), np.full(12, .2)])
    feats = points(spark, x)
    q = np.arange(0, 12_000, 60)
    asked = spark.createDataFrame([(int(i),) for i in q], "row_id long")
    near = knn.neighbours(feats, 10, only=asked, index="hashed").select("pid", "near").collect()
    want = dict(zip(q.tolist(), _brute_near(x, q, 10)))
    hit = sum(len({s["pid"] for s in r["near"]} & set(want[r["pid"]].tolist())) for r in near)
    assert hit >= 0.9 * 10 * len(q)


def test_hashed_neighbours_of_one_hot_code(spark):
    x = np.concatenate([np.random.default_rng(1).normal(size=(3000, 3)) * 1e-6,
                        [[5.0, 5, 5], [5, 5, 6]]])
    near = knn.neighbours(points(spark, x), 3, block=256, index="hashed").collect()
    assert len(near) == 3002
    far = {r["pid"]: [s["pid"] for s in r["near"]] for r in near}
    assert 3001 in far[3000] and 3000 in far[3001]
    assert all(len(v) >= 1 for v in far.values())


@pytest.mark.parametrize("held", [1 << 24, 0])
def test_robust_pca_holds_bounded_pieces(spark, cloud, monkeypatch, held):
    """A task's rows go through the rounds in pieces, of which few stay in memory."""
    monkeypatch.setattr(DT, "PIECE_CELLS", 640)
    monkeypatch.setattr(DT, "HELD_CELLS", held)
    x = np.concatenate([cloud / cloud.std(0)] * 3)  # copies are fitted as counts
    got = DT.robust_pca(points(spark, x), max_iter=12, refresh=5).scores.toPandas() \
        .sort_values("row_id")["raw"].to_numpy()
    n, d = x.shape
    lam, mu = 1 / np.sqrt(max(n, d)), n * d / (4 * np.abs(x).sum() + 1e-10)
    s, y = np.zeros_like(x), np.zeros_like(x)
    for _ in range(12):
        u, sig, vt = np.linalg.svd(x - s + y / mu, full_matrices=False)
        low = u * np.maximum(sig - 1 / mu, 0) @ vt
        t = x - low + y / mu
        s = np.sign(t) * np.maximum(np.abs(t) - lam / mu, 0)
        y = y + mu * (x - low - s)
    np.testing.assert_allclose(got, np.abs(s).mean(1), atol=1e-8)


def test_vectors_move_by_halls(spark, monkeypatch):
    """A query's vector travels once to a hall, whatever the number of blocks in it."""
    monkeypatch.setattr(knn, "HALLS", 3)
    calls = []
    find = knn._search_hall
    monkeypatch.setattr(knn, "_search_hall", lambda k: calls.append(k) or find(k))
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 12))
    x[40:60] = x[7]
    got = knn.edges(points(spark, x), 6, 32).toPandas().sort_values(["row_id", "rank"])
    d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    np.testing.assert_allclose(got["distance"].to_numpy().reshape(-1, 6),
                               np.sort(d, axis=1)[:, :6], rtol=1e-12)
    assert calls == [7]
    lines = [{"block": f"{i}", "pivot": i % 5, "inner": float(i), "size": 32} for i in range(22)]
    ordered, halls = knn._halls(x[:5], lines, 240)
    assert len(ordered) == 22 and max(np.bincount(halls)) <= 7 and halls.max() == 3


def test_rows_walk_all_trees_in_step():
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(300, 3)), 1)
    kinds = ("tree", "node", "feature", "cut", "left", "right", "depth")
    nodes = pd.DataFrame([n for t, part in enumerate((x[:64], x[:1], x[64:200])) for n in DT._grow(
        t, part, 5)], columns=kinds).sort_values(["tree", "node"], ignore_index=True)
    for t, walk in enumerate(DT._walks(nodes)):
        own = nodes[nodes["tree"] == t].set_index("node")
        want = []
        for v in x:
            at = own.loc[0]
            while at["feature"] >= 0:
                at = own.loc[at["left"] if v[int(at["feature"])] <= at["cut"] else at["right"]]
            want.append(at["depth"])
        assert DT._path_lengths(x, walk).tolist() == want
