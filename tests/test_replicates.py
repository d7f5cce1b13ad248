"""Replicates as weights beside refits on copied rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from veracell.operators import detectors as DT, knn, replicates as R, scoring as SC

RUNS = 3


@pytest.fixture(scope="module")
def feats(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(120, 4)), rng.normal(size=(40, 4)) * .3 + 4,
                        rng.normal(size=(6, 4)) * 8])
    x[10:14] = x[3]
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)],
                                 "row_id long, x array<double>").repartition(3).cache()


@pytest.fixture(scope="module")
def rows(feats):
    return R.weighted(feats, RUNS)


def copied(feats, detector, b):
    """Rows flagged and raw order of a refit on copied rows."""
    sample = SC.bootstrap(feats, b)
    found = detector(sample.select("row_id", "x"))
    hits = SC.flag(found.scores, ["score"], 0.05).where("flag_score")
    return {r[0] for r in sample.join(hits, "row_id").select("origin").distinct().collect()}


def test_weights_are_the_copies(feats, rows):
    for b in range(RUNS):
        n = {r[0]: r[1] for r in SC.bootstrap(feats, b).groupBy("origin").count().collect()}
        assert n == {r[0]: r[1] for r in rows.select("row_id", F.col("wv")[b]).where(
            F.col("wv")[b] > 0).collect()}


@pytest.mark.parametrize("method", ["autoencoder", "lof", "robust_pca", "hdbscan"])
def test_flags_are_those_of_copied_refits(feats, rows, method):
    shared = {}
    if method in ("lof", "hdbscan"):
        graph = knn.neighbours(feats, 30).cache()
        shared = {"graph": graph, "members": knn.to_rows(feats, graph.select("x", "pid", "w"))}
    scores = R.SCORERS[method](rows, RUNS, **shared, **(
        {"max_iter": 8} if method == "robust_pca" else {}))
    got = R.flags(rows, scores, RUNS, 0.05).collect()
    for b in range(RUNS):
        want = copied(feats, lambda s: DT.DETECTORS[method](s, max_iter=8), b)
        have = {r["row_id"] for r in got if r[f"r{b}"]}
        if method == "hdbscan":  # bridges are sampled by vectors, ties between levels differ
            assert len(have & want) >= 0.6 * len(have | want)
        else:
            assert have == want


def test_forests_of_weights(rows):
    nodes, psi = DT.forest(rows, 20, 64, 1, "wv", R._sizes(rows, RUNS))
    assert psi == [64] * RUNS and nodes["tree"].nunique() == 20 * RUNS
    hit = R.flags(rows, R.forest_scores(rows, RUNS, trees=60, sample=128), RUNS, 0.04).collect()
    far = set(range(160, 166))
    w = {r[0]: r[1] for r in rows.select("row_id", "wv").collect()}
    for b in range(RUNS):
        own = {i for i in far if w[i][b]}
        assert len(own & {r["row_id"] for r in hit if r[f"r{b}"]}) >= len(own) - 2


def test_short_lists_are_searched_again(feats, rows):
    graph = knn.neighbours(feats, 3)
    near = R.graph_of(rows, graph, RUNS, 20)
    have = F.col("copies") + F.aggregate("near", F.lit(0).cast("long"), lambda a, s: a + s.w)
    assert near.where(have < 20).isEmpty()


def test_methods_share_the_lists_of_the_replicates(feats, rows, monkeypatch):
    graph = knn.neighbours(feats, 30).cache()
    given = {"graph": graph, "members": knn.to_rows(feats, graph.select("x", "pid", "w"))}
    want = R.neighbour_scores(rows, RUNS, **given).collect()
    lists = R.shared_lists(rows, {"lof": given, "hdbscan": given}, RUNS, {})

    def again(*_):
        raise AssertionError("the lists were made again")

    monkeypatch.setattr(R, "graph_of", again)
    got = {r["row_id"]: r["s"] for r in R.neighbour_scores(rows, RUNS, **given, lists=lists).collect()}
    assert {r["row_id"]: [v is None for v in r["s"]] for r in want} == {
        k: [v is None for v in s] for k, s in got.items()}
    for r in want:
        np.testing.assert_allclose([v or 0 for v in got[r["row_id"]]], [v or 0 for v in r["s"]])
    drawn = rows.where(F.array_max("wv") > 0).count()  # in one replicate at least
    assert R.density_replicates(rows, RUNS, **given, lists=lists).count() == drawn


def test_a_ladder_in_one_task_is_that_of_the_rounds(rows, feats, monkeypatch):
    graph = knn.neighbours(feats, 30)
    lists = R.graph_of(rows, graph, RUNS, 20)
    near = knn.shorten(lists, 15).cache()
    sizes = R._sizes(rows, RUNS)

    def scored():
        points, steps, clusters = DT.density_scores(near, sizes)
        return sorted(tuple(r) for r in points.select(
            "rep", "point", F.round("raw", 10), "cluster").collect()), steps, clusters

    one = scored()
    monkeypatch.setattr(DT, "LADDER_ROWS", 0)
    assert one == scored()
    assert len({r[3] for r in one[0]}) > 2


def test_splits_alone_are_those_in_step(rows, monkeypatch):
    """Small replicates take a task each, without barrier rounds."""
    def parts():
        found, done = DT.sparse_parts(rows, "wv", RUNS, max_iter=30)
        return np.array([r["s"] for r in found.orderBy("row_id").collect()]), done

    calls = []
    real = DT._barrier_rounds
    monkeypatch.setattr(DT, "_barrier_rounds", lambda *a: calls.append(a) or real(*a))
    one, turns = parts()
    assert calls == []  # none from the driver: only tasks start rounds
    monkeypatch.setattr(DT, "TASK_CELLS", 1)
    two, again = parts()
    assert len(calls) > 0 and turns == again
    np.testing.assert_allclose(one, two, atol=1e-9)
