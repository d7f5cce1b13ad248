"""Bootstrap refits of the detectors as weights: all replicates of a method in the jobs of one.

A resample with replacement gives every row a count. Instead of copying rows and refitting, each
row carries its counts in all replicates: sums become weighted sums, forests draw from weighted
rows, neighbour lists of one graph are filtered to the rows a replicate has, and the splits of all
replicates run in step. Thresholds are quantiles over the copies of a replicate.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veracell.functions.arrow import arrays, matrix
from veracell.functions.hashing import poisson_one
from veracell.functions.session import cut_lineage
from veracell.operators import detectors as DT, knn
from veracell.operators.features import eigen
from veracell.operators.quantiles import group_quantiles
from veracell.operators.scoring import mean_jaccard

#: Rows that the lists of a shared graph hold: twice what the methods ask for, and some.
GRAPH_ROWS = 52


def weighted(feats: DataFrame, runs: int, seed: int = 42) -> DataFrame:
    """The rows with ``wv``: how often each is in every replicate."""
    key = F.col("row_id").cast("string")
    return cut_lineage(feats.select("row_id", "x", F.array(*[
        poisson_one(key, F.lit(b), seed=seed).cast("int") for b in range(runs)]).alias("wv")))


def _sizes(rows: DataFrame, runs: int) -> list[int]:
    return [int(v or 0) for v in rows.agg(*[F.sum(F.col("wv")[b]) for b in range(runs)]).first()]


def reconstruction_scores(rows: DataFrame, runs: int, **_) -> DataFrame:
    """(row_id, s): the residual under the bottleneck of each replicate."""
    d = len(rows.select("x").first()["x"])

    def partial(batches):
        acc = np.zeros((runs, 1 + d + d * d))
        for b in batches:
            x, w = matrix(b.column(0)), matrix(b.column(1))
            for r in range(runs if len(x) else 0):
                wx = x * w[:, r:r + 1]
                acc[r] += np.concatenate([[w[:, r].sum()], wx.sum(0), (wx.T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([arrays(acc.reshape(1, -1))], ["v"])

    flat = np.zeros(runs * (1 + d + d * d))
    for r in rows.select("x", F.col("wv").cast("array<double>")).mapInArrow(
            partial, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(
            F.sum("v").alias("v")).collect():
        flat[r["i"]] = r["v"]
    means, rests = [], []
    for v in flat.reshape(runs, -1):
        n, mean = max(v[0], 1.0), v[1:1 + d] / max(v[0], 1.0)
        _, basis = eigen(v[1 + d:].reshape(d, d) / n - np.outer(mean, mean))
        basis = basis[:, :max(1, min(d // 2, 10, int(n) - 1))]
        means.append(mean)
        rests.append(np.eye(d) - basis @ basis.T if n >= 50 and d >= 2 else np.zeros((d, d)))

    @F.arrow_udf("array<double>")
    def residual(x: pa.Array) -> pa.Array:
        m = matrix(x)
        return arrays(np.stack([(((m - mean) @ rest) ** 2).mean(1) for mean, rest in zip(
            means, rests)], 1) if len(m) else np.zeros((0, runs)))

    return rows.select("row_id", residual("x").alias("s"))


def forest_scores(rows: DataFrame, runs: int, trees: int = 200, sample: int = 256,
                  seed: int = 42, **_) -> DataFrame:
    nodes, psi = DT.forest(rows, trees, sample, seed, "wv", _sizes(rows, runs))
    return rows.select("row_id", DT._path_score(rows, nodes, psi, trees)("x").alias("s"))


def sparse_scores(rows: DataFrame, runs: int, max_iter: int = 100, tol: float = 1e-6,
                  **_) -> DataFrame:
    d = len(rows.select("x").first()["x"])
    parts, _ = DT.sparse_parts(rows, "wv", runs, max_iter, tol)
    mean = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda b: F.aggregate(
        F.slice("s", b * d + 1, d), F.lit(0.0), lambda a, v: a + F.abs(v)) / d)
    return parts.select("row_id", mean.alias("s"))


def graph_of(rows: DataFrame, graph: DataFrame, runs: int, k: int) -> DataFrame:
    """Neighbour lists of all replicates from one graph: ids are "replicate/point", weights the
    point's rows in the replicate, lists reach k rows or hold all there are.

    The graph is searched again with longer lists where a replicate has too few of a list's rows.
    """
    counts = rows.groupBy("x").agg(F.min("row_id").alias("pid"), *[
        F.sum(F.col("wv")[b]).alias(f"w{b}") for b in range(runs)])
    counts = cut_lineage(counts.select("pid", F.array(*[f"w{b}" for b in range(runs)]).alias("wv")))
    n, length = counts.count(), GRAPH_ROWS
    while True:
        near = graph.select("pid", F.explode("near").alias("s")).select(
            "pid", "s.d", F.col("s.pid").alias("npid")).join(
            counts.select(F.col("pid").alias("npid"), F.col("wv").alias("nwv")), "npid")
        lists = near.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct(
            "d", "npid", "nwv"))).alias("l"))
        tagged = graph.select("pid", "x").join(counts, "pid").join(lists, "pid", "left").select(
            "pid", "x", "l", F.posexplode("wv").alias("rep", "w")).where("w > 0")

        def name(p: Column) -> Column:
            return F.concat_ws("/", F.col("rep").cast("string"), p.cast("string"))
        own = F.transform(F.filter(F.coalesce("l", F.array()), lambda s: F.get(
            s.nwv, F.col("rep")) > 0), lambda s: F.struct(
            s.d.alias("d"), name(s.npid).alias("pid"), F.get(s.nwv, F.col("rep")).alias("w")))
        out = cut_lineage(tagged.select(
            "rep", F.col("pid").alias("base"), name(F.col("pid")).alias("pid"), "x", "w",
            (F.col("w") - 1).alias("copies"), own.alias("near"), F.size(F.coalesce(
                "l", F.array())).alias("listed")))
        have = F.col("copies") + F.aggregate("near", F.lit(0).cast("long"), lambda a, s: a + s.w)
        if length >= n or out.where((have < k) & (F.col("listed") < n - 1)).isEmpty():
            return out.drop("listed")
        length *= 2
        graph = cut_lineage(knn.neighbours(rows.select("row_id", "x"), length))


def _by_row(members: DataFrame, scores: DataFrame, runs: int) -> DataFrame:
    """(row_id, s) from scores of points: (rep, base, v)."""
    wide = scores.groupBy("base").agg(*[F.max(F.when(F.col("rep") == b, F.col("v"))).alias(
        f"v{b}") for b in range(runs)])
    return members.join(wide.select(F.col("base").alias("pid"), F.array(
        *[f"v{b}" for b in range(runs)]).alias("s")), "pid").select("row_id", "s")


def _lof_rows(sizes: list[int], neighbours: int = 20, **_) -> int:
    return min(neighbours, min(sizes) - 1)


def _density_rows(sizes: list[int], min_cluster_size: int = 15, min_samples: int = 5, **_) -> int:
    return max(DT.density_sizes(n, min_cluster_size, min_samples)[2] for n in sizes)


def shared_lists(rows: DataFrame, methods: dict[str, dict], runs: int,
                 options: dict[str, dict]) -> DataFrame | None:
    """``graph_of`` once for the methods, by name, whose ``graph`` is one: long enough for each."""
    if rows.count() < 20:
        return None
    sizes, needs = _sizes(rows, runs), {"lof": _lof_rows, "hdbscan": _density_rows}
    k = max(needs[m](sizes, **options.get(m, {})) for m in methods)
    return graph_of(rows, next(iter(methods.values()))["graph"], runs, k)


def neighbour_scores(rows: DataFrame, runs: int, graph: DataFrame, members: DataFrame,
                     neighbours: int = 20, lists: DataFrame | None = None, **_) -> DataFrame:
    """Local outlier factors in all replicates; ``lists`` are those of ``graph_of``."""
    k = _lof_rows(_sizes(rows, runs), neighbours)
    near = graph_of(rows, graph, runs, k) if lists is None else lists
    found = DT.lof_points(near, k)
    return _by_row(members, near.select("rep", "base", "pid").join(found.select(
        "pid", F.col("lof").alias("v")), "pid"), runs)


def density_replicates(rows: DataFrame, runs: int, graph: DataFrame, members: DataFrame,
                       min_cluster_size: int = 15, min_samples: int = 5, levels: int = 6,
                       lists: DataFrame | None = None, **_) -> DataFrame:
    sizes = _sizes(rows, runs)
    k = _density_rows(sizes, min_cluster_size, min_samples)
    tagged = graph_of(rows, graph, runs, k) if lists is None else lists
    near = cut_lineage(knn.shorten(tagged, k))
    points, _, _ = DT.density_scores(near, sizes, min_cluster_size, min_samples, levels)
    return _by_row(members, near.select("rep", "base", F.col("pid").alias("point")).join(
        points.select("point", F.col("raw").alias("v")), "point"), runs)


SCORERS = {"autoencoder": reconstruction_scores, "isolation_forest": forest_scores,
           "robust_pca": sparse_scores, "lof": neighbour_scores, "hdbscan": density_replicates}


def flags(rows: DataFrame, scores: DataFrame, runs: int, contamination: float) -> DataFrame:
    """(row_id, r0, r1, ...): which rows each replicate flags, strictly above the quantile over
    its copies. Flat scores flag nothing."""
    both = cut_lineage(rows.select("row_id", "wv").join(scores, "row_id"))
    copies = both.select(F.posexplode(F.arrays_zip("s", "wv")).alias("g", "e")).select(
        "g", F.col("e.s").alias("v"), F.col("e.wv").alias("n"))
    cut = group_quantiles(copies, runs, [1.0 - contamination])
    spans = both.agg(*[x for b in range(runs) for v in [F.when(
        F.col("wv")[b] > 0, F.col("s")[b])] for x in (F.max(v) - F.min(v),)]).first()
    return both.select("row_id", *[
        (F.lit((spans[b] or 0) >= DT.FLAT) & (F.col("wv")[b] > 0) & (
            F.col("s")[b] > F.lit(cut[b][0]))).alias(f"r{b}") for b in range(runs)])


def stability(rows: DataFrame, method: str, runs: int, contamination: float,
              graph: DataFrame | None = None, members: DataFrame | None = None,
              lists: DataFrame | None = None, **options) -> float:
    """Mean pairwise Jaccard overlap of the rows that the replicates flag."""
    if runs < 2 or rows.count() < 20:
        return 0.5
    shared = {"graph": graph, "members": members, "lists": lists} if method in (
        "lof", "hdbscan") else {}
    scores = SCORERS[method](rows, runs, **shared, **options)
    hit = flags(rows, scores, runs, contamination)
    names = [f"r{b}" for b in range(runs)]
    return mean_jaccard(hit.select(*[F.coalesce(c, F.lit(False)).alias(c) for c in names]),
                        names).first()[0]
