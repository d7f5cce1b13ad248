"""Five unsupervised detectors: ``(row_id, x)`` in, ``(row_id, score)`` in [0, 1] out.

Each keeps only bounded models on the driver: tree nodes, d x d matrices, a ladder of levels.
"""
from __future__ import annotations

import base64
import functools
import itertools
import math
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, Window, functions as F

from veracell.functions.arrow import arrays, matrix
from veracell.functions.hashing import scramble
from veracell.functions.joins import join_lines
from veracell.functions.session import cut_lineage
from veracell.operators import knn
from veracell.operators.features import eigen, gram_matrix
from veracell.operators.quantiles import group_quantiles

FLAT = 1e-10


@dataclass
class Detection:
    method: str
    scores: DataFrame
    params: dict = field(default_factory=dict)
    meta: dict = field(default_factory=dict)
    clusters: DataFrame | None = None


def min_max(df: DataFrame, column: str, out: str = "score") -> DataFrame:
    """Scale to [0, 1]; a flat column becomes 0."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None or hi - lo < FLAT:
        return df.withColumn(out, F.lit(0.0))
    return df.withColumn(out, (F.col(column) - F.lit(lo)) / F.lit(hi - lo))


def _zeros(feats: DataFrame) -> DataFrame:
    return feats.select("row_id", F.lit(0.0).alias("score"))


# ---- isolation forest --------------------------------------------------------------------------

def _mean_path(n: float) -> float:
    """Average path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, depth double"


def _grow(tree: int, x: np.ndarray, seed: int) -> list[tuple]:
    """Random splits until points are alone, equal, or the depth limit is reached."""
    rng = np.random.default_rng(seed + tree)
    limit, nodes, todo = math.ceil(math.log2(max(len(x), 2))), [], [(0, np.arange(len(x)), 0)]
    made = 1
    while todo:
        node, rows, depth = todo.pop()
        part = x[rows]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) else []
        if depth >= limit or len(rows) <= 1 or not len(spread):
            nodes.append((tree, node, -1, 0.0, -1, -1, depth + _mean_path(len(rows))))
            continue
        f = int(rng.choice(spread))
        lo, hi = part[:, f].min(), part[:, f].max()
        cut = float(rng.uniform(lo, hi))
        goes_left = part[:, f] <= cut
        nodes.append((tree, node, f, cut, made, made + 1, float(depth)))
        todo.append((made, rows[goes_left], depth + 1))
        todo.append((made + 1, rows[~goes_left], depth + 1))
        made += 2
    return nodes


#: Lines that bring sampled rows to the trees are put together by so many groups of trees.
TREE_GROUPS = 64


def forest(feats: DataFrame, trees: int = 200, sample: int = 256, seed: int = 42,
           weights: str | None = None, sizes: list[int] | None = None) \
        -> tuple[pd.DataFrame, int | list[int]]:
    """Node table of an isolation forest; each tree sees the ``psi`` rows with the smallest draws.

    A row's draw for a tree is a hash of both, so the sample of a tree is a bottom-k sample, which
    partitions could merge in any order; only draws under a bound that nearly always leaves enough
    are sent, and the bound is widened until every tree has its rows. ``weights`` names an array
    of row counts per replicate (``sizes``: rows of each replicate); then there is a forest for
    each, numbered on, in which every copy of a row draws anew.
    """
    n = [feats.count()] if sizes is None else sizes
    psi = [min(sample, m) for m in n]
    rows = feats.select(F.xxhash64(F.col("row_id").cast("string"), F.lit(seed)).alias("h"), "x",
                        F.array(F.lit(1)).alias("w") if weights is None else F.col(weights).alias(
                            "w"))
    groups = min(TREE_GROUPS, trees)

    def draws(h: np.ndarray, w: np.ndarray, slack: float):
        """(row, tree, draw) of the draws under the bound."""
        out = ([], [], [])
        for r in range(len(n)):
            bound = min(1.0, (psi[r] + slack * (math.sqrt(psi[r]) + 3)) / max(n[r], 1))
            copies = np.repeat(np.arange(len(h)), w[:, r])
            copy = np.arange(len(copies)) - np.searchsorted(copies, copies)
            own = scramble(h[copies] + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            for t in range(trees):
                v = scramble(own ^ scramble(np.array([r * trees + t + 1], np.uint64)))
                hit = np.flatnonzero(v <= np.uint64(min(int(bound * 2 ** 64), 2 ** 64 - 1)))
                for o, x in zip(out, (copies[hit], np.full(len(hit), r * trees + t), v[hit])):
                    o.append(x)
        return tuple(map(np.concatenate, out))

    def send(slack: float):
        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                row, tree, v = draws(b.column(0).to_numpy().view(np.uint64), matrix(b.column(2))
                                     .astype(np.int64), slack)
                by = np.lexsort((row, tree % groups))
                row, tree, v = row[by], tree[by], v[by]
                g = tree % groups
                cut = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (
                    row[1:] != row[:-1])])) if len(row) else np.zeros(0, np.int64)
                ends = pa.array(np.append(cut, len(row)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[cut].astype(np.int32)), b.column(1).take(pa.array(row[cut])),
                     pa.ListArray.from_arrays(ends, pa.array(tree.astype(np.int32))),
                     pa.ListArray.from_arrays(ends, pa.array(v.view(np.int64)))],
                    ["g", "x", "tree", "draw"])
        return run

    def build(t: pa.Table) -> pa.Table:
        x = matrix(t.column("x"))
        lists = t.column("tree").combine_chunks()
        row = np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy()))
        tree = lists.flatten().to_numpy()
        draw = t.column("draw").combine_chunks().flatten().to_numpy().view(np.uint64)
        by = np.lexsort((draw, tree))
        row, tree = row[by], tree[by]
        nodes = []
        for k in np.unique(tree).tolist():
            lo = np.searchsorted(tree, k)
            own = row[lo:np.searchsorted(tree, k, "right")][:psi[k // trees]]
            if len(own) < psi[k // trees]:
                nodes.append((k, -1, -1, 0.0, -1, -1, 0.0))
            nodes += _grow(k, x[own], seed)
        columns = list(zip(*nodes))
        return pa.table({f: pa.array(c, kind) for f, c, kind in zip(
            ("tree", "node", "feature", "cut", "left", "right", "depth"), columns,
            (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(),
             pa.float64()))})

    slack = 6.0
    while True:
        pool = rows.select("h", "x", "w").mapInArrow(
            send(slack), "g int, x array<double>, tree array<int>, draw array<long>")
        nodes = pool.groupBy("g").applyInArrow(build, NODE_SCHEMA).toPandas()
        if not (nodes["node"] < 0).any() and nodes["tree"].nunique() == trees * len(n):
            break
        slack *= 8
    nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
    return nodes, psi[0] if sizes is None else psi


def split_shares(nodes: pd.DataFrame, d: int) -> list[float]:
    """Share of all splits made on each feature."""
    used = nodes.loc[nodes["feature"] >= 0, "feature"].value_counts()
    total = max(int(used.sum()), 1)
    return [float(used.get(i, 0)) / total for i in range(d)]


def _walks(nodes: pd.DataFrame) -> list[tuple]:
    """Per tree (levels, feature, cut, children, depth); a leaf leads to itself, so all rows take
    the same steps. The children of node i are at 2 i (at or under the cut) and 2 i + 1."""
    out = []
    for _, t in nodes.groupby("tree", sort=True):
        feature, depth = t["feature"].to_numpy(), t["depth"].to_numpy(dtype=float)
        inner = feature >= 0
        own = np.arange(len(t))
        kids = np.stack([np.where(inner, t[c].to_numpy(), own) for c in ("left", "right")], 1)
        levels = int(depth[inner].max()) + 1 if inner.any() else 0
        out.append((levels, np.maximum(feature, 0).astype(np.intp), t["cut"].to_numpy(dtype=float),
                    kids.ravel().astype(np.intp), depth))
    return out


def _path_lengths(m: np.ndarray, walk: tuple) -> np.ndarray:
    """How deep each row comes to lie in one tree."""
    levels, feature, cut, kids, depth = walk
    flat, begin = np.ascontiguousarray(m).ravel(), np.arange(len(m)) * m.shape[1]
    at = np.zeros(len(m), np.intp)
    for _ in range(levels):
        over = ~(flat.take(begin + feature.take(at)) <= cut.take(at))
        at = kids.take(2 * at + over)
    return depth.take(at)


def _path_score(feats: DataFrame, nodes: pd.DataFrame, psi: list[int], trees: int):
    """A UDF of x: the score under each forest of the node table, as an array."""
    model = feats.sparkSession.sparkContext.broadcast(_walks(nodes))

    @F.arrow_udf("array<double>")
    def raw_score(x: pa.Array) -> pa.Array:
        m = matrix(x)
        total = np.zeros((len(m), len(psi)))
        for i, walk in enumerate(model.value if len(m) else ()):
            total[:, i // trees] += _path_lengths(m, walk)
        norm = np.array([_mean_path(p) or 1.0 for p in psi])
        return arrays(2.0 ** (-(total / trees) / norm))
    return raw_score


def isolation_forest(feats: DataFrame, trees: int = 200, sample: int = 256, seed: int = 42,
                     **_) -> Detection:
    nodes, psi = forest(feats, trees, sample, seed)
    d = len(feats.select("x").first()["x"])
    raw = cut_lineage(feats.select("row_id", _path_score(feats, nodes, [psi], trees)("x")[0].alias(
        "raw")))
    return Detection("isolation_forest", min_max(raw, "raw").select("row_id", "score"),
                     {"trees": trees, "sample": psi}, {"importances": split_shares(nodes, d)})


# ---- local outlier factor ----------------------------------------------------------------------

def _weighted_edges(near: DataFrame, k: int) -> DataFrame:
    """(pid, npid, d, rows): neighbours by distance, own copies first, k rows in all."""
    lists = near.select(
        "pid", F.concat(F.array("pid"), F.col("near.pid")).alias("npid"),
        F.concat(F.array(F.lit(0.0)), F.col("near.d")).alias("d"),
        knn.shares(k)("near.w", "copies").alias("rows"))
    return lists.select("pid", F.inline(F.arrays_zip("npid", "d", "rows"))).where("rows > 0")


def lof_points(near: DataFrame, k: int) -> DataFrame:
    """(pid, x, w, lof) per distinct point from lists that reach k rows."""
    near = cut_lineage(knn.shorten(near, k))
    reach = near.select(F.col("pid").alias("npid"), F.when(F.col("copies") >= k, 0.0).otherwise(
        F.coalesce(F.array_max(F.transform("near", lambda s: s.d)), F.lit(0.0))).alias("kdist"))
    links = cut_lineage(_weighted_edges(near, k))
    lrd = links.join(reach, "npid").groupBy("pid").agg(
        (1.0 / (F.sum(F.col("rows") * F.greatest("d", "kdist")) / F.sum("rows") + 1e-10))
        .alias("lrd"))
    lrd = cut_lineage(lrd)
    around = links.join(lrd.select(F.col("pid").alias("npid"), F.col("lrd").alias("nlrd")),
                        "npid").groupBy("pid").agg(
        (F.sum(F.col("rows") * F.col("nlrd")) / F.sum("rows")).alias("mean_lrd"))
    return near.select("pid", "x", "w").join(around, "pid").join(lrd, "pid").select(
        "pid", "x", "w", (F.col("mean_lrd") / F.col("lrd")).alias("lof"))


def local_outlier_factor(feats: DataFrame, neighbours: int = 20, block: int = knn.BLOCK,
                         index: str = "exact", graph: DataFrame | None = None, **_) -> Detection:
    """``graph`` may bring the neighbour lists (of ``neighbours`` rows or more)."""
    k = min(neighbours, feats.count() - 1)
    if k < 2:
        return Detection("lof", _zeros(feats), {"k": k})
    near = graph if graph is not None else knn.neighbours(feats, k, block, index=index)
    points = cut_lineage(lof_points(near, k))
    scaled = min_max(points, "lof").select("x", "w", "score", "lof")
    return Detection("lof", knn.to_rows(feats, scaled).select("row_id", "score", "lof"), {"k": k})


# ---- density clusters --------------------------------------------------------------------------

SMALL_GRAPH = 500_000


def _union(out: tuple[str, str]):
    """Smallest reachable node of every node on the edges of a partition."""
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        n = t.num_rows
        ends = pa.chunked_array(t.column("a").chunks + t.column("b").chunks).combine_chunks()
        # Codes follow the order of the ids, so the smallest code is the smallest id.
        ids = ends.unique().take(pc.sort_indices(ends.unique()))
        code = pc.index_in(ends, ids).to_numpy()
        a, b = code[:n], code[n:]
        label = np.arange(len(ids))
        while True:
            least = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], least)
            np.minimum.at(new, label[b], least)
            while True:  # halve the paths
                up = new[new]
                if (up == new).all():
                    break
                new = up
            if (new == label).all():
                break
            label = new
        yield pa.RecordBatch.from_arrays([ids, ids.take(pa.array(label))], list(out))
    return run


def components(edges: DataFrame, small: int = SMALL_GRAPH, at_most: int | None = None) -> DataFrame:
    """(node, label) of every node on an edge: the smallest node it can reach.

    Each partition first replaces its edges by one link per node to the smallest node it reaches
    there, which keeps all connections. A remainder of counted, bounded size is finished in one
    task; a larger one by rounds of minimum labels and pointer jumping. ``at_most`` bounds the
    number of edges where the caller knows it.
    """
    kind = edges.schema["a"].dataType.simpleString()
    if at_most is not None and at_most <= small:
        return cut_lineage(edges.select("a", "b").coalesce(1).mapInArrow(
            _union(("node", "label")), f"node {kind}, label {kind}"))
    local = cut_lineage(edges.select("a", "b").mapInArrow(
        _union(("a", "b")), f"a {kind}, b {kind}"))
    if local.count() <= small:
        return cut_lineage(local.coalesce(1).mapInArrow(
            _union(("node", "label")), f"node {kind}, label {kind}"))
    both = cut_lineage(local.unionByName(local.select(
        F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    links = both.count()
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.min("a")).alias("label")))
    while True:
        other = labels.select(F.col("node").alias("b"), F.col("label").alias("nl"))
        pull = join_lines(both, other, "b", links).groupBy(F.col("a").alias("node")).agg(F.min("nl").alias("m"))
        step = labels.join(pull, "node").select(
            "node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = cut_lineage(join_lines(step, jump, "label", links, "left").select(
            "node", "was", F.least("label", F.coalesce("up", "label")).alias("label")))
        if new.where("label <> was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


LANDMARKS = 256


def _bridges(core: DataFrame) -> dict[int, list[tuple]]:
    """Per replicate a minimum spanning tree over at most 256 sampled points, by mutual reachability.

    Nearest-neighbour edges stay inside clusters; these few edges tell at which distance clusters
    meet, so that outliers farther than that count as noise.
    """
    order = Window.partitionBy("rep").orderBy(F.xxhash64("x"))
    found: dict[int, list] = {}
    for r in core.withColumn("r", F.row_number().over(order)).where(
            F.col("r") <= LANDMARKS).orderBy("rep", "r").select("rep", "pid", "x", "core").collect():
        found.setdefault(r["rep"], []).append(r)
    return {rep: _spanning(rows) for rep, rows in found.items()}


def _spanning(rows: list) -> list[tuple]:
    if len(rows) < 2:
        return []
    x = np.array([r["x"] for r in rows], dtype=float)
    c = np.array([r["core"] if r["core"] is not None else 0.0 for r in rows])
    reach = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    reach = np.maximum(np.maximum(reach, c[:, None]), c[None, :])
    near, via = reach[0].copy(), np.zeros(len(rows), dtype=int)
    near[0], out = np.inf, []
    inside = np.zeros(len(rows), dtype=bool)
    inside[0] = True
    for _ in range(len(rows) - 1):
        j = int(np.argmin(np.where(inside, np.inf, near)))
        out.append((rows[via[j]]["pid"], rows[j]["pid"], float(near[j])))
        inside[j] = True
        closer = reach[j] < near
        near[closer], via[closer] = reach[j][closer], j
    return out


def density_clusters(feats: DataFrame, min_cluster_size: int = 15, min_samples: int = 5,
                     levels: int = 6, block: int = knn.BLOCK, index: str = "exact",
                     graph: DataFrame | None = None, **_) -> Detection:
    """Density-based outliers on a ladder of distance levels.

    Mutual-reachability edges of the k-nearest-neighbour graph are added level by level; a point
    is scored by how much later it joins a component of the minimum size than the densest part of
    that component formed. Clusters are the components whose persistence over the ladder exceeds
    that of the parts they split into. Approximate to the resolution of ladder and graph.
    ``graph`` may bring the neighbour lists (of 15 rows or more).
    """
    n = feats.count()
    mcs, ms, k = density_sizes(n, min_cluster_size, min_samples)
    if n < 5:
        return Detection("hdbscan", _zeros(feats), {"min_cluster_size": mcs})
    near = cut_lineage(knn.shorten(graph, k) if graph is not None else knn.neighbours(
        feats, k, block, index=index))
    points, n_levels, n_clusters = density_scores(near.withColumn("rep", F.lit(0)), [n],
                                                  min_cluster_size, min_samples, levels)
    scored = min_max(points, "raw")
    found = near.select("x", "w", F.col("pid").alias("point")).join(scored, "point")
    rows = cut_lineage(knn.to_rows(feats, found).select("row_id", "score", "cluster"))
    noise = rows.agg(F.avg((F.col("cluster") == "-1").cast("double"))).first()[0]
    return Detection("hdbscan", rows.select("row_id", "score"),
                     {"min_cluster_size": mcs, "min_samples": ms, "levels": n_levels},
                     {"n_clusters": n_clusters, "noise_ratio": noise},
                     rows.select("row_id", "cluster"))


def density_sizes(n: int, min_cluster_size: int = 15, min_samples: int = 5) -> tuple[int, int, int]:
    """Smallest cluster, rows of the core distance, rows of the neighbour lists."""
    mcs = max(5, min(min_cluster_size, n // 10))
    ms = max(3, min(min_samples, mcs))
    return mcs, ms, min(max(ms, 15), n - 1)


def density_scores(near: DataFrame, sizes: list[int], min_cluster_size: int = 15,
                   min_samples: int = 5, levels: int = 6) -> tuple[DataFrame, int, int]:
    """(rep, point, raw, cluster) of the points of one or more replicates at once.

    ``near`` has neighbour lists with a ``rep`` column (0, 1, ...; ids differ between replicates),
    ``sizes`` the rows of each. Every level is one set of jobs however many replicates there are.
    """
    reps, k = len(sizes), max(density_sizes(n, min_cluster_size, min_samples)[2] for n in sizes)
    smallest, rows_of_core = (F.array(*[F.lit(density_sizes(
        n, min_cluster_size, min_samples)[i]) for n in sizes])[F.col("rep")] for i in (0, 1))
    links = _weighted_edges(near, k)
    core = near.withColumn("least", rows_of_core).select(
        "rep", "pid", "x", "w", _core_distance()("near.w", "near.d", "copies", "least").alias("core"))
    core = cut_lineage(core)
    other = core.select(F.col("pid").alias("npid"), F.col("core").alias("ncore"))
    edges = cut_lineage(links.where("pid <> npid").join(core.select("rep", "pid", "core"), "pid")
                        .join(other, "npid").select(
        "rep", F.col("pid").alias("a"), F.col("npid").alias("b"),
        F.greatest("core", "ncore", "d").alias("w")))
    probs = [i / levels for i in range(1, levels + 1)]
    cuts = group_quantiles(edges.select(F.col("rep").alias("g"), F.col("w").alias("v")), reps,
                           probs)
    bridges = _bridges(core)
    ladders = [sorted({v for v in cuts[b] if v is not None} | {
        w for _, _, w in sorted(bridges.get(b, []), key=lambda e: -e[2])[:4]}) or [1.0]
        for b in range(reps)]
    # Shorter ladders stay at their last level, where nothing is added.
    steps = max(map(len, ladders))
    ladders = [x + [x[-1]] * (steps - len(x)) for x in ladders]
    if any(bridges.values()):
        edges = cut_lineage(edges.unionByName(feats_frame(core, [
            (b, *e) for b, es in bridges.items() for e in es], edges.schema)))

    def level(i: int):
        """The distance of level i (0 before the first, infinity after the last) by replicate."""
        return F.array(*[F.lit(float("inf") if i > steps else x[i - 1] if i else -1.0)
                         for x in ladders])[F.col("rep")]

    edges = _thinned(edges.select("rep", "a", "b", functools.reduce(
        lambda above, i: F.when(F.col("w") <= level(i), i).otherwise(above),
        range(steps, 0, -1), F.lit(steps + 1)).alias("level")).where(
        F.col("level") <= steps), reps)

    if max(sizes) <= LADDER_ROWS:
        names = ["rep", "pid", "w", "core"]
        points = core.select(*names).groupBy("rep").cogroup(edges.groupBy("rep")).applyInArrow(
            _climb(ladders, sizes, min_cluster_size, min_samples),
            f"rep int, point {core.schema['pid'].dataType.simpleString()}, raw double, "
            "cluster string")
        points = cut_lineage(points)
        return points, steps, points.where("cluster <> '-1'").agg(
            F.count_distinct("cluster")).first()[0]

    # comp: (label, node size, first level, chain and its sums); nodes: contracted components
    members = core.select("rep", F.col("pid").alias("point"), F.col("pid").alias("comp"), "w",
                          F.lit(None).cast("double").alias("joined"),
                          F.lit(None).cast("double").alias("densest"),
                          F.lit(None).cast("string").alias("chain"))
    members = cut_lineage(members)
    points_n, n_edges = members.count(), edges.count()
    big = None
    chains = []
    for i in range(steps):
        eps = level(i + 1)
        band = edges.where(F.col("level") == i + 1)
        la = members.select(F.col("point").alias("a"), F.col("comp").alias("ca"))
        lb = members.select(F.col("point").alias("b"), F.col("comp").alias("cb"))
        lifted = band.join(la, "a").join(lb, "b").where("ca <> cb").select(
            F.col("ca").alias("a"), F.col("cb").alias("b"))
        labels = components(lifted, at_most=n_edges).withColumnRenamed("node", "comp")
        moved = join_lines(members, labels, "comp", points_n, "left").withColumn(
            "comp", F.coalesce("label", "comp")).drop("label")
        big_ones = moved.groupBy("rep", "comp").agg(F.sum("w").alias("size"),
                                                    F.min("joined").alias("born"))
        big_ones = big_ones.where(F.col("size") >= smallest).select(
            "rep", "comp", "size", F.coalesce("born", eps).alias("born"))
        # chains of components that only grow; a merge of two big ones starts a new chain
        width = F.lit(1.0) / F.greatest(eps, F.lit(FLAT)) - F.when(
            level(i + 2) == float("inf"), 0.0).otherwise(F.lit(1.0) / F.greatest(
                level(i + 2), F.lit(FLAT)))
        if big is None:
            grown = big_ones.withColumn("kids", F.lit(0)).withColumn("kid", F.lit(None).cast("string")) \
                .withColumn("sum", F.lit(0.0)).withColumn("best", F.lit(0.0))
        else:
            up = big.join(labels, "comp", "left").select(
                F.coalesce("label", "comp").alias("label"), "chain", "sum", "best")
            kids = up.groupBy("label").agg(
                F.count(F.lit(1)).alias("kids"), F.min("chain").alias("kid"),
                F.max("sum").alias("one_sum"), F.max("best").alias("one_best"),
                F.sum(F.greatest("sum", "best")).alias("all_best"))
            chains.append(up.join(kids.where("kids > 1"), "label").select(
                "chain", "sum", "best", F.concat(F.col("label").cast("string"), F.lit(f"@{i}"))
                .alias("parent")))
            grown = big_ones.join(kids, big_ones["comp"] == kids["label"], "left").select(
                "rep", "comp", "size", "born", F.coalesce("kids", F.lit(0)).alias("kids"),
                F.when(F.col("kids") == 1, F.col("kid")).alias("kid"),
                F.when(F.col("kids") == 1, F.col("one_sum")).otherwise(0.0).alias("sum"),
                F.when(F.col("kids") == 1, F.col("one_best"))
                .when(F.col("kids") > 1, F.col("all_best")).otherwise(0.0).alias("best"))
        big = cut_lineage(grown.select(
            "rep", "comp", "size", "born",
            F.coalesce("kid", F.concat(F.col("comp").cast("string"), F.lit(f"@{i}")))
            .alias("chain"),
            (F.col("sum") + F.col("size") * width).alias("sum"), "best"))
        seen = big.select("comp", F.col("born").alias("b"), F.col("chain").alias("c"))
        members = cut_lineage(join_lines(moved, seen, "comp", points_n, "left").select(
            "rep", "point", "comp", "w",
            F.coalesce("joined", F.when(F.col("b").isNotNull(), eps))
            .alias("joined"),
            F.coalesce("densest", "b").alias("densest"), F.coalesce("chain", "c").alias("chain")))
    labels_by_chain, n_clusters = _pick_chains(big, chains)
    glosh = F.when(F.col("joined").isNull(), 1.0 - F.coalesce("nearest_born", F.lit(0.0)) /
                   F.greatest("core", level(steps))).when(F.col("joined") <= 0, 0.0) \
        .otherwise(1.0 - F.col("densest") / F.col("joined"))
    lowest = members.groupBy("rep").agg(F.min("joined").alias("nearest_born"))
    points = (members.join(core.select(F.col("pid").alias("point"), "core"), "point")
              .join(F.broadcast(lowest), "rep")  # a line per replicate
              .join(labels_by_chain, "chain", "left")
              .select("rep", "point", glosh.alias("raw"), F.coalesce("cluster", F.lit("-1"))
                      .alias("cluster")))
    return cut_lineage(points), steps, n_clusters


def _core_distance():
    @F.arrow_udf("double")
    def core(weights: pa.Array, d: pa.Array, own: pa.Array, least: pa.Array) -> pa.Array:
        """The distance at which the own copies and the neighbours reach ``least`` rows."""
        at, w, before = knn._before(weights, own)
        least = least.to_numpy()
        hit = np.flatnonzero(before + w >= least[at])
        which, first = np.unique(at[hit], return_index=True)
        out, known = np.zeros(len(weights)), own.to_numpy() >= least
        out[which] = d.flatten().to_numpy()[hit[first]]
        out[known] = 0.0
        known[which] = True
        return pa.array(out, mask=~known)
    return core


#: Rows of a replicate whose forest one task takes up the ladder; larger ones go by rounds of jobs.
LADDER_ROWS = 1_000_000


def _joined(x: np.ndarray, y: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For every node the smallest node it is linked with, of links between labels."""
    least = np.arange(len(label))
    while True:
        a, b = least[x], least[y]
        low = np.minimum(a, b)
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not (new[new] == new).all():
            new = new[new]
        if (new == least).all():
            return least[label]
        least = new


def _climb(ladders: list[list[float]], sizes: list[int], min_cluster_size: int, min_samples: int):
    """The levels of ``density_scores`` over the points and the spanning forest of a replicate."""
    def run(points: pa.Table, edges: pa.Table) -> pa.Table:
        t = points.take(pc.sort_indices(points.column("pid")))
        rep, ids = t.column("rep")[0].as_py(), t.column("pid").combine_chunks()
        ladder = ladders[rep]
        smallest = density_sizes(sizes[rep], min_cluster_size, min_samples)[0]
        n, w = t.num_rows, t.column("w").to_numpy()
        ends = [pc.index_in(edges.column(c).combine_chunks(), ids).to_numpy() for c in ("a", "b")]
        at_level = edges.column("level").to_numpy()
        comp = np.arange(n)
        joined, densest, chain = np.full(n, np.nan), np.full(n, np.nan), np.full(n, -1)
        # Chains: where they begin (component, level), their sums, and the chain they end in.
        begun: list[tuple[int, int]] = []
        total, best, parent = [], [], []
        live: dict[int, int] = {}  # component: chain
        for i, eps in enumerate(ladder):
            here = at_level == i + 1
            if here.any():
                comp = _joined(comp[ends[0][here]], comp[ends[1][here]], comp)
            size = np.bincount(comp, w, n)
            first = np.full(n, np.inf)
            np.fmin.at(first, comp, joined)
            big = np.flatnonzero(size >= smallest)
            first = np.where(np.isinf(first), eps, first)
            width = 1.0 / max(eps, FLAT) - (
                1.0 / max(ladder[i + 1], FLAT) if i + 1 < len(ladder) else 0.0)
            kids: dict[int, list[int]] = {}
            for c, own in live.items():
                kids.setdefault(int(comp[c]), []).append(own)
            live, of = {}, np.full(n, -1)
            for c in big.tolist():
                own = kids.get(c, [])
                if len(own) == 1:
                    k = own[0]
                else:
                    k = len(begun)
                    begun.append((c, i))
                    total.append(0.0)
                    best.append(sum(max(total[x], best[x]) for x in own))
                    parent.append(-1)
                    for x in own:
                        parent[x] = k
                total[k] += size[c] * width
                live[c] = of[c] = k
            inside = of[comp] >= 0
            joined = np.where(np.isnan(joined) & inside, eps, joined)
            densest = np.where(np.isnan(densest) & inside, first[comp], densest)
            chain = np.where((chain < 0) & inside, of[comp], chain)
        cluster = np.full(len(begun) + 1, -1)
        for k in range(len(begun) - 1, -1, -1):  # chains begin after those that end in them
            alone = parent[k] < 0 and len(live) == 1
            above = cluster[parent[k]] if parent[k] >= 0 else -1
            cluster[k] = above if above >= 0 else k if not alone and total[k] >= best[k] else -1
        of = cluster[chain]
        names = [*(f"{c}@{i}" for (c, i) in zip(ids.take(pa.array(
            [c for c, _ in begun], pa.int64())).cast(pa.string()).to_pylist(),
            (i for _, i in begun))), "-1"]
        core = np.nan_to_num(t.column("core").to_numpy(), nan=-np.inf)
        born = np.nanmin(joined) if (~np.isnan(joined)).any() else 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            raw = np.where(
                np.isnan(joined), 1.0 - born / np.maximum(core, ladder[-1]),
                np.where(joined <= 0, 0.0, 1.0 - densest / joined))
        return pa.table({"rep": t.column("rep"), "point": ids, "raw": pa.array(raw),
                         "cluster": pa.array(names, pa.string()).take(pa.array(
                             np.where(of < 0, len(begun), of)))})
    return run


#: Edges of one task that looks for those which connect nothing new.
FOREST_EDGES = 2_000_000


def _thinned(edges: DataFrame, reps: int) -> DataFrame:
    """The edges (rep, a, b, level) without those whose ends meet at their level or before anyway.

    Each task keeps a spanning forest of its edges, lowest levels first; that connects the same
    nodes at every level.
    """
    cuts = -(-edges.count() // (FOREST_EDGES * reps)) or 1
    part = F.col("rep") * cuts + F.pmod(F.xxhash64("a"), F.lit(cuts)).cast("int")
    return cut_lineage(edges.repartitionById(reps * cuts, part).mapInArrow(
        _spanning_forest, edges.schema))


def _spanning_forest(batches):
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    n = t.num_rows
    ends = pa.chunked_array(t.column("a").chunks + t.column("b").chunks).combine_chunks()
    ids = ends.unique()
    code = pc.index_in(ends, ids).to_numpy()
    a, b, level = code[:n], code[n:], t.column("level").to_numpy()
    label, keep = np.arange(len(ids)), np.zeros(n, bool)
    for k in np.unique(level):
        e = np.flatnonzero(level == k)
        while True:
            x, y = label[a[e]], label[b[e]]
            apart = x != y
            e, x, y = e[apart], x[apart], y[apart]
            if not len(e):
                break
            best = np.full(len(ids), n)  # every component takes its first edge
            np.minimum.at(best, x, e)
            np.minimum.at(best, y, e)
            own = np.flatnonzero(best < n)
            keep[best[own]] = True
            up = np.arange(len(ids))
            one, two = label[a[best[own]]], label[b[best[own]]]
            up[own] = np.where(one == own, two, one)
            both = (up[up] == np.arange(len(ids))) & (np.arange(len(ids)) < up)
            up[both] = np.flatnonzero(both)  # two that took the same edge
            while True:
                further = up[up]
                if (further == up).all():
                    break
                up = further
            label = up[label]
    yield from t.filter(pa.array(keep)).to_batches()


def feats_frame(like: DataFrame, rows: list[tuple], schema) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def _pick_chains(top: DataFrame, merged: list[DataFrame]) -> tuple[DataFrame, int]:
    """(chain, cluster): the chains that outlast their parts, each part mapped to its winner."""
    # The whole of a replicate is no cluster.
    alone = top.groupBy("rep").agg((F.count(F.lit(1)) == 1).alias("alone"))
    level = top.join(F.broadcast(alone), "rep").select("chain", F.when(
        ~F.col("alone") & (F.col("sum") >= F.col("best")), F.col("chain")).alias("cluster"))
    out = level
    if merged:
        parts = cut_lineage(functools.reduce(DataFrame.unionByName, [
            kids.withColumn("level", F.lit(i)) for i, kids in enumerate(merged)]))
        # A level where nothing merged changes nothing and needs no jobs.
        for r in parts.select("level").distinct().orderBy(F.desc("level")).collect():
            level = parts.where(F.col("level") == r["level"]).drop("level").join(
                level.select(F.col("chain").alias("parent"), F.col("cluster").alias("above"))
                .unionByName(out.select(F.col("chain").alias("parent"),
                                        F.col("cluster").alias("above"))).distinct(),
                "parent").select("chain", F.coalesce("above", F.when(
                    F.col("sum") >= F.col("best"), F.col("chain"))).alias("cluster"))
            out = cut_lineage(out.unionByName(level))
    return out, out.agg(F.count_distinct("cluster")).first()[0]


# ---- reconstruction error ----------------------------------------------------------------------

def _center(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return x - mean


def reconstruction_error(feats: DataFrame, **_) -> Detection:
    """Squared residual after a linear bottleneck: one covariance pass, one scoring pass."""
    n, s, g = gram_matrix(feats, "x")
    d = len(s)
    if n < 50 or d < 2:
        return Detection("autoencoder", _zeros(feats), meta={"skipped": True})
    mean = s / n
    cov = g / n - np.outer(mean, mean)
    keep = max(1, min(d // 2, 10, n - 1))
    _, basis = eigen(cov)
    basis = basis[:, :keep]
    rest = np.eye(d) - basis @ basis.T
    # mean squared residual per feature, from the covariance alone
    per_feature = np.diag(rest @ cov @ rest)

    @F.pandas_udf("double")
    def residual(x: pd.Series) -> pd.Series:
        m = _center(np.array(x.tolist(), dtype=float), mean) @ rest
        return pd.Series((m ** 2).mean(axis=1))

    raw = cut_lineage(feats.select("row_id", residual("x").alias("raw")))
    return Detection("autoencoder", min_max(raw, "raw").select("row_id", "score", "raw"),
                     {"components": keep}, {"feature_error": per_feature.tolist()})


# ---- robust PCA --------------------------------------------------------------------------------

#: Rounds of one barrier stage, after which the driver knows its steps.
REFRESH = 25
#: Numbers of state that one task holds before the work is spread further: an exchange between
#: tasks takes about a second, in which a task gets through about so many.
TASK_CELLS = 1 << 22
#: Numbers of one piece of a task's rows, which stays in the processor's cache.
PIECE_CELLS = 1 << 18
#: Numbers that a task keeps in memory; further pieces lie in a file of its own.
HELD_CELLS = 1 << 24


def _start(x: np.ndarray, t: np.ndarray, tau: float) -> np.ndarray:
    """What the low-rank part is taken from: x - sparse + multiplier, both parts of t."""
    return x - t + 2.0 * np.clip(t, -tau, tau)


def _step(x: np.ndarray, t: np.ndarray, basis: np.ndarray, tau: float) -> np.ndarray:
    """One round of a row's state ``t``: beyond ``tau`` lies the sparse part, within it the scaled
    multiplier. It follows from the row and the bases so far, so no state has to be stored."""
    return x + np.clip(t, -tau, tau) - (_start(x, t, tau) @ basis) @ basis.T


class _Pieces:
    """Rows (x, w, t) of a task in pieces: the first in memory, the rest in a temporary file."""

    def __init__(self, d: int, reps: int):
        self.fixed, self.state = d + reps, d * reps
        self.rows = max(1, PIECE_CELLS // (self.fixed + self.state))
        self.held, self.sizes, self.file = [], [], None

    def add(self, xw: np.ndarray) -> None:
        t = np.zeros((len(xw), self.state))
        if (len(self.held) + 1) * self.rows * (self.fixed + self.state) <= HELD_CELLS:
            self.held.append((xw, t))
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.write(xw.tobytes() + t.tobytes())
        self.sizes.append(len(xw))

    def fill(self, batches) -> None:
        waiting, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            waiting.append(np.concatenate([matrix(b.column(0)), matrix(b.column(1))], axis=1))
            n += b.num_rows
            if n >= self.rows:
                m = np.concatenate(waiting)
                for lo in range(0, n - self.rows + 1, self.rows):
                    self.add(m[lo:lo + self.rows].copy())
                waiting, n = [m[n - n % self.rows:]], n % self.rows
        if n:
            self.add(np.concatenate(waiting))

    def each(self):
        """(x and w, t) of every piece; changes of t are kept."""
        yield from self.held
        at = 0
        for n in self.sizes:
            self.file.seek(at)
            xw = np.frombuffer(self.file.read(8 * n * self.fixed)).reshape(n, -1)
            t = np.frombuffer(bytearray(self.file.read(8 * n * self.state))).reshape(n, -1)
            yield xw, t
            self.file.seek(at + xw.nbytes)
            self.file.write(t.tobytes())
            at += xw.nbytes + t.nbytes


def _barrier_rounds(d: int, lam: np.ndarray, mu: np.ndarray, norm: np.ndarray, tol: float,
                    rounds: int, alone: bool, known):
    """Some rounds of low-rank plus sparse splits, the tasks of the stage in step.

    Every task keeps its rows with their state, which it first brings to where the ``known`` bases
    lead. In a round each adds its part of the d x d Gram matrix of the present target (one per
    weight column), all tasks exchange these sums and take the same step. A split that has
    converged rests. The first task returns the bases, and which splits go on (turn -1).
    """
    def run(batches):
        exchange = (lambda own: [own]) if alone else BarrierTaskContext.get().allGather
        before, going = known.value
        reps, tau, going = len(lam), lam / mu, np.array(going, bool)
        pieces = _Pieces(d, reps)
        pieces.fill(batches)
        todo, left = before, np.zeros(reps)
        found = []
        for turn in range(rounds + 1):
            part = np.zeros((reps, d * d + 1))
            left = np.zeros(reps)
            for xw, state in pieces.each():
                x = xw[:, :d]
                for r in np.flatnonzero([going[r] or bool(todo[r]) for r in range(reps)]):
                    w, t = xw[:, d + r:d + r + 1], state[:, r * d:(r + 1) * d]
                    for basis in todo[r]:
                        new = _step(x, t, basis, tau[r])
                        if turn:
                            rest = np.clip(new, -tau[r], tau[r]) - np.clip(t, -tau[r], tau[r])
                            left[r] += ((rest ** 2).sum(1) * w[:, 0]).sum()
                        t[:] = new
                    m = _start(x, t, tau[r])
                    part[r, :-1] += ((m * w).T @ m).ravel()
            part[:, -1] = left
            got = exchange(base64.b64encode(part.tobytes()).decode())
            total = sum(np.frombuffer(base64.b64decode(g)).reshape(reps, -1) for g in got)
            if turn:
                going &= ~(np.sqrt(np.maximum(total[:, -1], 0)) / norm < tol)
            if turn == rounds or not going.any():
                break
            todo = [[] for _ in range(reps)]
            for r in np.flatnonzero(going):
                value, v = eigen(total[r, :-1].reshape(d, d))
                sigma = np.sqrt(np.maximum(value, 0.0))
                kept = np.maximum(sigma - 1.0 / mu[r], 0.0) / np.where(sigma > 0, sigma, 1.0)
                basis = (v * np.sqrt(kept))[:, kept > 0]
                todo[r] = [basis]
                found.append((int(r), turn, True, basis.ravel().tolist()))
        if alone or BarrierTaskContext.get().partitionId() == 0:
            found += [(r, -1, bool(going[r]), []) for r in range(reps)]
            yield pa.RecordBatch.from_pydict(dict(zip(
                ("rep", "turn", "going", "basis"), map(list, zip(*found)))), pa.schema([
                    ("rep", pa.int32()), ("turn", pa.int32()), ("going", pa.bool_()),
                    ("basis", pa.list_(pa.float64()))]))
    return run


def _split_alone(d: int, lam: np.ndarray, mu: np.ndarray, norm: np.ndarray, tol: float,
                 rounds: int):
    """All rounds of the one split whose rows (x, w, rep) a task has."""
    def run(batches):
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        rep = first.column(2)[0].as_py()
        known = SimpleNamespace(value=([[]], [True]))
        for b in _barrier_rounds(d, lam[[rep]], mu[[rep]], norm[[rep]], tol, rounds, True, known)(
                itertools.chain([first], batches)):
            yield b.set_column(0, "rep", pa.array([rep] * b.num_rows, pa.int32()))
    return run


def sparse_parts(feats: DataFrame, weights: str | None = None, reps: int = 1, max_iter: int = 100,
                 tol: float = 1e-6, refresh: int = REFRESH) -> tuple[DataFrame, list[int]]:
    """(row_id, s) with the sparse part of each split (flat, d values each), and the rounds taken.

    ``weights`` names an array of row counts, one split each; without it every row counts once.
    The bases of the rounds are fitted on distinct vectors with their counts where half of the rows
    or more are copies. The driver gets them after every ``refresh`` rounds; a stage that is lost
    begins there. At the end every row goes through all rounds once more, by itself.
    """
    w = F.array(F.lit(1.0)) if weights is None else F.transform(
        F.col(weights), lambda v: v.cast("double"))
    d = len(feats.select("x").first()["x"])
    rows = feats.select("row_id", "x", w.alias("w"))
    # One pass: rows, absolute and squared sums of every split.
    *one, lines, distinct = rows.select(
        F.aggregate("x", F.lit(0.0), lambda a, v: a + F.abs(v)).alias("a"),
        F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v).alias("q"), "w",
        F.xxhash64("x").alias("h")).agg(
        *[F.sum(F.col("w")[r] * c) for r in range(reps)
          for c in (F.lit(1.0), F.col("a"), F.col("q"))],
        F.count(F.lit(1)), F.approx_count_distinct("h")).first()
    n, size, square = np.array(one, float).reshape(reps, 3).T
    lam, mu = 1.0 / np.sqrt(np.maximum(n, d)), n * d / (4.0 * size + 1e-10)
    norm, tau = np.sqrt(np.maximum(square, 0.0)) + 1e-10, lam / mu
    key = "row_id"
    if 2 * distinct <= lines:
        rows, lines, key = cut_lineage(rows.groupBy("x").agg(*[
            F.sum(F.col("w")[r]).alias(f"w{r}") for r in range(reps)]).select(
            "x", F.array(*[f"w{r}" for r in range(reps)]).alias("w"))), distinct, "x"
    sc = feats.sparkSession.sparkContext
    tasks = int(max(1, min(sc.defaultParallelism, -(-lines * d * reps // TASK_CELLS))))
    points = rows.repartition(tasks, key).select("x", "w")
    bases, going, done = [[] for _ in range(reps)], [True] * reps, 0
    if reps > 1 and lines * d <= TASK_CELLS:  # a split fits into a task, and needs no exchange
        each = rows.select("x", F.posexplode("w").alias("rep", "w")).where("w > 0").select(
            "x", F.array("w"), "rep").repartitionById(reps, F.col("rep"))
        for r in sorted(each.mapInArrow(
                _split_alone(d, lam, mu, norm, tol, max_iter),
                "rep int, turn int, going boolean, basis array<double>").where(
                "turn >= 0").collect(), key=lambda r: r["turn"]):
            bases[r["rep"]].append(np.array(r["basis"], float).reshape(d, -1))
        done = max_iter
    while done < max_iter and any(going):
        rounds = min(refresh, max_iter - done)
        known = sc.broadcast((bases, going))
        got = points.mapInArrow(
            _barrier_rounds(d, lam, mu, norm, tol, rounds, tasks == 1, known),
            "rep int, turn int, going boolean, basis array<double>", barrier=tasks > 1).collect()
        for r in sorted(got, key=lambda r: r["turn"]):
            if r["turn"] < 0:
                going[r["rep"]] = r["going"]
            else:
                bases[r["rep"]].append(np.array(r["basis"], float).reshape(d, -1))
        known.unpersist()
        done += rounds
    model = sc.broadcast(bases)

    @F.arrow_udf("array<double>")
    def sparse(x: pa.Array) -> pa.Array:
        m = matrix(x)
        out = np.zeros((len(m), reps, d))
        for r, steps in enumerate(model.value if len(m) else ()):
            t = np.zeros_like(m)
            for basis in steps:
                t = _step(m, t, basis, tau[r])
            out[:, r] = t - np.clip(t, -tau[r], tau[r])
        return arrays(out.reshape(len(m), reps * d))

    return cut_lineage(feats.select("row_id", sparse("x").alias("s"))), [len(b) for b in bases]


def robust_pca(feats: DataFrame, max_iter: int = 100, tol: float = 1e-6, refresh: int = REFRESH,
               **_) -> Detection:
    """Low-rank plus sparse split; a row's score is the mean size of its sparse part."""
    n, d = feats.count(), len((feats.select("x").first() or {"x": []})["x"])
    if n < 10 or d < 2:
        return Detection("robust_pca", _zeros(feats), meta={"skipped": True})
    parts, done = sparse_parts(feats, max_iter=max_iter, tol=tol, refresh=refresh)
    raw = parts.withColumn("raw", F.aggregate("s", F.lit(0.0), lambda a, v: a + F.abs(v)) / d)
    sparse = raw.agg(*[F.avg(F.abs(F.col("s")[i])).alias(f"f{i}") for i in range(d)]).first()
    return Detection("robust_pca", min_max(raw.drop("s"), "raw").select("row_id", "score", "raw"),
                     {"iterations": done[0]}, {"sparse_magnitude": list(sparse)})


# ---- registry ----------------------------------------------------------------------------------

DETECTORS: dict[str, Callable[..., Detection]] = {
    "isolation_forest": isolation_forest,
    "hdbscan": density_clusters,
    "lof": local_outlier_factor,
    "autoencoder": reconstruction_error,
    "robust_pca": robust_pca,
}
BUILT_IN = dict(DETECTORS)
# How explainable each method is taken to be.
EXPLAINABILITY = {"isolation_forest": 0.9, "hdbscan": 0.6, "lof": 0.8, "autoencoder": 0.7,
                  "robust_pca": 0.7}


def register(name: str, detector: Callable[..., Detection], explainability: float = 0.5) -> None:
    """Add a user's detector: a function of ``(row_id, x)`` that returns a Detection."""
    DETECTORS[name] = detector
    EXPLAINABILITY[name] = explainability


def penalty(method: str, n: int, d: int) -> float:
    """How unsuited a method is to a table of n rows and d columns."""
    if method == "isolation_forest":
        return 0.3 if n < 50 else 0.0
    if method == "hdbscan":
        return 0.3 if d > 100 else 0.5 if n < 30 else 0.0
    if method == "lof":
        return 0.4 if n > 100_000 or n < 20 else 0.0
    if method == "autoencoder":
        return 0.5 if n < 100 else 0.2 if n > 500_000 else 0.0
    if method == "robust_pca":
        return 0.4 if n * d > 5_000_000 else 0.0
    return 0.0


def contamination_level(configured: float | None, noise: float | None) -> float:
    """The configured level, else the noise estimate, else 5 %; kept within 1 % and 20 %."""
    return max(0.01, min(configured or noise or 0.05, 0.2))


def choose(requested: str | list[str] = "auto") -> list[str]:
    if requested == "auto":
        return list(DETECTORS)
    names = requested.split(",") if isinstance(requested, str) else requested
    return [m for m in DETECTORS if m in names]


__all__ = ["DETECTORS", "Detection", "choose", "components", "contamination_level",
           "density_clusters", "forest", "isolation_forest", "local_outlier_factor", "min_max",
           "penalty", "reconstruction_error", "register", "robust_pca", "split_shares"]
