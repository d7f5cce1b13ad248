"""k-nearest-neighbour joins (Euclidean) on ``(row_id, x)`` tables: an exact and a bounded one.

Equal vectors are collapsed to one point with a weight, so hot copies cost one line. Points are
cut into blocks of bounded size: nearest pivot first, then rings of the distance to it. A first
round inside each block bounds every query's k-th distance; the triangle inequality then says
which other blocks may hold a nearer point, and only those are searched. Blocks close to each other
share a hall of bounded size: a query travels once to a hall, with its bound and the blocks to see
there, so vectors move by halls, not by blocks. Each task compares the blocks of one hall with one
bounded slice of queries by matrix products, which pick the points whose exact distances are then
taken, and emits at most k lines a query.

In high dimensions with little structure the exact join tends to all block pairs. The hashed join
(``index="hashed"``) is for those: every point gets a code of hyperplane sides in each of some
tables, and a query is compared with the points of its own code and of the codes that differ from
it at its nearest hyperplanes. Codes of too many points are sliced. A row costs the same number of
comparisons whatever the table's size; the price is a recall below one.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from veracell.functions.arrow import matrix
from veracell.functions.joins import join_group_facts, join_lines
from veracell.functions.session import cut_lineage

BLOCK = 2048
MAX_PIVOTS = 512
MAX_BLOCKS = 20_000
#: Numbers in the vectors of one hall; a smaller table has about ``HALLS`` of them.
HALL_CELLS, HALLS = 1 << 21, 10


def distinct_points(rows: DataFrame) -> DataFrame:
    """(pid, x, w): one point per distinct vector, its smallest row id and its number of rows."""
    return rows.groupBy("x").agg(F.min("row_id").alias("pid"), F.count(F.lit(1)).alias("w"))


def to_rows(rows: DataFrame, points: DataFrame) -> DataFrame:
    """Give every row what was found for its vector; ``points`` has x and its row count w."""
    return join_group_facts(rows, points, "x", rows.count(), "w").drop("w")


def _pivots(points: DataFrame, n: int, block: int) -> np.ndarray:
    """A repeatable sample of points, at most ``MAX_PIVOTS``."""
    want = min(MAX_PIVOTS, max(1, math.ceil(n / block)))
    picked = points.select(F.xxhash64("x").alias("h"), "x").orderBy("h").limit(want).collect()
    return np.array([r["x"] for r in picked], dtype=float)


def _nearest_pivot(pivots: np.ndarray):
    @F.arrow_udf("struct<pivot:int,dist:double>")
    def assign(x: pa.Array) -> pa.Array:
        m = matrix(x)
        best, dist = np.zeros(len(m), dtype=np.int32), np.full(len(m), np.inf)
        for i, p in enumerate(pivots):
            d = np.sqrt(((m - p) ** 2).sum(axis=1))
            hit = d < dist
            best[hit], dist[hit] = i, d[hit]
        return pa.StructArray.from_arrays([pa.array(best), pa.array(dist)], ["pivot", "dist"])
    return assign


def _blocks(points: DataFrame, pivots: np.ndarray, block: int) -> tuple[DataFrame, list]:
    """Points with their block, and the blocks: (block, pivot, inner radius, outer radius, size).

    A pivot with more points than a block is cut into rings at quantiles of the distance. Points
    at one and the same distance are spread over as many slices of that ring as they need.
    """
    placed = points.withColumn("a", _nearest_pivot(pivots)("x")).select(
        "*", F.col("a.pivot").alias("pivot"), F.col("a.dist").alias("dist")).drop("a")
    placed = cut_lineage(placed)
    sizes = {r["pivot"]: r["n"] for r in placed.groupBy("pivot").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    most = max(1, math.ceil(max(sizes.values()) / block))
    steps = [i / most for i in range(1, most)]
    cuts = {}
    if steps:
        for r in placed.groupBy("pivot").agg(F.percentile_approx(
                "dist", F.array(*map(F.lit, steps)), 10000).alias("q")).collect():
            rings = math.ceil(sizes[r["pivot"]] / block)
            pick = [r["q"][round(i * most / rings) - 1] for i in range(1, rings)]
            cuts[r["pivot"]] = sorted(set(pick))
    cut_map = F.create_map(*[x for p in sizes for x in (
        F.lit(p), F.array(*[F.lit(float(c)) for c in cuts.get(p, [])]).cast("array<double>"))])
    ring = F.size(F.filter(cut_map[F.col("pivot")], lambda c: c <= F.col("dist")))
    ringed = placed.withColumn("ring", ring)
    ring_sizes = ringed.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"))
    ringed = ringed.join(F.broadcast(ring_sizes), ["pivot", "ring"]).withColumn(
        "slice", F.pmod(F.xxhash64("x", F.lit(5)), F.ceil(F.col("n") / F.lit(float(block)))
                        .cast("long")).cast("int"))
    named = ringed.withColumn("block", F.concat_ws("/", "pivot", "ring", "slice")).select(
        "pid", "x", "w", "pivot", "dist", "block")
    named = cut_lineage(named)
    # one line per block: n / block lines of five numbers
    lines = named.groupBy("block", "pivot").agg(
        F.min("dist").alias("inner"), F.max("dist").alias("outer"),
        F.count(F.lit(1)).alias("size"), F.sum("w").alias("weight")).collect()
    return named, lines


PAIR_SCHEMA = "qid {id}, pid {id}, d double, w long"


#: Distances held at once.
CELLS = 1 << 21


def _search(k: int):
    """Compare one slice of queries with one block of points."""
    def run(queries: pa.Table, points: pa.Table) -> pa.Table:
        pid, weight = points.column("pid").combine_chunks(), points.column("w").to_numpy()
        p, q = matrix(points.column("px")), matrix(queries.column("x"))
        found = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)])
        if len(p) and len(q):
            rank = np.argsort(np.argsort(pid.to_numpy(zero_copy_only=False), kind="stable"))
            limit, step = min(k, len(p)), max(1, CELLS // len(p))
            middle = p.mean(0)  # keeps the products small
            pc, pn = p - middle, ((p - middle) ** 2).sum(1)
            for lo in range(0, len(q), step):
                part = q[lo:lo + step]
                qc = part - middle
                qn = (qc ** 2).sum(1)
                d2 = qn[:, None] + pn - 2 * (qc @ pc.T)
                edge = np.partition(d2, limit - 1, axis=1)[:, limit - 1]
                i, j = np.nonzero(d2 <= (edge + 1e-9 * (qn + pn.max()))[:, None])
                dist = np.sqrt(((p[j] - part[i]) ** 2).sum(axis=1))
                by = np.lexsort((rank[j], dist, i))
                i, j, dist = i[by], j[by], dist[by]
                # In the order of distance and id, until the weights reach k.
                reach = np.cumsum(weight[j]) - weight[j]
                keep = reach - reach[np.searchsorted(i, i)] < k
                for out, v in zip(found, (lo + i[keep], j[keep], dist[keep])):
                    out.append(v)
        i, j, dist = map(np.concatenate, found)
        return pa.table({"qid": queries.column("qid").combine_chunks().take(pa.array(i)),
                         "pid": pid.take(pa.array(j)), "d": pa.array(dist),
                         "w": pa.array(weight[j], pa.int64())})
    return run


def _search_hall(k: int):
    """Compare one slice of queries with the blocks of a hall that each of them must see."""
    def run(queries: pa.Table, points: pa.Table) -> pa.Table:
        pid, weight = points.column("pid").combine_chunks(), points.column("w").to_numpy()
        p, q = matrix(points.column("px")), matrix(queries.column("x"))
        found = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)])
        if len(p) and len(q):
            rank = np.argsort(np.argsort(pid.to_numpy(zero_copy_only=False), kind="stable"))
            far = queries.column("bound").combine_chunks().fill_null(float("inf")).to_numpy(
                zero_copy_only=False) * (1 + 1e-12) + 1e-12
            lists = queries.column("need").combine_chunks()
            asks = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
            asked = lists.flatten().to_numpy()
            by = np.argsort(asked, kind="stable")
            asks, asked = asks[by], asked[by]
            place = points.column("place").to_numpy()
            for b in np.unique(place):
                own = np.flatnonzero(place == b)
                who = asks[np.searchsorted(asked, b):np.searchsorted(asked, b, "right")]
                part, middle = p[own], p[own].mean(0)  # keeps the products small
                pc = part - middle
                pn = (pc ** 2).sum(1)
                limit, step = min(k, len(own)), max(1, CELLS // len(own))
                for lo in range(0, len(who), step):
                    rows = who[lo:lo + step]
                    qc = q[rows] - middle
                    qn = (qc ** 2).sum(1)
                    d2 = qn[:, None] + pn - 2 * (qc @ pc.T)
                    edge = far[rows] ** 2
                    many = np.flatnonzero((d2 <= edge[:, None]).sum(1) > limit)
                    if len(many):
                        edge[many] = np.partition(d2[many], limit - 1, axis=1)[:, limit - 1]
                    i, j = np.nonzero(d2 <= (edge + 1e-9 * (qn + pn.max()))[:, None])
                    dist = np.sqrt(((part[j] - q[rows[i]]) ** 2).sum(axis=1))
                    keep = dist <= far[rows[i]]
                    for out, v in zip(found, _reach(rows[i[keep]], own[j[keep]], dist[keep], rank,
                                                    weight, k)):
                        out.append(v)
        i, j, dist = _reach(*map(np.concatenate, found), rank, weight, k) if len(p) else map(
            np.concatenate, found)
        return pa.table({"qid": queries.column("qid").combine_chunks().take(pa.array(i)),
                         "pid": pid.take(pa.array(j)), "d": pa.array(dist),
                         "w": pa.array(weight[j], pa.int64())})
    return run


def _reach(i: np.ndarray, j: np.ndarray, dist: np.ndarray, rank: np.ndarray, weight: np.ndarray,
           k: int) -> tuple:
    """The pairs of each query i in the order of distance and id, until their weights reach k."""
    by = np.lexsort((rank[j], dist, i)) if len(i) else np.zeros(0, np.int64)
    i, j, dist = i[by], j[by], dist[by]
    reach = np.cumsum(weight[j]) - weight[j]
    keep = reach - reach[np.searchsorted(i, i)] < k
    return i[keep], j[keep], dist[keep]


def _halls(pivots: np.ndarray, lines: list, size: int) -> tuple[list, np.ndarray]:
    """The lines in an order that keeps close pivots together, and the hall of each."""
    order, rest = [0], set(range(1, len(pivots)))
    while rest:  # on to the nearest pivot that is left
        left = np.array(sorted(rest))
        order.append(int(left[((pivots[left] - pivots[order[-1]]) ** 2).sum(1).argmin()]))
        rest.remove(order[-1])
    at = {p: i for i, p in enumerate(order)}
    lines = sorted(lines, key=lambda r: (at[r["pivot"]], r["inner"], r["block"]))
    hall, held, halls = 0, 0, []
    for r in lines:
        if held and held + r["size"] > size:
            hall, held = hall + 1, 0
        held += r["size"]
        halls.append(hall)
    return lines, np.array(halls, np.int32)


def _visits(pivots: np.ndarray, lines: list, halls: np.ndarray):
    """Which blocks a query must see by hall, given its bound on the k-th distance (null: all)."""
    block = np.array([r["block"] for r in lines], dtype=object)
    place = {b: i for i, b in enumerate(block)}
    pivot = np.array([r["pivot"] for r in lines])
    inner = np.array([r["inner"] for r in lines])
    outer = np.array([r["outer"] for r in lines])

    @F.arrow_udf("array<struct<hall:int,need:array<int>>>")
    def visits(x: pa.Array, bound: pa.Array, home: pa.Array) -> pa.Array:
        m = matrix(x)
        limit = bound.fill_null(float("inf")).to_numpy(zero_copy_only=False)
        homes = np.array([place[h] for h in home.to_pylist()], np.int64)
        rows, seen = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, CELLS // len(block))
        for lo in range(0, len(m), step):
            part = m[lo:lo + step]
            d = np.stack([np.sqrt(((part - p) ** 2).sum(axis=1)) for p in pivots], 1)[:, pivot]
            least = np.maximum(np.maximum(inner - d, d - outer), 0.0)
            need = least <= (limit[lo:lo + step] * (1 + 1e-12) + 1e-12)[:, None]
            need[np.arange(len(part)), homes[lo:lo + step]] = False
            i, j = np.nonzero(need)
            rows.append(lo + i)
            seen.append(j)
        row, j = np.concatenate(rows), np.concatenate(seen)
        h = halls[j]
        cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (
            h[1:] != h[:-1])])) if len(row) else np.zeros(0, np.int64)
        need = pa.ListArray.from_arrays(pa.array(np.append(cut, len(row)).astype(np.int32)),
                                        pa.array(j.astype(np.int32)))
        return pa.ListArray.from_arrays(
            pa.array(np.searchsorted(row[cut], np.arange(len(m) + 1)).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array(h[cut]), need], ["hall", "need"]))
    return visits


def _cogroup(queries: DataFrame, points: DataFrame, k: int, id_type: str, block: int,
             lines: int | None = None) -> DataFrame:
    """Search (block, qid, x) in (block, pid, x, w); hot blocks get several query slices.

    ``lines`` is the number of query lines where the blocks are not bounded by ``MAX_BLOCKS``.
    """
    loads = queries.groupBy("block").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(block / 2.0)).cast("int").alias("slices"))
    if lines is None:
        with_loads = queries.join(F.broadcast(loads), "block")
    else:
        loads = cut_lineage(loads)
        with_loads = join_lines(queries, loads, "block", lines)
    q = with_loads.withColumn(
        "slice", F.pmod(F.xxhash64("qid"), F.col("slices").cast("long")).cast("int")) \
        .select("block", "slice", "qid", "x")
    p = points.join(F.broadcast(loads) if lines is None else loads, "block").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))) \
        .select(F.col("block").alias("pblock"), F.col("slice").alias("pslice"),
                F.col("pid").alias("pid"), F.col("x").alias("px"), F.col("w").alias("w"))
    return q.groupBy("block", "slice").cogroup(p.groupBy("pblock", "pslice")).applyInArrow(
        _search(k), PAIR_SCHEMA.format(id=id_type))


def _codes_in_order(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the values."""
    column = column.combine_chunks()
    ids = column.unique()
    return pc.index_in(column, ids.take(pc.sort_indices(ids))).to_numpy()


def _nearest_lines(k: int):
    """Of rows (qid, pid, d, w) sorted by qid: the nearest of each query, until they reach k."""
    def lists(t: pa.Table) -> pa.RecordBatch:
        qid = t.column("qid").combine_chunks()
        i, rank = _codes_in_order(t.column("qid")), _codes_in_order(t.column("pid"))
        d, w = t.column("d").to_numpy(), t.column("w").to_numpy()
        by = np.lexsort((rank, d, i))
        i, rank = i[by], rank[by]
        first = np.concatenate([[True], (i[1:] != i[:-1]) | (rank[1:] != rank[:-1])])
        by, i = by[first], i[first]  # a point may come more than once
        reach = np.cumsum(w[by]) - w[by]
        keep = reach - reach[np.searchsorted(i, i)] < k
        by, i = by[keep], i[keep]
        cut = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        lines = pa.StructArray.from_arrays([
            pa.array(d[by]), t.column("pid").combine_chunks().take(pa.array(by)),
            pa.array(w[by])], ["d", "pid", "w"])
        return pa.RecordBatch.from_arrays([
            qid.take(pa.array(by[cut])), pa.ListArray.from_arrays(
                pa.array(np.append(cut, len(by)).astype(np.int32)), lines)], ["qid", "c"])

    def run(batches):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            qid = t.column("qid")
            last = pc.index(qid, qid[-1]).as_py()  # rows of a query stand together
            rest = t.slice(last)
            if last:
                yield lists(t.slice(0, last))
        if rest is not None:
            yield lists(rest)
    return run


def _merge(pairs: DataFrame, k: int, times: int = 1) -> DataFrame:
    """Nearest points per query from block results, until their weights reach k.

    Every point weighs one or more, so the k nearest lines are enough; a point may come ``times``
    times, and then each task keeps that many lines of a query before anything is shuffled.
    """
    if times > 1:
        order = Window.partitionBy("qid").orderBy("d", "pid")
        pairs = pairs.withColumn("__r", F.row_number().over(order)).where(
            F.col("__r") <= k * times).drop("__r")
    ids = pairs.schema["qid"].dataType.simpleString(), pairs.schema["pid"].dataType.simpleString()
    return pairs.select("qid", "pid", "d", "w").repartition("qid").sortWithinPartitions(
        "qid").mapInArrow(_nearest_lines(k), f"qid {ids[0]}, c array<struct<d:double,"
                                             f"pid:{ids[1]},w:bigint>>")


def _before(weights: pa.Array, own: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every entry of the lists: its list, its weight, and the weights before it, ``own`` too."""
    size = weights.value_lengths().to_numpy()
    at = np.repeat(np.arange(len(size)), size)
    flat = weights.flatten().to_numpy().astype(np.int64)
    total = np.cumsum(flat) - flat
    begin = np.append(total, 0)[np.minimum(np.cumsum(size) - size, len(flat))]
    return at, flat, total - begin[at] + own.to_numpy().astype(np.int64)[at]


def _reached(k: int):
    """How many entries of a list of weights it takes to reach k rows, with the own copies."""
    @F.arrow_udf("int")
    def reached(weights: pa.Array, own: pa.Array) -> pa.Array:
        at, _, before = _before(weights, own)
        return pa.array(np.bincount(at[before < k], minlength=len(weights)).astype(np.int32))
    return reached


def shares(k: int):
    """How many rows of the first k each of [own copies, *neighbours] has, from their weights."""
    @F.arrow_udf("array<bigint>")
    def rows(weights: pa.Array, own: pa.Array) -> pa.Array:
        at, w, before = _before(weights, own)
        size = weights.value_lengths().to_numpy() + 1
        ends = np.cumsum(size)
        out = np.empty(ends[-1] if len(ends) else 0, np.int64)
        mine = np.zeros(len(out), bool)
        mine[ends - size] = True
        out[mine] = np.minimum(own.to_numpy(), k)
        out[~mine] = np.minimum(w, np.maximum(k - before, 0))
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)),
                                        pa.array(out))
    return rows


def neighbours(rows: DataFrame, k: int, block: int = BLOCK, only: DataFrame | None = None,
               index: str = "exact") -> DataFrame:
    """(pid, near) of each distinct point: near = array of (d, pid, w), other points by distance
    whose weights, after the point's own other copies, add up to at least k rows.

    ``only`` (row_id) limits the points asked about, not the points searched. ``index`` is
    "exact" or "hashed".
    """
    points = cut_lineage(distinct_points(rows))
    asked = points
    if only is not None:
        asked = points.join(rows.join(only.select("row_id"), "row_id", "left_semi")
                            .select("x").distinct(), "x")
    find = {"exact": nearest, "hashed": nearest_hashed}[index]
    found = find(asked.select(F.col("pid").alias("qid"), "x"), points, k + 1, block)
    own = points.select(F.col("pid").alias("qid"), (F.col("w") - 1).alias("copies"), "x", "w")
    joined = found.join(own, "qid")
    others = F.filter("c", lambda s: s.pid != F.col("qid"))
    return shorten(joined.select(F.col("qid").alias("pid"), "x", "w", "copies",
                                 others.alias("near")), k)


def shorten(near: DataFrame, k: int) -> DataFrame:
    """Neighbour lists cut where the own copies and the neighbours' weights reach k rows."""
    return near.withColumn("near", F.slice("near", F.lit(1), _reached(k)("near.w", "copies")))


def nearest(queries: DataFrame, points: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(qid, c) for queries (qid, x) against points (pid, x, w): c = array of (d, pid, w).

    ``c`` reaches a total weight of k (a point that is also a query counts itself).
    """
    id_type = points.schema["pid"].dataType.simpleString()
    n = points.count()
    if n <= block:  # one block, which each slice of the queries meets as a whole
        asked = queries.select(F.lit("0").alias("block"), "qid", "x")
        return _merge(_cogroup(asked, points.select(
            F.lit("0").alias("block"), "pid", "x", "w"), k, id_type, block), k)
    block = max(block, math.ceil(n / MAX_BLOCKS))  # keeps the list of blocks bounded
    pivots = _pivots(points, n, block)
    placed, lines = _blocks(points, pivots, block)
    home = queries.withColumn("a", _nearest_pivot(pivots)("x"))
    blocks = placed.select("block", "pid", "x", "w")
    # round one: the fullest block of the query's pivot bounds its k-th distance
    best = {}
    for r in lines:
        if r["pivot"] not in best or r["weight"] > best[r["pivot"]][1]:
            best[r["pivot"]] = (r["block"], r["weight"])
    first = F.create_map(*[x for p, (b, _) in best.items() for x in (F.lit(p), F.lit(b))])
    started = cut_lineage(home.select("qid", "x", first[F.col("a.pivot")].alias("block")))
    one = _cogroup(started, blocks, k, id_type, block)
    one = cut_lineage(one)
    bound = one.groupBy("qid").agg(F.sum("w").alias("weight"), F.max("d").alias("far")).select(
        "qid", F.when(F.col("weight") >= k, F.col("far")).alias("bound"))
    d = pivots.shape[1]
    size = max(block, min(HALL_CELLS // max(d, 1), math.ceil(n / HALLS)))
    lines, halls = _halls(pivots, lines, size)
    asked = cut_lineage(started.join(bound, "qid", "left").withColumn("v", _visits(
        pivots, lines, halls)("x", "bound", "block")).where(F.size("v") > 0)
        .select("qid", "x", "bound", "v"))
    # one line per hall: its queries in slices of a hall's size
    slices = {r["hall"]: math.ceil(r["n"] / size) for r in asked.select(
        F.explode("v.hall").alias("hall")).groupBy("hall").agg(F.count(F.lit(1)).alias("n"))
        .collect()}
    table = F.broadcast(points.sparkSession.createDataFrame(
        [(r["block"], i, int(h), slices.get(int(h), 0)) for i, (r, h) in enumerate(zip(
            lines, halls))], "block string, place int, hall int, slices int"))
    cuts = F.broadcast(points.sparkSession.createDataFrame(
        list(slices.items()), "hall int, slices int"))
    q = asked.select("qid", "x", "bound", F.explode("v").alias("s")).select(
        "qid", "x", "bound", F.col("s.hall").alias("hall"), F.col("s.need").alias("need")) \
        .join(cuts, "hall").withColumn("slice", F.pmod(F.xxhash64("qid"), F.col("slices").cast(
            "long")).cast("int")).select("hall", "slice", "qid", "x", "bound", "need")
    p = blocks.join(table, "block").where("slices > 0").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
        F.col("hall").alias("phall"), F.col("slice").alias("pslice"), "pid",
        F.col("x").alias("px"), "w", "place")
    two = q.groupBy("hall", "slice").cogroup(p.groupBy("phall", "pslice")).applyInArrow(
        _search_hall(k), PAIR_SCHEMA.format(id=id_type))
    return _merge(one.unionByName(two), k)


TABLES, PROBES, LEAF = 8, 4, 512


def _planes(points: DataFrame, n: int, tables: int, leaf: int, seed: int):
    """Normals and offsets of the hyperplanes of each table: midway between two sampled points.

    The sample grows with the logarithm of n: two points a plane.
    """
    bits = max(0, math.ceil(math.log2(max(n, 1) / leaf)))
    rows = points.select(F.xxhash64(F.lit(seed), "x").alias("h"), "x").orderBy("h").limit(
        2 * bits * tables).collect()
    x = np.array([r["x"] for r in rows], dtype=float)
    if not bits or len(x) < 2:
        return np.zeros((tables, 0, x.shape[1] if x.ndim == 2 else 0)), np.zeros((tables, 0))
    rng = np.random.default_rng(seed)
    a = rng.integers(0, len(x), (tables, bits))
    b = (a + rng.integers(1, len(x), (tables, bits))) % len(x)
    normal = x[a] - x[b]
    length = np.sqrt((normal ** 2).sum(-1, keepdims=True))
    normal /= np.where(length > 0, length, 1)
    return normal, (normal * (x[a] + x[b]) / 2).sum(-1)


def _codes(normal: np.ndarray, offset: np.ndarray, probes: int):
    """Codes table * 2**bits + sides of every vector, and of those across its nearest planes."""
    tables, bits = offset.shape

    @F.arrow_udf("array<bigint>")
    def codes(x: pa.Array) -> pa.Array:
        m = matrix(x)
        across = min(probes, bits)
        out = np.zeros((len(m), tables, 1 + across), np.int64)
        power = np.int64(1) << np.arange(bits, dtype=np.int64)
        for t in range(tables if len(m) else 0):
            far = m @ normal[t].T - offset[t]
            own = ((far > 0) * power).sum(1) + (np.int64(t) << bits)
            out[:, t, 0] = own
            near = np.argsort(np.abs(far), axis=1, kind="stable")[:, :across]
            out[:, t, 1:] = own[:, None] ^ power[near]
        flat = out.reshape(len(m), -1)
        cut = np.arange(len(m) + 1, dtype=np.int32) * np.int32(flat.shape[1])
        return pa.ListArray.from_arrays(pa.array(cut), pa.array(flat.ravel()))
    return codes


def nearest_hashed(queries: DataFrame, points: DataFrame, k: int, block: int = BLOCK,
                   tables: int = TABLES, probes: int = PROBES, leaf: int = LEAF,
                   seed: int = 42) -> DataFrame:
    """Like ``nearest``, approximately: (qid, c) from ``tables * (probes + 1)`` codes a query.

    A code of more points than a block is sliced by a hash, and a query looks into one slice, so
    that its cost stays bounded; among the very many points of one code all are about as near.
    """
    id_type = points.schema["pid"].dataType.simpleString()
    n, m = points.count(), queries.count()
    normal, offset = _planes(points, n, tables, leaf, seed)
    across = 1 + min(probes, offset.shape[1])
    coded = points.withColumn("code", F.explode(_codes(normal, offset, 0)("x")))
    sizes = cut_lineage(coded.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(
        block))).cast("long").alias("cuts")).where("cuts > 1"))

    def name(rows: DataFrame, lines: int) -> DataFrame:
        cut = F.pmod(F.xxhash64("x", F.lit(5)), F.coalesce("cuts", F.lit(1).cast("long")))
        return join_lines(rows, sizes, "code", lines, "left").withColumn(
            "block", F.concat_ws("/", "code", cut))

    asked = cut_lineage(name(queries.withColumn("code", F.explode(_codes(
        normal, offset, probes)("x"))), m * tables * across).select("block", "qid", "x"))
    pairs = _cogroup(asked, name(coded, n * tables).select("block", "pid", "x", "w"), k, id_type,
                     block, m * tables * across)
    return _merge(pairs, k, tables * across)


def edges(rows: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """Row-level neighbour list (row_id, rank, neighbour_id, distance), ties by id.

    A row's own copies come first. Meant for results and small k; detectors use weights instead.
    """
    near = cut_lineage(neighbours(rows, k, block))  # read twice
    members = to_rows(rows, near.select("x", "pid", "w")).select("row_id", "pid")
    copies = F.struct(F.lit(0.0).alias("d"), F.col("pid").alias("pid"),
                      F.col("w").alias("w"))
    lists = near.select("pid", F.explode(F.concat(F.array(copies), F.col("near"))).alias("s")) \
        .select("pid", F.col("s.d").alias("d"), F.col("s.pid").alias("npid"))
    # at most k + 1 members of a copied vector can be anybody's neighbour; the rank limit is
    # applied before the shuffle as well, so a hot vector stays small
    order = Window.partitionBy("pid").orderBy("row_id")
    first = members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1) \
        .select(F.col("pid").alias("npid"), F.col("row_id").alias("neighbour_id"))
    pairs = lists.join(first, "npid").select("pid", "d", "neighbour_id")
    short = pairs.groupBy("pid").agg(F.slice(F.array_sort(F.collect_list(
        F.struct("d", "neighbour_id"))), 1, k + 1).alias("n"))
    out = members.join(short, "pid").select(
        "row_id", F.slice(F.filter("n", lambda s: s.neighbour_id != F.col("row_id")), 1, k)
        .alias("n"))
    return out.select("row_id", F.posexplode("n").alias("rank", "s")).select(
        "row_id", (F.col("rank") + 1).alias("rank"), F.col("s.neighbour_id").alias("neighbour_id"),
        F.col("s.d").alias("distance"))

