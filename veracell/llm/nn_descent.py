"""Approximate nearest neighbours by cosine: NN-descent and greedy graph search.

Equal vectors are one node. The graph starts from groups around random pivots and is improved by
NN-descent: in each round every node sends its vector to its neighbours and to the nodes that have
it as a neighbour; the nodes that meet there are neighbours of neighbours, are compared, and pass
on what is nearer than their present last neighbour. Only pairs with a link that is new since the
last round are compared; rounds end when few links change. Queries keep a beam of nodes, expand
the nearest ones of it through their links in both directions, and stop when every node of the beam
has been expanded. What the beam holds in the end is ranked by the exact measure on the original
vectors.

Nodes lie in buckets by a hash. What nodes or queries send is one line per sender
and bucket, so a vector crosses the network once per bucket and not once per link; a bucket reads
its nodes first and then streams what was sent. The graph is built in half precision and searched
in single precision, so that very near copies are told apart.

``degree`` bounds the links of a node and ``REVERSE`` times that the sampled links back, which is
part of the method: the result is approximate, with the recall measured in the tests and the README.

Defined cases: rows with a null id, and vectors that are null, empty, zero or hold null or
non-finite components take no part, nor do vectors of another length than the commonest; a query's
own row is left out, its copies are candidates; repeated rows count as rows; ties go to the smaller
id; with fewer candidates than asked all are given; empty tables give no rows.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from veracell.functions.joins import join_group_facts
from veracell.functions.session import Steps, cut_lineage
from veracell.llm import textbatch as tb

DEGREE = 20
ROUNDS = 3
TREES = 4
#: Points around one pivot, and the most pivots that the driver and every task hold.
AROUND = 256
MAX_PIVOTS = 1024
#: Most nodes of a bucket. There are as many buckets as shuffle partitions, or more where these
#: would hold more nodes, so that what a node sends does not depend on the size of the table.
BUCKET = 1 << 14
#: Nodes a query keeps, and how many of them it expands in a round.
BEAM = 512
EXPAND = 128
SEARCH_ROUNDS = 24
ENTRIES = 16
#: A round that changes fewer links than this share is the last one.
STILL = 0.02
#: Share of new links that a round uses.
SAMPLE = 0.5
REVERSE = 0.5

LINE = "bucket long, kind int, x long, vec binary, ids array<long>, vals array<float>, " \
       "flags array<boolean>"
_NAMES = ["bucket", "kind", "x", "vec", "ids", "vals", "flags"]


@dataclass
class Index:
    """nodes (pid, vec, links), points (pid, key, v, n, first), and the bucket and pivot data."""
    nodes: DataFrame
    points: DataFrame
    buckets: int
    pivots: np.ndarray
    pivot_ids: np.ndarray
    keep: int


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (tb.mix64(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def units(vectors: np.ndarray, kind=np.float16) -> np.ndarray:
    """Unit vectors, in half precision for the graph."""
    big = np.abs(vectors).max(1, keepdims=True, initial=0)
    v = vectors / np.where(big > 0, big, 1)
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(kind)


def widened(half: np.ndarray) -> np.ndarray:
    """Half-precision vectors as unit vectors again: lengths that rounding made greater would make
    their nodes the nearest of all around."""
    v = half.astype(np.float32)
    return v / np.sqrt((v * v).sum(-1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision, summed in the order of the positions."""
    def even(m):  # by a power of two, which is exact and keeps squares in range
        return np.ldexp(m, -np.frexp(np.abs(m).max(1))[1][:, None])
    a, b = even(a), even(b)
    dot, na, nb = np.zeros((3, len(a)))
    for j in range(a.shape[1]):
        dot += a[:, j] * b[:, j]
        na += a[:, j] * a[:, j]
        nb += b[:, j] * b[:, j]
    return np.clip(dot / np.sqrt(na * nb), -1.0, 1.0)


# ---- lines in and out of tasks

def _binary(m: np.ndarray) -> pa.Array:
    """Rows of a matrix as binaries."""
    flat = np.ascontiguousarray(m)
    width = flat.itemsize * flat.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(m), [
        None, pa.py_buffer(np.arange(len(m) + 1, dtype=np.int32) * np.int32(width)),
        pa.py_buffer(flat)])


def _matrix(column, kind=np.float16) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 1), kind)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32)[column.offset:column.offset + n + 1]
    flat = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]]
    return np.frombuffer(flat.tobytes(), kind).reshape(n, -1)


def _lists(cut: np.ndarray, values: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values, kind))


def _line(bucket, kind, x, vec=None, cut=None, ids=None, vals=None, flags=None) -> pa.RecordBatch:
    n = len(x)

    def col(v, t):
        return pa.nulls(n, pa.list_(t)) if v is None else _lists(cut, v, t)
    return pa.RecordBatch.from_arrays([
        pa.array(bucket, pa.int64()), pa.array(np.full(n, kind, np.int32)),
        pa.array(x, pa.int64()), pa.nulls(n, pa.binary()) if vec is None else _binary(vec),
        col(ids, pa.int64()), col(vals, pa.float32()), col(flags, pa.bool_())], names=_NAMES)


class Lines:
    """The columns of some lines as NumPy arrays; list values are flat, ``of`` names their line."""

    def __init__(self, t: pa.Table | pa.RecordBatch):
        self.t = t
        self.x = t.column("x").to_numpy()

    def lists(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """(counts per line, flat values)."""
        c = self.t.column(name)
        if isinstance(c, pa.ChunkedArray):
            c = c.combine_chunks()
        counts = np.diff(c.offsets.to_numpy())
        return counts, c.flatten().to_numpy(zero_copy_only=False)

    def vectors(self, kind=np.float16) -> np.ndarray:
        return _matrix(self.t.column("vec"), kind)


def _grouped(key: np.ndarray):
    """Order that brings equal keys together, and where each group begins (with the end)."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else \
        np.zeros(0, np.int64)
    return order, np.append(first, len(k))


def _send(sender: np.ndarray, to: np.ndarray, buckets: int, x, vec=None, extra=None, flags=None,
          kind: int = 1, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """One line per sender and bucket with the nodes it is sent to. ``sender`` indexes x and vec;
    ``extra`` holds one number a sender, which travels as the only entry of vals."""
    if not len(to):
        return
    b = bucket_of(to, buckets)
    order, first = _grouped(sender * np.int64(buckets) + b if buckets < 1 << 31 else sender)
    if buckets >= 1 << 31:  # keys would overflow
        order = np.lexsort((b, sender))
        s, o = sender[order], b[order]
        first = np.append(np.flatnonzero(np.concatenate(
            [[True], (s[1:] != s[:-1]) | (o[1:] != o[:-1])])), len(s))
    for lo in range(0, len(first) - 1, size):
        cut = first[lo:lo + size + 1]
        part = order[cut[0]:cut[-1]]
        lead = sender[order[cut[:-1]]]
        lines = _line(b[order[cut[:-1]]], kind, x[lead], None if vec is None else vec[lead],
                      cut - cut[0], to[part], None, None if flags is None else flags[part])
        if extra is not None:
            vals = _lists(np.arange(len(lead) + 1), extra[lead], pa.float32())
            lines = lines.set_column(5, "vals", vals)
        yield lines


def _by_bucket(run: Callable[[Lines | None, Iterator[Lines]], Iterator[pa.RecordBatch]]):
    """Stream sorted lines: ``run`` gets a bucket's own lines (kind 0), then what was sent to it."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        feed = iter(batches)

        def pieces():
            for batch in feed:
                if batch.num_rows:
                    b = batch.column("bucket").to_numpy() * 2 + batch.column("kind").to_numpy()
                    at = np.append(np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])),
                                   len(b))
                    for lo, hi in zip(at[:-1], at[1:]):
                        yield int(b[lo]) >> 1, int(b[lo]) & 1, batch.slice(lo, hi - lo)

        stream = pieces()
        ahead = next(stream, None)
        while ahead is not None:
            bucket = ahead[0]
            waiting = []
            while ahead is not None and ahead[0] == bucket and ahead[1] == 0:
                waiting.append(ahead[2])
                ahead = next(stream, None)
            own = Lines(pa.Table.from_batches(waiting)) if waiting else None

            def sent():
                nonlocal ahead
                while ahead is not None and ahead[0] == bucket:
                    now = ahead
                    ahead = next(stream, None)
                    yield Lines(now[2])
            rest = sent()
            yield from run(own, rest)
            for _ in rest:  # whatever run left
                pass
        tb.hand_back()
    return go


def _meet(lines: DataFrame, run, schema: str = LINE) -> DataFrame:
    return lines.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(
        _by_bucket(run), schema)


# ---- points

def _vector(column: str) -> Column:
    return F.transform(F.col(column), lambda x: x.cast("double"))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, key) of the rows that take part; v in double precision."""
    v = rows.select(F.col(id_col).alias("id"), _vector(vector_col).alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") > 0)).where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
    usual = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "d").limit(1).select("d")
    width = usual.first()
    v = v.where(F.size("v") == F.lit(width["d"] if width else 0))
    # 0.0 and -0.0 hash alike only where they are made one.
    v = v.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    return v.withColumn("key", F.struct(F.xxhash64(F.lit(3), "v").alias("h1"),
                                        F.xxhash64(F.lit(5), "v").alias("h2")))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(pid, key, v, n, first): one point per vector with its ``keep`` smallest ids; written."""
    # The window keeps ``keep`` rows of a vector in each task before anything is shuffled.
    least = Window.partitionBy("key").orderBy("id")
    first = rows.withColumn("r", F.row_number().over(least)).where(F.col("r") <= keep).groupBy(
        "key").agg(F.sort_array(F.collect_list("id")).alias("first"), F.first("v").alias("v"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(first.join(sizes, "key").select(
        F.monotonically_increasing_id().alias("pid"), "key", "v", "n", "first"))


def _doubles(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else \
        np.zeros((0, 1))


def _pivots(points: DataFrame, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a repeatable sample, at most ``MAX_PIVOTS``."""
    want = min(MAX_PIVOTS, max(1, n // AROUND))
    rows = points.orderBy(F.xxhash64(F.lit(seed), "pid")).limit(want).select("pid", "v").collect()
    return (np.array([r["pid"] for r in rows], np.int64),
            units(np.array([r["v"] for r in rows])).astype(np.float32))


# ---- the graph

def _first_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Marks the first of equal pairs that stand together."""
    if not len(a):
        return np.zeros(0, bool)
    return np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])


def _top(u, v, s, fresh, k: int):
    """Of links (u, v, s, fresh) each pair once (an older one first) and u's k nearest, sorted.

    Ties go by a hash of both ends: by the id, all of many equal nodes would link to the same few.
    """
    by = np.lexsort((fresh, v, u))
    u, v, s, fresh = u[by], v[by], s[by], fresh[by]
    one = _first_of(u, v)
    u, v, s, fresh = u[one], v[one], s[one], fresh[one]
    tie = tb.mix64(u.astype(np.uint64) ^ tb.mix64(v.astype(np.uint64) + np.uint64(1)))
    by = np.lexsort((tie, -s, u))
    u, v, s, fresh = u[by], v[by], s[by], fresh[by]
    begin = np.searchsorted(u, u, "left")
    in_top = np.arange(len(u)) - begin < k
    return u[in_top], v[in_top], s[in_top], fresh[in_top]


def _merge(degree: int):
    """Own lines are nodes with their links; what was sent are nearer ones."""
    def run(own: Lines | None, sent: Iterator[Lines]) -> Iterator[pa.RecordBatch]:
        if own is None:
            return
        ids = np.sort(own.x)
        n, v = own.lists("ids")
        u = np.repeat(own.x, n)
        s, fresh = own.lists("vals")[1], own.lists("flags")[1].astype(bool)
        held = [(u, v, s, fresh)]
        size = len(u)
        for more in sent:
            n, w = more.lists("ids")
            held.append((np.repeat(more.x, n), w, more.lists("vals")[1], np.ones(len(w), bool)))
            size += len(w)
            if size > 1 << 21:
                held = [_top(*map(np.concatenate, zip(*held)), degree)]
                size = len(held[0][0])
        u, v, s, fresh = _top(*map(np.concatenate, zip(*held)), degree)
        by = np.argsort(own.x)
        cut = np.append(np.searchsorted(u, ids), len(u))
        bucket = own.t.column("bucket").to_numpy()
        yield _line(bucket, 0, ids, own.vectors()[by], cut, v, s.astype(np.float32), fresh)
    return run


def _from_pairs(buckets: int, u, v, s) -> Iterator[pa.RecordBatch]:
    """Links found, one line per node, sent to its bucket."""
    order, first = _grouped(u)
    for lo in range(0, len(first) - 1, 1 << 16):
        cut = first[lo:lo + (1 << 16) + 1]
        part = order[cut[0]:cut[-1]]
        x = u[order[cut[:-1]]]
        yield _line(bucket_of(x, buckets), 1, x, None, cut - cut[0], v[part],
                    s[part].astype(np.float32))


def _exhaustive(degree: int, buckets: int):
    """Compare all members of a group around a pivot, at most twice ``AROUND`` at once."""
    def run(own, sent: Iterator[Lines]) -> Iterator[pa.RecordBatch]:
        held = list(sent)
        x = np.concatenate([h.x for h in held])
        vec = widened(np.concatenate([h.vectors() for h in held]))
        for part in np.array_split(np.arange(len(x)), max(1, -(-len(x) // (4 * AROUND)))):
            k = min(degree, len(part) - 1)
            if k < 1:
                continue
            s = vec[part] @ vec[part].T
            np.fill_diagonal(s, -2)
            near = np.argpartition(-s, k - 1, 1)[:, :k]
            yield from _from_pairs(buckets, np.repeat(x[part], k), x[part][near].ravel(),
                                   np.take_along_axis(s, near, 1).ravel())
    return run


def _nearest_pivot(sets: list[np.ndarray], slices: list[np.ndarray] | None, seed: int):
    """Lines (group, x, vec), one per set of pivots; large groups are cut by a hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = Lines(b)
            half = lines.vectors()
            vec = widened(half)
            for t, pivots in enumerate(sets):
                group = (vec @ pivots.T).argmax(1).astype(np.int64) + t * MAX_PIVOTS
                if slices is None:
                    count = np.bincount(group, minlength=1)
                    some = np.flatnonzero(count)
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])],
                                                     ["g", "n"])
                else:
                    cut = slices[t][group - t * MAX_PIVOTS]
                    part = tb.mix64(lines.x.astype(np.uint64) + np.uint64(seed + t)) % cut.astype(
                        np.uint64)
                    yield _line(group + part.astype(np.int64) * (MAX_PIVOTS * len(sets)), 1,
                                lines.x, half)
    return run


def _sampled(x: np.ndarray, y: np.ndarray, turn: int, share: float) -> np.ndarray:
    mixed = tb.mix64(x.astype(np.uint64) ^ tb.mix64(y.astype(np.uint64) + np.uint64(turn)))
    return mixed < np.uint64(int(share * 2 ** 64))


def _capped(u, v, flags, cap: int, turn: int):
    """At most ``cap`` links of every v, drawn by a hash, new ones first."""
    draw = tb.mix64(u.astype(np.uint64) ^ np.uint64(turn))
    by = np.lexsort((draw, ~flags, v))
    u, v, flags = u[by], v[by], flags[by]
    keep = np.arange(len(v)) - np.searchsorted(v, v, "left") < cap
    return u[keep], v[keep], flags[keep]


def _backward(buckets: int, cap: int, turn: int):
    """Tell the nodes that are neighbours who has them as one: lines (x = neighbour, ids = nodes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = Lines(b)
            n, v = lines.lists("ids")
            u, flags = np.repeat(lines.x, n), lines.lists("flags")[1].astype(bool)
            use = ~flags | _sampled(u, v, turn, SAMPLE)
            u, v, flags = _capped(u[use], v[use], flags[use], cap, turn)
            cut = np.append(np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])), len(v)) \
                if len(v) else np.zeros(1, np.int64)
            x = v[cut[:-1]]
            yield _line(bucket_of(x, buckets), 1, x, None, cut, u, None, flags)
    return run


def _gather_back(sent: Iterator[Lines], cap: int, turn: int):
    """(node, neighbour, flag): the capped links back that were sent to a bucket."""
    held, size = [], 0
    for more in sent:
        n, u = more.lists("ids")
        held.append((u, np.repeat(more.x, n), more.lists("flags")[1].astype(bool)))
        size += len(u)
        if size > 1 << 20:
            held = [_capped(*map(np.concatenate, zip(*held)), cap, turn)]
            size = len(held[0][0])
    if not held:
        none = np.zeros(0, np.int64)
        return none, none, none > 0
    return _capped(*map(np.concatenate, zip(*held)), cap, turn)


def _introduce(degree: int, buckets: int, cap: int, turn: int):
    """Every node sends its vector to its neighbours in both directions."""
    def run(own: Lines | None, sent: Iterator[Lines]) -> Iterator[pa.RecordBatch]:
        back, node, new_back = _gather_back(sent, cap, turn)
        if own is None:
            return
        n, v = own.lists("ids")
        flags = own.lists("flags")[1].astype(bool)
        row = np.repeat(np.arange(len(own.x)), n)
        use = ~flags | _sampled(own.x[row], v, turn, SAMPLE)
        at = np.argsort(own.x)
        of = at[np.searchsorted(own.x[at], node)]
        far = np.full(len(own.x), -2, np.float32)
        vals = own.lists("vals")[1]
        full = n >= degree
        far[full] = vals[np.cumsum(n)[full] - 1]
        row, to = np.concatenate([row[use], of]), np.concatenate([v[use], back])
        flags = np.concatenate([flags[use], new_back])
        by = np.lexsort((~flags, to, row))
        row, to, flags = row[by], to[by], flags[by]
        one = _first_of(row, to)
        yield from _send(row[one], to[one], buckets, own.x, own.vectors(), far, flags[one])
    return run


def _compare(buckets: int, size: int = 1 << 22):
    """Those who met at a node are compared; pairs nearer than somebody's last link are told."""
    def run(own, sent: Iterator[Lines]) -> Iterator[pa.RecordBatch]:
        held = list(sent)
        x = np.concatenate([h.x for h in held])
        vec = np.concatenate([h.vectors() for h in held])
        far = np.concatenate([h.lists("vals")[1] for h in held])
        counts = np.concatenate([h.lists("ids")[0] for h in held])
        at = np.concatenate([h.lists("ids")[1] for h in held])
        new = np.concatenate([h.lists("flags")[1] for h in held]).astype(bool)
        who = np.repeat(np.arange(len(x)), counts)
        by = np.lexsort((~new, at))
        at, who, new = at[by], who[by], new[by]
        first = np.append(np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])), len(at))
        groups = np.diff(first)
        fresh = np.add.reduceat(new, first[:-1])
        found, held_pairs = [], 0
        g = np.flatnonzero((groups > 1) & (fresh > 0))
        g = g[np.argsort(groups[g], kind="stable")]
        lo = 0
        while lo < len(g):
            hi = lo + 1
            while hi < len(g) and (hi - lo + 1) * int(groups[g[hi]]) ** 2 <= size and \
                    groups[g[hi]] <= groups[g[lo]] + 4:
                hi += 1
            part = g[lo:hi]
            lo = hi
            wide = int(groups[part[-1]])
            slot = first[part][:, None] + np.arange(wide)
            there = np.arange(wide) < groups[part][:, None]
            m = who[np.minimum(slot, len(who) - 1)]
            some = int(fresh[part].max())
            v = widened(vec[m])
            s = np.matmul(v[:, :some], v.transpose(0, 2, 1))
            # Rows are new ones; a pair of new ones is taken once.
            ok = (np.arange(some) < fresh[part][:, None])[:, :, None] & there[:, None, :]
            ok &= np.arange(some)[:, None] < np.arange(wide)
            a_far, b_far = far[m[:, :some]][:, :, None], far[m][:, None, :]
            i, j, k = np.nonzero(ok & ((s > a_far) | (s > b_far)))
            a, b, c = m[i, j], m[i, k], s[i, j, k]
            u = np.concatenate([x[a][c > far[a]], x[b][c > far[b]]])
            w = np.concatenate([x[b][c > far[a]], x[a][c > far[b]]])
            found.append((u, w, np.concatenate([c[c > far[a]], c[c > far[b]]])))
            held_pairs += len(u)
            if held_pairs > 1 << 20:
                found = [_once(*map(np.concatenate, zip(*found)))]
                yield from _from_pairs(buckets, *found[0])
                found, held_pairs = [], 0
        if found:
            yield from _from_pairs(buckets, *_once(*map(np.concatenate, zip(*found))))
    return run


def _once(u, w, s):
    ok = u != w
    u, w, s = u[ok], w[ok], s[ok]
    by = np.lexsort((w, u))
    u, w, s = u[by], w[by], s[by]
    one = _first_of(u, w)
    return u[one], w[one], s[one]


def _aged(turn: int):
    """Links that this round uses are not new in the next one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = Lines(b)
            n, v = lines.lists("ids")
            flags = lines.lists("flags")[1].astype(bool)
            flags &= ~_sampled(np.repeat(lines.x, n), v, turn, SAMPLE)
            cut = np.concatenate([[0], np.cumsum(n)])
            yield b.set_column(6, "flags", _lists(cut, flags, pa.bool_()))
    return run


def _links(own_degree: int):
    """Final links of a node: its own and sampled ones back."""
    def run(own: Lines | None, sent: Iterator[Lines]) -> Iterator[pa.RecordBatch]:
        back, node, _ = _gather_back(sent, own_degree, 0)
        if own is None:
            return
        n, v = own.lists("ids")
        u = np.concatenate([np.repeat(own.x, n), node])
        u, v, _ = _once(u, np.concatenate([v, back]), np.zeros(len(u)))
        by = np.argsort(own.x)
        ids = own.x[by]
        cut = np.append(np.searchsorted(u, ids), len(u))
        yield _line(own.t.column("bucket").to_numpy(), 0, ids, own.vectors()[by], cut, v)
    return run


def build_graph(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                degree: int = DEGREE, rounds: int = ROUNDS, trees: int = TREES, keep: int = 6,
                bucket: int = BUCKET) -> Index | None:
    """The neighbour graph of all vectors; None where no vector takes part."""
    spark = rows.sparkSession
    points = distinct_vectors(usable(rows, id_col, vector_col), keep)
    n = points.count()
    if not n:
        return None
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // bucket))
    sets = [_pivots(points, n, seed) for seed in range(1, trees + 1)]

    def bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy()
            if len(x):
                none = np.zeros(0)
                yield _line(bucket_of(x, buckets), 0, x, units(_doubles(b.column(1))),
                            np.zeros(len(x) + 1), none, none, none)

    steps = Steps(spark)
    nodes = steps.write(points.select("pid", "v").mapInArrow(bare, LINE))
    pivots = [p for _, p in sets]
    # At most ``trees * MAX_PIVOTS`` lines come to the driver.
    sizes = np.zeros(trees * MAX_PIVOTS, np.int64)
    for r in nodes.mapInArrow(_nearest_pivot(pivots, None, 0), "g long, n long").groupBy("g").agg(
            F.sum("n").alias("n")).collect():
        sizes[r["g"]] = r["n"]
    slices = list(np.maximum(1, -(-sizes // (2 * AROUND))).reshape(trees, MAX_PIVOTS))
    found = _meet(nodes.mapInArrow(_nearest_pivot(pivots, slices, 17), LINE),
                  _exhaustive(degree, buckets))
    graph = steps.write(_meet(nodes.unionByName(found), _merge(degree)))
    cap = max(1, int(degree * REVERSE))
    for turn in range(1, rounds + 1):
        told = graph.mapInArrow(_backward(buckets, cap, turn), LINE)
        met = _meet(_meet(graph.unionByName(told), _introduce(degree, buckets, cap, turn)),
                    _compare(buckets))
        graph = steps.write(_meet(graph.mapInArrow(_aged(turn), LINE).unionByName(met),
                                  _merge(degree)))
        changed = graph.agg(F.sum(F.size(F.filter("flags", lambda f: f)))).first()[0]
        if changed <= STILL * n * degree:
            break
    told = graph.mapInArrow(_backward(buckets, degree, 0), LINE)
    nodes = cut_lineage(_meet(graph.unionByName(told), _links(degree)))
    return Index(nodes, points, buckets, pivots[0], sets[0][0], keep)


# ---- search

def _pick(n: np.ndarray, flags: np.ndarray, expand: int) -> np.ndarray:
    """Which beam entries (sorted nearest first) are expanded next."""
    open_ = ~flags
    line = np.repeat(np.arange(len(n)), n)
    rank = np.cumsum(open_) - open_
    begin = np.concatenate([[0], np.cumsum(n)])[:-1]
    base = np.append(np.cumsum(open_) - open_, open_.sum())[np.minimum(begin, len(open_))]
    return open_ & (rank - base[line] < expand)


def _ask(buckets: int, beam: int, expand: int):
    """Queries ask the buckets of the nodes they expand for those nodes' links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = Lines(b)
            n, ids = q.lists("ids")
            vals, flags = q.lists("vals")[1], q.lists("flags")[1].astype(bool)
            go = _pick(n, flags, expand)
            last = np.cumsum(n) - 1
            far = np.where(n >= beam, vals[np.maximum(last, 0)] if len(vals) else -2, -2)
            yield from _send(np.repeat(np.arange(len(n)), n)[go], ids[go], buckets, q.x,
                             q.vectors(np.float32), far.astype(np.float32))
    return run


def _ragged(of: np.ndarray, cut: np.ndarray):
    """Positions of all list values of the lines ``of``, and which of them each belongs to."""
    size = cut[of + 1] - cut[of]
    line = np.repeat(np.arange(len(of)), size)
    return line, np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(
        cut[of], size)


def _expand(buckets: int):
    """Links of the nodes asked for go on, with the query, to the buckets of what they lead to."""
    def run(own: Lines | None, sent: Iterator[Lines]) -> Iterator[pa.RecordBatch]:
        if own is None:
            return
        at = np.argsort(own.x)
        n, links = own.lists("ids")
        cut = np.concatenate([[0], np.cumsum(n)])
        for q in sent:
            asked, ids = q.lists("ids")
            node = at[np.searchsorted(own.x[at], ids)]
            line, where = _ragged(node, cut)
            row, to = np.repeat(np.arange(len(asked)), asked)[line], links[where]
            by = np.lexsort((to, row))
            row, to = row[by], to[by]
            one = _first_of(row, to)
            yield from _send(row[one], to[one], buckets, q.x, q.vectors(np.float32), q.lists("vals")[1])
    return run


def _measure(query_buckets: int):
    """Nodes nearer than the last of the query's beam go back to the query."""
    def run(own: Lines | None, sent: Iterator[Lines]) -> Iterator[pa.RecordBatch]:
        if own is None:
            return
        at = np.argsort(own.x)
        vec = own.vectors(np.float32)[at]
        ids_at = own.x[at]
        for q in sent:
            n, ids = q.lists("ids")
            row = np.repeat(np.arange(len(n)), n)
            qv, far = q.vectors(np.float32), q.lists("vals")[1]
            for lo in range(0, len(ids), 1 << 16):
                w = slice(lo, lo + (1 << 16))
                s = np.einsum("ij,ij->i", qv[row[w]], vec[np.searchsorted(ids_at, ids[w])])
                ok = s > far[row[w]]
                yield from _from_pairs(query_buckets, q.x[row[w][ok]], ids[w][ok], s[ok])
    return run


def _advance(beam: int, expand: int):
    """The beam takes what was found; entries just expanded are marked."""
    def run(own: Lines | None, sent: Iterator[Lines]) -> Iterator[pa.RecordBatch]:
        if own is None:
            return
        n, ids = own.lists("ids")
        done = own.lists("flags")[1].astype(bool)
        done |= _pick(n, done, expand)
        held = [(np.repeat(own.x, n), ids, own.lists("vals")[1], ~done)]
        size = len(ids)
        for more in sent:
            k, v = more.lists("ids")
            held.append((np.repeat(more.x, k), v, more.lists("vals")[1], np.ones(len(v), bool)))
            size += len(v)
            if size > 1 << 21:
                held = [_top(*map(np.concatenate, zip(*held)), beam)]
                size = len(held[0][0])
        u, v, s, fresh = _top(*map(np.concatenate, zip(*held)), beam)
        by = np.argsort(own.x)
        x = own.x[by]
        cut = np.append(np.searchsorted(u, x), len(u))
        yield _line(own.t.column("bucket").to_numpy(), 0, x, own.vectors(np.float32)[by], cut, v,
                    s.astype(np.float32), ~fresh)
    return run


def _start(index: Index, query_buckets: int):
    """The first beam: the nearest pivots, and the query's own node where it is one."""
    pivots, ids, buckets = index.pivots, index.pivot_ids, query_buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, own = b.column(0).to_numpy(), b.column(2)
            if not len(x):
                continue
            vec = units(_doubles(b.column(1)), np.float32)
            s = vec @ pivots.T
            k = min(ENTRIES, len(ids))
            near = np.argpartition(-s, k - 1, 1)[:, :k]
            u, v = np.repeat(x, k), ids[near].ravel()
            score = np.take_along_axis(s, near, 1).ravel()
            self_ = own.to_numpy(zero_copy_only=False).astype(float)
            has = np.flatnonzero(~np.isnan(self_))
            if len(has):
                mine = own.take(pa.array(has)).to_numpy()
                u, v = np.concatenate([x[has], u]), np.concatenate([mine, v])
                score = np.concatenate([np.ones(len(has), np.float32), score])
            u, v, score, _ = _top(u, v, score, np.zeros(len(u), bool), k + 1)
            by = np.argsort(x)
            cut = np.append(np.searchsorted(u, x[by]), len(u))
            yield _line(bucket_of(x[by], buckets), 0, x[by], vec[by], cut, v,
                        score.astype(np.float32), np.zeros(len(u), bool))
    return run


def _rank(query_buckets: int):
    """Exact measures of the nodes a query ends with: lines (x = query, ids, doubles in vec)."""
    def run(own: Lines | None, sent: Iterator[Lines]) -> Iterator[pa.RecordBatch]:
        if own is None:
            return
        at = np.argsort(own.x)
        vec, ids_at = own.vectors(np.float64)[at], own.x[at]
        for q in sent:
            n, ids = q.lists("ids")
            row, qv = np.repeat(np.arange(len(n)), n), q.vectors(np.float64)
            for lo in range(0, len(ids), 1 << 14):
                w = slice(lo, lo + (1 << 14))
                s = cosines(qv[row[w]], vec[np.searchsorted(ids_at, ids[w])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q.x[row[w]]), pa.array(ids[w]), pa.array(s)], ["qid", "pid", "s"])
    return run


def search(index: Index, queries: DataFrame, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """(qid, pid, s) for queries (qid, v, pid): the nodes of each beam with exact cosines.

    ``pid`` names the query's own node, null where it is none of the indexed ones.
    """
    spark = queries.sparkSession
    n = queries.count()
    buckets = index.buckets
    query_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET))
    steps = Steps(spark)
    state = steps.write(queries.select("qid", "v", "pid").mapInArrow(
        _start(index, query_buckets), LINE))
    links = index.nodes.withColumn("vec", F.lit(None).cast("binary"))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(0).to_numpy()
                yield _line(bucket_of(x, buckets), 0, x, units(_doubles(b.column(1)), np.float32))

    vectors = cut_lineage(index.points.select("pid", "v").mapInArrow(single, LINE))
    for _ in range(SEARCH_ROUNDS):
        if state.where(F.exists("flags", lambda f: ~f)).isEmpty():
            break
        asked = state.mapInArrow(_ask(buckets, beam, expand), LINE)
        led = _meet(links.unionByName(asked), _expand(buckets))
        found = _meet(vectors.unionByName(led), _measure(query_buckets))
        state = steps.write(_meet(state.unionByName(found), _advance(beam, expand)))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(0).to_numpy()
                yield _line(bucket_of(x, buckets), 0, x, _doubles(b.column(1)) + 0.0)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = b.column(3).to_numpy(zero_copy_only=False)
                lists = b.column(2)
                cut, ids = lists.offsets.to_numpy(), lists.flatten().to_numpy()
                size = np.diff(cut)
                row = np.repeat(np.arange(b.num_rows), size)
                at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                to = ids[np.repeat(cut[:-1], size) + at]
                mine = np.flatnonzero(~np.isnan(own.astype(float)))
                row = np.concatenate([row, mine])
                to = np.concatenate([to, b.column(3).take(pa.array(mine)).to_numpy()])
                pairs = np.unique(np.stack([row, to], 1), axis=0)
                yield from _send(pairs[:, 0], pairs[:, 1], buckets, b.column(0).to_numpy(),
                                 _doubles(b.column(1)) + 0.0)

    ends = queries.select("qid", "v", "pid").join(
        state.select(F.col("x").alias("qid"), "ids"), "qid").select("qid", "v", "ids", "pid")
    return _meet(index.points.select("pid", "v").mapInArrow(exact, LINE).unionByName(
        ends.mapInArrow(final, LINE)), _rank(query_buckets), "qid long, pid long, s double")


def nearest_rows(rows: DataFrame, asked: Column, id_col: str = "vec_id",
                 vector_col: str = "embedding", k: int = 5, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of every row that ``asked`` (a
    condition on ``id``) names, found in the graph of all rows."""
    kind = rows.schema[id_col].dataType.simpleString()
    index = build_graph(rows, id_col, vector_col, keep=k + 1, **options)
    if index is None:
        return rows.sparkSession.createDataFrame(
            [], f"query_id {kind}, rank int, vec_id {kind}, score double")
    own = usable(rows, id_col, vector_col).where(asked).select("id", "key")
    asked_keys = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    queries = cut_lineage(index.points.drop("n").join(asked_keys, "key").select(
        F.col("pid").alias("qid"), "v", "pid", "n", "key"))
    found = search(index, queries)
    # Ties end by the smallest ids, so k + 1 nodes with k + 1 ids each are enough.
    named = found.join(index.points.select("pid", "first"), "pid").select(
        "qid", "pid", "s", F.explode("first").alias("id"))
    order = Window.partitionBy("qid").orderBy(F.desc("s"), "id")
    best = named.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy(
        "qid").agg(F.sort_array(F.collect_list(F.struct("r", "id", "s", "pid"))).alias("near"))
    per_key = best.join(queries.select("qid", "key", "n"), "qid").select(
        "key", "qid", "n", "near")
    out = join_group_facts(own, per_key, "key", own.count())
    # The query's own row is one of the entries with its id, where that is among them.
    mine = F.array_position(F.transform("near", lambda e: (e.id == F.col("id")) & (
        e.pid == F.col("qid"))), True)
    others = F.when(mine > 0, F.filter("near", lambda e, i: i != mine - 1)).otherwise(
        F.col("near"))
    return out.select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias(
        "rank", "e")).select("query_id", (F.col("rank") + 1).alias("rank"),
                             F.col("e.id").alias("vec_id"), F.col("e.s").alias("score"))
