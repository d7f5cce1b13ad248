"""Near-duplicates by a chosen-path set similarity join over minwise tokens.

A document is its set of 5-word shingles; equal sets are collapsed to one representative. Sixteen
independent trees start from a minwise token each: documents with the same token form a node. A
node that is small is compared exhaustively on compact signatures; a larger one branches its
documents by two more minwise coordinates that its key selects, again and again, unless a child
keeps nearly all of its parent, in which case branching cannot part it and it is compared too.
Comparing walks the candidate graph outwards from one document and looks only at those not reached
yet, so a tight group costs one comparison each. Candidates are gathered in groups, their full
sets are laid side by side, and links are confirmed on them by the same walk. No pair list is ever
written; groups too large for a task are laid out as pairs of blocks, which covers all pairs.

A pair of similarity s misses all 16 first tokens with probability (1-s)^16 (2e-10 at 0.75);
each branching keeps 1-(1-s)^2 of the pairs (94 % at 0.75) in each tree.

Defined cases: a null or empty text is linked with nothing; a text of fewer than five words is one
shingle; repeated rows share their component; rows with a null id are kept and have no component;
an empty table gives no rows. Ids must be integers; rows that share an id must share the text.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veracell.functions.joins import join_group_facts
from veracell.functions.session import cut_lineage
from veracell.llm import textbatch as tb
from veracell.llm.components import connected_components

TREES = 16
SIGNATURE = 128
SMALL_NODE = 512
#: A child that keeps more than this share of its parent is not branched further.
TIGHT = 0.7
MAX_DEPTH = 8
#: Documents that one task compares at once by signature, and shingles it compares in full.
BLOCK_ROWS = 16_384
BLOCK_SHINGLES = 4_000_000

_ROOTS = tb.mix64(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_FACTOR = (tb.mix64(np.arange(100, 100 + SIGNATURE, dtype=np.uint64)) >> np.uint64(32)).astype(
    np.uint32) | np.uint32(1)
_SHIFT = tb.mix64(np.arange(900, 900 + SIGNATURE, dtype=np.uint64)).astype(np.uint32)


def sketch_set(s: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Root tokens (64-bit minima) and the signature (a byte of each of 128 minima)."""
    roots = np.array([tb.mix64(s ^ r).min() for r in _ROOTS])
    low = tb.mix64(s).astype(np.uint32)
    least = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        least = np.minimum(least, (low[i:i + 2048] * _FACTOR[:, None] + _SHIFT[:, None]).min(1))
    return tb.mix64(roots ^ _ROOTS), ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(
        np.uint8).tobytes()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, f1, f2, roots, sig = [], [], [], [], []
        for _, s, _ in tb.shingle_sets(tb.text_array(b.column(1))):
            n.append(len(s))
            f1.append(int(tb.mix64(s).sum().astype(np.int64)))
            f2.append(int(tb.mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum().astype(np.int64)))
            r, g = sketch_set(s) if len(s) else (np.zeros(0, np.uint64), b"")
            roots.append(r.view(np.int64))
            sig.append(g)
        yield pa.RecordBatch.from_arrays([
            b.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()),
            pa.array(f2, pa.int64()), pa.array(roots, pa.list_(pa.int64())),
            pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "f1", "f2", "roots", "sig"])


class Groups:
    """Rows of a partition sorted by key, handed on as whole groups."""

    def __init__(self, key: int = 0):
        self.key = key
        self.rest: pa.Table | None = None

    def feed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Tables of whole groups and the row where each group begins."""
        for b in batches:
            t = pa.Table.from_batches([b])
            if self.rest is not None:
                t = pa.concat_tables([self.rest, t])
            k = t.column(self.key).to_numpy()
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1])) if np.all(k[:-1] <= k[1:]) else \
                int(np.flatnonzero(k != k[-1])[-1] + 1 if (k != k[-1]).any() else 0)
            self.rest = t.slice(last)
            if last:
                yield self._cut(t.slice(0, last), k[:last])
        if self.rest is not None and self.rest.num_rows:
            yield self._cut(self.rest, self.rest.column(self.key).to_numpy())

    @staticmethod
    def _cut(t: pa.Table, k: np.ndarray) -> tuple[pa.Table, np.ndarray]:
        return t, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))


def walk(n: int, reaches: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The first member of each member's component; ``reaches(i, others)`` marks linked others."""
    root = np.full(n, -1)
    left = np.arange(n)
    while len(left):
        start, left = left[0], left[1:]
        root[start] = start
        front = [start]
        while front and len(left):
            i = front.pop()
            hit = reaches(i, left)
            front.extend(left[hit].tolist())
            root[left[hit]] = start
            left = left[~hit]
        # members still in front have nobody left to reach
    return root


def _least_matches(percent: int) -> int:
    """Equal signature bytes below which a pair at the threshold is 4.4 deviations away."""
    s = percent / 100
    return int(np.floor(SIGNATURE * (s - 4.4 * np.sqrt(s * (1 - s) / SIGNATURE))))


def _candidates(percent: int):
    """Star edges (a, b) of the candidate components of each node."""
    least = _least_matches(percent)

    def near(sig: np.ndarray, size: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
        lo, hi = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
        return (100 * lo >= percent * hi) & (
            np.count_nonzero(sig[others] == sig[i], axis=1) >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in Groups().feed(batches):
            ids = t.column("rep").to_numpy()
            size = t.column("n").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(
                -1, SIGNATURE)
            count = np.diff(np.append(first, len(ids)))
            a, b = [], []
            for g in (2, 3):  # the bulk of the nodes, all at once
                at = first[count == g]
                for i in range(g):
                    for j in range(i + 1, g):
                        x, y = at + i, at + j
                        lo, hi = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
                        ok = (100 * lo >= percent * hi) & (
                            np.count_nonzero(sig[x] == sig[y], axis=1) >= least)
                        a.append(ids[x[ok]])
                        b.append(ids[y[ok]])
            for f, c in zip(first[count > 3].tolist(), count[count > 3].tolist()):
                s, z = sig[f:f + c], size[f:f + c]
                root = walk(c, lambda i, o: near(s, z, i, o))
                far = np.flatnonzero(root != np.arange(c))
                a.append(ids[f + root[far]])
                b.append(ids[f + far])
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
    return run


def _confirm(percent: int):
    """Star edges (a, b) of the components by full sets within each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in Groups().feed(batches):
            ids = t.column("rep").to_numpy()
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in t.column("shingles")]
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(
                -1, SIGNATURE)
            a, b = [], []
            for f, to in zip(first.tolist(), np.append(first[1:], len(ids)).tolist()):
                root = walk(to - f, _linked(sets[f:to], sig[f:to], percent))
                far = np.flatnonzero(root != np.arange(to - f))
                a.append(ids[f + root[far]])
                b.append(ids[f + far])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
    return run


def _linked(sets: list[np.ndarray], sig: np.ndarray, percent: int):
    size = np.array([len(s) for s in sets])
    least = _least_matches(percent)

    def reaches(i: int, others: np.ndarray) -> np.ndarray:
        lo, hi = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
        hit = (100 * lo >= percent * hi) & (
            np.count_nonzero(sig[others] == sig[i], axis=1) >= least)
        for k in np.flatnonzero(hit):
            x, y = sets[i], sets[others[k]]
            x, y = (x, y) if len(x) <= len(y) else (y, x)
            shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            hit[k] = 100 * shared >= percent * (len(x) + len(y) - shared)
        return hit
    return reaches


def _branch(nodes: DataFrame, reps: DataFrame) -> DataFrame:
    """Two children per row: the node's key selects two coordinates of the signature."""
    c1 = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(SIGNATURE))
    c2 = F.pmod(c1 + 1 + F.pmod(F.xxhash64("key", F.lit(2)), F.lit(SIGNATURE - 1)),
                F.lit(SIGNATURE))
    return nodes.join(reps.select("rep", "sig"), "rep").select(
        "rep", F.col("m").alias("parent"), "key", "sig",
        F.explode(F.array(c1, c2)).alias("c")).select(
        "rep", "parent", F.xxhash64("key", "c", F.expr("substring(sig, int(c + 1), 1)")).alias(
            "key"))


def _counted(nodes: DataFrame) -> DataFrame:
    """Nodes of two rows or more, with their size."""
    sizes = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return cut_lineage(nodes.join(sizes, "key"))


def leaves(reps: DataFrame, small_node: int = SMALL_NODE) -> DataFrame:
    """(key, rep, m) of all nodes to compare."""
    nodes = _counted(reps.select(F.explode("roots").alias("key"), "rep", F.lit(None).cast(
        "long").alias("parent")))
    out = []
    for depth in range(MAX_DEPTH + 1):
        small = F.col("m") <= small_node
        tight = F.coalesce(F.col("m") > TIGHT * F.col("parent"), F.lit(False))
        ends = (small | tight) if depth < MAX_DEPTH else F.lit(True)
        out.append(nodes.where(ends).select("key", "rep", "m"))
        rest = nodes.where(~ends)
        if depth == MAX_DEPTH or rest.isEmpty():
            break
        nodes = _counted(_branch(rest, reps))
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every


def _blocked(rows: DataFrame, blocks, *key: str) -> DataFrame:
    """Rows times the block pairs they take part in: one if there is one block."""
    mine = F.pmod(F.xxhash64("rep", *key), F.col("blocks"))
    return rows.withColumn("blocks", blocks.cast("long")).withColumn("mine", mine).withColumn(
        "other", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn(
        "group", F.when(F.col("blocks") == 1, F.xxhash64(*key)).otherwise(F.xxhash64(
            *key, F.least("mine", "other"), F.greatest("mine", "other")))).drop("mine", "other")


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id",
                    text_col: str = "text", small_node: int = SMALL_NODE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Rows are linked where 100 * shared shingles >= percent * shingles of both; component_id is the
    smallest id that links reach, kept tells the row that has it.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                         F.col(text_col).cast("string").alias("text"))
    rows = cut_lineage(narrow.mapInArrow(
        _sketch, "doc_id long, n_shingles long, f1 long, f2 long, roots array<long>, sig binary"))
    sets = rows.where("n_shingles > 0 and doc_id is not null")
    groups = cut_lineage(sets.groupBy("f1", "f2").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_rows"),
        F.first("n_shingles").alias("n"), F.first("roots").alias("roots"),
        F.first("sig").alias("sig")))
    reps = groups.select("rep", "n", "roots", "sig")

    # Nodes are compared by signature.
    nodes = _blocked(leaves(reps, small_node), F.ceil(F.col("m") / BLOCK_ROWS), "key")
    laid = nodes.select("group", "rep").join(reps.select("rep", "n", "sig"), "rep").select(
        "group", "rep", "n", "sig").repartition("group").sortWithinPartitions("group")
    stars = laid.mapInArrow(_candidates(percent), "a long, b long")
    near = connected_components(stars)

    # Candidate groups are confirmed on full sets.
    near = near.join(reps.select(F.col("rep").alias("node"), "n", "sig"), "node").select(
        F.col("node").alias("rep"), "component", "n", "sig")
    weight = near.groupBy("component").agg(F.sum("n").alias("weight"))
    near = _blocked(near.join(weight, "component"), F.ceil(
        F.col("weight") / BLOCK_SHINGLES), "component").select("group", "rep", "sig")
    texts = narrow.join(near.withColumnRenamed("rep", "doc_id"), "doc_id").select(
        "group", "doc_id", "sig", "text")
    laid = texts.mapInArrow(_full_sets, "group long, rep long, sig binary, shingles binary"
                            ).repartition("group").sortWithinPartitions("group")
    links = laid.mapInArrow(_confirm(percent), "a long, b long")
    merged = connected_components(links)

    facts = groups.select(F.struct("f1", "f2").alias("set"), "rep", "n_rows").join(
        merged.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set", F.coalesce("component", "rep").alias("component"), "n_rows")
    total = rows.count()
    linked = join_group_facts(
        sets.select("doc_id", "n_shingles", F.struct("f1", "f2").alias("set")),
        cut_lineage(facts), "set", total, size_col="n_rows", small=0)
    alone = rows.where("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).alias(
            "component"))
    return linked.select("doc_id", "n_shingles", "component").unionByName(alone).select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [s.tobytes() for _, s, _ in tb.shingle_sets(tb.text_array(b.column(3)))]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sets, pa.binary())],
                                         names=["group", "rep", "sig", "shingles"])
