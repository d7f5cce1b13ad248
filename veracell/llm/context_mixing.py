"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is coded byte by byte, each byte as eight binary decisions, and closed by a zero byte. For
the last two to five bytes each, and for the present word so far, there is a predictor: counts of
both outcomes under the hash of context and decided bits, gathered over all learning texts. Their log odds are mixed with weights
that a gate selects (the longest context with evidence, and how much evidence each has); the
weights are learned online, batch by batch, on every distinct byte in context of the learning
texts as often as it occurs, against counts that leave the present occurrence out, and averaged
over the tasks by the bits they saw. A last table refines the mixed probability by what it met in
practice. The score is log10 of the probability of the whole text; ``bits_per_byte`` follows.

All work on bits is done once per distinct gram (context and byte): learning texts send grams with
their counts, dealt out by the last three context bytes into parts of bounded size, whose sums per
slot add up.

Beside it stands the unigram base over words, closed by one end per text. Word counts are exact:
words are counted first, as 64-bit hashes. The most frequent ones, of which there are fewer than
``COMMON`` whatever the corpus, go to every task with their counts; the others travel with lists of
the texts of a batch that hold them, cut by hash range into buckets of bounded size, because none
of them has more than one in ``COMMON`` of all tokens.

The model's size is fixed by ``BITS`` (31 MB), whatever the corpus; tables of the corpus are summed
by hash range and only the finished model goes to the tasks.

Defined cases: a null or empty text has one token, the end; repeated rows are scored each; texts
are lower-cased (A-Z); an empty table gives no rows; without learning texts all is unknown.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from veracell.functions.session import cut_lineage
from veracell.llm import textbatch as tb
from veracell.llm.near_duplicates import Groups

#: log2 of the slots of each predictor: the last 2 to 5 bytes, and (WORD) those of the last 5
#: that belong to the present word.
WORD = 1
BITS = {2: 18, WORD: 20, 3: 19, 4: 21, 5: 22}
ORDERS = list(BITS)
REACH = max(ORDERS)
SEGMENTS = 64
SLAB = tb.SLAB
LEVELS = 8
PRIOR = 0.3
CELLS = 33
BATCH = 8192
#: Grams of one online step, passes over them, and the least steps of a task.
STEP, EPOCHS, STEPS = 1024, 3, 600
#: Grams are dealt into one part for so many bytes of text, and these at least.
PART_BYTES, PARTS = 16 << 20, 64
#: Words with over one in ``COMMON`` of all tokens go to every task.
COMMON = 1 << 16
#: Tokens of the other words in a bucket, and grams that a learner takes at once.
BUCKET, CHUNK = 1 << 19, 1_000_000
#: Distinct grams that a task holds before it sends them, and a worker remembers scored.
HELD = 2_000_000

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_LEVEL = np.minimum(np.ceil(np.log2(np.arange(256) + 1)), LEVELS - 1).astype(np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last five bytes and the present one of every position, end included, packed; and the
    position where each text begins in that row."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    wide = np.zeros(len(data) + n * (REACH + 1), np.uint8)
    shift = np.arange(n) * (REACH + 1) + REACH
    at = np.arange(len(data)) + np.repeat(shift, size)
    wide[at] = data
    out = np.zeros(len(wide) - REACH, np.uint64)
    for j in range(REACH + 1):
        out = (out << np.uint64(8)) | wide[j:len(wide) - REACH + j]
    begin = offsets[:-1] + np.arange(n)
    keep = np.arange(len(data) + n) + np.repeat(np.arange(n) * REACH, size + 1)
    return out[keep], begin


def _seen(u: np.ndarray, order: int) -> np.ndarray:
    """The grams with only the bytes that a predictor looks at, the present byte included."""
    if order != WORD:
        return u & np.uint64((1 << (8 * (order + 1))) - 1)
    out, inside = u & np.uint64(255), np.ones(len(u), bool)
    for j in range(1, REACH + 1):
        byte = (u >> np.uint64(8 * j)) & np.uint64(255)
        inside &= tb.PLAIN_WORD[byte.astype(np.int64)] & (byte > 0)
        out |= np.where(inside, byte << np.uint64(8 * j), np.uint64(0))
    return out


def _context(u: np.ndarray, order: int) -> np.ndarray:
    return tb.mix64((_seen(u, order) >> np.uint64(8)) | np.uint64(order << 56))


def _slot(hashed: np.ndarray, node: np.ndarray, order: int) -> np.ndarray:
    return (((hashed + node * _K1) * _K2) >> np.uint64(64 - BITS[order])).astype(np.int64)


def _decisions(u: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Decided bits (with a leading one) and the next bit, eight times."""
    byte = u & np.uint64(255)
    for j in range(8):
        yield (np.uint64(1 << j) | (byte >> np.uint64(8 - j)),
               ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64))


def _texts(b: pa.RecordBatch, column: int, slab: int = SLAB):
    texts = tb.text_array(b.column(column))
    for lo, hi in tb.slabs(texts, slab):
        data, offsets = tb.flat(texts.slice(lo, hi - lo))
        yield lo, hi, tb.LOWER[data], offsets


def _merged(u: list[np.ndarray], c: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    grams_, inverse = np.unique(np.concatenate(u), return_inverse=True)
    return grams_, np.bincount(inverse, weights=np.concatenate(c)).astype(np.int64)


def _packed(u: np.ndarray) -> bytes:
    """Grams byte by byte: sorted, so that the first bytes hardly change."""
    return u.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :REACH + 1].T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(REACH + 1, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :REACH + 1] = planes.T
    return out.view("<u8").ravel()


def _count(parts: int):
    """Distinct grams and their counts, by the last three context bytes."""
    def send(us: list[np.ndarray], cs: list[np.ndarray]) -> pa.RecordBatch:
        u, c = _merged(us, cs)
        part = (tb.mix64((u >> np.uint64(8)) & np.uint64(0xFFFFFF)) % np.uint64(parts)).astype(
            np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        live = np.flatnonzero(np.diff(cut))
        rows = [order[cut[k]:cut[k + 1]] for k in live]
        return pa.RecordBatch.from_arrays([
            pa.array(live), pa.array([_packed(u[r]) for r in rows], pa.binary()),
            pa.array([c[r].astype("<u4").tobytes() for r in rows], pa.binary())],
            names=["part", "u", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, cs = [], []
        for b in batches:
            for _, _, data, offsets in _texts(b, 0):
                u, c = np.unique(grams(data, offsets)[0], return_counts=True)
                us.append(u)
                cs.append(c)
                if sum(map(len, us)) > HELD:
                    u, c = _merged(us, cs)
                    us, cs = [u], [c]
                    if len(u) > HELD // 2:
                        yield send(us, cs)
                        us, cs = [], []
        if us:
            yield send(us, cs)
    return run


def _tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part: its grams (segment -1), and what they add to the segments of the tables."""
    for t, first in Groups(0).feed(batches):
        for f, to in zip(first.tolist(), np.append(first[1:], t.num_rows).tolist()):
            part = t.slice(f, to - f)
            u, c = _merged([_unpacked(x) for x in part.column("u").to_pylist()],
                           [np.frombuffer(x, "<u4") for x in part.column("c").to_pylist()])
            rows = [(-1, _packed(u), c.astype("<u8").tobytes())]
            for o in ORDERS:
                short, inverse = np.unique(_seen(u, o), return_inverse=True)
                n = np.bincount(inverse, weights=c).astype(np.int64)
                hashed, total = _context(short, o), np.zeros(2 << BITS[o], np.int64)
                for node, bit in _decisions(short):
                    np.add.at(total, _slot(hashed, node, o) * 2 + bit, n)
                at = np.flatnonzero(total)
                n = total[at].astype("<u8")
                size = (2 << BITS[o]) // SEGMENTS
                cut = np.searchsorted(at, np.arange(SEGMENTS + 1) * size)
                rows += [(o * SEGMENTS + k, (at[cut[k]:cut[k + 1]] - k * size).astype(
                    "<u4").tobytes(), n[cut[k]:cut[k + 1]].tobytes())
                    for k in range(SEGMENTS) if cut[k] < cut[k + 1]]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([
                pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()),
                pa.array(cols[2], pa.binary())], names=["part", "at", "n"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one segment of a table; large ones are scaled down to 16 bits."""
    part, total = None, None

    def done():
        pair = total.reshape(-1, 2)
        scale = np.maximum(1.0, pair.max(1) / 65535)[:, None]
        return pa.RecordBatch.from_arrays([
            pa.array([part], pa.int64()),
            pa.array([np.ceil(pair / scale).astype("<u2").tobytes()], pa.binary())],
            names=["part", "n"])

    for b in batches:
        for k, at, n in zip(*(c.to_pylist() for c in b.columns)):
            if k != part:
                if part is not None:
                    yield done()
                part, total = k, np.zeros((2 << BITS[k // SEGMENTS]) // SEGMENTS, np.int64)
            total[np.frombuffer(at, "<u4")] += np.frombuffer(n, "<u8").astype(np.int64)
    if part is not None:
        yield done()


class Model:
    """Counts, mixing weights and the refining table."""

    def __init__(self, counts: dict[int, np.ndarray], shared=None):
        self.counts, self.shared = counts, shared
        self.weights = np.full((len(ORDERS) + 1, len(ORDERS), LEVELS), 0.35)
        self.cells = np.zeros((256, CELLS, 2))

    def inputs(self, u: np.ndarray, leave_out: bool):
        """Log odds and evidence levels of every predictor (orders x 8 x grams), and the bits."""
        shape = (len(ORDERS), 8, len(u))
        odds, level = np.zeros(shape, np.float32), np.zeros(shape, np.uint8)
        nodes, bits = np.zeros(shape[1:], np.int64), np.zeros(shape[1:], np.int64)
        for i, o in enumerate(ORDERS):
            hashed, table = _context(u, o), self.counts[o]
            for j, (node, bit) in enumerate(_decisions(u)):
                nodes[j], bits[j] = node, bit
                n = table[_slot(hashed, node, o)].astype(np.float32)
                if leave_out:
                    n1 = np.maximum(n[:, 1] - bit, 0)
                    n0 = np.maximum(n[:, 0] - (1 - bit), 0)
                else:
                    n0, n1 = n[:, 0], n[:, 1]
                odds[i, j] = np.log((n1 + PRIOR) / (n0 + PRIOR))
                level[i, j] = _LEVEL[np.minimum(n0 + n1, 255).astype(np.int64)]
        return odds, level, nodes, bits

    def mixed(self, odds, level):
        """Log odds after mixing, and the index of every weight used."""
        gate = np.zeros(level.shape[1:], np.int64)
        for i in range(len(ORDERS)):
            gate = np.where(level[i] > 0, i + 1, gate)
        flat, where = self.weights.ravel(), []
        z = np.zeros(gate.shape)
        for i in range(len(ORDERS)):
            at = (gate * len(ORDERS) + i) * LEVELS + level[i]
            z += flat[at] * odds[i]
            where.append(at)
        return z, where

    @staticmethod
    def cell(z: np.ndarray) -> np.ndarray:
        return np.clip(np.round(z * 2) + CELLS // 2, 0, CELLS - 1).astype(np.int64)

    def learn(self, u: np.ndarray, c: np.ndarray, slope: np.ndarray, rng,
              steps: int = STEPS) -> int:
        """Online steps over distinct grams of multiplicity c; the last pass fills the table."""
        share = c / c.mean()
        epochs = max(EPOCHS, -(-steps * STEP // max(len(u), 1)))
        for epoch in range(epochs):
            order = rng.permutation(len(u))
            for i in range(0, len(u), STEP):
                take = order[i:i + STEP]
                odds, level, nodes, bits = self.inputs(u[take], True)
                z, where = self.mixed(odds, level)
                wrong = (bits - 1 / (1 + np.exp(-z))) * share[take]
                grad = np.zeros(self.weights.size)
                for k, at in enumerate(where):
                    grad += np.bincount(at.ravel(), (wrong * odds[k]).ravel(), self.weights.size)
                slope += grad ** 2
                self.weights += (0.05 * grad / np.sqrt(slope + 1e-8)).reshape(self.weights.shape)
                if epoch == epochs - 1:
                    at = (nodes * CELLS + self.cell(z)) * 2 + bits
                    self.cells += np.bincount(
                        at.ravel(), np.broadcast_to(c[take], bits.shape).ravel(),
                        self.cells.size).reshape(self.cells.shape)
        return int(c.sum()) * 8

    def log10(self, u: np.ndarray) -> np.ndarray:
        """log10 of the probability of the present byte of every gram."""
        middle = (np.arange(CELLS) - CELLS // 2) / 2
        prior = 1 / (1 + np.exp(-middle))
        refined = (self.cells[:, :, 1] + 16 * prior) / (self.cells.sum(2) + 16)
        out = np.zeros(len(u))
        for i in range(0, len(u), BATCH):
            odds, level, nodes, bits = self.inputs(u[i:i + BATCH], False)
            z, _ = self.mixed(odds, level)
            p = (1 / (1 + np.exp(-z)) + refined[nodes, self.cell(z)]) / 2
            p = np.clip(np.where(bits == 1, p, 1 - p), 1e-7, 1)
            out[i:i + BATCH] = np.log10(p).sum(0)
        return out


def _learner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        slope = np.zeros(model.weights.size)
        rng = np.random.default_rng(5)
        seen, us, cs = 0, [], []

        def learn() -> int:
            return model.learn(np.concatenate(us), np.concatenate(cs).astype(np.int64), slope, rng,
                               0 if seen else STEPS)

        for b in batches:
            for u, c in zip(*b.columns):
                us.append(_unpacked(u.as_buffer()))
                cs.append(np.frombuffer(c.as_buffer(), "<u8"))
                if sum(map(len, us)) >= CHUNK:
                    seen += learn()
                    us, cs = [], []
        if us:
            seen += learn()
        if seen:
            yield pa.RecordBatch.from_arrays([
                pa.array([float(seen)]), pa.array([(model.weights * seen).ravel().tolist()]),
                pa.array([model.cells.ravel().tolist()])], names=["seen", "weights", "cells"])
    return run


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Learn from all rows."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(PARTS, -(-size // PART_BYTES))
    tabled = cut_lineage(texts.mapInArrow(
        _count(parts), "part long, u binary, c binary").repartition("part").sortWithinPartitions(
        "part").mapInArrow(_tabled, "part long, at binary, n binary"))
    summed = tabled.where("part >= 0").repartition("part").sortWithinPartitions(
        "part").mapInArrow(_sum, "part long, n binary")
    counts = {o: np.zeros((1 << BITS[o], 2), np.uint16) for o in ORDERS}
    for part, n in summed.toLocalIterator():  # the finished model, of fixed size
        o, s = divmod(part, SEGMENTS)
        got = np.frombuffer(n, "<u2").reshape(-1, 2)
        counts[o][s * len(got):(s + 1) * len(got)] = got
    model = Model(counts, spark.sparkContext.broadcast(counts))
    learned = cut_lineage(tabled.where("part < 0").select("at", "n").mapInArrow(
        _learner(model.shared), "seen double, weights array<double>, cells array<double>"))
    # A line of fixed length per task, added up in a few tasks before it comes to the driver.
    totals = learned.repartition(4).mapInArrow(_added, learned.schema).collect()
    seen = sum(r.seen for r in totals)
    if seen:
        model.weights = sum(np.array(r.weights) for r in totals).reshape(
            model.weights.shape) / seen
        model.cells = sum(np.array(r.cells) for r in totals).reshape(model.cells.shape)
    return model


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for row in zip(*(c for c in b.columns)):
            row = [np.array(x.as_py()) for x in row]
            total = row if total is None else [a + x for a, x in zip(total, row)]
    if total is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.tolist()]) for x in total], names=["seen", "weights", "cells"])


class Memory:
    """Scores of the grams that a worker has met, sorted."""

    def __init__(self, model: Model):
        self.model = model
        self.u, self.v = np.zeros(0, np.uint64), np.zeros(0)

    def scores(self, u: np.ndarray) -> np.ndarray:
        """Scores of distinct sorted grams."""
        at = np.searchsorted(self.u, u)
        known = np.zeros(len(u), bool)
        inside = at < len(self.u)
        known[inside] = self.u[at[inside]] == u[inside]
        out = np.empty(len(u))
        out[known] = self.v[at[known]]
        new = u[~known]
        out[~known] = values = self.model.log10(new)
        if len(self.u) + len(new) > HELD:
            self.u, self.v = u, out
        else:
            self.u, self.v = (np.insert(x, at[~known], y) for x, y in (
                (self.u, new), (self.v, values)))
        return out


_workers: dict[str, Memory] = {}


class Lookup:
    """Values of distinct grams by a direct table; grams that share a slot are searched."""

    BITS = 20

    def __init__(self, u: np.ndarray, values: np.ndarray):
        self.u, self.values = u, values
        at = self._at(u)
        self.table = np.full(1 << self.BITS, np.nan, np.float64)
        self.table[at] = values
        taken = np.bincount(at, minlength=1 << self.BITS)
        self.table[taken > 1] = np.nan

    def _at(self, g: np.ndarray) -> np.ndarray:
        return ((g * _K1) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def get(self, g: np.ndarray) -> np.ndarray:
        out = self.table[self._at(g)]
        miss = np.flatnonzero(np.isnan(out))
        out[miss] = self.values[np.searchsorted(self.u, g[miss])]
        return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every token; the end of a text is a word of its own."""
    starts, ends, doc = tb.words(data, offsets, tb.PLAIN_WORD)
    hashed = tb.span_hash(tb.prefix_hash(data), starts, ends)
    n = len(offsets) - 1
    return (np.concatenate([hashed, np.full(n, np.uint64(0))]),
            np.concatenate([doc, np.arange(n)]))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task with their tokens in learning texts and in all; a word may come again."""
    def line(us: list[np.ndarray], cs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h, at = np.unique(np.concatenate(us), return_inverse=True)
        c = np.concatenate(cs)
        return h, np.stack([np.bincount(at, c[:, k], len(h)) for k in (0, 1)], 1).astype(np.int64)

    def send(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(h.view(np.int64)), pa.array(c[:, 0]), pa.array(c.sum(1))],
            names=["h", "learnt", "tokens"])

    us, cs = [], []
    for b in batches:
        held = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for lo, _, data, offsets in _texts(b, 0):
            hashed, doc = _words(data, offsets)
            for k, those in enumerate((~held[lo + doc], held[lo + doc])):
                h, n = np.unique(hashed[those], return_counts=True)
                us.append(h)
                cs.append(np.stack([n * (1 - k), n * k], 1))
            if sum(map(len, us)) > HELD:
                h, c = line(us, cs)
                us, cs = [h], [c]
                if len(h) > HELD // 2:
                    yield send(h, c)
                    us, cs = [], []
    if us:
        yield send(*line(us, cs))


_SCORED = ("doc_id {0}, unit long, bucket long, n_tokens long, n_bytes long, held_out boolean, "
           "score double, base double, known long, h binary, n binary, docs binary, tf binary")


def _scorer(shared, weights: np.ndarray, cells: np.ndarray, buckets: int, common):
    """Lines of texts (bucket -1, in the order of their unit) with the base terms of common words,
    and lists of the other words by hash range. A unit is a batch."""
    name = uuid.uuid4().hex

    def lists(hashed: np.ndarray, doc: np.ndarray, tf: np.ndarray, unit: int, kind: pa.DataType):
        order = np.argsort(hashed, kind="stable")  # texts stay in order
        hashed, doc, tf = hashed[order], doc[order], tf[order]
        first = np.flatnonzero(np.concatenate([[True], hashed[1:] != hashed[:-1]]))
        words, n = hashed[first], np.diff(np.append(first, len(doc)))
        which = ((words >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        cut = np.searchsorted(which, np.arange(buckets + 1, dtype=np.uint64))
        pair = np.append(first, len(doc))[cut]
        live = np.flatnonzero(np.diff(cut))
        none = np.zeros(len(live), np.int64)
        return pa.RecordBatch.from_arrays([
            pa.nulls(len(live), kind), pa.array(none + unit), pa.array(live), pa.array(none),
            pa.array(none), pa.array(none.astype(bool)), pa.array(none.astype(float)),
            pa.array(none.astype(float)), pa.array(none),
            *[pa.array([x[c[k]:c[k + 1]].tobytes() for k in live], pa.binary()) for x, c in (
                (words, cut), (n.astype("<u4"), cut), (doc.astype("<u4"), pair), (tf, pair))]],
            names=names)

    names = ["doc_id", "unit", "bucket", "n_tokens", "n_bytes", "held_out", "score", "base",
             "known", "h", "n", "docs", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _workers:
            _workers.clear()
            model = Model(shared.value)
            model.weights, model.cells = weights, cells
            _workers[name] = Memory(model)
        memory, unit = _workers[name], TaskContext.get().partitionId() << 32
        often, often_n = common.value
        for b in batches:
            rare: list[tuple] = []
            for lo, hi, data, offsets in _texts(b, 1):
                g, begin = grams(data, offsets)
                u = np.unique(g)
                score = np.add.reduceat(Lookup(u, memory.scores(u)).get(g), begin)
                rows = hi - lo
                hashed, doc = _words(data, offsets)
                held = b.column(2).slice(lo, rows).to_numpy(zero_copy_only=False).astype(bool)
                order = np.argsort(hashed, kind="stable")  # texts stay in order
                hashed, doc = hashed[order], doc[order]
                new = np.flatnonzero(np.concatenate([[True], (hashed[1:] != hashed[:-1])
                                                     | (doc[1:] != doc[:-1])]))
                tf = np.diff(np.append(new, len(doc)))
                hashed, doc = hashed[new], doc[new]
                tokens = np.bincount(doc, weights=tf, minlength=rows).astype(np.int64)
                at = np.minimum(np.searchsorted(often, hashed), max(len(often) - 1, 0))
                met = often[at] == hashed if len(often) else np.zeros(len(hashed), bool)
                at, of, times = at[met], doc[met], tf[met]
                base = np.bincount(of, times * np.log10(often_n + 0.1)[at], rows)
                known = np.bincount(of, np.where(often_n[at] > 0, times, 0), rows)
                rest = ~met
                rare.append((hashed[rest], doc[rest] + lo, np.where(
                    held[doc[rest]], -tf[rest], tf[rest]).astype("<i4")))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, rows), pa.array(np.full(rows, unit)),
                    pa.array(np.full(rows, -1)), pa.array(tokens), pa.array(np.diff(offsets)),
                    pa.array(held), pa.array(score), pa.array(base),
                    pa.array(known.astype(np.int64)),
                    *[pa.nulls(rows, pa.binary()) for _ in range(4)]], names=names)
            if rare:
                hashed, doc, tf = (np.concatenate(x) for x in zip(*rare))
                if len(hashed):
                    yield lists(hashed, doc, tf, unit, b.schema.field(0).type)
            unit += 1

    return run


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: each unit's sums by text."""
    for t, first in Groups(0).feed(batches):
        for f, to in zip(first.tolist(), np.append(first[1:], t.num_rows).tolist()):
            part = t.slice(f, to - f)
            h, n, docs, tf = ([np.frombuffer(x.as_buffer(), k) for x in part.column(c)]
                              for c, k in (("h", "<u8"), ("n", "<u4"), ("docs", "<u4"),
                                           ("tf", "<i4")))
            sizes = np.array([len(x) for x in docs])
            words, inverse = np.unique(np.concatenate(h), return_inverse=True)
            word = np.repeat(inverse, np.concatenate(n))
            tf, docs = np.concatenate(tf).astype(np.int64), np.concatenate(docs).astype(np.int64)
            count = np.bincount(word, np.maximum(tf, 0), len(words))
            tf = np.abs(tf)
            add = tf * np.log10(count + 0.1)[word]
            known = np.where(count[word] > 0, tf, 0)
            unit = np.repeat(np.arange(len(sizes)), sizes)
            key, at = np.unique((unit << 32) | docs, return_inverse=True)
            add, known = np.bincount(at, add, len(key)), np.bincount(at, known, len(key))
            cut = np.searchsorted(key >> 32, np.arange(len(sizes) + 1))
            doc = (key & 0xFFFFFFFF).astype("<u4")
            yield pa.RecordBatch.from_arrays([part.column("unit").combine_chunks(), *[
                pa.array([x[cut[i]:cut[i + 1]].tobytes() for i in range(len(sizes))], pa.binary())
                for x in (doc, add.astype("<f8"), known.astype("<i8"))]],
                names=["unit", "docs", "add", "known"])


def _gather(id_type: str):
    """Texts of a unit beside their summed base terms."""
    names = ["doc_id", "held_out", "n_tokens", "n_bytes", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in Groups(0).feed(batches):
            for f, to in zip(first.tolist(), np.append(first[1:], t.num_rows).tolist()):
                part = t.slice(f, to - f)
                texts = part.filter(pa.compute.is_null(part.column("docs"))).sort_by("place")
                add, known = (texts.column(c).to_numpy().copy() for c in ("base", "n_known"))
                sums = part.filter(pa.compute.is_valid(part.column("docs"))).sort_by("place")
                for d, a, k in zip(*(sums.column(c).to_pylist() for c in ("docs", "add",
                                                                          "known"))):
                    at = np.frombuffer(d, "<u4")
                    add[at] += np.frombuffer(a, "<f8")
                    known[at] += np.frombuffer(k, "<i8")
                out = texts.select(names).append_column("n_known", pa.array(known)).append_column(
                    "base", pa.array(add)).combine_chunks()
                yield from out.to_batches()
    return run


def score_texts(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of
    every row; the base counts the rows that are not held out."""
    spark = docs.sparkSession
    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held"))
    counts = cut_lineage(rows.select("text", "held").mapInArrow(
        _word_counts, "h long, learnt long, tokens long").groupBy("h").agg(
        F.sum("learnt").alias("learnt"), F.sum("tokens").alias("tokens")))
    tokens, words, spoken = (x or 0 for x in counts.agg(
        F.sum("learnt"), F.count_if(F.col("learnt") > 0), F.sum("tokens")).first())
    often = counts.where(F.col("tokens") * COMMON > spoken).toArrow()  # fewer than COMMON lines
    h, learnt, met = (often.column(c).to_numpy() for c in ("h", "learnt", "tokens"))
    order = np.argsort(h.view(np.uint64))
    common = spark.sparkContext.broadcast((h.view(np.uint64)[order], learnt[order]))
    buckets = max(8, -(-(spoken - int(met.sum())) // BUCKET))
    shared = model.shared or spark.sparkContext.broadcast(model.counts)
    scored = cut_lineage(rows.mapInArrow(
        _scorer(shared, model.weights, model.cells, buckets, common),
        _SCORED.format(id_type)).withColumn("place", F.monotonically_increasing_id()))
    parts = scored.where("bucket >= 0").select(
        "bucket", "unit", "h", "n", "docs", "tf").repartition(
        buckets, "bucket").sortWithinPartitions("bucket", "unit").mapInArrow(
        _base, "unit long, docs binary, add binary, known binary")
    columns = ["doc_id", "held_out", "n_tokens", "n_bytes", "score", "base", "n_known"]
    texts = scored.where("bucket = -1").withColumnRenamed("known", "n_known").select(
        "unit", "place", *columns, *[F.lit(None).cast("binary").alias(c)
                                     for c in ("docs", "add", "known")])
    sums = parts.select(
        "unit", F.xxhash64("docs", "add").alias("place"),
        *[F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in columns],
        "docs", "add", "known")
    out = texts.unionByName(sums).repartition("unit").sortWithinPartitions("unit").mapInArrow(
        _gather(id_type), f"doc_id {id_type}, held_out boolean, n_tokens long, n_bytes long, "
        "score double, n_known long, base double")
    floor = float(np.log10(tokens + 0.1 * (words + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias(
            "train_tokens"), (F.col("base") - F.col("n_tokens") * floor).alias("base_score"),
        "score", (-F.col("score") / float(np.log10(2)) / (F.col("n_bytes") + 1)).alias(
            "bits_per_byte"))
