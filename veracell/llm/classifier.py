"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters slide over the bytes of overlapping chunks that cover the whole text; each filter
is max-pooled over a chunk, and the mean and the maximum over the chunks are combined into one
probability. Only bytes are inputs.

The network is fitted on a sample of labelled rows of bounded number (``sample_rows``, drawn by
hash), whose texts the driver holds; every text is learned from and scored whole, by the same chunks.

Defined cases: a null or empty text is one chunk of padding; every row gets a score, repeated rows
the same; null labels are not learned from; without labels of both kinds every
text gets the only label there is, or 1.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veracell.llm import textbatch as tb

CHUNK, STEP = 256, 224
WIDTH, DEPTH, FILTERS = 5, 8, 16
SAMPLE_ROWS, EPOCHS = 4000, 12
POOLED = 256  # chunks whose responses are held at once
PAD = 0


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of overlapping chunks that cover every byte; an empty text has one."""
    size = np.diff(offsets)
    n = np.maximum(1, -(-(size - (CHUNK - STEP)) // STEP))
    doc = np.repeat(np.arange(len(size)), n)
    start = offsets[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * STEP
    return start, np.minimum(start + CHUNK, offsets[doc + 1]), doc


def chunk_matrix(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Chunks as rows of CHUNK bytes, padded with zeros."""
    at = start[:, None] + np.arange(CHUNK)
    inside = at < end[:, None]
    if not len(data):
        return np.zeros(at.shape, np.uint8)
    return np.where(inside, data[np.minimum(at, len(data) - 1)], PAD).astype(np.uint8)


class Chunks:
    """The chunks of texts in order; only those of a slice are written out as a matrix."""

    def __init__(self, texts: list[np.ndarray]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.data = np.concatenate(texts)
        self.start, self.end, doc = chunks(self.data, np.append(0, np.cumsum(sizes)))
        self.first = np.searchsorted(doc, np.arange(len(texts)))

    def __len__(self) -> int:
        return len(self.start)

    def __getitem__(self, of: slice) -> np.ndarray:
        return chunk_matrix(self.data, self.start[of], self.end[of])


class Network:
    #: The score of every text where there was nothing to learn.
    constant: float | None = None

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {"embed": rng.normal(0, 0.5, (256, DEPTH)),
                  "filters": rng.normal(0, 0.3, (WIDTH, DEPTH, FILTERS)),
                  "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.1, 2 * FILTERS),
                  "out_bias": np.zeros(1)}

    def tables(self) -> np.ndarray:
        """The filters applied to every byte value: WIDTH x 256 x FILTERS."""
        return np.einsum("be,kef->kbf", self.p["embed"], self.p["filters"]).astype(np.float32)

    def pool(self, x: np.ndarray, tables: np.ndarray, want_place: bool = False):
        """Largest response of each filter in each chunk (and where it was)."""
        n = CHUNK - WIDTH + 1
        out = tables[0].take(x[:, :n], axis=0)
        for k in range(1, WIDTH):
            out += tables[k].take(x[:, k:k + n], axis=0)
        bias = self.p["bias"].astype(np.float32)
        if want_place:
            place = out.argmax(1)
            return np.take_along_axis(out, place[:, None], 1)[:, 0] + bias, place
        return out.max(1) + bias

    def combine(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Inputs of the last layer per text; ``first`` has the first chunk of each."""
        h = np.maximum(pooled, 0)
        count = np.diff(np.append(first, len(h)))
        return np.concatenate([np.add.reduceat(h, first) / count[:, None],
                               np.maximum.reduceat(h, first)], 1)

    def score(self, data: np.ndarray, offsets: np.ndarray, tables: np.ndarray) -> np.ndarray:
        start, end, doc = chunks(data, offsets)
        pooled = np.concatenate([
            self.pool(chunk_matrix(data, start[i:i + POOLED], end[i:i + POOLED]), tables)
            for i in range(0, len(start), POOLED)])
        first = np.searchsorted(doc, np.arange(len(offsets) - 1))
        z = self.combine(pooled, first) @ self.p["out"] + self.p["out_bias"][0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradient(self, x: np.ndarray | Chunks, first: np.ndarray, y: np.ndarray,
                 weight: np.ndarray):
        """Slopes of the weighted loss; only the winning places go back, a slab of chunks at once."""
        tables, slabs = self.tables(), [slice(i, i + POOLED) for i in range(0, len(x), POOLED)]
        pooled, place = (np.concatenate(a) for a in zip(*[
            self.pool(x[of], tables, True) for of in slabs]))
        v = self.combine(pooled, first)
        z = v @ self.p["out"] + self.p["out_bias"][0]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / weight.sum()
        g = {"out": v.T @ d, "out_bias": np.array([d.sum()])}
        back = np.outer(d, self.p["out"])
        count = np.diff(np.append(first, len(x)))
        doc = np.repeat(np.arange(len(first)), count)
        top = np.maximum(pooled, 0)
        to = back[doc, :FILTERS] / count[doc][:, None]
        best = (top == v[doc, FILTERS:]) & (top > 0)
        ties = np.maximum(np.add.reduceat(best.astype(float), first), 1)
        to = (to + back[doc, FILTERS:] * best / ties[doc]) * (pooled > 0)
        g["bias"] = to.sum(0)
        g["filters"], g["embed"] = np.zeros_like(self.p["filters"]), np.zeros((256, DEPTH))
        for of in slabs:
            part, back, at = x[of], to[of], place[of]
            rows = np.arange(len(part))[:, None]
            for k in range(WIDTH):
                b = part[rows, at + k]  # chunk x filter: the byte under this weight
                e = self.p["embed"][b]
                g["filters"][k] += np.einsum("cfe,cf->ef", e, back)
                np.add.at(g["embed"], b.ravel(), (back[:, :, None]
                          * self.p["filters"][k].T[None]).reshape(-1, DEPTH))
        return g

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS,
            batch: int = 32, rate: float = 0.01, seed: int = 11) -> "Network":
        """Adam over batches of texts, each an array of its bytes; classes weigh alike."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        share = np.array([1 / max(1, (labels == c).sum()) for c in (0, 1)])
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                who = order[i:i + batch]
                x = Chunks([texts[j] for j in who])
                g = self.gradient(x, x.first, labels[who], share[labels[who]])
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                    self.p[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-7)
        return self


def fit_classifier(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality",
                   id_col: str = "doc_id", text_col: str = "text",
                   sample_rows: int = SAMPLE_ROWS) -> Network:
    """Fit on labelled rows where ``learn`` (a condition on the id) holds.

    With labels of one kind, or none, or no documents, the network scores every text alike.
    """
    rows = labels.where(learn & F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    # At most sample_rows lines, drawn by hash, half of them for each label where there are so many.
    half = sample_rows // 2
    drawn = [rows.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half)
             for c in (0, 1)]
    sample = F.broadcast(drawn[0].unionByName(drawn[1]))

    got = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias(
        "text")).join(sample, "doc_id").select(
        "y", F.xxhash64("doc_id", "text").alias("h"), F.coalesce("text", F.lit("")).cast(
            "binary").alias("text")).toArrow().sort_by([("h", "ascending")])
    y = got.column("y").to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        # Nothing to tell apart: every text gets the only label there is, or 1 without any.
        network = Network()
        network.constant = float(y[0]) if len(y) else 1.0
        return network
    texts = [np.frombuffer(t.as_py(), np.uint8) for t in got.column("text")]
    return Network().fit(texts, y)


def quality_score(network: Network, text_col: str = "text") -> Column:
    """The probability of label 1 of whole texts, as a column; no shuffle."""
    if network.constant is not None:
        return F.lit(network.constant)
    tables = network.tables()

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        texts = tb.text_array(column)
        out = [network.score(*tb.flat(texts.slice(lo, hi - lo)), tables)
               for lo, hi in tb.slabs(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return score(F.col(text_col).cast("string"))
