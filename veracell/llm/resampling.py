"""Drawing documents whose words are those of a target text collection.

Features are runs of one and two words, hashed by crc32 into buckets. One pass counts the buckets
of the documents and one those of the target; the log ratio of the two is the gain of a bucket, an
array that every task holds. A document's weight is the floored mean of the gains of its features,
its score adds a Gumbel draw from its id, so that the highest scores are a draw without replacement
in proportion to the weights.

The highest scores are found by a distributed quickselect over the composite key (score, id,
features, position): each round draws random pivot keys among the rows still in question, counts
the rows between them exactly, and goes on inside the one gap that holds the k-th key. It ends when
a pivot is that key. Rows are neither sorted nor moved; only the winners are sorted and ranked.

Texts are worked through in pieces cut between words, also inside a text, so that memory does not
grow with the length of a text.

Defined cases: null and empty texts have no features and weight 0; a null id draws as the empty id
and loses ties; repeated rows are rows of their own, and of rows that tie in everything those read
first win; an empty target gives the ratio against no counts; an empty table gives no rows. The
input may have any further columns.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F

from veracell.functions.session import cut_lineage
from veracell.llm import textbatch as tb
from veracell.operators.numbering import number_rows

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: Pivot keys of one round.
PIVOTS = 24
#: Bytes worked through at once.
PIECE = 1 << 20
#: Words up to this length have their crc taken in columns.
SHORT = 32


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_CRC = _crc_table()


def _shift_tables() -> np.ndarray:
    """[n, i, b]: the effect of byte i (value b) of a crc after n further bytes."""
    one = np.arange(256, dtype=np.uint32)
    now = np.stack([one << np.uint32(8 * i) for i in range(4)])
    out = [now]
    for _ in range(SHORT):
        now = _CRC[now & 255] ^ (now >> np.uint32(8))
        out.append(now)
    return np.stack(out)


_SHIFT = _shift_tables()
_SPACE = np.uint32(zlib.crc32(b" "))


def crc_then(first: np.ndarray, second: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """crc32 of two strings put together, from their crcs and the second one's length."""
    at = np.broadcast_to(np.asarray(length), first.shape)
    moved = np.zeros(len(first), np.uint32)
    for i in range(4):
        moved ^= _SHIFT[at, i, (first >> np.uint32(8 * i)) & np.uint32(255)]
    return moved ^ second


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of every word."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    at = np.flatnonzero(size <= SHORT)
    at = at[np.argsort(-size[at], kind="stable")]
    by = size[at]
    for j in range(int(by[0]) if len(by) else 0):
        live = at[:np.searchsorted(-by, -j, "left")]
        c = out[live]
        out[live] = _CRC[(c ^ data[starts[live] + j]) & np.uint32(255)] ^ (c >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > SHORT):
        out[i] = zlib.crc32(data[starts[i]:ends[i]])
    return out


def _pair_crcs(first: np.ndarray, second: np.ndarray, size: np.ndarray, data, starts, ends):
    """crc32 of ``first word + " " + second word``; ``size`` is the second word's length."""
    led = crc_then(first, np.full(len(first), _SPACE, np.uint32), 1)
    out = crc_then(led, second, np.minimum(size, SHORT))
    for i in np.flatnonzero(size > SHORT):
        out[i] = zlib.crc32(data[starts[i]:ends[i]], int(led[i]))
    return out


def features(texts: pa.Array, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(text, crc32) of the features, piece by piece, and how many of them are single words
    (these come first)."""
    data, offsets = tb.flat(texts)
    at, last_doc, last = 0, -1, np.zeros(1, np.uint32)
    while at < len(data):
        to = min(at + piece, len(data))
        while to < len(data) and tb.ALNUM_WORD[tb.LOWER[data[to]]]:
            step = data[to:to + 4096]
            gap = np.flatnonzero(~tb.ALNUM_WORD[tb.LOWER[step]])
            to += int(gap[0]) if len(gap) else len(step)
        low = tb.LOWER[data[at:to]]
        a, b = np.searchsorted(offsets, [at, to], "right")
        cuts = np.concatenate([[0], offsets[a:b] - at, [to - at]])
        starts, ends, doc = tb.words(low, cuts, tb.ALNUM_WORD)
        doc = doc + a - 1
        # Texts that begin at the end of the piece or are empty share an offset.
        doc = np.searchsorted(offsets, starts + at, "right") - 1 if len(starts) else doc
        crc = word_crcs(low, starts, ends)
        if len(crc):
            before = np.concatenate([last, crc[:-1]])
            pair = np.concatenate([[last_doc], doc[:-1]]) == doc
            i = np.flatnonzero(pair)
            both = _pair_crcs(before[i], crc[i], (ends - starts)[i], low, starts[i], ends[i])
            yield np.concatenate([doc, doc[i]]), np.concatenate([crc, both]), len(crc)
            last_doc, last = int(doc[-1]), crc[-1:]
        at = to


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features by bucket, counted in each task before they are added up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for b in batches:
            for _, crc, _ in features(tb.text_array(b.column(0))):
                held += np.bincount(crc % np.uint32(buckets), minlength=buckets)
            tb.hand_back()
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["bucket", "n"])

    return df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text",
          buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket; the driver reads at most two lines a bucket."""
    sides = []
    for df, col in ((docs, text_col), (target, target_col)):
        held = np.zeros(buckets, np.int64)
        for r in bucket_counts(df, col, buckets).collect():
            held[r["bucket"]] = r["n"]
        sides.append(held)
    s, t = sides
    of, to = float(int(s.sum()) + buckets), float(int(t.sum()) + buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * of / ((float(a) + 1) * to)))
                     for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          ) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    buckets = np.uint32(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, n, total = np.zeros((3, b.num_rows), np.int64)
            for doc, crc, single in features(tb.text_array(b.column(1))):
                words += np.bincount(doc[:single], minlength=b.num_rows)
                n += np.bincount(doc, minlength=b.num_rows)
                # Sums of a piece stay far under 2**53.
                total += np.bincount(doc, gain[crc % buckets].astype(float),
                                     b.num_rows).astype(np.int64)
            tb.hand_back()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *map(pa.array, (words, n, total // np.maximum(n, 1)))],
                ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, "
                                "n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A draw in thousandths from the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


#: The order in which rows win: highest score, smallest id (null last), fewest features, position.
KEY = ("k_score", "k_null", "doc_id", "n_features", "pos")


def _before(row: Row) -> Column:
    """Whether a row's key comes before this one, column by column."""
    out, same = F.lit(False), F.lit(True)
    for c in KEY:
        if row[c] is None:  # the id of null ids; k_null has told them apart
            continue
        out = out | (same & F.coalesce(F.col(c) < F.lit(row[c]), F.lit(False)))
        same = same & F.coalesce(F.col(c) == F.lit(row[c]), F.lit(False))
    return out


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS, seed: int = SEED) -> Row | None:
    """The k-th key (from 1) of a written table with the ``KEY`` columns, all keys different.

    Every round costs two narrow scans and brings ``pivots`` lines to the driver; the rows in
    question fall by about that factor.
    """
    if k < 1:
        return None
    live, skipped, turn = rows, 0, 0
    while True:
        turn += 1
        drawn = live.orderBy(F.xxhash64(F.lit(seed), F.lit(turn), *KEY)).limit(pivots).select(*KEY)
        drawn = drawn.orderBy(*KEY).collect()
        if not drawn:
            return None
        # Rows under each pivot: the differences are the exact sizes of the gaps.
        under = live.agg(*[F.count_if(_before(p)).alias(f"u{i}")
                           for i, p in enumerate(drawn)]).first()
        want = k - skipped  # 1-based among the live rows
        for i, p in enumerate(drawn):
            if under[i] == want - 1:
                return p
        low = max((i for i in range(len(drawn)) if under[i] < want - 1), default=None)
        high = min((i for i in range(len(drawn)) if under[i] >= want), default=None)
        if low is None and high is None:
            return None
        # From the written table, so that the plan keeps two bounds whatever the round.
        if low is not None:
            skipped += under[low] + 1
            bottom = drawn[low]
        elif turn == 1:
            bottom = None
        if high is not None:
            top = drawn[high]
        elif turn == 1:
            top = None
        live = rows
        if bottom is not None:
            live = live.where(F.col("k_score") >= bottom["k_score"]).where(
                ~_before(bottom) & (F.col("pos") != bottom["pos"]))
        if top is not None:
            live = live.where(F.col("k_score") <= top["k_score"]).where(_before(top))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS,
             seed: int = SEED, buckets: int = BUCKETS, pivots: int = PIVOTS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``.

    ``rank`` numbers the floor(percent * N / 100) highest scores of the N rows of ``min_words``
    words or more; it is null elsewhere.
    """
    gain = gains(docs, target, text_col, target_col, buckets)
    weighed = weigh(docs, gain, id_col, text_col)
    score = F.col("weight") + gumbel(F.col("doc_id"), seed)
    scored = cut_lineage(weighed.select(
        "doc_id", "n_words", "n_features", "weight", score.alias("score"), (-score).alias(
            "k_score"), F.col("doc_id").isNull().alias("k_null"),
        F.monotonically_increasing_id().alias("pos")))
    fit = scored.where(F.col("n_words") >= min_words)
    last = kth_key(fit, percent * fit.count() // 100, pivots, seed)
    out = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return scored.select(*out, none)
    won = (F.col("n_words") >= min_words) & (_before(last) | (F.col("pos") == last["pos"]))
    ranked = number_rows(scored.where(won), list(KEY), "rank")
    return ranked.select(*out, F.col("rank").cast("long")).unionByName(
        scored.where(~won).select(*out, none))
