"""Packing: concatenate and cut.

Pass one tokenises every text once and writes, per task, the token ids with running offsets.
The totals of the tasks (one line each) are summed to global offsets; pass two cuts the
concatenation at every multiple of the sequence length, in SQL expressions. A text that lies
across a cut gives one boundary record per sequence. Only the last sequence is padded.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; an empty
table gives no pieces; further columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from veracell.functions.session import scratch_path
from veracell.llm import textbatch as tb

#: Words a worker remembers; others are tokenised again when they come back.
CACHE_WORDS = 900_000
#: Marks that the splitting pattern parts from the letters before them.
CLOSING = [".", ",", ";", ":", "!", "?"]
_workers: dict = {}


class WordEncoder:
    """Token ids of texts for tokenizers that drop white space, so that words are independent.

    Words are looked up by their 64-bit hash, all words of a slab at once. A new word that is
    letters and one closing mark is put together from both, as the splitting pattern parts them
    anyway; the library encodes the rest.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # Tables with room to grow: where the ids of a word begin, and how many it has.
        self.ids, self.start, self.size = (np.zeros(1 << 16, k) for k in (
            np.uint32, np.int64, np.int64))
        self.n_words = self.n_ids = 0
        self._append([[end_id]], keep=True)  # word 0 is the end of a text
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.marks = {ord(m): e.ids for m, e in zip(CLOSING, self.tokenizer.encode_batch_fast(
            CLOSING, add_special_tokens=False))}

    def _find(self, hashed: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        if not len(self.keys):
            return np.full(len(hashed), -1)
        i = np.minimum(np.searchsorted(self.keys, hashed), len(self.keys) - 1)
        return np.where(self.keys[i] == hashed, self.at[i], -1)

    def _encode(self, words: list[bytes], bases: np.ndarray) -> list[list[int]]:
        """Ids of new words; ``bases`` has the number of each word without its last byte, or -1."""
        pieces: dict[str, int] = {}
        parts = []  # (a known word or else a piece to encode, closing mark)
        for w, at in zip(words, bases.tolist()):
            mark = self.marks.get(w[-1])
            text = w.decode("utf-8")
            if mark is not None and text[:-1].isalpha():
                text = text[:-1]
            else:
                at, mark = -1, []
            parts.append((at, pieces.setdefault(text, len(pieces)) if at < 0 else 0, mark))
        got = [e.ids for e in self.tokenizer.encode_batch_fast(
            list(pieces), add_special_tokens=False)]
        return [(got[i] if at < 0 else self.ids[self.start[at]:self.start[at] + self.size[at]]
                 .tolist()) + mark for at, i, mark in parts]

    def _append(self, own: list[list[int]], keep: bool) -> None:
        """Write the words behind those known; without ``keep`` the next call overwrites them."""
        size = np.fromiter(map(len, own), np.int64, len(own))
        total = int(size.sum())
        if self.n_ids + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.n_ids + total))
        if self.n_words + len(own) > len(self.start):
            self.start = np.resize(self.start, 2 * (self.n_words + len(own)))
            self.size = np.resize(self.size, 2 * (self.n_words + len(own)))
        self.ids[self.n_ids:self.n_ids + total] = np.fromiter(
            chain.from_iterable(own), np.uint32, total)
        to = slice(self.n_words, self.n_words + len(own))
        self.size[to] = size
        self.start[to] = self.n_ids + np.cumsum(size) - size
        if keep:
            self.n_words += len(own)
            self.n_ids += total

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has (its end id included)."""
        raw, n = data.tobytes(), len(offsets) - 1
        low = tb.LOWER[data]
        at = raw.find(b"<|")
        while at >= 0:  # the strings of special tokens count only as they are written
            row = int(np.searchsorted(offsets, at, "right")) - 1
            low[offsets[row]:offsets[row + 1]] = data[offsets[row]:offsets[row + 1]]
            at = raw.find(b"<|", int(offsets[row + 1]))
        starts, ends, doc = tb.words(low, offsets, tb.PLAIN_WORD)
        prefix = tb.prefix_hash(low)
        hashed = tb.span_hash(prefix, starts, ends)
        which = self._find(hashed)
        miss = np.flatnonzero(which < 0)
        if len(miss):
            new, first, inverse = np.unique(hashed[miss], return_index=True, return_inverse=True)
            s, e = starts[miss[first]], ends[miss[first]]
            text = low.tobytes()
            own = self._encode([text[a:b] for a, b in zip(s.tolist(), e.tolist())],
                               self._find(tb.span_hash(prefix, s, e - 1)))
            which[miss] = self.n_words + inverse
            keep = self.n_words + len(new) <= CACHE_WORDS
            if keep:
                to = np.searchsorted(self.keys, new)
                self.keys = np.insert(self.keys, to, new)
                self.at = np.insert(self.at, to, self.n_words + np.arange(len(new)))
            self._append(own, keep)
        every = np.zeros(len(which) + n, np.int64)  # word 0 closes every text
        every[np.arange(len(which)) + doc] = which
        sizes = self.size[every]
        begin = np.cumsum(sizes) - sizes
        ids = self.ids[np.repeat(self.start[every] - begin, sizes)
                       + np.arange(int(sizes.sum()))]
        count = np.bincount(doc, minlength=n) + 1
        return ids, np.add.reduceat(sizes, np.cumsum(count) - count)


def _encoder(path: str, end_id: int) -> WordEncoder:
    key = (path, end_id)
    if key not in _workers:
        _workers[key] = WordEncoder(path, end_id)
    return _workers[key]


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = _encoder(path, end_id), TaskContext.get().partitionId(), 0
        for b in batches:
            texts = tb.text_array(b.column(1))
            for lo, hi in tb.slabs(texts):
                ids, n = encoder.encode(*tb.flat(texts.slice(lo, hi - lo)))
                begin = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(hi - lo, part, np.int64)),
                    pa.array(before + begin[:-1]),
                    b.column(0).slice(lo, hi - lo),
                    pa.array(n),
                    pa.Array.from_buffers(pa.large_binary(), hi - lo, [
                        None, pa.py_buffer((begin * 4).astype(np.int64)),
                        pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary()),
                ], names=["part", "before", "doc_id", "doc_tokens", "ids"])
                before += int(begin[-1])
    return run


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all texts: doc_id, start, length, ids (binary, little-endian 32-bit),
    doc_tokens, sequence_id, offset. Sequences hold exactly ``length`` ids but for the last.

    ``tokenizer_path`` names a ``tokenizers`` file whose words are independent (white space is
    dropped); every executor must have it.
    """
    spark = docs.sparkSession
    id_type = dict(docs.dtypes)[id_col]
    tokens = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        _tokenise(tokenizer_path, end_id),
        f"part long, before long, doc_id {id_type}, doc_tokens long, ids binary")
    path = scratch_path(spark, "tokens")
    tokens.write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema(tokens.schema).parquet(path)
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    # One line per task of the scan, so the window and the broadcast stay small at any size.
    offsets = totals.select("part", (F.sum("n").over(
        Window.orderBy("part")) - F.col("n")).alias("part_offset"))
    at = tokens.join(F.broadcast(offsets), "part").select(
        "doc_id", "doc_tokens", "ids", (F.col("part_offset") + F.col("before")).alias("g"))
    cut = at.select("*", F.explode(F.expr(
        f"sequence(g div {length}, (g + doc_tokens - 1) div {length})")).alias("sequence_id"))
    cut = cut.withColumn("start", F.greatest(F.col("sequence_id") * length - F.col("g"), F.lit(0)))
    cut = cut.withColumn("length", F.least(
        F.col("doc_tokens"), (F.col("sequence_id") + 1) * length - F.col("g")) - F.col("start"))
    return cut.select(
        "doc_id", F.col("start").cast("long"), F.col("length").cast("long"),
        F.expr("substring(ids, int(start * 4 + 1), int(length * 4))").alias("ids"),
        "doc_tokens", "sequence_id",
        (F.col("g") + F.col("start") - F.col("sequence_id") * length).cast("long").alias("offset"))


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id, ids (binary, padded to ``length`` ids, unless their
    number is a power of two), n_tokens. A group holds at most ``length`` ids."""
    joined = pieces.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"),
        F.sum("length").alias("n_tokens"))
    ids = F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))")
    pad = int(pad_id).to_bytes(4, "little").hex()
    padding = F.unhex(F.expr(f"repeat('{pad}', int({length} - n_tokens))"))
    whole = (F.col("n_tokens") >= length) | (F.expr("n_tokens & (n_tokens - 1)") == 0)
    return joined.select("sequence_id", F.when(whole, ids).otherwise(
        F.concat(ids, padding)).alias("ids"), "n_tokens")
