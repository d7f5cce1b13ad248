"""Benchmark decontamination: MinHash containment search, partitioned by size.

Every test item is a set of 5-word shingles. Items are partitioned by set size; the size fixes the
length of their sketch: the bottom shingles in a minwise order, one more than a document may lack
at the threshold. A document that holds the threshold's share of an item therefore holds at least
one sketch entry, however long it is, so candidates lose nothing; they are verified by the exact
share of the item's shingles. Items are handed to the tasks in blocks of bounded size, one scan of
the documents per block.

Defined cases: items and texts that are null or without words match nothing; an item of fewer than
five words is one shingle and matches only a text that is that sequence; repeated rows on either
side give a line each; empty tables give no lines.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veracell.functions.session import cut_lineage
from veracell.llm import textbatch as tb

#: Shingles of the items that one scan carries to every task (16 MB).
BLOCK_SHINGLES = 2_000_000
_BITS = 22


def item_sets(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for _, s, _ in tb.shingle_sets(tb.text_array(b.column(1)))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["item_id", "shingles"])

    return items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string")).mapInArrow(
        run, f"item_id {dict(items.dtypes)[id_col]}, shingles array<long>")


def sketch_length(n: int, percent: int) -> int:
    """How many minwise entries an item of n shingles needs: one more than a match may lack."""
    return n - (-(-percent * n // 100)) + 1


class Block:
    """Items of one block, their sketches in one sorted index."""

    def __init__(self, rows, percent: int):
        self.ids = [r[0] for r in rows]
        self.sets = [np.asarray(r[1], np.int64).view(np.uint64) for r in rows]
        self.percent = percent
        keys, owner = [], []
        for i, s in enumerate(self.sets):
            order = np.argsort(tb.mix64(s), kind="stable")  # the minwise order
            entries = s[order[:sketch_length(len(s), percent)]]
            keys.append(entries)
            owner.append(np.full(len(entries), i))
        keys, owner = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, shingles: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared shingles) of one slab; shingles are in order of their texts."""
        maybe = np.flatnonzero(self.seen[(shingles >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(maybe):
            return
        lo = np.searchsorted(self.keys, shingles[maybe])
        hi = np.searchsorted(self.keys, shingles[maybe], "right")
        hit = hi > lo
        maybe, lo, hi = maybe[hit], lo[hit], hi[hit]
        pairs = np.unique(np.concatenate([
            np.stack([np.repeat(doc[maybe], hi - lo), self.owner[
                np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo)
                + np.arange(int((hi - lo).sum()))]], 1),
            np.zeros((0, 2), np.int64)]), axis=0)
        mine, have = -1, None
        for r, i in pairs.tolist():
            if r != mine:
                a, b = np.searchsorted(doc, [r, r + 1])
                mine, have = r, np.unique(shingles[a:b])
            s = self.sets[i]
            at = np.minimum(np.searchsorted(have, s), len(have) - 1)
            shared = int((have[at] == s).sum())
            if 100 * shared >= self.percent * len(s):
                yield r, i, shared


def item_blocks(items: DataFrame, percent: int, id_col: str, text_col: str) -> Iterator[list]:
    """The items with their shingles, in blocks of about BLOCK_SHINGLES, by size in each."""
    sets = cut_lineage(item_sets(items, id_col, text_col).where(
        F.size("shingles") > 0).withColumn("n", F.size("shingles")))
    size = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_SHINGLES))
    for k in range(blocks):
        mine = sets.where(F.pmod(F.xxhash64("item_id", "n"), F.lit(blocks)) == k)
        rows = mine.orderBy("n").select("item_id", "shingles").collect()
        if rows:
            yield rows


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 75,
                    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                    item_text_col: str = "text") -> DataFrame:
    """item_id, doc_id, n_item, n_shared, containment of all pairs at ``percent`` or more."""
    kinds = f"item_id {dict(items.dtypes)[item_id_col]}, doc_id {dict(docs.dtypes)[id_col]}, " \
            "n_item long, n_shared long"
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string"))
    out = docs.sparkSession.createDataFrame([], kinds)
    for rows in item_blocks(items, percent, item_id_col, item_text_col):
        out = out.unionByName(narrow.mapInArrow(_search(Block(rows, percent)), kinds))
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def _shingled(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = tb.flat(texts)
    low = tb.LOWER[data]
    starts, ends, doc = tb.words(low, offsets, tb.PLAIN_WORD)
    return tb.shingle_hashes(tb.span_hash(tb.prefix_hash(low), starts, ends), doc, len(texts))


def _search(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = tb.text_array(b.column(1))
            for lo, hi in tb.slabs(texts):
                found = list(block.find(*_shingled(texts.slice(lo, hi - lo))))
                if found:
                    rows, which, shared = map(list, zip(*found))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([block.ids[i] for i in which]),
                        b.column(0).slice(lo, hi - lo).take(pa.array(rows)),
                        pa.array([len(block.sets[i]) for i in which], pa.int64()),
                        pa.array(shared, pa.int64())],
                        names=["item_id", "doc_id", "n_item", "n_shared"])
    return run


def without_items(docs: DataFrame, items: DataFrame, percent: int = 75, text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows that hold no item at ``percent`` or more; one scan per block, no shuffle."""
    out = docs
    for rows in item_blocks(items, percent, item_id_col, item_text_col):
        out = out.where(~_holds(Block(rows, percent))(F.col(text_col).cast("string")))
    return out


def _holds(block: Block):
    @F.arrow_udf("boolean")
    def holds(column: pa.Array) -> pa.Array:
        texts = tb.text_array(column)
        out = np.zeros(len(texts), bool)
        for lo, hi in tb.slabs(texts):
            for row, _, _ in block.find(*_shingled(texts.slice(lo, hi - lo))):
                out[lo + row] = True
        return pa.array(out)
    return holds
