"""Alignment of two tokenizers' tokens by the bytes they stand for.

The first tokenizer (``tokenizers``, byte-level BPE) reads a space and the text, the second one
(``sentencepiece``, BPE with byte fallback, which adds the space itself) the text. The character
offsets of the first and the spans of the second's protobuf result are the coarse cuts; where
several tokens share a character, and at byte-fallback pieces, whose spans are empty, the decoded
bytes of the tokens say where each ends. Byte offsets where tokens of both end cut the text into
groups, whose tokens are linked each to each.

Both tokenizers cut before a single space between two characters that are not white space: the
first by its splitting pattern, the second because no piece goes on after a space (checked when it
is loaded). A text is therefore taken apart there, and what such a part gives is computed once and
kept by each task.

How many texts link a pair of ids is counted in the tasks first. The most frequent pairs, a fixed
number, go to all tasks, where nearly all links find their count; the links of other pairs travel to
their counts by a join, in which no pair is frequent.

Defined cases: null and empty texts, and texts whose tokens do not give back the space and the text,
have no tokens: zeros and an empty ``groups``; a null id is a row like others; repeated rows count
as texts of their own; an empty table gives no rows. The input may have any further columns.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from veracell.functions.session import cut_lineage
from veracell.llm import textbatch as tb

#: Pairs whose counts every task holds.
COMMON = 1 << 19
#: Characters worked through at once, and those that a task keeps the results of.
PIECE = 1 << 20
KEPT_UNITS = 500_000
KEPT_CHARS = 1 << 23
_SPLIT = re.compile(r" (?=\S)(?<!\s )")


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 characters
    stand for themselves, the other bytes take the characters from 256 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(c): b for c, b in zip(own + [256 + i for i in range(len(other))], own + other)}


class Aligner:
    """Parts of texts with their tokens and groups, each computed once."""

    def __init__(self, a_path: str, b_path: str):
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        n_a = self.a.get_vocab_size()
        self.a_bytes = [b""] * n_a
        for t, i in self.a.get_vocab(with_added_tokens=False).items():
            if all(c in alphabet for c in t):
                self.a_bytes[i] = bytes(alphabet[c] for c in t)
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.n_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_byte = np.array([self.b.is_byte(i) for i in range(self.n_b)])
        #: Ids as text with what follows inside and at the end of their side of a group.
        self.a_text = np.array([[f"{i}{c}" for i in range(n_a)] for c in ",|"], object)
        self.b_text = np.array([[f"{i}{c}" for i in range(self.n_b)] for c in ",;"], object)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode()
                        for p, is_byte in zip(pieces, self.b_byte)]
        #: Whether a space always begins a piece, so that texts may be cut before it.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.chars = 0
        self.facts = np.zeros((1024, 5), np.int64)  # tokens of a, of b, groups, links, failed
        #: Where the pairs of each part begin; the pairs of all parts and how often each is linked.
        self.cut = np.zeros(1025, np.int64)
        self.links = np.zeros((2, 1 << 14), np.int64)

    def a_ends(self, text: str, ids: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
        """Where the first tokenizer's tokens end, in bytes of ``text`` (the space included)."""
        spans = np.fromiter(chain.from_iterable(offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
        if text.isascii():
            coarse = spans[:, 1]
        else:
            c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            coarse = np.concatenate([[0], np.cumsum(
                1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))])[spans[:, 1]]
        shared = np.append(spans[1:, 0] < spans[:-1, 1], False)
        return _refined(coarse, ~shared, self.a_size[ids])

    def b_ends(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The same of the second tokenizer; its spans leave out the space that it adds."""
        return _refined(ends + 1, ~self.b_byte[ids], np.ones(len(ids), np.int64))

    def _learn(self, parts: list[str]) -> None:
        """Work out new parts, many at once: put together with spaces they stay apart, but for
        those that begin or end with white space."""
        held, size = [], 0
        for part in parts:
            if not self.cuts or part != part.strip():
                self._take([part])
            else:
                held.append(part)
                size += len(part) + 1
                if size > 1 << 17:
                    self._take(held)
                    held, size = [], 0
        if held:
            self._take(held)

    def _take(self, parts: list[str]) -> None:
        part = " ".join(parts)
        text = " " + part
        want = text.encode()
        enc = self.a.encode(text, add_special_tokens=False)
        proto = self.b.encode(part, return_type="proto", num_threads=1).pieces
        a = np.array(enc.ids, np.int64)
        b = np.array([x.id for x in proto], np.int64)
        known = b"".join(map(self.a_bytes.__getitem__, a.tolist())) == want and b"".join(
            map(self.b_bytes.__getitem__, b.tolist())) == want
        if known:
            ends_a = self.a_ends(text, a, enc.offsets)
            ends_b = self.b_ends(b, np.array([x.end for x in proto], np.int64))
            known = ends_a[-1] == ends_b[-1] == len(want)
        if known:
            size = np.array([1 + len(x.encode()) for x in parts])
            self._groups(parts, np.cumsum(size), a, ends_a, b, ends_b)
        elif len(parts) > 1:
            for x in parts:
                self._take([x])
        else:
            self._keep(parts, np.array([[0, 0, 0, 0, 1]]), [""], np.zeros(2, np.int64),
                       np.zeros((2, 0), np.int64))

    def _keep(self, parts, facts, groups, cut, links) -> None:
        """Add parts with their facts, groups as text, and pairs (``cut`` says where they begin)."""
        i, n = len(self.groups), len(parts)
        while i + n > len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
            self.cut = np.concatenate([self.cut, np.zeros_like(self.cut[1:])])
        self.at.update(zip(parts, range(i, i + n)))
        self.chars += sum(map(len, parts))
        self.facts[i:i + n] = facts
        self.groups.extend(groups)
        lo = int(self.cut[i])
        hi = lo + links.shape[1]
        while hi > self.links.shape[1]:
            self.links = np.concatenate([self.links, np.zeros_like(self.links)], 1)
        self.links[:, lo:hi] = links
        self.cut[i + 1:i + n + 1] = lo + cut[1:]

    def _groups(self, parts, part_ends, a, ends_a, b, ends_b) -> None:
        """Cut parts into groups and link the tokens of each."""
        n = len(parts)
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        ga, gb = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        na, nb = np.bincount(ga, minlength=len(cuts)), np.bincount(gb, minlength=len(cuts))
        of = np.searchsorted(part_ends, cuts)  # the part of each group
        facts = np.zeros((n, 5), np.int64)
        for k, x in enumerate((na, nb, np.ones(len(cuts)), na * nb)):
            facts[:, k] = np.bincount(of, x, n).astype(np.int64)
        # The groups as text: tokens in order, each with what follows it.
        before_a, before_b = np.cumsum(na) - na, np.cumsum(nb) - nb
        order_a = np.arange(len(a)) + before_b[ga]
        order_b = np.arange(len(b)) + (before_a + na)[gb]
        words = np.empty(len(a) + len(b), object)
        words[order_a] = self.a_text[np.where(np.append(ga[1:] == ga[:-1], False), 0, 1), a]
        words[order_b] = self.b_text[np.where(np.append(gb[1:] == gb[:-1], False), 0, 1), b]
        ends = np.cumsum(facts[:, 0] + facts[:, 1]).tolist()
        words, start, texts = words.tolist(), 0, []
        for end in ends:
            texts.append("".join(words[start:end])[:-1])
            start = end
        held, sizes = [], []
        # Some groups at once, so that the pairs of few large ones do not come together.
        total = np.cumsum(na * nb)
        lo = 0
        while lo < len(cuts):
            base = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, base + (1 << 20), "right")))
            held.append(_linked(of[lo:hi], before_a[lo:hi], na[lo:hi], before_b[lo:hi],
                                nb[lo:hi], a, b, self.n_b))
            lo = hi
        part, pair, times = map(np.concatenate, zip(*held))
        if len(held) > 1:
            part, pair, times = _summed_pairs(part, pair, times)
        cut = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=n))])
        self._keep(parts, facts, texts, cut, np.stack([pair, times]))

    def make_room(self) -> None:
        if len(self.groups) > KEPT_UNITS or self.chars > KEPT_CHARS:
            self.clear()

    def look_up(self, parts: list[str]) -> np.ndarray:
        new = [p for p in dict.fromkeys(parts) if p not in self.at]
        if new:
            self._learn(new)
        return np.fromiter(map(self.at.__getitem__, parts), np.int64, len(parts))

    def segments(self, text: str, piece: int) -> Iterator[list[str]]:
        """The parts of a text, some ``piece`` characters together; each is meant with a space
        before it."""
        whole, at = " " + text, 0
        while at < len(whole):
            found = _SPLIT.search(whole, at + piece) if self.cuts and at + piece < len(
                whole) else None
            to = found.start() if found else len(whole)
            parts = _SPLIT.split(whole[at:to]) if self.cuts else [whole[at:to]]
            # A segment begins with a space: what is before it is empty, unless white space follows.
            parts = parts[1:] if not parts[0] else [parts[0][1:], *parts[1:]]
            yield parts
            at = to


def _refined(coarse: np.ndarray, sure: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ends of tokens: the coarse ones where they are sure, beyond those by the tokens' bytes."""
    last = np.maximum.accumulate(np.where(sure, np.arange(len(sure)), -1))
    run = np.concatenate([[0], np.cumsum(size)])
    base = np.where(last >= 0, coarse[np.maximum(last, 0)], 0)
    return base + run[1:] - run[last + 1]


def _linked(of, first_a, na, first_b, nb, a, b, n_b):
    """(part, pair, times): the linked pairs of some groups, sorted."""
    if len(of) == 1:  # perhaps a very large one: ids first, then pairs
        ua, ca = np.unique(a[first_a[0]:first_a[0] + na[0]], return_counts=True)
        ub, cb = np.unique(b[first_b[0]:first_b[0] + nb[0]], return_counts=True)
        pair = (ua[:, None] * n_b + ub).ravel()
        return np.full(len(pair), of[0]), pair, (ca[:, None] * cb).ravel()
    each = na * nb
    g = np.repeat(np.arange(len(of)), each)
    k = np.arange(len(g)) - np.repeat(np.cumsum(each) - each, each)
    pair = a[first_a[g] + k // nb[g]] * n_b + b[first_b[g] + k % nb[g]]
    return _summed_pairs(of[g], pair, np.ones(len(g), np.int64))


def _summed_pairs(part, pair, times):
    """Equal (part, pair) once, sorted, with the sums of their times."""
    if int(pair.max(initial=0)) < 1 << 32 and int(part.max(initial=0)) < 1 << 31:
        order = np.argsort((part << 32) | pair)
    else:
        order = np.lexsort((pair, part))
    part, pair, times = part[order], pair[order], times[order]
    first = np.flatnonzero(np.concatenate(
        [[True], (part[1:] != part[:-1]) | (pair[1:] != pair[:-1])]))
    return part[first], pair[first], np.add.reduceat(times, first)


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    if not len(keys):
        return keys, weights
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights, first)


def _ragged(of: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all values of the rows ``of``, and which of them each belongs to."""
    size = cut[of + 1] - cut[of]
    row = np.repeat(np.arange(len(of)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(
        cut[of], size)


@lru_cache(maxsize=2)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _text_facts(al: Aligner, text: str, piece: int):
    """(facts, groups, pairs, times) of one long text, part by part."""
    facts, groups = np.zeros(5, np.int64), []
    pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for parts in al.segments(text, piece):
        al.make_room()
        at = al.look_up(parts)
        facts += al.facts[at].sum(0)
        if facts[4]:
            return np.zeros(5, np.int64), "", pairs[:0], times[:0]
        groups.append(";".join([al.groups[i] for i in at.tolist()]))
        unit, n = np.unique(at, return_counts=True)
        row, where = _ragged(unit, al.cut)
        p, t = al.links[:, where]
        pairs, times = summed(np.concatenate([pairs, p]), np.concatenate([times, t * n[row]]))
    return facts, ";".join(groups), pairs, times


def _facts(al: Aligner, texts: list[str], piece: int) -> list[tuple]:
    """The same of some texts of together about ``piece`` characters at once."""
    if len(texts) == 1 and len(texts[0]) > piece:
        return [_text_facts(al, texts[0], piece)]
    al.make_room()
    parts = [next(al.segments(t, 2 * piece + 2)) if t else [] for t in texts]
    size = np.array([len(p) for p in parts])
    at = al.look_up(list(chain.from_iterable(parts)))
    doc = np.repeat(np.arange(len(texts)), size)
    facts = np.stack([np.bincount(doc, al.facts[at, c], len(texts)) for c in range(5)], 1).astype(
        np.int64)
    failed = facts[:, 4] > 0
    facts[failed] = 0
    ends = np.cumsum(size)
    names, start, groups = [al.groups[i] for i in at.tolist()], 0, []
    for end, bad in zip(ends.tolist(), failed.tolist()):
        groups.append("" if bad else ";".join(names[start:end]))
        start = end
    use = ~failed[doc]
    key, n = np.unique(doc[use] * np.int64(len(al.groups)) + at[use], return_counts=True)
    owner, unit = np.divmod(key, np.int64(len(al.groups) or 1))
    row, where = _ragged(unit, al.cut)
    pair, times = al.links[:, where]
    if len(pair):
        owner, pair, times = _summed_pairs(owner[row], pair, times * n[row])
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [(facts[i], groups[i], pair[cut[i]:cut[i + 1]], times[cut[i]:cut[i + 1]])
            for i in range(len(texts))]


SCHEMA = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, " \
         "times array<long>"


def token_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id",
                 text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """Each text's alignment: doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``),
    pairs (a's id times the size of b's vocabulary plus b's id) and how often each is linked."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = _aligner(a_path, b_path)

        def give(ids, held):
            counts = np.array([h[0][:4] for h in held]).reshape(-1, 4)

            def lists(k):
                cut = np.concatenate([[0], np.cumsum([len(h[k]) for h in held])])
                return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)),
                                                pa.array(np.concatenate([h[k] for h in held])))
            return pa.RecordBatch.from_arrays(
                [ids, *(pa.array(counts[:, c]) for c in range(4)),
                 pa.array([h[1] for h in held], pa.string()), lists(2), lists(3)],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

        for b in batches:
            for lo, hi in tb.slabs(tb.text_array(b.column(1)), piece):
                texts = [t or "" for t in b.column(1).slice(lo, hi - lo).to_pylist()]
                yield give(b.column(0).slice(lo, hi - lo), _facts(al, texts, piece))
        tb.hand_back()

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): in how many rows a pair is linked; counted in tasks before they are added up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def give():
            return pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["pair", "n"])
        for b in batches:
            p = b.column(0).flatten().to_numpy()
            for lo in range(0, len(p), 1 << 21):
                q = p[lo:lo + (1 << 21)]
                held = summed(np.concatenate([held[0], q]),
                              np.concatenate([held[1], np.ones(len(q), np.int64)]))
                if len(held[0]) > 1 << 20:
                    yield give()
                    held = (held[0][:0], held[1][:0])
        yield give()
        tb.hand_back()

    return aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(
        F.sum("n").alias("n"))


def link_counts(aligned: DataFrame, n_b: int, common: int = COMMON) -> DataFrame:
    """The rows of a written alignment with n_best (links whose count is the highest of their first
    id) and count_sum (the counts of all links added up) in place of pairs and times."""
    spark = aligned.sparkSession
    rows = aligned.withColumn("__pos", F.monotonically_increasing_id())
    first_id = Window.partitionBy(F.expr(f"pair div {n_b}"))
    counts = cut_lineage(pair_counts(aligned).withColumn(
        "best", F.col("n") == F.max("n").over(first_id)))
    # At most ``common`` lines.
    top = counts.orderBy(F.desc("n"), "pair").limit(common).toArrow()
    order = np.argsort(top.column("pair").to_numpy())
    held = spark.sparkContext.broadcast(tuple(
        top.column(c).to_numpy()[order] for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = held.value
        for b in batches:
            lists, times = b.column("pairs"), b.column("times").flatten().to_numpy()
            size = np.diff(lists.offsets.to_numpy())
            row, p = np.repeat(np.arange(b.num_rows), size), lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, p), max(len(pair) - 1, 0))
            hit = pair[at] == p if len(pair) else np.zeros(len(p), bool)
            sums = np.zeros((2, b.num_rows), np.int64)
            np.add.at(sums[0], row[hit], times[hit] * best[at[hit]])
            np.add.at(sums[1], row[hit], times[hit] * n[at[hit]])
            cut = pa.array(np.concatenate([[0], np.cumsum(np.bincount(
                row[~hit], minlength=b.num_rows))]).astype(np.int32))
            out = [b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays([
                *out[:-3], out[-1], pa.array(sums[0]), pa.array(sums[1]),
                pa.ListArray.from_arrays(cut, pa.array(p[~hit])),
                pa.ListArray.from_arrays(cut, pa.array(times[~hit]))],
                [*b.schema.names[:-3], "__pos", "n_best", "count_sum", "pairs", "times"])
        tb.hand_back()

    own = [c for c in aligned.columns if c not in ("pairs", "times")]
    kinds = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in own)
    rows = cut_lineage(rows.select(*own, "pairs", "times", "__pos").mapInArrow(
        run, f"{kinds}, __pos long, n_best long, count_sum long, pairs array<long>, "
             "times array<long>"))
    out = [*own, "n_best", "count_sum"]
    open_ = rows.where(F.size("pairs") > 0)
    found = open_.select("__pos", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select(
        "__pos", F.col("l.pairs").alias("pair"), F.col("l.times").alias("t")).join(
        counts, "pair").groupBy("__pos").agg(
        F.sum(F.col("t") * F.col("best").cast("long")).alias("more_best"),
        F.sum(F.col("t") * F.col("n")).alias("more_sum"))
    joined = open_.join(found, "__pos").select(
        *own, (F.col("n_best") + F.col("more_best")).alias("n_best"),
        (F.col("count_sum") + F.col("more_sum")).alias("count_sum"))
    return rows.where(F.size("pairs") == 0).select(*out).unionByName(joined)


def alignment_digest(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id",
                     text_col: str = "text", common: int = COMMON) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every row."""
    aligned = token_groups(docs, a_path, b_path, id_col, text_col)
    aligned = cut_lineage(aligned.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"),
        "pairs", "times"))
    size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    return link_counts(aligned, size, common)
