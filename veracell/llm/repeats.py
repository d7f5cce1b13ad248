"""Removal of repeated byte strings through Burrows-Wheeler steps over anchored suffixes.

Every 400-byte window has an anchor, the 48-byte string with the smallest hash inside it, so
equal windows have equal anchors at equal places. Only anchors found at two places or more can
belong to repeats; their surroundings are brought together by anchor, from all shards of the
input. Within an anchor the suffixes that begin at the anchor are ordered once; all suffixes that
begin before it are never sorted: as in the merging of Burrows-Wheeler transforms, each pass
refines the interleave of the occurrences by the byte that precedes them (a stable distribution of
the present order), and the common prefixes follow from those of the pass before. After pass d the
order is that of the suffixes d bytes before the anchor; where the common prefix with a neighbour
reaches 400, a repeated interval begins. Occurrences that cannot reach 400 any more leave.

Surroundings that are equal as a whole settle each other when they are counted; only one of each
goes on to be ordered. An anchor that still has more different surroundings than one task should
hold is split by longer anchors: its windows are put into classes of 32, then 4, then single ones by
their distance from the anchor, and the bytes that all windows of a class share become the anchor.
At single windows equal surroundings are equal windows, so nothing is left to be ordered.

What a text sends is one line for each bucket of keys, which the lines of the repeated keys of that
bucket precede in a sorted stream; a key that very many texts hold is one entry there.

Texts are compared once each: equal texts are collapsed by a 128-bit fingerprint, and a text of 400
bytes or more that several rows have is removed whole in all of them. Long texts are worked through
in overlapping pieces.

Defined cases: a null text is empty; texts under 400 bytes are kept; repeated rows are copies of
each other; an empty table gives no rows; extra columns may have any names.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veracell.functions.joins import join_group_facts
from veracell.functions.session import cut_lineage, forget_shuffles
from veracell.llm import textbatch as tb
from veracell.llm.near_duplicates import Groups

LENGTH = 400
GRAM = 48
_PLACE_BITS = np.uint64(28)
#: Occurrences that one refinement takes at once, and rows of a slab inside it.
TOGETHER = 30_000
SLAB_ROWS = 4096
#: Different surroundings of one anchor beyond which it is split by longer anchors, and the windows
#: of a class at each turn.
HOT_ANCHOR = 30_000
WIDTHS = (32, 4, 1)
#: Bytes of a text that are searched for anchors at once.
PIECE = 1 << 20
_FAR = -(1 << 30)
#: A passage that documents share has over 50 words; bytes are repeated from ``LENGTH`` on.
PASSAGE_WORDS = 51
WORD_GRAM = 16
_NEVER = 1 << 62


def text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(3), text).alias("h1"), F.xxhash64(F.lit(5), text).alias("h2"))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(key, text, place, first and last window start that the anchor serves), places in slab."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.view(np.uint64), none, none, none, none
    width = length - gram + 1
    prefix = tb.prefix_hash(data)
    n = len(data) - gram + 1
    keys = tb.mix64((prefix[gram:] - prefix[:-gram]) * tb._inverse[:n])
    ranked = (keys & ~((np.uint64(1) << _PLACE_BITS) - np.uint64(1))) | np.arange(
        n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = ranked
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - width + 1
    least = np.minimum(after[:starts], before[width - 1:width - 1 + starts])
    # Window starts whose window ends in their own text.
    doc = np.repeat(np.arange(len(offsets) - 1), np.maximum(0, np.diff(offsets) - length + 1))
    count = np.maximum(0, np.diff(offsets) - length + 1)
    p = offsets[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    if not len(p):
        return none.view(np.uint64), none, none, none, none
    at = (least[p] & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    return keys[at[first]], doc[first], at[first], p[first], p[last]


def _surroundings(prefix, at: np.ndarray, first: np.ndarray, last: np.ndarray, length: int):
    """A fingerprint of the bytes around each anchor and of where in them it is."""
    layout = (at - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64)
    return tb.mix64(tb.span_hash(prefix, first, last + length) ^ tb.mix64(layout + np.uint64(1)))


def _found_anchors(length: int, gram: int, piece: int = PIECE, words: bool = False):
    """(row, key, surroundings, place, first, last) of all anchors of a batch, some at a time;
    lengths and places are in words if ``words``, else in bytes."""
    def run(b: pa.RecordBatch):
        texts = tb.text_array(b.column(2))
        for lo, hi in tb.slabs(texts):
            data, offsets = tb.flat(texts.slice(lo, hi - lo))
            if words:
                data, offsets = tb.word_hashes(data, offsets)
            if hi - lo > 1 or len(data) <= piece:
                key, doc, at, first, last = anchors(data, offsets, length, gram)
                f = _surroundings(tb.prefix_hash(data), at, first, last, length)
                begin = offsets[doc]
                yield lo + doc, key, f, at - begin, first - begin, last - begin
                continue
            # One long text: windows that begin in this piece; an anchor that goes on in the next
            # piece waits for it.
            held = None
            for start in range(0, len(data) - length + 1, piece):
                end = min(start + piece + length - 1, len(data))
                key, _, at, first, last = anchors(
                    data[start:end], np.array([0, end - start]), length, gram)
                at, first, last = at + start, first + start, last + start
                if held is not None:
                    if len(at) and held[1] == at[0]:
                        first[0] = held[2]
                    else:
                        key, at, first, last = (np.concatenate([[h], x]).astype(x.dtype)
                                                for h, x in zip(held, (key, at, first, last)))
                held = None
                if end < len(data):
                    held = key[-1], at[-1], first[-1], last[-1]
                    key, at, first, last = key[:-1], at[:-1], first[:-1], last[:-1]
                if len(key):
                    base = int(first[0])
                    f = _surroundings(tb.prefix_hash(data[base:end]), at - base, first - base,
                                      last - base, length)
                    yield np.full(len(key), lo), key, f, at, first, last
    return run


def _split_anchors(length: int, width: int):
    """The same for the anchors that lines of texts name, split into classes of windows."""
    def run(b: pa.RecordBatch):
        texts, named = tb.text_array(b.column(2)), b.column(3)
        count = np.diff(named.offsets.to_numpy())
        cut = np.concatenate([[0], np.cumsum(count)])
        flat = named.flatten()
        all_key, *rest = (flat.field(i).to_numpy() for i in range(4))
        all_at, all_first, all_last = (x.astype(np.int64) for x in rest)
        for r in range(b.num_rows):
            data, _ = tb.flat(texts.slice(r, 1))
            for i in range(cut[r], cut[r + 1], 1024):
                w = slice(i, min(i + 1024, cut[r + 1]))
                key, at, first, last = (x[w] for x in (all_key, all_at, all_first, all_last))
                near, far = (at - last) // width, (at - first) // width
                of = np.repeat(np.arange(len(at)), far - near + 1)
                c = np.arange(len(of)) - np.repeat(np.cumsum(far - near + 1) - (
                    far - near + 1), far - near + 1) + near[of]
                place = at[of] - c * width
                a = np.maximum(first[of], place - width + 1)
                z = np.minimum(last[of], place)
                base, end = int(first.min()), int(last.max()) + length
                prefix = tb.prefix_hash(data[base:end])
                core = tb.span_hash(prefix, place - base, place - width + 1 + length - base)
                new = tb.mix64(key[of].astype(np.uint64) + tb.mix64(
                    c.astype(np.uint64) + np.uint64(77))) ^ core
                yield (np.full(len(of), r), new, _surroundings(
                    prefix, place - base, a - base, z - base, length), place, a, z)
    return run


def _flat_rows(find, mark):
    """One row per anchor, for counting: its key, its surroundings and which place it is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for row, key, f, place, _, _ in find(b):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(f.view(np.int64)),
                     pa.array(mark(h1[row], h2[row], place))], names=["key", "f", "m"])
    return run


def _rows_of_lines(mark):
    """The same of lines that are written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, f, place = (b.column(i) for i in (4, 5, 6))
            row = np.repeat(np.arange(b.num_rows), np.diff(key.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays(
                [key.flatten(), f.flatten(), pa.array(mark(
                    b.column(2).to_numpy()[row], b.column(3).to_numpy()[row],
                    place.flatten().to_numpy().astype(np.int64)))], names=["key", "f", "m"])
    return run


_ENTRY = ("bucket", "kind", "h1", "h2", "key", "f", "place", "first", "last")
ENTRY = "bucket long, kind int, h1 long, h2 long, key array<long>, f array<long>, " \
        "place array<int>, first array<int>, last array<int>"


def _packed(find, buckets: int):
    """One line per text and bucket of keys, with all anchors of that bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, key, f, place, first, last in find(b):
                if not len(row):
                    continue
                key = key.view(np.int64)
                bucket = np.mod(key, buckets)
                by = np.lexsort((bucket, row))
                r, k = row[by], bucket[by]
                head = np.flatnonzero(np.concatenate(
                    [[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])]))
                cut = pa.array(np.append(head, len(by)).astype(np.int32))
                rows = pa.array(r[head])

                def lists(x, kind):
                    return pa.ListArray.from_arrays(cut, pa.array(x[by], kind))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k[head]), pa.array(np.ones(len(head), np.int32)),
                     b.column(0).take(rows), b.column(1).take(rows), lists(key, pa.int64()),
                     lists(f.view(np.int64), pa.int64()), lists(place.astype(np.int32), pa.int32()),
                     lists(first.astype(np.int32), pa.int32()),
                     lists(last.astype(np.int32), pa.int32())], names=list(_ENTRY))
    return run


#: What becomes of an anchor: its windows are repeated, it is ordered with others, or split.
SETTLED, ORDERED, SPLIT = 0, 1, 2


def _sorted_out(hot: int, mark):
    """Streams of a bucket: what was counted of its keys, then the lines of texts, of which the
    anchors that matter are left, with what becomes of them."""
    def flat(b: pa.RecordBatch, name: str) -> np.ndarray:
        return b.column(_ENTRY.index(name)).flatten().to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, many, several = -1, [], None, None
        for batch in batches:
            code = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            cut = np.append(np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])),
                            len(code)) if len(code) else np.zeros(1, np.int64)
            for lo, hi in zip(cut[:-1], cut[1:]):
                b = batch.slice(int(lo), int(hi - lo))
                bucket, kind = int(code[lo]) >> 1, int(code[lo]) & 1
                if bucket != now:
                    now, held, many = bucket, [], None
                if kind == 0:
                    held.append(b)
                    continue
                if many is None:
                    many, several = _counted(held, flat)
                yield from _judge(b, flat, many, several, hot, mark)
    return run


def _counted(held: list[pa.RecordBatch], flat):
    """(key, f, first of them) of surroundings found twice, and (key, how many) of keys with
    several; both sorted."""
    none = np.zeros(0, np.int64)
    if not held:
        return (none, none, none), (none, none)
    key = np.concatenate([flat(b, "key") for b in held])
    f = np.concatenate([flat(b, "f") for b in held])
    a = np.concatenate([b.column(2).to_numpy() for b in held])
    n = np.concatenate([b.column(3).to_numpy() for b in held])
    twice, keys = n == 0, n > 0
    by = np.argsort(_both(key[twice], f[twice]), kind="stable")
    order = np.argsort(key[keys], kind="stable")
    return tuple(x[twice][by] for x in (key, f, a)), (key[keys][order], n[keys][order])


def _both(key: np.ndarray, f: np.ndarray) -> np.ndarray:
    return tb.mix64(key.astype(np.uint64) ^ tb.mix64(f.astype(np.uint64)))


def _mark(h1, h2, place) -> np.ndarray:
    """One number for a place in a text."""
    return tb.mix64(tb.mix64(h1.astype(np.uint64) ^ tb.mix64(h2.astype(np.uint64))) + place.astype(
        np.uint64)).view(np.int64)


def _mark_of_text(h1, h2, place) -> np.ndarray:
    """One number for a text, whatever the place."""
    return _mark(h1, h2, np.zeros_like(place))


def _judge(b: pa.RecordBatch, flat, many, several, hot: int, mark) -> Iterator[pa.RecordBatch]:
    key, f, place, first, last = (flat(b, c) for c in _ENTRY[4:])
    count = np.diff(b.column(4).offsets.to_numpy())
    row = np.repeat(np.arange(b.num_rows), count)
    own = mark(b.column(2).to_numpy()[row], b.column(3).to_numpy()[row], place)
    what = np.full(len(key), -1, np.int8)
    two, first_mark = np.zeros(len(key), bool), np.zeros(len(key), bool)
    if len(many[0]):
        pairs = _both(many[0], many[1])
        at = np.minimum(np.searchsorted(pairs, _both(key, f)), len(pairs) - 1)
        two = (many[0][at] == key) & (many[1][at] == f)
        first_mark = two & (many[2][at] == own)
    if len(several[0]):
        at = np.minimum(np.searchsorted(several[0], key), len(several[0]) - 1)
        group = several[0][at] == key
        go = group & (~two | first_mark)
        what[go] = np.where(several[1][at[go]] > hot, SPLIT, ORDERED)
    yield from _named(b, row, key, place, first, last, what, what >= 0)
    yield from _named(b, row, key, place, first, last, np.full(len(key), SETTLED, np.int8), two)


def _named(b, row, key, place, first, last, what, use) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(use)
    if not len(at):
        return
    n = np.bincount(row[at], minlength=b.num_rows)
    some = np.flatnonzero(n)
    cut = pa.array(np.concatenate([[0], np.cumsum(n[some])]).astype(np.int32))
    found = pa.StructArray.from_arrays(
        [pa.array(key[at]), *(pa.array(x[at].astype(np.int32)) for x in (place, first, last)),
         pa.array(what[at])], ["key", "place", "first", "last", "what"])
    rows = pa.array(some)
    yield pa.RecordBatch.from_arrays(
        [b.column(2).take(rows), b.column(3).take(rows), pa.ListArray.from_arrays(cut, found)],
        names=["h1", "h2", "found"])


def _segments(length: int):
    """The bytes from the first window start to the end of the last window of each anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = tb.text_array(b.column(2))
            found = b.column(3)
            count = np.diff(found.offsets.to_numpy())
            f = found.flatten()
            key, place, first, last = (f.field(i) for i in range(4))
            row = np.repeat(np.arange(b.num_rows), count)
            lo, hi = first.to_numpy(), last.to_numpy()
            data, offsets = tb.flat(texts)
            for i in range(0, len(row), 20_000):
                w = slice(i, i + 20_000)
                seg = [data[offsets[r] + x:offsets[r] + y + length].tobytes()
                       for r, x, y in zip(row[w], lo[w], hi[w])]
                rows = pa.array(row[w])
                yield pa.RecordBatch.from_arrays(
                    [key[i:i + 20_000], b.column(0).take(rows), b.column(1).take(rows),
                     place[i:i + 20_000], first[i:i + 20_000], last[i:i + 20_000],
                     pa.array(seg, pa.binary())],
                    names=["key", "h1", "h2", "place", "first", "last", "seg"])
    return run


def refine(group: np.ndarray, segments: list[bytes], left: np.ndarray, late: np.ndarray,
           length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(occurrence, bytes before the anchor) of every repeated window start.

    ``left`` is how many bytes of a segment lie before its anchor, ``late`` how many bytes before
    the anchor the last window start is.
    """
    n = len(group)
    flat = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.fromiter(map(len, segments), np.int64, n)
    begin = np.cumsum(sizes) - sizes
    right = np.minimum(sizes - left, length)
    windows = np.lib.stride_tricks.sliding_window_view(
        np.concatenate([flat, np.zeros(length, np.uint8)]), length)
    rows = np.empty((n, 8 + length), np.uint8)
    rows[:, :8] = group.astype(">u8").view(np.uint8).reshape(n, 8)
    for i in range(0, n, SLAB_ROWS):
        w = slice(i, i + SLAB_ROWS)
        rows[w, 8:] = windows[(begin + left)[w]]
        rows[w, 8:][np.arange(length) >= right[w, None]] = 0
    order = np.argsort(rows.view(f"S{8 + length}").ravel(), kind="stable")
    lcp = np.empty(max(n - 1, 0), np.int64)
    for i in range(0, n - 1, SLAB_ROWS):
        a, b = order[i:i + SLAB_ROWS + 1][:-1], order[i + 1:i + SLAB_ROWS + 1]
        differs = rows[a[:len(b)], 8:] != rows[b, 8:]
        lcp[i:i + SLAB_ROWS] = np.where(differs.any(1), differs.argmax(1), length)
    del rows
    lcp = np.minimum(lcp, np.minimum(right[order[:-1]], right[order[1:]]))
    lcp[group[order[1:]] != group[order[:-1]]] = _FAR
    lcp = np.concatenate([[_FAR], lcp])  # with the one before

    who, where = [], []
    step = 0
    while True:
        best = np.maximum(lcp, np.append(lcp[1:], _FAR))
        hit = (best >= length) & (late[order] <= step)
        who.append(order[hit])
        where.append(np.full(int(hit.sum()), step))
        # Leave: no byte before, or not enough of them to reach the length.
        stay = np.flatnonzero((left[order] > step) & (best + left[order] - step >= length))
        if len(stay) < 2:
            break
        order, lcp = _pick(order, lcp, stay)
        step += 1
        key = group[order] * 256 + flat[begin[order] + left[order] - step]
        to = np.argsort(key, kind="stable")
        key = key[to]
        order, lcp = _pick(order, lcp, to)
        same = np.concatenate([[False], key[1:] == key[:-1]])
        other = np.concatenate([[True], key[1:] // 256 != key[:-1] // 256])
        lcp = np.where(same, lcp + 1, np.where(other, _FAR, 0))
    return np.concatenate(who), np.concatenate(where)


def _pick(order: np.ndarray, lcp: np.ndarray, to: np.ndarray):
    """The members ``to`` in this order; the common prefix of two that rise is the least between."""
    out = np.full(len(to), _FAR)
    s, t = to[:-1], to[1:]
    near = t == s + 1
    out[1:][near] = lcp[t[near]]
    far = np.flatnonzero(t > s + 1)
    if len(far):
        wide = np.append(lcp, _FAR)
        cuts = np.stack([s[far] + 1, t[far] + 1], 1).ravel()
        out[1:][far] = np.minimum.reduceat(wide, cuts)[::2]
    return order[to], out


def _repeated(length: int):
    """Intervals of repeated window starts of each text."""
    def emit(t: pa.Table, group: np.ndarray) -> pa.RecordBatch | None:
        place, first, last = (t.column(c).to_numpy().astype(np.int64)
                              for c in ("place", "first", "last"))
        seg = [s.as_buffer().to_pybytes() for s in t.column("seg")]
        who, back = refine(group, seg, place - first, place - last, length)
        if not len(who):
            return None
        by = np.lexsort((-back, who))
        who, start = who[by], place[who[by]] - back[by]
        new = np.concatenate([[True], (who[1:] != who[:-1]) | (start[1:] != start[:-1] + 1)])
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(who)) - 1
        rows = pa.array(who[a])
        return pa.RecordBatch.from_arrays([
            t.column("h1").combine_chunks().take(rows), t.column("h2").combine_chunks().take(rows),
            pa.array(start[a].astype(np.int32)), pa.array(start[z].astype(np.int32))],
            names=["h1", "h2", "a", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in Groups().feed(batches):
            count = np.diff(np.append(first, t.num_rows))
            group = np.repeat(np.arange(len(first)), count)
            at = 0
            while at < len(first):
                to = max(at + 1, int(np.searchsorted(first, first[at] + TOGETHER)))
                end = int(first[to]) if to < len(first) else t.num_rows
                out = emit(t.slice(int(first[at]), end - int(first[at])),
                           group[first[at]:end] - group[first[at]])
                if out is not None:
                    yield out
                at = to
    return run


def repeated_starts(docs: DataFrame, text_col: str = "text", length: int = LENGTH,
                    gram: int = GRAM, hot: int = HOT_ANCHOR,
                    widths: tuple[int, ...] = WIDTHS, piece: int = PIECE,
                    texts: DataFrame | None = None) -> DataFrame:
    """(h1, h2, starts) per distinct text with repeats: intervals [a, z] of window starts whose
    ``length`` bytes also begin elsewhere in the distinct texts. ``texts`` are these with their
    keys, if there are such already."""
    spark = docs.sparkSession
    long = docs.select(F.col(text_col).cast("string").alias("text")).where(
        F.octet_length("text") >= length).select(text_key(F.col("text")).alias("k"), "text").select(
        "k.h1", "k.h2", "text")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if texts is None:
        texts = long.groupBy("h1", "h2").agg(F.first("text").alias("text"))
    schema = "key long, h1 long, h2 long, place int, first int, last int, seg binary"
    found, source, find = None, long, _found_anchors(length, gram, piece)

    def with_text(named: DataFrame, what: int) -> DataFrame:
        mine = named.select("h1", "h2", F.filter("found", lambda x: x.what == what).alias(
            "f")).where(F.size("f") > 0)
        return texts.join(mine, ["h1", "h2"])

    for width in (*widths, None):
        named, split = _settle(source, find, buckets, hot)
        settled = named.select("h1", "h2", F.explode(F.filter(
            "found", lambda x: x.what == SETTLED)).alias("s")).select(
            "h1", "h2", F.col("s.first").alias("a"), F.col("s.last").alias("z"))
        ordered = with_text(named, ORDERED).mapInArrow(_segments(length), schema).repartition(
            "key").sortWithinPartitions("key").mapInArrow(
            _repeated(length), "h1 long, h2 long, a int, z int")
        both = settled.unionByName(ordered)
        found = both if found is None else found.unionByName(both)
        if width is None or not split:
            break
        source, find = with_text(named, SPLIT), _split_anchors(length, width)
    return found.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("a", "z"))).alias(
        "starts"))


def _settle(source: DataFrame, find, buckets: int, hot: int, mark=_mark,
            written: bool = False) -> tuple[DataFrame, bool]:
    """(h1, h2, found) lines of the anchors that matter, and whether any has to be split.

    Surroundings are settled if found at two places, which ``mark`` tells apart.
    """
    lines = source.mapInArrow(_packed(find, buckets), ENTRY)
    if written:
        lines = cut_lineage(lines)
        rows = lines.mapInArrow(_rows_of_lines(mark), "key long, f long, m long")
    else:
        # Anchors are found anew for counting and for fetching: cheaper than a line for each.
        rows = source.mapInArrow(_flat_rows(find, mark), "key long, f long, m long")
    kinds = rows.groupBy(
        "key", "f").agg(F.min("m").alias("a"), F.max("m").alias("z")).where("a <= z")
    # Copies of a text give the same occurrence, which counts once.
    twice = kinds.where(F.col("a") != F.col("z")).select(
        "key", "f", "a", F.lit(0).cast("long").alias("n"))
    several = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "key", F.lit(0).cast("long").alias("f"), F.lit(0).cast("long").alias("a"), "n")
    # Written: read for its size and for the lines below. Both parts read one exchange: the condition
    # on a and z, which always holds, keeps these in both.
    keys = cut_lineage(several.unionByName(twice))
    none = F.array().cast("array<int>")
    counted = keys.select(
        F.pmod("key", F.lit(buckets)).alias("bucket"), F.lit(0).alias("kind"),
        F.col("a").alias("h1"), F.col("n").alias("h2"), F.array("key").alias("key"),
        F.array("f").alias("f"), *[none.alias(c) for c in _ENTRY[6:]])
    named = lines.unionByName(counted).repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(
        _sorted_out(hot, mark), "h1 long, h2 long, found array<struct<key: bigint, place: int, "
                          "first: int, last: int, what: tinyint>>")
    # Copies of a text sent equal lines.
    once = named.groupBy("h1", "h2").agg(F.flatten(F.collect_set("found")).alias("found"))
    return cut_lineage(once), not keys.where(F.col("n") > hot).isEmpty()


def _open_windows(words: int):
    """One row per window of the anchors of a text that are not settled; known are those whose
    surroundings another text has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, named = tb.text_array(b.column(2)), b.column(3)
            found = named.flatten()
            at, first, last, what = (found.field(i).to_numpy().astype(np.int64)
                                     for i in range(1, 5))
            row = np.repeat(np.arange(b.num_rows), np.diff(named.offsets.to_numpy()))
            settled = what == SETTLED
            known = np.isin(row << 32 | at, (row << 32 | at)[settled])
            for lo, hi in tb.slabs(texts):
                hashed, offsets = tb.word_hashes(*tb.flat(texts.slice(lo, hi - lo)))
                use = np.flatnonzero((row >= lo) & (row < hi) & ~settled)
                n = last[use] - first[use] + 1
                of = np.repeat(use, n)
                place = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                p = offsets[row[of] - lo] + place
                key = tb.span_hash(tb.prefix_hash(hashed), p, p + words).view(np.int64)
                rows = pa.array(row[of])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), b.column(0).take(rows), b.column(1).take(rows),
                     pa.array(place.astype(np.int32)), pa.array(known[of])],
                    names=["key", "h1", "h2", "place", "known"])
    return run


def _shared_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key those whose window another text has; known ones are settled."""
    for t, first in Groups().feed(batches):
        h1, h2, place, known = (t.column(i).to_numpy() for i in range(1, 5))
        text = _mark_of_text(h1, h2, np.zeros(len(h1), np.int64))
        both = (np.minimum.reduceat(text, first) != np.maximum.reduceat(text, first)) | \
            np.logical_or.reduceat(known, first)
        use = np.repeat(both, np.diff(np.append(first, len(h1)))) & ~known
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[use]) for x in (h1, h2, place, place)], names=["h1", "h2", "a", "z"])


def _covered(words: int):
    """How many words the windows of each line cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(2).flatten()
            a, z = (spans.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            row = np.repeat(np.arange(b.num_rows), np.diff(b.column(2).offsets.to_numpy()))
            base = row << 32
            end = np.maximum.accumulate(base + z + words)
            before = np.concatenate([[0], end[:-1]])
            new = np.maximum(0, base + z + words - np.maximum(base + a, before))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.bincount(
                    row, new, b.num_rows).astype(np.int64))], names=["h1", "h2", "n_shared"])
    return run


def shared_words(docs: DataFrame, text_col: str = "text", words: int = PASSAGE_WORDS,
                 gram: int = WORD_GRAM, piece: int = PIECE,
                 texts: DataFrame | None = None) -> DataFrame:
    """(h1, h2, n_shared) per distinct text that has a run of ``words`` words in common with
    another one: how many of its words lie in such runs.

    Anchors of words are counted by text like those of bytes by place. Surroundings that two texts
    have are settled; of the other anchors that two surroundings have, the windows are compared.
    ``texts`` are the distinct texts with their keys, if there are such already.
    """
    spark = docs.sparkSession
    long = docs.select(F.col(text_col).cast("string").alias("text")).where(
        F.octet_length("text") >= 2 * words - 1).select(
        text_key(F.col("text")).alias("k"), "text").select("k.h1", "k.h2", "text")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    named, _ = _settle(long, _found_anchors(words, gram, piece, True), buckets, _NEVER,
                       _mark_of_text, written=True)
    forget_shuffles(spark)
    if texts is None:
        texts = long.groupBy("h1", "h2").agg(F.first("text").alias("text"))
    more = texts.join(named.where(F.exists("found", lambda x: x.what == ORDERED)), [
        "h1", "h2"]).select("h1", "h2", "text", "found").mapInArrow(
        _open_windows(words), "key long, h1 long, h2 long, place int, known boolean").repartition(
        "key").sortWithinPartitions("key").mapInArrow(
        _shared_windows, "h1 long, h2 long, a int, z int")
    settled = named.select("h1", "h2", F.explode(F.filter(
        "found", lambda x: x.what == SETTLED)).alias("s")).select(
        "h1", "h2", F.col("s.first").alias("a"), F.col("s.last").alias("z"))
    return settled.unionByName(more).groupBy("h1", "h2").agg(F.sort_array(
        F.collect_list(F.struct("a", "z"))).alias("spans")).mapInArrow(
        _covered(words), "h1 long, h2 long, n_shared long")


def n_words(text: Column) -> Column:
    @F.arrow_udf("bigint")
    def count(t: pa.Array) -> pa.Array:
        t = tb.text_array(t)
        n = [np.bincount(tb.words(*tb.flat(t.slice(lo, hi - lo)), tb.PLAIN_WORD)[2],
                         minlength=hi - lo) for lo, hi in tb.slabs(t)]
        return pa.array(np.concatenate([np.zeros(0, np.int64), *n]))

    return count(text)


def removed_spans(starts, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the windows of the sorted start intervals."""
    out: list[list[int]] = []
    for a, z in starts:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z + length)
        else:
            out.append([a, z + length])
    return [(a, b) for a, b in out]


def _cut(data: bytes, starts: list[dict] | None, length: int) -> tuple[bytes, int, int]:
    """The bytes that stay, and how many bytes and runs went."""
    spans = removed_spans([(i["a"], i["z"]) for i in starts or []], length)
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept), sum(b - a for a, b in spans), len(spans)


def cut_bytes(text: Column, starts: Column, length: int = LENGTH) -> Column:
    """kept (binary), n_removed, n_spans."""
    kind = pa.struct([("kept", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])

    @F.arrow_udf("struct<kept: binary, n_removed: bigint, n_spans: bigint>")
    def cut(t: pa.Array, s: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("kept", "n_removed", "n_spans"), _cut(
            x.as_buffer().to_pybytes(), y.as_py(), length)))
            for x, y in zip(tb.text_array(t), s)], kind)

    return cut(text, starts)


def cut_text(text: Column, starts: Column, length: int = LENGTH) -> Column:
    """The text that stays; a character that a cut splits goes too."""
    @F.arrow_udf("string")
    def cut(t: pa.Array, s: pa.Array) -> pa.Array:
        return pa.array([_cut(x.as_buffer().to_pybytes(), y.as_py(), length)[0].decode(
            "utf-8", "ignore") for x, y in zip(tb.text_array(t), s)], pa.string())

    return cut(text, starts)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = LENGTH, passage_words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with ``passage_words`` also
    n_passage_words: how many words lie in runs of that many words or more, whatever their bytes,
    that another row has too. Nothing is removed for these."""
    least = length if passage_words is None else min(length, 2 * passage_words - 1)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    size = F.octet_length("text").cast("long")
    none = F.lit(0).cast("long")
    short = rows.where(size < least).select(
        "doc_id", size.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), none.alias("n_passage_words"))
    long = rows.where(size >= least).withColumn("k", text_key(F.col("text")))
    texts = long.select("k.h1", "k.h2", "text").groupBy("h1", "h2").agg(
        F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    # One exchange of the texts serves all three joins with them: the condition holds for all, but
    # keeps the count in each.
    same = texts.where("n > 0").select("h1", "h2", "text")
    once = F.col("n") == 1
    passages = none
    if passage_words is not None:
        shared = shared_words(docs, text_col, passage_words, texts=same)
    found = texts.join(repeated_starts(docs, text_col, length, texts=same), ["h1", "h2"], "left")
    if passage_words is not None:
        found = found.join(shared, ["h1", "h2"], "left")
        # Copies share all their words, if these are enough.
        words = n_words(F.when(~once, F.col("text")))
        passages = F.when(once, F.coalesce("n_shared", none)).when(
            words >= passage_words, words).otherwise(none)
    to_cut = once & F.col("starts").isNotNull()
    cut = found.select(
        F.struct("h1", "h2").alias("k"), "n", size.alias("n_bytes"),
        F.when(to_cut, cut_bytes(F.when(to_cut, F.col("text")), F.col("starts"), length)).alias("c"),
        F.sha2("text", 256).alias("whole"), passages.alias("n_passage_words"))
    one, gone = once | (F.col("n_bytes") < length), F.sha2(F.lit(""), 256)
    facts = cut_lineage(cut.select(
        "k", "n", "n_bytes",
        F.when(one, F.coalesce("c.n_removed", F.lit(0))).otherwise(F.col("n_bytes")).cast(
            "long").alias("n_removed"),
        F.when(one, F.coalesce("c.n_spans", F.lit(0))).otherwise(1).cast("long").alias("n_spans"),
        F.when(~one, gone).when(F.col("c").isNull(), F.col("whole")).otherwise(
            F.sha2("c.kept", 256)).alias("kept_sha256"), "n_passage_words"))
    keys = long.select("doc_id", "k")
    out = join_group_facts(keys, facts, "k", rows.count(), small=0)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if passage_words is not None:
        names.append("n_passage_words")
    return out.select(*names).unionByName(short.select(*names))


def without_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The same rows and columns with the repeated bytes cut out of the texts; a character that a
    cut splits goes too. Rows that share a text of ``length`` bytes or more become empty."""
    starts = repeated_starts(docs, text_col, length)
    text = F.col(text_col).cast("string")
    long = F.coalesce(F.octet_length(text) >= length, F.lit(False))
    # Rows travel as one column, beside which no name can clash. Short texts, of which very many
    # may be equal, take no part in the join.
    keyed = docs.where(long).select(F.struct(*docs.columns).alias("row"), text_key(text).alias(
        "k"), text.alias("text"))
    copies = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"), F.lit(True).alias("copied"))
    facts = starts.join(copies, ["h1", "h2"], "full").select(
        F.struct("h1", "h2").alias("k"), "starts", "copied")
    kept = F.when(F.col("copied"), F.lit("")).when(F.col("starts").isNull(), F.col("text")).otherwise(
        cut_text(F.col("text"), F.col("starts"), length))
    cut = keyed.join(facts, "k", "left").select(F.col("row").withField(text_col, kept).alias(
        "row")).select("row.*")
    return cut.unionByName(docs.where(~long))
